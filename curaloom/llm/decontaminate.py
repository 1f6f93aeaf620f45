"""Benchmark decontamination by canonical templates.

Numbers, units and names become typed placeholders, so a question with other
values keeps its template.  A text is read in three ways:

* ``words``: its lower-cased words, for verbatim passages; in scripts that are
  written without spaces each character is one;
* ``values``: numbers and units as placeholders, names as words, for texts in
  another letter case;
* ``names``: numbers, units and names as placeholders, where a run of capitalised
  words is one name and a run of number words one number, so values may have
  other lengths.

Windows of at most eight entries, at every position of items and documents, are
hashed and joined.  Windows of an item that meet a document at one distance are an
alignment.  In it a placeholder must stand for one value: where an item's value
``x`` meets ``y`` at one place and ``z`` at another, only windows with the item's
own values count.

Everything is an expression of Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import once, rest_of, store, text_or_empty

#: Words for numbers, and units that count as such after a number.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms kilograms ton tons ounce ounces pound pounds ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent cent cents dollar dollars euro euros usd eur mph kmh degree degrees celsius fahrenheit watt watts kw kwh volt volts amp amps hz khz mhz ghz byte bytes kb mb gb tb".split()
#: Characters of scripts without spaces between words (Thai, Lao, Burmese, Khmer, Japanese, Chinese), and all others.
UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
SPACED = r"\x{0}-\x{DFF}\x{F00}-\x{FFF}\x{10A0}-\x{177F}\x{1800}-\x{303F}\x{3100}-\x{31EF}\x{3200}-\x{33FF}\x{4DC0}-\x{4DFF}\x{A000}-\x{F8FF}\x{FB00}-\x{1FFFF}\x{40000}-\x{10FFFF}"
ENTRY = rf"[\p{{L}}\p{{M}}&&[{SPACED}]]+|[0-9]+(?:[.,:/][0-9]+)*+|[\p{{L}}\p{{M}}&&[{UNSPACED}]]\p{{M}}*+"
#: Windows of the benchmark that go into a broadcast at most; more are joined by shuffling.
BROADCAST_WINDOWS = 200_000
#: Entries of the benchmark that documents' entries are held against at most; with more, every window is hashed.
BROADCAST_WORDS = 20_000
#: The readings, by number.
WORDS, VALUES, NAMES = 0, 1, 2


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


def templated(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, way, h, v``: a row per text and reading, with the hashes of its entries and of the placeholders' values (null at other entries)."""
    keep = F.col("id")
    words = once(rows, F.col(id_col).alias("id"), ws=F.regexp_extract_all(text_or_empty(text_col), F.lit(ENTRY), F.lit(0)))
    words = once(words, keep, F.col("ws"), l=F.expr("transform(ws, w -> lower(w))"))
    words = once(words, keep, F.col("ws"), F.col("l"), d=F.expr(f"zip_with(ws, l, (w, x) -> w < ':' OR x IN ({quoted(NUMBER_WORDS)}))"))
    kind = f"""transform(ws, (w, i) -> CASE
        WHEN d[i] THEN 1
        WHEN i > 0 AND d[i - 1] AND l[i] IN ({quoted(UNITS)}) THEN 2
        WHEN w <> l[i] AND length(w) > 1 AND substr(w, 2) = lower(substr(w, 2)) THEN 3
        ELSE 0 END)"""
    words = once(words, keep, F.col("ws"), F.col("l"), k=F.expr(kind), g=F.expr("transform(l, w -> xxhash64(w))"))
    # places at which an entry of the third reading starts
    starts = "filter(transform(ws, (w, i) -> CASE WHEN i > 0 AND k[i] = k[i - 1] AND (k[i] = 3 OR (k[i] = 1 AND w > ':')) THEN NULL ELSE i END), i -> i IS NOT NULL)"
    words = once(words, keep, F.col("l"), F.col("k"), F.col("g"), s=F.expr(starts))
    none = "CAST(array() AS array<bigint>)"
    ways = f"""array(
        named_struct('way', {WORDS}, 'h', g, 'v', {none}),
        named_struct('way', {VALUES}, 'h', zip_with(g, k, (x, y) -> CASE WHEN y IN (1, 2) THEN CAST(y AS BIGINT) ELSE x END), 'v', zip_with(g, k, (x, y) -> CASE WHEN y IN (1, 2) THEN x END)),
        named_struct('way', {NAMES}, 'h', transform(s, p -> CASE WHEN k[p] = 0 THEN g[p] ELSE CAST(k[p] AS BIGINT) END),
                     'v', transform(s, (p, j) -> CASE WHEN k[p] > 0 THEN xxhash64(slice(l, p + 1, coalesce(get(s, j + 1), size(l)) - p)) END)))"""
    return words.select("id", F.inline(F.expr(ways)))


def windows_of(rows: DataFrame, widths: list[int], known: list[int] | None) -> DataFrame:
    """``id, way, pos, key, seen`` of every window of some widths; where the entries of all items are known, of windows without others."""
    base = [F.col(c) for c in ("id", "way", "h", "v")]
    if known is not None:
        rows = once(rows, *base, f=F.expr(f"transform(h, x -> x IN ({', '.join(map(str, known)) or 'NULL'}))"))
    fits = {}
    for width in widths:
        every = f"sequence(1, size(h) - {width} + 1)"
        if known is not None:
            every = f"filter({every}, i -> {' AND '.join(f'f[i + {n - 1}]' for n in range(width))})"
        fits[f"t{width}"] = F.expr(f"CASE WHEN size(h) >= {width} THEN {every} ELSE array() END")
    rows = once(rows, *base, **fits)
    made = [f"transform(t{w}, i -> named_struct('pos', i, 'key', xxhash64(slice(h, i, {w}), {w}, way), 'seen', CASE WHEN way > {WORDS} THEN slice(v, i, {w}) ELSE v END))" for w in widths]
    return rows.select("id", "way", F.inline(F.expr(f"concat({', '.join(made)})" if made else "CAST(array() AS array<struct<pos:int,key:bigint,seen:array<bigint>>>)")))


def consistent() -> Column:
    """The windows of an alignment that count: all if each value of the item meets one value, else those with the item's own values."""
    # numbers are told apart by hashing, structures only by comparing all
    pairs = "flatten(transform(met, m -> m.pairs))"
    agrees = f"size(array_distinct(transform({pairs}, p -> xxhash64(p.own, p.seen)))) = size(array_distinct(transform({pairs}, p -> p.own)))"
    return F.expr(f"CASE WHEN {agrees} THEN met ELSE filter(met, m -> forall(m.pairs, p -> p.own = p.seen)) END")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, passage: int = 16, plain: int = 4, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of documents and benchmark items that they repeat, verbatim or with other values.

    Returns ``id``, ``item_id``, ``verbatim`` (words of the item that stand in the
    document in windows of ``width`` words, or as the whole of a shorter item),
    ``template`` (entries of the item's template that the document repeats, by the
    reading that has more) and ``share`` (the larger of both as a share of the
    item).  A pair is reported if

    * any window stands there verbatim, in any letter case; or
    * consistent alignments cover ``passage`` entries of the template, or ``share``
      of it, with at least ``plain`` different entries that are no placeholders.
      With fewer of those the passage must be longer in proportion (with one of
      four, four times as long); or
    * they cover a whole template of at least ``plain`` entries, one of them no
      placeholder.

    A window of placeholders alone matches verbatim only: by its template it can't
    be told from any row of numbers or names.

    Defined cases: null and empty texts and texts without words match nothing;
    items with fewer entries than ``width`` are one window of their own length, so
    an item of one word is found wherever that word stands; rows with a null id or
    item are left out, since a pair needs both; repeated ids are one document;
    equal items are all reported; empty tables give an empty result; only the
    named columns are read.
    """
    items = templated(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text_col).withColumnRenamed("id", "item").where("size(h) > 0")
    items = items.withColumn("n", F.size("h")).withColumn("width", F.least("n", F.lit(width)))
    spots = items.select("item", "way", "n", "width", "h", "v", F.explode(F.expr("sequence(1, n - width + 1)")).alias("at"))
    own = F.expr(f"CASE WHEN way > {WORDS} THEN slice(v, at, width) ELSE v END")
    spots = spots.select("item", "way", "n", "width", "at", F.expr("slice(h, at, width)").alias("hs"), own.alias("own"))
    words = F.expr("filter(zip_with(hs, own, (x, y) -> CASE WHEN y IS NULL THEN x END), x -> x IS NOT NULL)")
    spots = spots.withColumn("words", F.when(F.col("way") > WORDS, words).otherwise(F.array().cast("array<bigint>"))).where((F.col("way") == WORDS) | (F.size("words") > 0))
    spots = store(spots.select("item", "way", "n", "width", "at", "hs", "own", "words"), "spots")
    widths = sorted(r["width"] for r in spots.select("width").distinct().collect())  # at most ``width`` values
    found = spots.select(F.explode("hs").alias("h")).distinct().limit(BROADCAST_WORDS + 1).collect()
    known = sorted(r["h"] for r in found) if len(found) <= BROADCAST_WORDS else None
    spots = spots.select("item", "n", F.struct("at", "width", "words").alias("spot"), "own", F.xxhash64("hs", "width", "way").alias("key"))

    rows = templated(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    made = windows_of(rows, widths, known)
    few = spots.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    hits = made.join(F.broadcast(spots) if few else spots, "key")
    pairs = F.expr("filter(arrays_zip(own, seen), p -> p.own IS NOT NULL)")
    hits = hits.select("id", "item", "way", "n", "spot", (F.col("pos") - F.col("spot.at")).alias("shift"), pairs.alias("pairs"))

    # an alignment has at most the item's windows and placeholders, so these sets are bounded by the item
    lines = hits.groupBy("id", "item", "way", "n", "shift").agg(F.collect_set(F.struct("spot", "pairs")).alias("met"))
    sound = lines.withColumn("met", consistent()).select("id", "item", "way", "n", F.explode("met.spot").alias("spot"))
    read = sound.groupBy("id", "item", "way", "n").agg(F.collect_set("spot").alias("spots"))
    covered = F.expr("size(array_distinct(flatten(transform(spots, s -> sequence(s.at, s.at + s.width - 1)))))")
    read = read.select("id", "item", "way", "n", covered.alias("c"), F.expr("size(array_distinct(flatten(transform(spots, s -> s.words))))").alias("p"))
    long_enough = (F.col("c") * F.least("p", F.lit(plain)) >= passage * plain) | ((F.col("p") >= plain) & (F.col("c") >= share * F.col("n"))) | ((F.col("c") == F.col("n")) & (F.col("n") >= plain))
    counts = (F.col("way") == WORDS) | long_enough
    verbatim, template = F.when(F.col("way") == WORDS, F.col("c")), F.when(F.col("way") > WORDS, F.col("c"))
    whole = read.groupBy("id", "item").agg(
        F.max(counts).alias("counts"), F.coalesce(F.max(verbatim), F.lit(0)).cast("bigint").alias("verbatim"), F.coalesce(F.max(template), F.lit(0)).cast("bigint").alias("template"), F.max(F.col("c") / F.col("n")).alias("share"),
    )
    return whole.where("counts").select("id", F.col("item").alias("item_id"), "verbatim", "template", "share")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that repeat no benchmark item, in whole or in passages, with all their columns.

    Defined cases: rows without an id stay, and so do null and empty texts; of
    rows that share an id all go if one of their texts repeats an item; empty
    tables give an empty result or change nothing; columns may have any name.
    """
    gone = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **how).select("id").distinct()
    return rest_of(docs, id_col, gone)
