"""Overlap of rows with held-out material: by keyword, by topic id, and by contained text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import store
from .sampling import numbered

Keyword = tuple[str, int, str, int, str]


def pattern(keyword: str) -> str:
    """A keyword between boundaries of identifiers."""
    return rf"(?<![a-z0-9_]){re.escape(keyword)}(?![a-z0-9_])"


def keyword_table(keywords: list[Keyword]) -> Column:
    """The keywords that can match, in order, as one literal array.

    Phrases (with a space) match as they are; single words match between
    boundaries, and never if shorter than four characters.
    """
    usable = [(lang, topic, word, " " in word) for lang, _, topic, _, word in sorted(keywords, key=lambda k: (k[1], k[3])) if " " in word or len(word) >= 4]
    if not usable:
        return F.array().cast("array<struct<language:string,topic:string,keyword:string,pattern:string>>")
    return F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(topic).alias("topic"), F.lit(word).alias("keyword"), F.lit(None if phrase else pattern(word)).cast("string").alias("pattern")) for lang, topic, word, phrase in usable])


def leak(keywords: list[Keyword], instruction: Column, code: Column, language: Column | None = None, topic_id: Column | None = None) -> Column:
    """The first match as ``struct<topic, keyword>``, or null.

    A held-out topic id comes first; then topics of the row's language (all if
    none is given) with their keywords, in order.  A keyword's pattern is tried
    only where the text contains the keyword at all.
    """
    empty = F.lit("")
    hay = F.lower(F.concat(F.coalesce(instruction, empty), F.lit("\n"), F.coalesce(code, empty)))

    def fits(k: Column) -> Column:
        there = F.contains(hay, k["keyword"]) & (k["pattern"].isNull() | F.regexp_like(hay, k["pattern"]))
        return there if language is None else (k["language"] == language) & there

    first = F.try_element_at(F.filter(keyword_table(keywords), fits), F.lit(1))
    by_word = F.when(first.isNotNull(), F.struct(first["topic"].alias("topic"), first["keyword"].alias("keyword")))
    if topic_id is None:
        return by_word
    held = sorted({k[2] for k in keywords})
    return F.when(topic_id.isin(*held) & (topic_id != ""), F.struct(topic_id.alias("topic"), topic_id.alias("keyword"))).otherwise(by_word)


def leak_message(example_id: Column, found: Column) -> Column:
    return F.when(found.isNotNull(), F.format_string("HeldOutLeakDetected: example '%s' matches held-out topic '%s' via keyword '%s'", example_id, found["topic"], found["keyword"]))


#: Rows of the contained side, or keys of the rows, that are sent to every task at most.
BROADCAST_ROWS = 100_000
#: Characters by whose head a text without an inner word is found.
GRAM = 3


def within(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """An inner join that sends the right side to the rows if it is small."""
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, on)


def containing(rows: DataFrame, key: str, text_col: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``key, item_key`` of every row whose text contains the text of an item.

    A row that contains an item contains each of its inner words as a whole word,
    so rows and items meet on the item's longest inner word.  Items without an
    inner word (under three words) meet on their first characters.  Keys and words
    travel alone; the texts of rows that met an item are brought in afterwards, and
    containment is verified.

    Defined cases: null texts and null keys contain nothing and are in nothing; an
    empty item is in every text; repeated rows and items give their pair once;
    empty tables give an empty result.
    """
    split = r"[ \t\n\x0B\f\r]+"
    goods = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("it")).where("it IS NOT NULL AND item IS NOT NULL")
    inner = F.filter(F.split("it", split), lambda w: w != "")
    goods = goods.withColumn("ws", inner).withColumn("inner", F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 2, F.lit(0))))
    longest = F.element_at(F.array_sort(F.transform("inner", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    head = F.substr("it", F.lit(1), F.lit(GRAM))
    goods = store(goods.select("item", "it", F.when(F.size("inner") > 0, longest).otherwise(head).alias("mark"), (F.size("inner") > 0).alias("worded")), "contained")
    worded, short = goods.where("worded").select("item", "mark"), goods.where("NOT worded").select("item", "mark")
    texts = rows.select(F.col(key).alias("key"), F.col(text_col).alias("t")).where("t IS NOT NULL AND key IS NOT NULL")
    met = within(texts.select("key", F.explode(F.array_distinct(F.split("t", split))).alias("mark")), worded, "mark").select("key", "item")
    lengths = sorted(r["n"] for r in short.select(F.length("mark").alias("n")).distinct().collect())  # at most GRAM + 1 values
    if lengths:
        grams = [F.array(F.lit(""))] if lengths[0] == 0 else []
        for n in (n for n in lengths if n):
            grams.append(F.when(F.length("t") >= n, F.expr(f"transform(sequence(1, length(t) - {n - 1}), i -> substr(t, i, {n}))")).otherwise(F.array().cast("array<string>")))
        met = met.unionByName(within(texts.select("key", F.explode(F.array_distinct(F.concat(*grams))).alias("mark")), short, "mark").select("key", "item"))
    met = store(met.distinct(), "met")
    keys = met.select("key").distinct()
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    reached = texts.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    pairs = within(reached.join(met, "key"), goods.select("item", "it"), "item").where(F.contains("t", "it"))
    return pairs.select("key", F.col("item").alias("item_key")).distinct()


#: What keyword boundaries are made of, and the characters kept before and after the space of a seam.
WORD, BEFORE, AFTER = "a-z0-9_", 1, 2
#: Stands where a long piece was cut. Texts are in small letters, so it is in none, and it counts as part of a word.
CUT = "X"
#: Characters from which a piece without a space is cut.
LONG = 256


def keyword_dictionary(keywords: DataFrame, by_language: bool = True) -> DataFrame:
    """``language, topic, keyword, no, part, mark, sort, whole, pattern`` of the keywords that can match (columns as in ``schemas.KEYWORDS``), each once.

    ``no`` is the place in the order of topics and keywords.  ``part`` is the keyword up
    to a second space, ``whole`` that this is all of it.  ``sort`` says how a part is met:
    by the ``seam`` around its space, by its longest ``word``, or by its first characters
    (``head``) where it has neither.  ``mark`` is what a text must have then.
    """
    k = keywords.select("language" if by_language else F.lit("").alias("language"), "topic_ord", "kw_ord", F.col("topic_id").alias("topic"), "keyword")
    # texts are in small letters, so a capital is in none
    k = k.where(f"keyword IS NOT NULL AND (contains(keyword, ' ') OR length(keyword) >= 4) AND NOT regexp_like(keyword, '[A-Z]')")
    k = k.groupBy("language", "keyword").agg(F.min(F.struct("topic_ord", "kw_ord", "topic")).alias("first")).select("language", "keyword", "first.*")
    k = numbered(k, ["topic_ord", "kw_ord", "topic", "keyword"], "no").withColumn("part", F.substring_index("keyword", " ", 2))
    at = F.instr("part", F.lit(" "))
    left = F.least(at - 1, F.lit(BEFORE))
    runs = F.array_sort(F.transform(F.regexp_extract_all("part", F.lit(f"([{WORD}]+)"), F.lit(1)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    longest = F.try_element_at(runs, F.lit(1))["w"]
    sort = F.when(at > 0, "seam").when(longest.isNotNull(), "word").otherwise("head")
    mark = F.when(at > 0, F.substr("part", at - left, left + 1 + AFTER)).otherwise(F.coalesce(longest, F.substr("part", F.lit(1), F.lit(GRAM))))
    # a word as it is, between boundaries of identifiers
    pattern = F.concat(F.lit(rf"(?<![{WORD}{CUT}])\Q"), F.replace("part", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?![{WORD}{CUT}])"))
    return k.select("language", "topic", "keyword", "no", "part", mark.alias("mark"), sort.alias("sort"), (F.col("part") == F.col("keyword")).alias("whole"), pattern.alias("pattern"))


def seams(hay: Column) -> Column:
    """Every two neighbouring pieces of a text, with the space between them, once."""
    # look-ahead takes the second piece, which is the first one of the next match
    return F.array_distinct(F.regexp_extract_all(hay, F.lit("(?<![^ ])(?=([^ ]*+ [^ ]*+))[^ ]*+ "), F.lit(1)))


def pieces(hay: Column, longest: int) -> Column:
    """What a text has between its spaces, once; a long piece in windows.

    Windows overlap, so that any run of up to ``longest`` characters lies in one with
    its neighbours at both sides.
    """
    windows = F.regexp_replace(hay, F.lit(rf"([^ ]{{{max(LONG, longest)}}})(?=([^ ]{{{longest + 1}}})[^ ])"), F.lit(f"$1$2{CUT} {CUT}"))
    return F.array_distinct(F.split(windows, " "))


def keyword_leaks(rows: DataFrame, key: str, hay: Column, language: str | None, keywords: DataFrame) -> DataFrame:
    """``key, topic, keyword``: the first keyword in order of each row whose text has one, for any number of keywords.

    The keywords are a table (``schemas.KEYWORDS``), matched as ``leak`` matches them.
    A text is cut at its spaces.  A word lies within one piece, a phrase of one space
    across two neighbours, so a row gives its different pieces and neighbours, each
    meets by key the keywords that have a mark in common, and the piece alone decides.
    Only phrases of more spaces are tried on the whole text, after their first two
    pieces were found and no earlier keyword was.

    Defined cases: null keys and texts have no leak; keywords that are null, empty or
    single words under four characters never match; of repeated rows with one key the
    first match of any counts; a null language has no keywords; empty tables give an
    empty result.
    """
    known = store(keyword_dictionary(keywords, language is not None), "keywords")
    shapes = known.groupBy("sort", F.instr("mark", F.lit(" ")).alias("at"), F.length("mark").alias("n")).agg(F.max(F.length("part")).alias("longest"), F.every("whole").alias("whole")).collect()  # a dozen at most
    around = sorted({(r["at"] - 1, r["n"] - r["at"]) for r in shapes if r["sort"] == "seam"})
    heads = sorted({r["n"] for r in shapes if r["sort"] == "head"})
    longest = max((r["longest"] for r in shapes if r["sort"] != "seam"), default=0)
    own = F.col(language).cast("string") if language else F.lit("")
    texts = rows.select(F.col(key).alias("key"), own.alias("own"), F.lower(hay).alias("hay")).where("key IS NOT NULL AND hay IS NOT NULL AND own IS NOT NULL")
    # marks meet by hash; the piece decides, so two marks of one hash do no harm
    side = known.select("language", F.xxhash64("language", "mark").alias("hash"), "no", "part", "keyword", "sort", "whole", "pattern")
    few = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(side) if few else side
    # as a case, or the language becomes part of the key, which is slower than a number alone
    same = F.col("own") == F.col("language")
    # no higher-order functions here: with one of these a step is interpreted row by row
    at, bit = F.instr("bit", F.lit(" ")), F.col("bit")
    found = []
    if longest:
        # a keyword that is met by its head has no character of words, so neither has the head
        runs = F.concat(F.regexp_extract_all("bit", F.lit(f"([{WORD}{CUT}]+)"), F.lit(1)), *[F.regexp_extract_all("bit", F.lit(f"(?=([^{WORD}]{{{n}}}))"), F.lit(1)) for n in heads])
        words = texts.select("key", "own", F.explode(pieces(F.col("hay"), longest)).alias("bit"))
        words = words.select("key", "own", "bit", F.explode(F.array_distinct(runs)).alias("mark")).withColumn("hash", F.xxhash64("own", "mark"))
        # a pattern is made for each row, so it is left to pieces that have the keyword more than once
        first = F.instr("bit", F.col("part"))
        beside = F.concat(F.substr(F.concat(F.lit(" "), "bit"), first, F.lit(1)), F.substr("bit", first + F.length("part"), F.lit(1)))
        bounded = ~F.regexp_like(beside, F.lit(f"[{WORD}{CUT}]"))
        found.append(words.join(side.where("sort <> 'seam'"), "hash").where(F.when(same, (bit == F.col("part")) | F.contains(bit, F.col("part")) & (bounded | (F.position("part", "bit", first + 1) > 0) & F.regexp_like(bit, "pattern")))))
    if around:
        near = [F.when((at > left) & (F.length("bit") - at >= right), F.xxhash64("own", F.substr("bit", at - left, F.lit(left + 1 + right)))) for left, right in around]
        pairs = texts.select("key", "own", F.explode(seams(F.col("hay"))).alias("bit")).select("key", "own", "bit", F.explode(F.array(*near)).alias("hash"))
        found.append(pairs.join(side.where("sort = 'seam'"), "hash").where(F.when(same & F.col("whole"), F.contains(bit, F.col("part"))).when(same, F.endswith(bit, F.col("part")))))
    if not found:
        return known.select(F.lit(None).cast(texts.schema["key"].dataType).alias("key"), "topic", "keyword").limit(0)
    met = reduce(DataFrame.unionByName, [f.select("key", "no", "keyword", "whole") for f in found])
    if all(r["whole"] for r in shapes):
        best = store(met.groupBy("key").agg(F.min("no").alias("no")), "met-keywords")
    else:
        met = store(met.distinct(), "met-keywords")
        sure = met.where("whole").groupBy("key").agg(F.min("no").alias("first"))
        open_ = met.where("NOT whole").join(sure, "key", "left").where("first IS NULL OR no < first").select("key", "no", "keyword")
        keys = open_.select("key").distinct()
        few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        reached = texts.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("key", "hay")
        tried = reached.join(open_, "key").where(F.contains("hay", F.col("keyword"))).select("key", "no")
        best = sure.withColumnRenamed("first", "no").unionByName(tried).groupBy("key").agg(F.min("no").alias("no"))
    return within(best, known.select("no", "topic", "keyword"), "no").select("key", "topic", "keyword")
