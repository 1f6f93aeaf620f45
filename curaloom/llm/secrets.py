"""Secret scans weighted by corpus-wide ownership.

Patterns find candidates with their places in the text.  Every candidate's value
is hashed, and the hashes are counted over the whole corpus by distinct
repositories and owners.  A value that several owners have is a copied example,
and so is one that its only owner has in many repositories, as template files
are; a value of one owner in few repositories looks live.  Base patterns always
give spans; the wider patterns, which would be noisy by themselves, give spans
only for values that look live.

Everything is an expression of Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import once, store, text_or_empty

#: Base patterns in their order, the group that holds the value, and the least length of that group.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Wider patterns: keys with a provider's prefix, signed web tokens, private key headers, and opaque runs that mix digits and both cases.
WIDE = (
    ("prefixed", r"(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,})", 0, 14),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    ("opaque", r"[A-Za-z0-9]{24,}", 0, 24),
)
MIXED = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
#: Matches of one text whose places are summed in one go.
BLOCK = 256


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, found: str, pattern: str, group: int) -> str:
    """SQL for the array of ``(start, end, value)`` in code points of a pattern's matches.

    ``found`` names the array of whole matches.  The text between matches comes
    from splitting by the same pattern.  Places are running sums of lengths: within
    blocks of matches, from the sums of the blocks before.
    """
    p, empty = literal(pattern), "CAST(array() AS array<struct<start:bigint,end:bigint,value:string>>)"
    steps = f"slice(arrays_zip(transform(split({text}, {p}, -1), gp -> length(gp)), transform({found}, mt -> length(mt)), regexp_extract_all({text}, {p}, {group})), 1, size({found}))"
    numbers = f"sequence(0, CAST((size({found}) - 1) DIV {BLOCK} AS INT))"
    parts = f"transform({numbers}, bn -> slice(al, bn * {BLOCK} + 1, {BLOCK}))"
    sums = "transform(bs, ba -> aggregate(ba, 0L, (su, sq) -> su + sq.`0` + sq.`1`))"
    before = "aggregate(ss, named_struct('at', 0L, 'o', CAST(array() AS array<bigint>)), (st, sv) -> named_struct('at', st.at + sv, 'o', concat(st.o, array(st.at))), st -> st.o)"
    place = "concat(st.o, array(named_struct('start', st.at + sp.`0`, 'end', st.at + sp.`0` + sp.`1`, 'value', sp.`2`)))"
    run = f"aggregate(ba, named_struct('at', bo, 'o', {empty}), (st, sp) -> named_struct('at', st.at + sp.`0` + sp.`1`, 'o', {place}), st -> st.o)"
    # one-element arrays name what is used more than once
    summed = f"flatten(transform(array({sums}), ss -> flatten(zip_with(bs, {before}, (ba, bo) -> {run}))))"
    return f"CASE WHEN size({found}) = 0 THEN {empty} ELSE flatten(transform(array({steps}), al -> flatten(transform(array({parts}), bs -> {summed})))) END"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """``row_no, id, owner, repo, found`` per input row, with the candidates of all patterns as an array."""
    rows = once(docs, F.col(id_col).alias("id"), owner=owner.cast("string"), repo=repo.cast("string"), x=text_or_empty(text_col))
    matches = {f"m{nth}": F.regexp_extract_all("x", F.lit(pattern), F.lit(0)) for nth, (_, pattern, _, _) in enumerate(BASE + WIDE)}
    rows = once(rows, F.col("id"), F.col("owner"), F.col("repo"), F.col("x"), **matches)
    found = []
    for nth, (kind, pattern, group, least) in enumerate(BASE + WIDE):
        fits = f"length(ct.value) >= {least}" + f" AND ct.value RLIKE {literal(MIXED)}" * (kind == "opaque")
        item = f"named_struct('start', cs.start, 'nth', {nth}, 'kind', '{kind}', 'end', cs.end, 'wide', {str(nth >= len(BASE)).lower()}, 'hash', unhex(sha2(cs.value, 256)))"
        found.append(f"transform(filter({spans('x', f'm{nth}', pattern, group)}, ct -> {fits}), cs -> {item})")
    return store(rows.select(F.monotonically_increasing_id().alias("row_no"), "id", "owner", "repo", F.expr(f"concat({', '.join(found)})").alias("found")), "secrets")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, most_owners: int = 1, most_repos: int = 3) -> DataFrame:
    """Secrets of every row with the ownership of their values.

    Returns ``id``, ``found`` (array of start, nth, kind, end, wide, owners,
    repos, live; in order) per input row.  A value is live if at most
    ``most_owners`` owners have it, in at most ``most_repos`` repositories.  Of the
    wider patterns only live values are kept that don't overlap a base span.

    Defined cases: a null text is empty; a null owner or repository is one of its
    own; a null id and repeated rows keep their rows, and copies of a row count as
    one owner's; an empty table gives an empty result; other columns aren't read.
    """
    base = candidates(docs, id_col, text_col, F.lit(None) if owner is None else owner, F.lit(None) if repo is None else repo)
    each = base.select("row_no", "id", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), F.explode("found").alias("c")).select("row_no", "id", "owner", "repo", "c", F.col("c.hash").alias("hash"))
    places = each.select("hash", "owner", "repo").distinct()
    counts = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repos"))
    counts = counts.withColumn("digest", F.xxhash64("hash"))
    known = each.withColumn("digest", F.xxhash64("hash")).join(counts, ["digest", "hash"])
    # a wider span clashes if a base span that starts before its end reaches beyond its start: one pass in the order of places
    place = F.when(F.col("c.wide"), F.col("c.end")).otherwise(F.col("c.start"))
    before = Window.partitionBy("row_no").orderBy("place", F.col("c.wide").desc(), "c.nth").rowsBetween(Window.unboundedPreceding, -1)
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    swept = known.withColumns({"place": place, "live": live}).withColumn("reach", F.max(F.when(~F.col("c.wide"), F.col("c.end"))).over(before))
    kept = ~F.col("c.wide") | (F.col("live") & ~F.coalesce(F.col("reach") > F.col("c.start"), F.lit(False)))
    item = F.struct("c.start", "c.nth", "c.kind", "c.end", "c.wide", "owners", "repos", "live")
    listed = swept.groupBy("row_no", "id").agg(F.sort_array(F.collect_list(F.when(kept, item))).alias("found")).select("id", "found")
    none = base.where(F.size("found") == 0).select("id", F.array().cast(listed.schema["found"].dataType).alias("found"))
    return listed.unionByName(none)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the scan that other programs compare: counts, hash of base spans, all spans.

    ``n_live`` counts the values that look live; ``most_owners`` and ``most_repos``
    are those of the row's most widely held value, 0 without any.
    """

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: ~s["wide"])
    n = {f"n_{kind}": F.expr(f"CAST(size(filter(found, fd -> fd.kind = '{kind}')) AS BIGINT)") for kind, _, _, _ in BASE}
    return found.select("id", *[c.alias(k) for k, c in n.items()], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: s["live"])).cast("bigint").alias("n_live"), *[F.expr(f"CAST(coalesce(array_max(transform(found, fd -> fd.{c})), 0) AS BIGINT)").alias(f"most_{c}") for c in ("owners", "repos")])
