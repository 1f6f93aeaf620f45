"""Exact deduplication by content-defined chunk recipes.

A document is its recipe: the ordered list of identifiers of its chunks.  Chunks
end where the content says so (after a punctuation mark, within bounds of
length), so equal texts have equal chunks wherever they lie.  Identifiers are 64
bits wide and verified: a chunk dictionary of (identifier, SHA-256) pairs shows
the identifiers that two different chunks share, and those get the rank of their
digest added.  Documents are then compared by their lists alone, so no text is
ever shuffled: a chunk of about a thousand characters travels as 40 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, joined_by, once, rest_of, store, text_or_empty

#: Fixed values of the normal form: the white space that is deleted.
SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def chunks(text: Column, at_least: int = 512, at_most: int = 4096) -> Column:
    """Array of the content-defined chunks of a text; joined they are the text."""
    cut = rf"(?s).{{{at_least},{at_most}}}?[.!?;:|,]|.{{1,{at_most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64, at_least: int = 512, at_most: int = 4096) -> DataFrame:
    """One row per input row: row_no, id, code_points, text_sha256, recipe.

    ``recipe`` is an array of verified chunk identifiers (strings of bytes are
    never compared again).  ``id_bits`` narrows the identifiers for tests.
    """
    spark = docs.sparkSession
    short = F.shiftrightunsigned(F.xxhash64("c"), 64 - id_bits)
    rows = once(docs, F.col(id_col).alias("id"), x=text_or_empty(text_col))
    rows = once(rows, F.col("id"), F.length("x").alias("code_points"), n=normalised(F.col("x")))
    rows = rows.select("id", "code_points", F.sha2("n", 256).alias("text_sha256"), chunks(F.col("n"), at_least, at_most).alias("cs"))
    pair = F.transform("cs", lambda c: F.struct(F.shiftrightunsigned(F.xxhash64(c), 64 - id_bits).alias("h"), F.unhex(F.sha2(c, 256)).alias("s")))
    base = store(rows.select(F.monotonically_increasing_id().alias("row_no"), "id", "code_points", "text_sha256", pair.alias("pairs")), "recipes")

    dictionary = base.select(F.explode("pairs").alias("p")).select("p.h", "p.s").distinct()
    shared = dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("s")).alias("all")).where("n > 1")
    shared = store(shared.select("h", F.posexplode("all").alias("variant", "s")), "shared-ids")
    if shared.isEmpty():
        return base.select("row_no", "id", "code_points", "text_sha256", F.transform("pairs", lambda p: F.struct(p["h"].alias("h"), F.lit(0).alias("variant"))).alias("recipe"))
    parts = base.select("row_no", F.posexplode("pairs").alias("pos", "p")).select("row_no", "pos", "p.h", "p.s")
    lists = parts.join(shared, ["h", "s"], "left").groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("l"))
    none = F.array().cast("array<struct<h:bigint,variant:int>>")
    listed = F.coalesce(F.transform("l", lambda p: F.struct(p["h"].alias("h"), p["variant"].alias("variant"))), none)
    return base.drop("pairs").join(lists, "row_no", "left").select("row_no", "id", "code_points", "text_sha256", listed.alias("recipe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Decide, for every row, which row of its group of equal texts stays.

    Returns ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and
    ``code_points``, one row per input row.  The row with most code points in the original text stays,
    then the smallest id, then the first of rows equal in both.

    Defined cases: a null text is the empty text; texts of white space alone are
    equal to it; a null id comes after all others; repeated rows are a group like
    any other, of which one stays; an empty table gives an empty result; only the
    two named columns are read, so others may have any name.
    """
    base = recipes(docs, id_col, text_col, **how).withColumn("digest", F.xxhash64("recipe"))
    best = F.min(F.struct((-F.col("code_points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id"), F.col("row_no")))
    groups = base.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.xxhash64("recipe").alias("digest"), "recipe", F.col("best.id").alias("keep_id"), F.col("best.row_no").alias("keep_no"), "group_size")
    return base.join(groups, ["digest", "recipe"]).select("id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_no")).alias("kept"), "text_sha256", "code_points")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows go by their id, so that no text is shuffled.  Only where some rows of an
    id stay and others go are rows told apart by digest and length of their text
    as well; of rows equal in all of these, one stays.

    Defined cases: null ids are one id; null and empty texts and texts of white
    space alone are copies of each other; repeated rows leave one; an empty table
    gives an empty result; columns may have any name.
    """
    base = store(exact_groups(docs, id_col, text_col).select("id", "kept", "text_sha256", "code_points"), "exact")
    by_id = store(base.groupBy("id").agg(F.bool_and("kept").alias("whole"), F.bool_or("kept").alias("some")).where("NOT whole"), "exact-ids")
    rest = rest_of(docs, id_col, by_id.where("id IS NOT NULL").select("id"))
    split = by_id.where("some")
    if split.isEmpty():
        return rest
    nulls = not split.where("id IS NULL").isEmpty()
    parted = joined_by(docs, id_col, split.where("id IS NOT NULL").select("id"), "left_semi")
    if nulls:
        rest, parted = rest.where(F.col(id_col).isNotNull()), parted.unionByName(docs.where(F.col(id_col).isNull()))

    # plain columns on both sides, so the window finds the rows dealt out by the join
    names = [fresh(docs, n) for n in ("of_id", "of_sha", "of_points")]
    nth = fresh(docs, "nth")
    key = lambda row_id: F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("-"))
    stays = base.where("kept").select(key(F.col("id")).alias(names[0]), F.col("text_sha256").alias(names[1]), F.col("code_points").alias(names[2]))
    text = text_or_empty(text_col)
    keyed = parted.withColumns(dict(zip(names, (key(F.col(id_col)), F.sha2(normalised(text), 256), F.length(text)), strict=True)))
    one = Window.partitionBy(*names).orderBy(F.lit(0))
    first = keyed.join(stays, names, "left_semi").withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1)
    return rest.unionByName(first.drop(*names, nth))
