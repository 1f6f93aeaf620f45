"""Exact similarity join of token sets.

Rows with equal sets are one class, so copies are never paired.  Sets that reach a
high threshold differ in few tokens: dealt out by hash into one part more than that,
they have a part in common (pigeonhole), which a number stands for.  Below
``SEGMENTED`` parts get too short; there, such sets share a token among their rarest
few (prefix filter).  Sizes lie within bounds, and exact overlap is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..storage import store

#: Guards ceil() against a product that is a hair above a whole number.
HAIR = 1e-9
#: Thresholds from here on are met by parts of sets, of nine tokens or more on average.
SEGMENTED = 0.9
#: Sets that are cut at once, which bounds a task's memory.
ROWS = 1000


def token_classes(rows: DataFrame, key: str, ord_col: str, text_col: str, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``members`` (key, ord, by, class_id) and ``classes`` (class_id, by, tokens, size).

    A class is the rows of one partition value with one token set; its id is the
    SHA-256 of both.
    """
    cols = [F.col(key).alias("key"), F.col(ord_col).alias("ord"), (F.col(by).cast("string") if by else F.lit("")).alias("by")]
    sets = rows.select(*cols, F.sort_array(text.token_set(F.col(text_col))).alias("tokens"))
    sets = store(sets.withColumn("class_id", F.sha2(F.concat_ws("\u0001", F.coalesce("by", F.lit("\u0002")), F.array_join("tokens", " ")), 256)), "token-sets")
    classes = sets.groupBy("class_id").agg(F.first("by").alias("by"), F.first("tokens").alias("tokens"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("members"))
    return sets.select("key", "ord", "by", "class_id"), classes.withColumn("size", F.size("tokens"))


def bounds(most: int, threshold: float) -> np.ndarray:
    """The largest sizes of the groups of sizes, up to one that holds ``most``: a set reaches the threshold with its own and the next groups alone."""
    ends = [0]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int(np.floor((ends[-1] + 1) / threshold + HAIR))))
    return np.array([*ends, int(np.floor((ends[-1] + 1) / threshold + HAIR))])


def segments(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """``no, size, mark``: numbers that stand for the parts of each set (``no, by, hashes``).

    A set is cut for its own group of sizes and for the one above, so that it meets
    both neighbours.  Of sets of at most ``m`` tokens those that reach the threshold
    differ in ``2 m (1 - t) / (1 + t)`` tokens at most; there is one part more.
    """
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        lists, nos = batch.column("hashes"), batch.column("no").to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        tokens, by = lists.flatten().to_numpy().view(np.uint64), batch.column("by").to_numpy().view(np.uint64)
        ends = bounds(int(sizes.max()), threshold)
        group = np.searchsorted(ends, sizes)
        for step in (0, 1):
            most = ends[group + step]
            parts = np.floor(2 * most * (1 - threshold) / (1 + threshold) + HAIR).astype(np.int64) + 1
            starts = np.concatenate(([0], np.cumsum(parts)))
            row = np.repeat(np.arange(len(nos)), sizes)
            with np.errstate(over="ignore"):
                place = starts[row] + ((tokens >> np.uint64(33)) % parts[row].astype(np.uint64)).astype(np.int64)
                # sums of halves are exact in doubles; equal parts have equal sums
                mixed = (tokens ^ (tokens >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                low, high = (np.bincount(place, x.astype(np.float64), starts[-1]).astype(np.uint64) for x in (mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)))
                of = np.repeat(np.arange(len(nos)), parts)
                nth = (np.arange(starts[-1]) - starts[of]).astype(np.uint64)
                mark = (low * np.uint64(0xBF58476D1CE4E5B9)) ^ (high * np.uint64(0x94D049BB133111EB))
                mark = (mark ^ (mark >> np.uint64(31)) ^ by[of] ^ ((group[of] + step).astype(np.uint64) << np.uint64(40)) ^ (nth << np.uint64(16))) * np.uint64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays([pa.array(nos[of]), pa.array(sizes[of].astype(np.int32)), pa.array(mark.view(np.int64))], ["no", "size", "mark"])


def met_by_segments(classes: DataFrame, threshold: float) -> DataFrame:
    """``x, y``: numbers of classes that have a part in common; every pair that reaches the threshold is among them."""
    hashed = classes.select("no", F.xxhash64(F.coalesce("by", F.lit("\u0002"))).alias("by"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    marks = store(hashed.mapInArrow(partial(segments, threshold=threshold), "no bigint, size int, mark bigint"), "token-segments")
    a, b = marks.alias("a"), marks.alias("b")
    sized = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * threshold - HAIR
    return a.join(b, (F.col("a.mark") == F.col("b.mark")) & (F.col("a.no") < F.col("b.no")) & sized).select(F.col("a.no").alias("x"), F.col("b.no").alias("y")).distinct()


def met_by_prefix(classes: DataFrame, threshold: float) -> DataFrame:
    """``x, y``: numbers of classes that share one of their rarest tokens."""
    words = classes.select("no", "by", "size", F.explode("tokens").alias("token")).withColumn("n", F.length("token"))
    # the second key makes the join deal both sides out anew, so adaptive execution can split a frequent token
    rarity = words.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("n", F.length("token"))
    ranked = words.join(rarity.hint("shuffle_hash"), ["token", "n"]).groupBy("no", "by", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    keep = (F.col("size") - F.ceil(F.col("size") * threshold - HAIR) + 1).cast("int")
    prefix = ranked.select("no", "by", "size", F.explode(F.slice("ranked", F.lit(1), keep)).alias("r"))
    prefix = prefix.where("r.df > 1").select("no", "by", "size", "r.token")  # a token of one class meets nothing
    prefix = store(prefix, "token-prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.token") == F.col("b.token")) & F.col("a.by").eqNullSafe(F.col("b.by")) & (F.col("a.no") < F.col("b.no"))
    sized = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * threshold - HAIR
    return a.join(b, near & sized).select(F.col("a.no").alias("x"), F.col("b.no").alias("y")).distinct()


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` for different classes of one partition value, ``a`` the one with the smaller ``ord``.

    Empty sets are similar to each other alone, and those are one class already.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    classes = store(classes.where("size > 0").select("class_id", "by", "tokens", "ord", "size").withColumn("no", F.monotonically_increasing_id()), "token-classes")
    pairs = store((met_by_segments if threshold >= SEGMENTED else met_by_prefix)(classes, threshold), "met-classes")
    full = classes.select("no", "class_id", "by", "ord", "tokens")
    # texts of classes that met another alone travel
    full = full.join(pairs.select(F.col("x").alias("no")).union(pairs.select("y")).distinct(), "no", "left_semi")
    side = lambda n: full.select(F.col("no").alias(n), *[F.col(c).alias(f"{n}{c[0]}") for c in ("class_id", "by", "ord", "tokens")])
    both = pairs.join(side("x"), "x").join(side("y"), "y").where(F.col("xb").eqNullSafe(F.col("yb")))
    scored = both.withColumn("similarity", text.jaccard(F.col("xt"), F.col("yt"))).where(F.col("similarity") >= threshold)
    first = F.col("xo") < F.col("yo")
    return scored.select(F.when(first, F.col("xc")).otherwise(F.col("yc")).alias("a"), F.when(first, F.col("yc")).otherwise(F.col("xc")).alias("b"), "similarity")


def duplicates(rows: DataFrame, key: str, text_col: str, threshold: float = 0.95, by: str | None = None) -> DataFrame:
    """Per row: ``key``, ``class_id`` (smallest key with an equal set) and ``links`` (similar rows, itself left out)."""
    members, classes = token_classes(rows, key, key, text_col, by)
    classes = store(classes, "classes")
    pairs = similar_classes(classes, threshold)
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(pairs.select(F.col("b"), F.col("a")))
    sizes = classes.select(F.col("class_id").alias("other"), F.col("members").alias("n"))
    more = both.join(sizes, "other").groupBy("class_id").agg(F.sum("n").alias("n"))
    whole = classes.select("class_id", F.col("ord").alias("least"), "members").join(more, "class_id", "left")
    whole = whole.select("class_id", "least", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    return members.select("key", "class_id").join(whole, "class_id").select("key", F.col("least").alias("class_id"), "links")


def duplicate_pairs(rows: DataFrame, key: str, text_col: str, threshold: float = 0.95, by: str | None = None) -> DataFrame:
    """``left_key, right_key, similarity`` between class representatives (their smallest keys), smaller key first."""
    _, classes = token_classes(rows, key, key, text_col, by)
    classes = store(classes, "classes")
    name = classes.select("class_id", "ord")
    pairs = similar_classes(classes, threshold)
    return pairs.join(name.select(F.col("class_id").alias("a"), F.col("ord").alias("left_key")), "a").join(name.select(F.col("class_id").alias("b"), F.col("ord").alias("right_key")), "b").select("left_key", "right_key", "similarity")
