"""Deterministic samples: the rows with the smallest hash of a seed and their id."""

from __future__ import annotations

import hashlib
import math
import random
from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store


def sample_size(count: int, rate: float, least: int) -> int:
    """A share of the rows, rounded up, at least ``least`` and at most all."""
    return 0 if count <= 0 else min(count, max(least, math.ceil(count * rate)))


def sample_size_column(count: Column, rate: float, least: int) -> Column:
    return F.when(count <= 0, 0).otherwise(F.least(count, F.greatest(F.lit(least), F.ceil(count * F.lit(rate))))).cast("bigint")


def turn(seed: str | int, key: Column) -> Column:
    """The place of a row in the order that a seed gives."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


#: Hexadecimal digits of the hash that are counted: 65,536 counts at most.
COUNTED = 4


def hash_sample(rows: DataFrame, key: str, seed: str | int, size: int) -> DataFrame:
    """``size`` rows without replacement, in the order of their hashes; any engine with SHA-256 draws the same.

    Rows are counted by the head of their hash.  All rows below the head at the
    edge are drawn as they are; only those at the edge are put in order.

    Defined cases: rows with a null key come by the hash of the seed alone; rows
    equal in hash and key are drawn in any order; a size of all rows or more draws
    all, one of zero or less none.
    """
    if size <= 0:
        return rows.limit(0)
    head = F.substr(turn(seed, F.col(key)), F.lit(1), F.lit(COUNTED))
    counts = sorted((r["head"], r["count"]) for r in rows.groupBy(head.alias("head")).count().collect())
    below, edge = 0, None
    for value, count in counts:
        if below + count > size:
            edge = value
            break
        below += count
    if edge is None:
        return rows.orderBy(turn(seed, F.col(key)), key)
    drawn = rows.where(head < edge).unionByName(rows.where(head == edge).orderBy(turn(seed, F.col(key)), key).limit(size - below))
    return drawn.orderBy(turn(seed, F.col(key)), key)


def review_sample(rows: DataFrame, key: str, run_id: str, rate: float = 0.05, least: int = 1) -> DataFrame:
    return hash_sample(rows, key, run_id, sample_size(rows.count(), rate, least))


def numbered(rows: DataFrame, order: list[str], name: str = "place", group: str | None = None) -> DataFrame:
    """``rows`` with their places 0, 1, ... in an order, within each value of ``group`` if one is given.

    Rows are dealt out by ranges of the order and counted by task; a place is the
    count of the tasks before and the place within the task.  No task has more than
    its range, however many rows a group has.

    Defined cases: nulls come first; rows equal in the order have any order among
    themselves; an empty table gives an empty result; ``name`` must be free.
    """
    by = [c for c in [group, *order] if c]
    part, nth = f"{name}_part", f"{name}_nth"
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the lower bits of the id count the rows of a task
    ranged = store(ranged.withColumns({part: F.spark_partition_id(), nth: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row per task
    starts = counts.select(part, F.coalesce(before, F.lit(0)).alias(f"{name}_start"))
    placed = ranged.join(F.broadcast(starts), part).withColumn(name, F.col(f"{name}_start") + F.col(nth)).drop(part, nth, f"{name}_start")
    if group is None:
        return placed
    first = placed.groupBy(F.col(group).alias(f"{name}_of")).agg(F.min(name).alias(f"{name}_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col(f"{name}_of"))).withColumn(name, F.col(name) - F.col(f"{name}_first")).drop(f"{name}_of", f"{name}_first")


def random_places(count: int, run_id: str, size: int) -> list[int]:
    """The places that Python's own generator draws, seeded by the run's hash; for parity with results drawn so."""
    seed = int(hashlib.sha256(run_id.encode()).hexdigest()[:16], 16)
    return random.Random(seed).sample(range(count), size)


def parity_sample(rows: DataFrame, ord_col: str, run_id: str, rate: float = 0.05, least: int = 1) -> DataFrame:
    """The review sample by place in the order of ``ord_col`` (0, 1, ...), in the order drawn as ``drawn``."""
    count = rows.count()
    places = random_places(count, run_id, sample_size(count, rate, least))
    drawn = rows.sparkSession.createDataFrame(list(enumerate(places)), "drawn int, place bigint")
    return rows.join(F.broadcast(drawn), F.col(ord_col) == F.col("place")).drop("place").orderBy("drawn")


#: Rows whose places the driver may shuffle: eight bytes each.
MOST_SHUFFLED = 50_000_000


def shuffled_places(count: int, seed: int, limit: int) -> list[int]:
    """The head of a shuffle by Python's own generator.

    Every place of such a head depends on all swaps, so it can't be dealt out; the
    driver holds places alone, never rows.  Draw larger sets with ``hash_sample``.
    """
    if count > MOST_SHUFFLED:
        raise ValueError(f"a shuffle of {count} rows can't be drawn like Python's; use the order of hashes")
    places = array("q", range(count))
    random.Random(seed).shuffle(places)
    return list(places[:limit])


def shuffled_subset(rows: DataFrame, ord_col: str, seed: int, limit: int) -> DataFrame:
    """The rows that a seeded shuffle of their places (``ord_col``: 0, 1, ...) puts first, in that order as ``drawn``."""
    places = shuffled_places(rows.count(), seed, limit)
    drawn = rows.sparkSession.createDataFrame(list(enumerate(places)), "drawn int, place bigint")
    return rows.join(F.broadcast(drawn), F.col(ord_col) == F.col("place")).drop("place")
