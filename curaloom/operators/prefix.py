"""Running sums that no single task has to make.

Rows are dealt out by ranges of their key and order, so a key with many rows spans
many ranges.  Each range is summed for each of its keys; a row's running sum is
that of the ranges before it and that within its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store

#: Sums are exact, so the order of additions can't change them.
EXACT = "decimal(30,12)"
#: Two of these add up without losing a digit.
ADDED = "decimal(37,12)"


def exact(value: Column) -> Column:
    """A number as an exact one; what isn't a finite number adds nothing."""
    return F.coalesce(value.try_cast(EXACT), F.lit(0).cast(EXACT))


def running_sums(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the exact sum of ``value`` over the rows of their key up to and including them.

    A window over a key would put all of its rows into one task.  Here a task has
    one range of rows.  A window over ranges has a row for each range that a key
    spans, so as many as there are partitions.

    Defined cases: null keys are one key; nulls come first in the order; rows equal
    in key and order have any order among themselves; values that are null, infinite,
    no numbers or beyond the range of ``EXACT`` add nothing; an empty table gives an empty result; ``name`` must be
    free.
    """
    part, nth, own, before, value_col = (f"{name}_{x}" for x in ("part", "nth", "own", "before", "value"))
    keys = [F.col(c) for c in by]
    ranged = rows.withColumn(value_col, exact(value)).repartitionByRange(*[*by, *order]).sortWithinPartitions(*by, *order)
    # rows keep the range and the place in it that they were dealt
    ranged = store(ranged.withColumns({part: F.spark_partition_id(), nth: F.monotonically_increasing_id()}), "ranges")
    sums = ranged.groupBy(*keys, part).agg(F.sum(value_col).alias(own))
    earlier = F.sum(own).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*by, part, F.coalesce(earlier, F.lit(0)).alias(before)).toDF(*[f"{name}_{c}" for c in by], f"{part}_of", before)
    within = F.sum(value_col).over(Window.partitionBy(part, *by).orderBy(nth).rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn(own, within)
    same = F.col(part) == F.col(f"{part}_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{name}_{c}"))
    return summed.join(starts, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(own).cast(ADDED) + F.col(before).cast(ADDED)).alias(name))


def before_first(rows: DataFrame, by: list[str], order: list[str], hit: str) -> DataFrame:
    """The rows of each key before its first with ``hit``; all of a key without one.

    Only each key's first hit is looked for, so rows meet it in a join and aren't
    put in order.

    Defined cases: null keys are one key; a null ``hit`` is none; rows that equal the
    first hit in the order go with it.
    """
    end = F.struct(*[F.col(c) for c in order])
    firsts = store(rows.where(F.col(hit)).groupBy(*[F.col(c).alias(f"{hit}_{c}") for c in by]).agg(F.min(end).alias(f"{hit}_end")), "first-hits")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{hit}_{c}"))
    met = rows.join(firsts if by else F.broadcast(firsts), same, "left")  # without a key there is one row
    return met.where(F.col(f"{hit}_end").isNull() | (end < F.col(f"{hit}_end"))).select(*[F.col(f"`{c}`") for c in rows.columns])
