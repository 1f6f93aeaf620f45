"""Small helpers shared by the operators; stored tables come from ``curaloom.storage``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, drop_stored, forget, new_path, shared_dir, store

__all__ = ["ARROW_BYTES", "ARROW_ROWS", "BROADCAST_KEYS", "discard", "drop_stored", "forget", "fresh", "joined_by", "new_path", "once", "rest_of", "shared_dir", "small_batches", "store", "text_or_empty"]

#: Rows and bytes per Arrow batch.  Texts can be very long, so batches are small.
ARROW_ROWS, ARROW_BYTES = 256, "16m"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def once(df: DataFrame, *keep: Column, **made: Column) -> DataFrame:
    """Add columns that are evaluated once, however often later steps use them.

    Projections that follow each other are merged by the optimizer, which copies
    a costly expression into each place that uses it.  A generator of one row
    stops that.
    """
    row = F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()])))
    return df.select(*keep, row)


def text_or_empty(name: str) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Keys that are broadcast at most; beyond that the rows are dealt out by key.
BROADCAST_KEYS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_by(docs: DataFrame, key_col: str, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` with all its columns, whose ``key_col`` is (``left_semi``) or isn't (``left_anti``) among ``keys`` (one column).

    Few keys are sent to the rows, so no text moves; more are met by shuffling.
    """
    name = fresh(docs, "key")
    keys = keys.toDF(name)
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    kept = docs.withColumn(name, F.col(key_col)).join(F.broadcast(keys) if few else keys, name, how)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def rest_of(docs: DataFrame, key_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't among ``gone``; rows with a null key stay."""
    return joined_by(docs, key_col, store(gone, "gone"), "left_anti")
