"""Intermediate tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``.  Where that
    is unset (tests, a single machine), a temporary folder is made, and only a
    local master may use it.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="curaloom-")
    return _own_dir


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/curaloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; two runs never share one."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and gives rows made by non-deterministic expressions
    (row numbers by partition) one fixed value.  A lost executor loses nothing.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._curaloom_path = path
    return stored


def forget(stored: DataFrame) -> None:
    """Delete a table that ``store`` returned, once nothing reads it any more."""
    discard(stored.sparkSession, stored._curaloom_path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete everything this application has put into the shared folder."""
    discard(spark, own_dir(spark))
