"""Sinks.  Tables go out through Spark's writers; single small documents are written by the driver through the same file systems."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists, filesystem, read_json


class PublishError(Exception):
    """A version that can't be published."""


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    files, place = filesystem(spark, path)
    out = files.create(place, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: dict | list) -> None:
    """A JSON document, indented, non-ASCII as it is."""
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, codec: str = "none") -> None:
    """JSON lines, absent fields for nulls; an empty table leaves an empty folder.  Scans read packed files (``codec``) as they read plain ones."""
    writer = rows.write.mode(mode).option("ignoreNullFields", "true").option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def append_rejected(rows: DataFrame, path: str, run_id: str, rejected_at: str) -> None:
    """Rejected rows, with the example nested and the run as partition, added to the log."""
    plain = [c for c in rows.columns if c not in ("accepted", "reasonCode", "message", "gatesPassed")]
    out = rows.where("NOT accepted").select(F.struct(*plain).alias("example"), F.col("id").alias("exampleId"), "reasonCode", "message", "gatesPassed", F.lit(rejected_at).alias("rejectedAt"), F.lit(run_id).alias("runId"))
    json_lines(out, path, "append", ["runId"], "gzip")


def batch_files(rows: DataFrame, folder: str, order: str = "ord") -> int:
    """Rows in their order as files ``batch-NNNNNN.jsonl``; returns how many.

    Tasks write ranges of the order, so the files' names and lines give it back.  The
    driver only renames the finished files.
    """
    spark = rows.sparkSession
    staged = f"{folder}/_staged"
    rows.orderBy(order).write.mode("errorifexists").option("ignoreNullFields", "true").json(staged)
    files, place = filesystem(spark, staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = sorted(f.getPath().getName() for f in files.listStatus(place) if f.getPath().getName().startswith("part-"))  # names rise with the range
    for nth, name in enumerate(names):
        if not files.rename(path(f"{staged}/{name}"), path(f"{folder}/batch-{nth:06d}.jsonl")):
            raise PublishError(f"can't name {folder}/batch-{nth:06d}.jsonl")
    files.delete(place, True)
    return len(names)


def batches(rows: DataFrame, path: str, size: int = 25) -> None:
    """Files of at most ``size`` rows, dealt out by batch number."""
    rows.repartition("batch").sortWithinPartitions("batch", "ord").write.mode("overwrite").option("maxRecordsPerFile", size).option("compression", "gzip").partitionBy("batch").json(path)


def promoted_seeds(rows: DataFrame, path: str) -> None:
    """Seeds in a folder for each language."""
    json_lines(rows, path, "overwrite", ["targetLanguage"])


def publish_snapshot(rows: DataFrame, root: str, version: str, manifest: dict) -> None:
    """An immutable version: examples, then the manifest that makes it published.  An existing one is an error."""
    spark = rows.sparkSession
    if exists(spark, f"{root}/{version}"):
        raise PublishError(f"published dataset already exists: {root}/{version}")
    rows.write.mode("errorifexists").option("ignoreNullFields", "true").json(f"{root}/{version}/examples.jsonl")
    write_json(spark, f"{root}/{version}/manifest.json", manifest)


def claimed(spark: SparkSession, path: str) -> bool:
    """Make an empty file that wasn't there; false if it was.  Of several callers one succeeds."""
    files, place = filesystem(spark, path)
    files.mkdirs(place.getParent())
    jvm = spark.sparkContext._jvm
    try:
        if place.toUri().getScheme() in (None, "file"):
            # the local file system of the client only looks before it writes; this makes the file or fails
            jvm.java.nio.file.Files.write(jvm.java.nio.file.Paths.get(jvm.java.net.URI(f"file://{place.toUri().getPath()}")), bytearray(), nio_options(spark, "CREATE_NEW"))
        else:
            files.create(place, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def nio_options(spark: SparkSession, name: str):
    context = spark.sparkContext
    options = context._gateway.new_array(context._jvm.java.nio.file.OpenOption, 1)
    options[0] = context._jvm.java.nio.file.StandardOpenOption.valueOf(name)
    return options


#: The folder of the log of publications, and how its entries are named.
LOG, ENTRY = "published-index", "{:08d}"


def append_index(spark: SparkSession, root: str, entry: dict) -> int:
    """One more publication in the log; returns its number.

    The log is a folder with a file for each entry.  A writer claims the next number
    by making a file that nobody else can make, and goes on to the number after if it
    was taken, so publishers at one time lose nothing.  An entry appears whole, by
    renaming.  A writer that dies between the two leaves a number without an entry.

    ``published-index.json`` is the list of all entries for other readers.  It is
    written from the log, again while entries have come meanwhile.
    """
    folder = f"{root}/{LOG}"
    files, place = filesystem(spark, folder)
    files.mkdirs(place)
    number = 1 + max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(place) if f.getPath().getName().endswith(".claim")), default=0)
    while not claimed(spark, f"{folder}/{ENTRY.format(number)}.claim"):
        number += 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    write_json(spark, f"{folder}/_{ENTRY.format(number)}", entry)
    if not files.rename(path(f"{folder}/_{ENTRY.format(number)}"), path(f"{folder}/{ENTRY.format(number)}.json")):
        raise PublishError(f"can't add entry {number} to {folder}")
    listed = None
    while listed != (listed := entry_names(spark, folder)):
        found = spark.read.text([f"{folder}/{n}" for n in listed], wholetext=True).orderBy("_metadata.file_path")
        write_json(spark, f"{root}/{LOG}.json", [json.loads(r["value"]) for r in found.collect()])  # a small document for each publication
    return number


def entry_names(spark: SparkSession, folder: str) -> list[str]:
    """The finished entries of a log, in order."""
    files, place = filesystem(spark, folder)
    return sorted(name for f in files.listStatus(place) if (name := f.getPath().getName()).endswith(".json") and name[0] not in "_.")


def record_files(rows: DataFrame, folder: str, name: str) -> int:
    """A JSON file ``NAME.json`` for each row, named by a column of distinct names; returns how many.

    Tasks write the files; the driver only renames them, so it handles names alone.
    Characters that a path can't hold are escaped as Spark escapes them in partitions.
    """
    spark = rows.sparkSession
    staged = f"{folder}/_staged"
    rows.withColumn("_name", F.col(name)).write.mode("errorifexists").partitionBy("_name").option("ignoreNullFields", "true").json(staged)
    files, place = filesystem(spark, staged)
    path, count = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, 0
    for own in files.listStatus(place):
        if own.isDirectory() and own.getPath().getName().startswith("_name="):
            target = own.getPath().getName().removeprefix("_name=")
            made = [f.getPath() for f in files.listStatus(own.getPath()) if f.getPath().getName().startswith("part-")]
            if len(made) != 1 or not files.rename(made[0], path(f"{folder}/{target}.json")):
                raise PublishError(f"can't write one record to {folder}/{target}.json")
            count += 1
    files.delete(place, True)
    return count


def append_events(events: list[dict], spark: SparkSession, path: str) -> None:
    """Events as one more file of the log's folder; a stream over the folder sees it once."""
    if events:
        rows = spark.createDataFrame([(json.dumps(e, ensure_ascii=False),) for e in events], "value string")
        rows.coalesce(1).write.mode("append").text(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def text_lines(rows: DataFrame, path: str, head: list[str] | None = None) -> None:
    """Ordered lines of one small file, after the lines of a head."""
    write_text(rows.sparkSession, path, "\n".join([*(head or []), *[r[0] for r in rows.collect()]]) + "\n")
