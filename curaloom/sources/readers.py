"""Scans.  All name a schema, keep file and line order where it decides results, and read missing files as their contract says."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..storage import store
from ..vocabulary import DIRECTORY, LANGUAGES, PREFIX


class NotPublished(Exception):
    """A dataset version without a manifest, in another state, or empty."""


class VersionMismatch(Exception):
    """A test set of another version than asked for."""


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark knows."""
    files, place = filesystem(spark, path)
    return files.exists(place)


def read_json(spark: SparkSession, path: str) -> dict | list:
    """A small JSON document, read by the driver."""
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0]["value"])


def documents_of(spark: SparkSession, path: str, glob: str, schema: str, recursive: bool = False) -> DataFrame:
    """One record per JSON file, with ``file``; an unreadable one is a row of nulls with ``corrupt`` set."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    raw = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parsed(raw, schema)


def parsed(raw: DataFrame, schema: str) -> DataFrame:
    """The JSON of ``value`` as columns; ``corrupt`` holds what doesn't parse."""
    got = F.from_json("value", f"{schema}, corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return raw.withColumn("got", got).select(*[c for c in raw.columns if c != "value"], "got.*")


def seeds(spark: SparkSession, path: str, include_reference: bool = False) -> DataFrame:
    """Seed records below a folder in the order of their paths as ``ord``; ``REF-`` files are left out unless asked for."""
    rows = documents_of(spark, path, "*.json", schemas.EXAMPLE, recursive=True)
    if not include_reference:
        rows = rows.where(~F.substring_index("file", "/", -1).startswith("REF-"))
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("file")) - 1)  # a few hundred hand-written files


def draft_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Seeds of the three language folders, or of the whole folder where none of them is there."""
    found = [seeds(spark, f"{root}/{DIRECTORY[name]}") for name in LANGUAGES if exists(spark, f"{root}/{DIRECTORY[name]}")]
    if not found:
        return seeds(spark, root)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: The lower bits of a row's number count the rows of its task.
IN_TASK = (1 << 33) - 1
#: Blocks of files that are sent to every task at most; more are met by shuffling.
BLOCKS = 200_000


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file, line, ord, value``: the lines of files, split scans included, with their places.

    ``line`` counts from 0 within a file, ``ord`` over all files in the order of their
    names.  Large files are read by many tasks, a block of the file each.  A first
    scan counts the lines of each block and notes where the task was when the block
    began; sums over the blocks before give each block's first line, and a second
    scan adds a line's place within its block.  No line is moved, and only counts of
    blocks are summed.

    Defined cases: lines end at line feeds alone, so other separators may stand
    inside strings; blank lines count and are returned; a file that ends in a line
    feed has no line after it; empty files have none.  Files must not change between
    the scans; a line that a block can't hold is an error.
    """
    reader = spark.read.option("lineSep", "\n")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    # the two scans are the same plan over the same files, so tasks get the same blocks in the same order
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    counted = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    counted = store(counted, "blocks")
    whole = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_file = counted.withColumn("line_start", whole(Window.partitionBy("file").orderBy("block")))
    files = counted.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", whole(Window.orderBy("file")).alias("file_start"))  # a row for each file
    starts = in_file.join(files, "file").select("file", "block", "first", "n", "line_start", "file_start")
    starts = F.broadcast(starts) if counted.limit(BLOCKS + 1).count() <= BLOCKS else starts
    nth = F.col("at").bitwiseAND(F.lit(IN_TASK)) - F.col("first").bitwiseAND(F.lit(IN_TASK))
    sure = F.when((nth >= 0) & (nth < F.col("n")), nth).otherwise(F.raise_error(F.concat(F.lit("a file changed between two scans: "), F.col("file"))))
    placed = raw.join(starts, ["file", "block"]).withColumn("nth", sure)
    return placed.select("file", (F.col("line_start") + F.col("nth")).alias("line"), (F.col("file_start") + F.col("line_start") + F.col("nth")).alias("ord"), "value")


def not_blank(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\t\r]", " ")) != ""


def ordered_records(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """JSON lines with ``file``, ``line`` and ``ord``, as ``numbered_lines`` has them; blank lines are skipped."""
    return parsed(numbered_lines(spark, path, glob).where(not_blank(F.col("value"))), schema)


def lines(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """JSON lines with ``file``, ``line`` and so the order of records; blank lines are skipped."""
    return ordered_records(spark, path, schema, glob).drop("ord")


def in_order(rows: DataFrame) -> DataFrame:
    """``ord`` by file name and then line: the rank of the file, and the line within it.

    Only the names of files are ranked, so rows aren't brought together.  Numbers
    rise but have gaps.
    """
    files = rows.select("file").distinct().withColumn("nth", F.row_number().over(Window.orderBy("file")) - 1)
    return rows.join(files, "file").withColumn("ord", F.shiftleft(F.col("nth").cast("bigint"), 40) + F.col("line")).drop("nth")


def raw_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All ``batch-*.jsonl`` of a run, in the order of file names and lines, as ``ord``."""
    return ordered_records(spark, folder, schemas.EXAMPLE, "batch-*.jsonl")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without their order; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a ``.jsonl`` file, of a folder of JSON files, or of one JSON file; ``REF-`` files count."""
    if path.endswith(".jsonl"):
        return lines(spark, path, schemas.EXAMPLE)
    if path.endswith(".json"):
        return parsed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), schemas.EXAMPLE)
    return seeds(spark, path, include_reference=True)


def held_out_tasks(spark: SparkSession, root: str, limit: int | None = None, language: str | None = None) -> DataFrame:
    """Held-out tasks with ``task_index`` from 0 within their language; a missing file is an error."""
    names = [language] if language else list(LANGUAGES)
    for name in names:
        if not exists(spark, f"{root}/{PREFIX[name]}.jsonl"):
            raise FileNotFoundError(f"held-out tasks not found: {root}/{PREFIX[name]}.jsonl")
    rows = lines(spark, root, schemas.HELD_OUT_TASK, "{" + ",".join(f"{PREFIX[n]}.jsonl" for n in names) + "}")
    rows = rows.withColumn("task_index", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)
    return rows if limit is None else rows.where(F.col("task_index") < limit)


def held_out_manifest(spark: SparkSession, root: str, expected: str | None = None) -> dict:
    """The manifest of the test set; raises if it has another version than expected."""
    if not exists(spark, f"{root}/manifest.json"):
        raise FileNotFoundError(f"held-out manifest not found: {root}/manifest.json")
    found = read_json(spark, f"{root}/manifest.json")
    if expected is not None and found.get("heldOutTestSetVersion") != expected:
        raise VersionMismatch(f"expected held-out test set {expected}, found {found.get('heldOutTestSetVersion')}")
    return found


def published(spark: SparkSession, root: str, version: str) -> tuple[DataFrame, dict]:
    """Examples and manifest of a published version, of one language or mixed.

    ``languages`` of the manifest is filled in for both forms.
    """
    place = f"{root}/{version}"
    if not exists(spark, f"{place}/manifest.json"):
        raise NotPublished(f"dataset not published: {version}")
    manifest = read_json(spark, f"{place}/manifest.json")
    if manifest.get("state") != "Published":
        raise NotPublished(f"dataset {version} is {manifest.get('state')}, not Published")
    rows = json_lines(spark, f"{place}/examples.jsonl", schemas.EXAMPLE)
    if rows.isEmpty():
        raise NotPublished(f"dataset {version} has no examples")
    return rows, manifest | {"languages": manifest.get("targetLanguages") or [manifest["targetLanguage"]]}


def published_in_order(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The examples of a published version with their place in it as ``ord``."""
    published(spark, root, version)
    return ordered_records(spark, f"{root}/{version}/examples.jsonl", schemas.EXAMPLE).drop("file", "line", "corrupt")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All published manifests as rows; an empty table if there are none."""
    try:
        return documents_of(spark, root, "manifest.json", schemas.MANIFEST, recursive=True)
    except AnalysisException:
        return spark.createDataFrame([], f"file STRING, {schemas.MANIFEST}, corrupt STRING")


def published_index(spark: SparkSession, root: str) -> DataFrame:
    """Every publication with its number ``entry`` in the log; an empty table if there are none."""
    if not exists(spark, f"{root}/published-index"):
        return spark.createDataFrame([], f"entry BIGINT, {schemas.MANIFEST}")
    rows = documents_of(spark, f"{root}/published-index", "*.json", schemas.MANIFEST).where("corrupt IS NULL")
    return rows.withColumn("entry", F.regexp_extract("file", r"(\d+)\.json$", 1).cast("bigint")).select("entry", *[c for c in rows.columns if c not in ("file", "corrupt")])


def latest_published(spark: SparkSession, root: str) -> DataFrame:
    """The last entry of each dataset version."""
    rows = published_index(spark, root)
    last = rows.groupBy("datasetVersion").agg(F.max_by(F.struct("*"), "entry").alias("last"))
    return last.select("last.*")


def draft(spark: SparkSession, folder: str) -> tuple[dict, dict]:
    """The two manifests that a draft must have."""
    for name in ("filter-manifest.json", "manual-review-manifest.json"):
        if not exists(spark, f"{folder}/{name}"):
            raise FileNotFoundError(f"draft lacks {name}: {folder}")
    return read_json(spark, f"{folder}/filter-manifest.json"), read_json(spark, f"{folder}/manual-review-manifest.json")


def checkpoint(spark: SparkSession, folder: str) -> dict:
    if not exists(spark, f"{folder}/checkpoint-manifest.json"):
        raise FileNotFoundError(f"checkpoint manifest not found: {folder}/checkpoint-manifest.json")
    return read_json(spark, f"{folder}/checkpoint-manifest.json")


def benchmark_runs(spark: SparkSession, root: str, run_ids: list[str]) -> DataFrame:
    """A row per run with ``ord``: its ``evaluation.json`` where there is one, else its ``results.json``; a run with neither is an error."""
    order = spark.createDataFrame(list(enumerate(run_ids)), "ord int, asked string")
    paths = [f"{root}/{r}/{n}" for r in run_ids for n in ("evaluation.json", "results.json") if exists(spark, f"{root}/{r}/{n}")]
    lost = [r for r in run_ids if not any(p.startswith(f"{root}/{r}/") for p in paths)]
    if lost:
        raise FileNotFoundError(f"benchmark artifacts not found for run: {lost[0]}")
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = parsed(raw, schemas.BENCHMARK)
    better = F.row_number().over(Window.partitionBy("asked").orderBy(F.when(F.endswith("file", F.lit("/evaluation.json")), 0).otherwise(1)))
    rows = rows.withColumn("asked", F.element_at(F.split("file", "/"), -2)).withColumn("nth", better).where("nth = 1").drop("nth")
    return order.join(rows, "asked").drop("asked", "file", "corrupt").withColumns({
        "compressionMethod": F.coalesce("compressionMethod", F.lit("Unknown")), "evidenceLevel": F.coalesce("evidenceLevel", F.lit("Established")),
        **{c: F.coalesce(c, F.lit("")) for c in ("datasetVersion", "heldOutTestSetVersion", "studentModel")}, **{c: F.coalesce(c, F.lit(0.0)) for c in ("passAt1", "passAt5")},
    })


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event log: ``event``, ``ts``, ``runId`` and the whole object as ``payload``."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return with_event_columns(raw)


def with_event_columns(raw: DataFrame) -> DataFrame:
    head = F.from_json("value", "event STRING, timestamp STRING, runId STRING")
    return raw.select(head["event"].alias("event"), F.try_to_timestamp(head["timestamp"]).alias("ts"), head["runId"].alias("runId"), F.col("value").alias("payload"))


def template(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
