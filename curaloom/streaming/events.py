"""The event log and the gates as streams.

The batch engine has no streams of its own; these are the same operators over
unbounded input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources.readers import with_event_columns


def read_log(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """New files of an event log's folder as a stream of events."""
    return with_event_columns(spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder).where(F.trim("value") != ""))


def once_each(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events without repetitions that arrive within the delay; state is kept for that long."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["payload"])


def counts(events: DataFrame, width: str = "1 day", delay: str | None = "1 day") -> DataFrame:
    """``start, event, events`` by tumbling windows; rows later than the delay are left out.

    Without a delay the events bring a watermark of their own, as those of
    ``once_each`` do.
    """
    marked = events.withWatermark("ts", delay) if delay else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event", "events")


def filter_stream(spark: SparkSession, folder: str, checkpoint: str, gate: Callable[[DataFrame], DataFrame], accept: str, reject: str) -> StreamingQuery:
    """Candidate files through the gates, a batch at a time.

    ``gate`` gets a batch with its order and returns it decided; accepted rows of
    earlier batches are its baseline if it reads ``accept``.  A batch that runs
    again replaces its own output, so nothing is written twice.
    """
    raw = spark.readStream.text(folder).select(F.from_json("value", schemas.EXAMPLE).alias("r")).select("r.*")

    def handle(batch: DataFrame, number: int) -> None:
        decided = gate(batch.withColumn("ord", F.monotonically_increasing_id())).withColumn("batch", F.lit(number))
        for rows, place in ((decided.where("accepted"), accept), (decided.where("NOT accepted"), reject)):
            rows.drop("batch").write.mode("overwrite").parquet(f"{place}/batch={number}")

    return raw.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
