"""Runs followed through an unbounded log of events: steps that their machine lacks, and runs that go silent.

State is kept by run: its last state, when that was, and events that may still be
preceded by others.  A timer for a run's first held event puts all that the watermark
has passed in order; another tells that a run has waited too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timers need this store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "run string, kind string, previous string, state string, at timestamp"
FIRST = "Pending"


def millis(t: datetime) -> int:
    """Milliseconds of a time without a zone, which stands for UTC."""
    return int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)


class Follower(StatefulProcessor):
    """``illegal`` steps in the order of event time, and ``unfinished`` runs after ``patience`` milliseconds of silence.

    ``legal`` are pairs of states, ``final`` the states that end a run.
    """

    def __init__(self, legal: frozenset[tuple[str, str]], final: frozenset[str], patience: int):
        self.legal, self.final, self.patience = legal, final, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, at timestamp, due bigint")
        self.early = handle.getListState("early", "state string, at timestamp, nth bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Keep the events until the watermark has passed them; one timer, for the first of them."""
        came = [(r["state"], r["at"], r["nth"]) for r in rows]
        self.early.appendList(came)
        self.handle.registerTimer(min(millis(r[1]) for r in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # nothing can come any more before the watermark, so all that it has passed is ripe at once
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = sorted(self.early.get(), key=lambda r: (r[1], r[2])) if self.early.exists() else []
        ripe = [r for r in held if millis(r[1]) <= now]
        rest = [tuple(r) for r in held[len(ripe) :]]
        if ripe:
            self.early.clear()
            if rest:
                self.early.put(rest)
                self.handle.registerTimer(millis(rest[0][1]))
        last = self.last.get() if self.last.exists() else None
        previous, at, due = (last[0], last[1], last[2]) if last else (FIRST, None, None)
        for state, when, _ in ripe:
            if due is not None and millis(when) > due:
                yield Row(run=key[0], kind="unfinished", previous=None, state=previous, at=at)
            if (previous, state) not in self.legal:
                yield Row(run=key[0], kind="illegal", previous=previous, state=state, at=when)
            previous, at = state, when
            due = None if state in self.final else millis(when) + self.patience
        # what is held, if anything, comes after the watermark
        if due is not None and due < now:
            yield Row(run=key[0], kind="unfinished", previous=None, state=previous, at=at)
            due = None
        elif ripe and due is not None:
            self.handle.registerTimer(due + 1)  # after all that may still come at that time
        if at is not None:
            self.last.update((previous, at, due))

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """The store that timers need, for the streams that start inside; the setting is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def follow(events: DataFrame, run: str, state: str, at: str, nth: str, legal: set[tuple[str, str]], final: set[str], patience_ms: int, delay: str = "0 seconds") -> DataFrame:
    """``run, kind, previous, state, at`` from a stream of events.

    ``kind`` is ``illegal`` for a step from ``previous`` to ``state`` that isn't among
    ``legal`` (a run comes from ``Pending``), and ``unfinished`` for a run that stayed
    in a state which isn't ``final`` for more than ``patience_ms`` before its next
    event, or before the watermark.  Each silence is told once, however the log is
    cut into batches.

    Events are put in the order of ``at`` and then ``nth``.  Those that come later than
    ``delay`` are left out; state is kept for events within it and one row a run.
    Start the stream inside ``state_store``.

    Defined cases: events without a run, a time or a number are left out; times are
    compared by milliseconds; an empty log gives nothing.
    """
    named = events.select(F.col(run).cast("string").alias("run"), F.col(state).cast("string").alias("state"), F.col(at).cast("timestamp").alias("at"), F.col(nth).cast("bigint").alias("nth"))
    kept = named.where("run IS NOT NULL AND at IS NOT NULL AND nth IS NOT NULL AND state IS NOT NULL").withWatermark("at", delay)
    return kept.groupBy("run").transformWithState(Follower(frozenset(legal), frozenset(final), patience_ms), RESULT, "Append", "EventTime")


def follow_log(spark: SparkSession, folder: str, out: str, checkpoint: str, patience_ms: int, legal: set[tuple[str, str]], final: set[str], delay: str = "0 seconds", files_a_trigger: int = 100) -> DataFrame:
    """What has come into a folder of JSON lines (run, state, at, nth) since the last call, followed; returns all that was found so far."""
    log = spark.readStream.schema("run STRING, state STRING, at TIMESTAMP, nth BIGINT").option("maxFilesPerTrigger", files_a_trigger).json(folder)
    with state_store(spark):
        query = follow(log, "run", "state", "at", "nth", legal, final, patience_ms, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(RESULT).parquet(out)
