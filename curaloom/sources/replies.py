"""Recorded replies of a teacher as a data source of Spark, in batches and as a stream.

A teacher is plugged in by a format: anything that gives rows of ``SCHEMA`` will do,
and everything after it (parsing, budget, batches) stays the same.  This one reads
what was recorded: JSON lines in the files of a folder.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import json_object

SCHEMA = "callId STRING, ord BIGINT, text STRING, inputTokens BIGINT, outputTokens BIGINT, model STRING"
FIELDS = pa.schema([("callId", pa.string()), ("ord", pa.int64()), ("text", pa.string()), ("inputTokens", pa.int64()), ("outputTokens", pa.int64()), ("model", pa.string())])
#: Bytes that one task reads, and replies in one batch of rows.
SPAN, ROWS = 8 << 20, 512


@dataclass
class Span(InputPartition):
    """The lines of a file that start in a range of bytes."""

    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__(self.path)


def files_of(folder: str) -> dict[str, int]:
    """Files of a folder with their sizes; hidden ones are passed over."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(folder)
    return {i.path: i.size for i in store.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File and i.base_name[0] not in "._"}


def reply(line: bytes) -> dict:
    """The fields of one line; what is missing, of another kind or no JSON object is null."""
    try:
        said = json.loads(line)
    except ValueError:
        said = None
    said = said if isinstance(said, dict) else {}
    fits = lambda v, kind: isinstance(v, str) if pa.types.is_string(kind) else type(v) is int and abs(v) < 1 << 63
    return {f.name: v if fits(v := said.get(f.name), f.type) else None for f in FIELDS}


def rows_of(folder: str, span: Span) -> Iterator[pa.RecordBatch]:
    """The replies that start in a span.  A line belongs to the span that holds its first byte.

    Reading a span again gives the same rows and needs nothing of other spans.
    """
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    rows: list[dict] = []
    with store.open_input_file(span.path) as raw:
        # a line that starts at the first byte of the span has its line feed just before
        at = max(0, span.start - 1)
        raw.seek(at)
        file = io.BufferedReader(raw, 1 << 20)
        if span.start:
            at += len(file.readline())
        while at < span.end and (line := file.readline()):
            at += len(line)
            if line.strip():
                rows.append(reply(line))
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)


def spans(sizes: dict[str, int], since: dict[str, int], span: int) -> list[Span]:
    """Ranges of the bytes that files have beyond those of ``since``."""
    return [Span(path, start, min(start + span, size)) for path, size in sorted(sizes.items()) for start in range(since.get(path, 0), size, span)]


class Batch(DataSourceReader):
    def __init__(self, folder: str, span: int):
        self.folder, self.span = folder, span

    def partitions(self) -> list[Span]:
        return spans(files_of(self.folder), {}, self.span)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return rows_of(self.folder, partition)


class Stream(DataSourceStreamReader):
    """Offsets are the bytes of each file that were read, so a restarted stream goes on where it stood."""

    def __init__(self, folder: str, span: int):
        self.folder, self.span = folder, span

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return files_of(self.folder)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return spans(end, start, self.span)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return rows_of(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class RecordedReplies(DataSource):
    """The format ``recorded_replies``: ``load(folder)``, with the option ``span`` for the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "recorded_replies"

    def schema(self) -> str:
        return SCHEMA

    def _told(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("span", SPAN))

    def reader(self, schema) -> Batch:
        return Batch(*self._told())

    def streamReader(self, schema) -> Stream:
        return Stream(*self._told())


def recorded(spark: SparkSession, folder: str, span: int = SPAN) -> DataFrame:
    """Recorded replies with the JSON object in each as ``candidate`` (null where there is none)."""
    spark.dataSource.register(RecordedReplies)
    return with_candidate(spark.read.format("recorded_replies").option("span", span).load(folder))


def recorded_stream(spark: SparkSession, folder: str, span: int = SPAN) -> DataFrame:
    """The same of files that come or grow, as a stream; a file must end in a whole line whenever it is looked at."""
    spark.dataSource.register(RecordedReplies)
    return with_candidate(spark.readStream.format("recorded_replies").option("span", span).load(folder))


def with_candidate(said: DataFrame) -> DataFrame:
    return said.withColumn("candidate", json_object(said["text"]))
