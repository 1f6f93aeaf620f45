"""Packing documents into training sequences: shortest pack first over the length histogram.

Documents are tokenised once and cut into full sequences and a rest.  Only the
histogram of piece lengths (one count for each length up to the size of a
sequence) comes to the driver.  Lengths are placed longest first, each into the
emptiest packs that have room, by updating counts of packing patterns: a step
either fills a whole group of equal packs or uses up a length, so there are at
most two groups for each length, whatever the number of documents.  The patterns
are joined back to the pieces by length and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, store


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None = None, pattern: str | None = None):
    """A function from text to an array of ids, as ``tokenizers`` gives them without special tokens.

    With ``ranks`` (the same vocabulary as ranks) and the ``pattern`` of its
    pieces, texts go through ``tiktoken``, which yields the same ids several times
    faster.  A text that holds the string of an added token is left to
    ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    strings = [t.content for t in slow.get_added_tokens_decoder().values()]

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks is None:
        return by_tokenizers
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def by_ranks(text: str) -> np.ndarray:
        if any(s in text for s in strings):
            return by_tokenizers(text)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return by_ranks


def pieces(docs: DataFrame, path: str, ranks: str | None, pattern: str | None, size: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """The cut documents: ``id, start, length, ids_crc32, doc_tokens, part, nth`` and, if asked for, ``ids``.

    ``nth`` counts the pieces of one length within the task ``part``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        encode, part, seen = encoder(path, ranks, pattern), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            at, made, ids_out = [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    cut = ids[start : start + size]
                    at.append(row)
                    made.append((start, len(cut), zlib.crc32(cut.tobytes()), len(ids), part, seen[len(cut)]))
                    seen[len(cut)] += 1
                    if with_ids:
                        ids_out.append(cut.astype(np.int32))
            columns = [pa.array([m[k] for m in made], pa.int64()) for k in range(6)]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, nth bigint" + ", ids array<int>" * with_ids)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of every packing pattern, by shortest pack first."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {size: []}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, groups in by_room.items() if groups and r >= length), default=None)
            if room is None:
                by_room.setdefault(size - length, []).append((left, (length,)))
                break
            count, pattern = by_room[room].pop()
            used = min(count, left)
            left -= used
            by_room.setdefault(room - length, []).append((used, (*pattern, length)))
            if count > used:
                by_room[room].append((count - used, pattern))
    return [group for room in sorted(by_room) for group in by_room[room]]


def slots(groups: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, rank after the last, first sequence, offset)`` of each place in each pattern."""
    out, used, base = [], defaultdict(int), 0
    for count, lengths in groups:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + count, base, offset))
            used[length] += count
            offset += length
        base += count
    return out


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``size`` tokens.

    Returns a row per piece: ``id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` (and ``ids``).  Each document ends with ``end_id``; its
    pieces are full sequences and one rest.

    Defined cases: a null or empty text is the end id alone; a null id or a
    repeated row is packed like any other; a text of any length is cut into
    pieces; an empty table gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    made = store(pieces(docs, path, ranks, pattern, size, end_id, id_col, text_col, with_ids), "pieces")
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length up to size
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    places = spark.createDataFrame(slots(patterns(histogram, size)), "length bigint, lo bigint, hi bigint, base bigint, offset bigint")
    ranked = made.join(starts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    # at most two patterns for each length, so the size of this side is bounded by ``size`` alone
    hit = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])
    placed = ranked.join(F.broadcast(places), hit)
    return placed.select("id", "start", ranked["length"].alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *["ids"] * with_ids)
