"""Audit of how text filters interact, over all orders in which they can be applied.

A document's outcome depends on which filters it fails, so a part of the corpus is
told by 32 counts: documents by the set of filters that they fail (a mask of five
bits), and the same for good and for toxic ones.  These histograms are stacked as
rows of integers and multiplied by 0/1 matrices of 32 masks by 600 columns, one
for each step of each of the 120 orders.  The corpus is read once; no order is
ever run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import once, small_batches, store, text_or_empty

#: Letters of the filters; the first is the lowest bit of a mask.
FILTERS = "ABCDE"
MASKS, STEPS = 2 ** len(FILTERS), len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_failures(text: str, words: str) -> list[Column]:
    """The conditions under which a text fails filters A to D, from columns that hold it and its words."""
    n, capitals = F.size(words).cast("bigint"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    return [n < 200, F.size(F.array_distinct(words)).cast("bigint") * 100 < n * 50, capitals * 100 > F.length(text).cast("bigint") * 3, F.col(text).rlike("[#$%&*|]")]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, mask`` of every row.

    Filter E fails a row whose text a row with a smaller id has.  Texts are compared
    by SHA-256, so none is moved; rows of a much repeated text meet their group in a
    join that adaptive execution can split.
    """
    rows = once(docs, F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), x=text_or_empty(text_col))
    rows = once(rows, F.col("id"), F.col("part"), F.col("x"), ws=F.regexp_extract_all("x", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures("x", "ws"))), F.lit(0))
    facts = store(rows.select("id", "part", bits.alias("mask"), F.unhex(F.sha2("x", 256)).alias("digest")), "filter-facts")
    first = facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # the second key makes the join deal both sides out anew
    keyed = facts.withColumn("head", F.xxhash64("digest")).join(first.select(F.xxhash64("digest").alias("head"), "digest", "first"), ["head", "digest"], "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return keyed.select("id", "part", (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


@cache
def incidence() -> dict[str, np.ndarray]:
    """The matrices of 32 masks by 600 columns (order, then step), and the filter of each column."""
    kept, removed, redundant, unique = (np.zeros((MASKS, len(ORDERS) * STEPS), dtype=np.int64) for _ in range(4))
    letters = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    for column, letter in enumerate(letters):
        before = letters[column - column % STEPS : column]
        earlier = sum(1 << int(b) for b in before)
        for mask in range(MASKS):
            fails, gone = mask >> int(letter) & 1, bool(mask & earlier)
            kept[mask, column] = not fails and not gone
            removed[mask, column] = fails and not gone
            redundant[mask, column] = fails and gone
            unique[mask, column] = mask == 1 << int(letter)
    return {"kept": kept, "removed": removed, "redundant": redundant, "unique": unique, "letters": letters}


def outcomes(stacked: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of parts by column from histograms of shape (3, parts, 32): all documents, good and toxic ones."""
    m = incidence()
    everyone, good, toxic = stacked
    removed = everyone @ m["removed"]
    by_filter = np.stack([removed[:, m["letters"] == f].sum(axis=1) for f in range(STEPS)], axis=1)
    return {"kept": everyone @ m["kept"], "removed": removed, "redundant": everyone @ m["redundant"], "unique_fails": everyone @ m["unique"], "good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"], "shapley": by_filter[:, m["letters"]]}


def multiplied(histograms: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``part, cells`` (mask, n, good, toxic; 32 at most) times the matrices."""
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(n, pa.int64()) for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])
    for batch in histograms:
        parts = batch.column(0).to_pylist()
        stacked = np.zeros((3, len(parts), MASKS), dtype=np.int64)
        for i, cells in enumerate(batch.column(1).to_pylist()):
            for c in cells:
                stacked[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
        told = outcomes(stacked)
        names = [np.repeat(np.array(parts, dtype=object), len(ORDERS) * STEPS), np.tile(np.repeat(np.array(ORDERS, dtype=object), STEPS), len(parts)), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS) * len(parts))]
        columns = [pa.array(v, type=f.type) for v, f in zip([*names, *[told[f.name].ravel() for f in list(schema)[3:]]], schema, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def histograms(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by what they fail, and how many of them are labelled good or toxic."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("bigint")).alias("good"), F.max((F.col("toxic") == 1).cast("bigint")).alias("toxic"))
    return failed.join(marks, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each step of each order of the filters does to each part; columns as in ``RESULT``.

    Filters fail a text of under 200 words (A), with fewer distinct words than half
    of its words (B), with more than 3 % capital letters A to Z (C), with one of
    ``#$%&*|`` (D), and one that a smaller id has, in any part (E).

    Defined cases: a null text is empty; a null part is the part with the empty
    name; a null id has no label, is no copy and makes none; rows that repeat an id
    count each, and none of them is a copy of another by that id; a document with
    several labels is good or toxic if any says so; an empty table gives an empty
    result; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    cells = histograms(failures(docs, id_col, text_col, part_col), labels, id_col)
    each = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most
    return each.mapInArrow(multiplied, RESULT)
