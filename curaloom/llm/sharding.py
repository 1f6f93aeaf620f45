"""Shards of nearly equal size by histogram sort.

Rows get a place in one total order (``key``).  Splitters between shards are found
by counting: each round counts the exact bytes below every candidate boundary of
the order, over all partitions, and looks closer only where a splitter is still
too far from its target.  Then the rows are exchanged once.

The order goes by the digest of the text, so equal texts lie next to each other
and share a shard unless a splitter must fall between them; then by the digest of
the id; then by the row itself.  However many rows are equal, the order can be
cut between any two of them.

Everything is an expression of Spark SQL.  The driver gets a row for each splitter
that is still open, never one for a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .shared import fresh, store, text_or_empty

#: Hexadecimal digits of a key that each of its three parts has, and digits that are told apart after each round.
PART = 16
ROUNDS = (3, 6, 9, 12, 16, 19, 22, 25, 28, 32, 35, 38, 41, 44, 48)
#: Bytes that a row has besides its text.
OVERHEAD = 16


def row_key(text: Column, row_id: Column, row_no: Column) -> Column:
    """The place of a row in the order, as 48 hexadecimal digits."""
    digits = lambda c: F.substr(F.md5(c.cast("string").cast("binary")), F.lit(1), F.lit(PART))
    return F.concat(digits(text), digits(F.coalesce(row_id.cast("string"), F.lit(""))), digits(row_no))


def row_size(text: str) -> Column:
    """UTF-8 bytes of a text (none for null) and what any row has besides."""
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + OVERHEAD).cast("bigint")


def splitters(keys: DataFrame, shards: int, one_in: int = 100) -> list[str]:
    """The least keys of all shards but the first, from a table of ``key`` and ``size``.

    A splitter stands at the edge of a cell of keys, the nearer one of the cell that
    its target lies in.  Cells are made smaller, round by round, until the edge is
    within one part in ``one_in`` of a shard's size, or a cell holds one row: a row is
    never cut, so its nearer edge is the nearest there is.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = total // (one_in * shards)
    found = [""] * (shards - 1)
    # target, its cell so far, bytes below that cell
    still = {k: (total * k // shards, "", 0) for k in range(1, shards) if total * k // shards > 0}
    for digits in ROUNDS:
        if not still:
            break
        cells = sorted({cell for _, cell, _ in still.values()})
        near = keys.where(F.substr("key", F.lit(1), F.lit(len(cells[0]))).isin(cells)) if cells[0] else keys
        counted = near.groupBy(F.substr("key", F.lit(1), F.lit(digits)).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        counted = counted.withColumn("within", F.substr("cell", F.lit(1), F.lit(len(cells[0]))))
        so_far = F.sum("bytes").over(Window.partitionBy("within").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        edges = counted.withColumn("upper", so_far).withColumn("lower", F.col("upper") - F.col("bytes"))
        asked = keys.sparkSession.createDataFrame([(k, target - below, cell) for k, (target, cell, below) in still.items()], "k int, target bigint, within string")
        hits = edges.join(F.broadcast(asked), "within").where("lower < target AND target <= upper")  # a row for each splitter
        for r in hits.select("k", "cell", "lower", "upper", "rows").collect():
            target, _, below = still[r["k"]]
            down, up = target - below - r["lower"], below + r["upper"] - target
            if min(down, up) <= slack or r["rows"] == 1 or digits == ROUNDS[-1]:
                found[r["k"] - 1] = r["cell"] if down <= up else r["cell"] + "g"  # "g" comes after all digits
                del still[r["k"]]
            else:
                still[r["k"]] = (target, r["cell"], below + r["lower"])
    return found


def shard_of(key: Column, bounds: Sequence[str], first: int = 0) -> Column:
    """The number of splitters that aren't above a key, by a search that halves them."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(key < bounds[middle], shard_of(key, bounds[:middle], first)).otherwise(shard_of(key, bounds[middle + 1 :], first + middle + 1))


def assign(docs: DataFrame, shards: int = 40, one_in: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row; slots count from 0 within a shard, in the order of keys.

    Texts aren't moved: a row travels as its key and three numbers.  Sizes of shards
    differ from an equal share by two parts in ``one_in`` at most, where rows are
    smaller than that; else by a row at either end.

    Defined cases: a null text has no bytes and the checksum of the empty text; a
    null id is ordered as an empty one; repeated rows are rows of their own; of rows
    equal in text and id any comes first; with fewer rows than shards some shards
    are empty; an empty table gives an empty result; other columns aren't read.
    """
    if shards < 1:
        raise ValueError("there is one shard at least")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), row_size(text_col).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), row_key(text, F.col(id_col), F.monotonically_increasing_id()).alias("key"))
    rows = store(rows, "shard-keys")
    placed = rows.withColumn("shard", shard_of(F.col("key"), splitters(rows, shards, one_in)))
    return numbered(placed, ["key"], "slot", "shard").select("id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, one_in: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as Parquet files in a folder ``shard=N`` for each shard, ordered by key; returns what was written.

    Splitters are found first; then the texts are exchanged once.  The cases are
    those of ``assign``; a column ``shard`` of the input is replaced.
    """
    key, row, size = fresh(docs, "key"), fresh(docs, "row"), fresh(docs, "size")
    held = store(docs.withColumn(row, F.monotonically_increasing_id()), "shard-rows")  # a row keeps its number
    keyed = held.withColumns({key: row_key(text_or_empty(text_col), F.col(id_col), F.col(row)), size: row_size(text_col)})
    bounds = splitters(keyed.select(F.col(key).alias("key"), F.col(size).alias("size")), shards, one_in)
    dealt = keyed.withColumn("shard", shard_of(F.col(key), bounds)).repartitionByRange("shard", key).sortWithinPartitions("shard", key)
    dealt.drop(key, row, size).write.mode("errorifexists").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
