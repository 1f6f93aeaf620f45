"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

A document is scored against the counts of all other documents: its own
occurrences are subtracted, so a text that shares nothing with the corpus backs
off all the way.

Exploded n-grams are many times larger than the text, so they travel packed.
Documents are cut into blocks of whole documents; a row holds the distinct
n-grams of one block that fall into one hash partition.  A count table is the
group of one partition; the join gives every block the totals of its own n-grams,
in the order in which it sent them; and the terms are summed per document.  An
n-gram is sent only if both shorter ones inside it occur at least twice in the
corpus (else its own count is one, which is exact).  A very frequent n-gram costs
one entry a block, not one an occurrence.

``score_rows`` is the same by plain relations, with a row for each n-gram of each
document.  It takes several times the space of the shared folder and of shuffles.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, forget, new_path, small_batches, store

#: Tokens of a block, and n-grams of a hash partition, about.
BLOCK_TOKENS, PARTITION_GRAMS = 3 << 19, 1 << 20
#: Buckets of a table at most; with more blocks than that, a task has several.
MOST_BUCKETS = 100_000
#: N-grams of a row at least, on average.
ROW_GRAMS = 64


class Numbering(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def planes(values: np.ndarray) -> bytes:
    """Bytes of unsigned numbers by significance, which compresses well, after their number of bytes each."""
    width = 4 if not len(values) or values.max() < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel()


def partition_totals(table: pa.Table) -> pa.Table:
    """The count table of one hash partition of one level, by the block that sent each part: totals in the order in which they came."""
    level, part = table.column("level")[0].as_py(), table.column("part")[0].as_py()
    grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    _, back = np.unique(np.concatenate(grams), return_inverse=True)
    # sums of whole numbers are exact in doubles up to 2 ** 53
    sums = np.bincount(back, weights=np.concatenate([unplanes(c) for c in table.column("counts").to_pylist()])).astype(np.int64)[back]
    totals = [planes(t) for t in np.split(sums, np.cumsum([len(g) for g in grams])[:-1])]
    return pa.table({"level": pa.array([level] * len(grams), pa.int32()), "part": pa.array([part] * len(grams), pa.int64()), "block": table.column("block").combine_chunks(), "totals": pa.array(totals, pa.binary())})


def scaled(corpus_bytes: int, block_tokens: int, partition_grams: int) -> tuple[int, int]:
    """Tokens of a block and n-grams of a partition for a corpus of some size.

    A row is what one block has in one partition.  With B tokens a block and G
    n-grams a partition, N tokens make N/B blocks and N/G partitions, and a row
    holds about B G / N n-grams.  Both grow with the root of the corpus where rows
    would hold fewer than ``ROW_GRAMS``, and so does the memory that a task needs.
    """
    tokens = corpus_bytes / 6  # of a word and its space, about
    more = max(1.0, math.sqrt(ROW_GRAMS * tokens / (block_tokens * partition_grams)))
    return int(block_tokens * more), int(partition_grams * more)


def blocks(docs: DataFrame, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """``block, tokens, ids, lengths, words, vocabulary``: whole documents as numbers of words.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        known, ids, words, lengths, count, id_type = Numbering(), [], [], [], 0, None

        def block():
            vocabulary = np.array([xxhash.xxh64_intdigest(w) for w in known], dtype=np.uint64)
            values = [[(part << 32) + nth], [count], [ids], [np.array(lengths, np.int32).tobytes()], [planes(np.concatenate(words))], [vocabulary.tobytes()]]
            types = [pa.int64(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["block", "tokens", "ids", "lengths", "words", "vocabulary"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = (text or b"").lower().split()
                ids.append(own)
                words.append(np.fromiter(map(known.__getitem__, w), np.uint32, len(w)))
                lengths.append(len(w))
                count += len(w)
                if count >= block_tokens:
                    yield block()
                    known, ids, words, lengths, count, nth = Numbering(), [], [], [], 0, nth + 1
        if ids:
            yield block()

    return rows.mapInArrow(run, f"block bigint, tokens bigint, ids array<{kind}>, lengths binary, words binary, vocabulary binary")


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Block:
    """The n-grams of one block, by level.

    ``at[k]`` are the positions where an n-gram of k words ends that was sent,
    ``sent[k]`` the sorted distinct hashes, ``which[k]`` the index for each
    position, ``totals[k]`` the corpus totals by that index.
    """

    def __init__(self, row: dict, order: int):
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        words = np.frombuffer(row["vocabulary"], np.uint64)[unplanes(row["words"])] if row["tokens"] else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.place = np.arange(len(words), dtype=np.int32) - np.repeat(starts, self.lengths)
        self.order, self.words, self.gram, self.top = order, words, mix(words), 1
        self.at, self.sent, self.which, self.often, self.totals = {}, {}, {}, {}, {}

    def level(self, k: int) -> None:
        """Work out what is sent at a level, each after the one below; above two, after ``learn`` too."""
        while self.top < k:
            longer = np.zeros(len(self.words), np.uint64)
            longer[1:] = mix(self.gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.words[1:])
            self.gram, self.top = longer, self.top + 1
        fits = self.place >= k - 1
        if k > 2:
            twice = np.zeros(len(self.words), bool)
            twice[self.at[k - 1]] = self.totals[k - 1][self.which[k - 1]] >= 2
            fits[1:] &= twice[1:] & twice[:-1]
        self.at[k] = np.flatnonzero(fits).astype(np.int32)
        self.sent[k], which, self.often[k] = np.unique(self.gram[self.at[k]], return_inverse=True, return_counts=True)
        self.which[k] = which.astype(np.int32)

    def learn(self, k: int, totals: np.ndarray) -> None:
        """Take the corpus totals of what was sent; an n-gram that wasn't sent occurs once."""
        self.totals[k] = totals

    def others(self, k: int) -> np.ndarray:
        """By position: the count of the n-gram ending there in all other documents."""
        out = np.zeros(len(self.words), np.int64)
        own = self.doc[self.at[k]].astype(np.int64) * max(len(self.sent[k]), 1) + self.which[k]
        _, back, counts = np.unique(own, return_inverse=True, return_counts=True)
        out[self.at[k]] = self.totals[k][self.which[k]] - counts[back]
        return out

    def scores(self, corpus_tokens: int, alpha: float) -> np.ndarray:
        """Sum of natural logarithms of the scores of each document's words."""
        n, step = len(self.words), math.log(alpha)
        if not n:
            return np.zeros(len(self.lengths))
        most = np.minimum(self.place + 1, self.order)
        rest = np.log(np.maximum(corpus_tokens - self.lengths, 1))[self.doc]
        below = self.others(1)
        out = np.where(below > 0, np.log(np.maximum(below, 1)) + (most - 1) * step, most * step) - rest
        for k in range(2, self.order + 1):
            counts = self.others(k)
            hit = np.flatnonzero(counts > 0)
            out[hit] = np.log(counts[hit]) - np.log(below[hit - 1]) + (most[hit] - k) * step
            below = counts
        return np.bincount(self.doc, weights=out, minlength=len(self.lengths))


def totals_of(table: pa.Table, k: int) -> np.ndarray:
    """The totals of a level in the order of the sorted hashes."""
    rows = sorted((p, t) for level, p, t in zip(*(table.column(c).to_pylist() for c in ("level", "part", "totals")), strict=True) if level == k)
    return np.concatenate([unplanes(t) for _, t in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, partition_grams: int = PARTITION_GRAMS) -> DataFrame:
    """``id, tokens, log_score`` (sum of natural logarithms) per input row.

    With c(.) the count in all other rows and T their tokens, a word scores
    c(h w) / c(h) for the longest history h of at most ``order`` - 1 words with
    c(h w) > 0, times ``alpha`` for each word that the history was shortened by;
    without any history c(w) / T; and a word that no other row has scores
    ``alpha`` / T, further shortened alike.  T is at least one.

    Defined cases: null, empty and wordless texts have no tokens and score 0; a
    null id keeps its row; repeated rows are evidence for each other; an empty
    table gives an empty result; other columns aren't read.  N-grams are told
    apart by 64-bit hashes.

    Tables of the work are deleted before the result is returned.
    """
    if order < 2:
        raise ValueError("order is two at least")
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("bigint")), F.lit(0))).first()[0]
    block_tokens, partition_grams = scaled(size, block_tokens, partition_grams)
    shape = blocks(docs, id_col, text_col, block_tokens)
    kind = shape.schema["ids"].dataType.elementType.simpleString()
    first = new_path(spark, "lm-blocks")
    shape.write.option("compression", "zstd").parquet(first)
    made = spark.read.schema(shape.schema).parquet(first)
    corpus = made.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, bits = corpus["t"], max(0, math.ceil(math.log2(max(corpus["t"], 1) / partition_grams)))
    # laid out by block once, so that only the totals move when they are joined
    name = f"lm_blocks_{uuid.uuid4().hex[:12]}"
    places = min(max(corpus["n"], int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_BUCKETS)
    bucketed = new_path(spark, "lm-bucketed")
    made.write.bucketBy(places, "block").option("path", bucketed).option("compression", "zstd").saveAsTable(name)
    discard(spark, first)
    made = spark.table(name)
    sent_type = "level int, part bigint, block bigint, grams binary, counts binary"

    def sending(block: Block, number: int, levels: range):
        for k in levels:
            block.level(k)
            grams, often = block.sent[k], block.often[k]
            if not len(grams):
                continue
            part = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
            ids, first = np.unique(part, return_index=True)
            for p, a, b in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(grams)], strict=True):
                yield k, p, number, grams[a:b].tobytes(), planes(often[a:b])

    def sent_rows(rows: list) -> pa.Table:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["level", "part", "block", "grams", "counts"])

    def send_first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(sending(Block(row, order), row["block"], range(1, 3)))
                yield from sent_rows(rows).to_batches()

    def informed(left: pa.Table, right: pa.Table, top: int) -> tuple[Block, dict]:
        row = left.to_pylist()[0]
        block = Block(row, order)
        for k in range(1, top + 1):
            block.level(k)
            block.learn(k, totals_of(right, k))
        return block, row

    def send_next(level: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return sent_rows([])
            block, row = informed(left, right, level - 1)
            return sent_rows(list(sending(block, row["block"], range(level, level + 1))))

        return run

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block, row = informed(left, right, order) if left.num_rows else (None, None)
        if block is None:
            return pa.table({"id": pa.array([], left.schema.field("ids").type.value_type), "tokens": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        return pa.table({"id": left.column("ids").combine_chunks().flatten(), "tokens": pa.array(block.lengths, pa.int64()), "log_score": pa.array(block.scores(total, alpha), pa.float64())})

    def counted(sent: DataFrame, at: str) -> DataFrame:
        return store(sent.groupBy("level", "part").applyInArrow(partition_totals, "level int, part bigint, block bigint, totals binary"), at, "zstd")

    tables = [counted(made.select("block", "tokens", "ids", "lengths", "words", "vocabulary").mapInArrow(send_first, sent_type), "lm-totals")]
    for level in range(3, order + 1):
        known = reduce(DataFrame.unionByName, tables)
        more = made.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send_next(level), sent_type)
        tables.append(counted(more, "lm-totals"))
    known = reduce(DataFrame.unionByName, tables)
    scores = store(made.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(finish, f"id {kind}, tokens bigint, log_score double"), "lm-scores")
    for table in tables:
        forget(table)
    spark.sql(f"DROP TABLE {name}")
    discard(spark, bucketed)
    return scores


def score_rows(docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``score`` returns, by count tables with a row per n-gram, partitioned by hash and joined to the exploded n-grams.

    Defined cases are those of ``score``.
    """
    if order < 2:
        raise ValueError("order is two at least")
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("ws"))
    rows = store(rows.withColumn("tokens", F.size("ws").cast("bigint")), "lm-rows")
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    at = None
    for k in range(1, order + 1):
        # one row for each n-gram of each document, with its places
        each = rows.where(f"tokens >= {k}").select("row_no", F.posexplode(F.expr(f"transform(sequence(1, size(ws) - {k - 1}), i -> xxhash64(slice(ws, i, {k})))")).alias("first", "gram"))
        own = each.groupBy("gram", "row_no").agg(F.count(F.lit(1)).alias("own"), F.collect_list(F.col("first") + (k - 1)).alias("places"))
        own = store(own, f"lm-grams-{k}")
        counts = own.groupBy("gram").agg(F.sum("own").alias("n"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
        known = own.join(counts, "gram").select("row_no", F.explode("places").alias("pos"), (F.col("n") - F.col("own")).alias("c"), F.lit(k).alias("level"))
        at = known if at is None else at.unionByName(known)
    by_place = at.groupBy("row_no", "pos").agg(*[F.coalesce(F.max(F.when(F.col("level") == k, F.col("c"))), F.lit(0)).alias(f"c{k}") for k in range(1, order + 1)])
    every = rows.select("row_no", "tokens", F.explode(F.sequence(F.lit(0), F.col("tokens").cast("int") - 1)).alias("pos")).where("tokens > 0")
    found = every.join(by_place, ["row_no", "pos"], "left").na.fill(0)
    before = Window.partitionBy("row_no").orderBy("pos")
    found = found.withColumns({f"p{k}": F.lag(f"c{k}").over(before) for k in range(1, order)})
    most, step = F.least(F.col("pos") + 1, F.lit(order)), math.log(alpha)
    rest = F.log(F.greatest(F.lit(total) - F.col("tokens"), F.lit(1)))
    term = F.when(F.col("c1") > 0, F.log("c1") + (most - 1) * step - rest).otherwise(most * step - rest)
    for k in range(2, order + 1):
        term = F.when(F.col(f"c{k}") > 0, F.log(f"c{k}") - F.log(f"p{k - 1}") + (most - k) * step).otherwise(term)
    sums = found.groupBy("row_no").agg(F.sum(term).alias("log_score"))
    return rows.select("row_no", "id", "tokens").join(sums, "row_no", "left").select("id", "tokens", F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
