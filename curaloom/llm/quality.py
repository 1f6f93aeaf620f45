"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL.

A text is a sparse vector: its words and pairs of neighbouring words, hashed into
``2 ** bits`` places, with damped counts scaled to one length.  Training follows
the regularised leader coordinate by coordinate (FTRL-proximal) over a bounded
sample of labelled rows, streamed through one task.  A score is the logistic
function of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, small_batches

#: A run of letters and digits, or a run of other signs.
WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")
#: Euclidean length of a text's vector.
LENGTH = np.float32(8)
#: Words of which a task remembers the hash.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class Model:
    """Weights by place, and the intercept."""

    bits: int
    weights: np.ndarray
    bias: float

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[places] @ values, -35, 35))))


def shape(word: bytes) -> int:
    """Class of a word: 0 signs, 1 with digits, 2 all upper case, 3 capitalised, 4 other."""
    if not (word[:1].isalnum() or word[0] >= 128):
        return 0
    if any(48 <= c <= 57 for c in word):
        return 1
    return 2 if word.isupper() and len(word) > 1 else 3 if word[:1].isupper() else 4


def vector(text: bytes | None, bits: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a whole text; both empty for a text without words.

    The n-grams are words, pairs of words, and pairs of classes of words, in which
    a word that repeats the one before it is told apart.
    """
    words = WORD.findall(text or b"")
    if len(known) > REMEMBERED:
        known.clear()
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = zlib.crc32(w) << 3 | shape(w)
        hashes.append(h)
    got = np.array(hashes, dtype=np.uint64)
    one, kind = got >> np.uint64(3), got & np.uint64(7)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    classes = (kind[:-1] * np.uint64(16) + kind[1:] * np.uint64(2) + (one[:-1] == one[1:]) + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
    mixed = np.concatenate((one * np.uint64(0xD6E8FEB86659FD93), two, classes))
    places, counts = np.unique((mixed >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
    values = np.log1p(counts).astype(np.float32)
    norm = np.sqrt((values * values).sum())
    return places, values * (LENGTH / norm) if norm else values


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def follow_leader(rows, bits: int, alpha: float, beta: float, l1: float, l2: float) -> Model:
    """FTRL-proximal over an iterable of ``(places, values, label)``."""
    size = (1 << bits) + 1  # the last place is the intercept
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for places, values, label in rows:
        at, x = np.append(places, size - 1), np.append(values, 1.0)
        w = weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
        z[at] += g - s * w
        n[at] += g * g
    w = weights(np.arange(size))
    return Model(bits, w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8192, epochs: int = 6, bits: int = 18, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.0, l2: float = 1e-4) -> Model:
    """Learn from at most ``max_rows`` labelled rows outside the held-out fold.

    The sample is the labelled rows with the smallest hash of their id, so it
    doesn't depend on the order of the input.  Rows without an id, a label or a
    document are passed over; a label row that repeats counts once, and of documents
    that share an id the one with the smallest vector.  Without any row to learn
    from, every score is 0.5.
    """
    small_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("id")))
    sample = usable.withColumn("turn", F.xxhash64("id", F.lit(7))).orderBy("turn", "id", "label").limit(max_rows)
    # at most max_rows rows of three numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("x")).join(F.broadcast(sample), "id")

    def vectors(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            made = [vector(x, bits, known) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["turn", "label", "places", "vals"])

    def train(batches):
        def stream():
            for batch in batches:
                for label, places, values in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    yield np.frombuffer(places, np.int32), np.frombuffer(values, np.float32), label

        model = follow_leader(stream(), bits, alpha, beta, l1, l2)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    made = rows.select("turn", "label", "x").mapInArrow(vectors, "turn bigint, label double, places binary, vals binary")
    # a document id that repeats is one row to learn from, so the sample bounds what the one task reads
    made = made.groupBy("turn", "label").agg(F.min(F.struct("places", "vals")).alias("v")).select("turn", "label", "v.places", "v.vals")
    turns = made.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions("epoch", "turn", "label", F.xxhash64("places"))
    got = turns.select("turn", "label", "places", "vals").mapInArrow(train, "weights binary, bias double").first()
    if got is None:
        return Model(bits, np.zeros(1 << bits, dtype=np.float32), 0.0)
    return Model(bits, np.frombuffer(got["weights"], np.float32), got["bias"])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores between 0 and 1; a text without words gets the intercept's."""
    small_batches(docs.sparkSession)
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is taken; name another column for the scores")
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            scores = pa.array([model.score(*vector(x, model.bits, known)) for x in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField(out_col, T.DoubleType(), False)]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``.

    Defined cases: null, empty and wordless texts get the score of the intercept;
    a null id is not held out and is scored like any other; repeated rows are
    scored each; an empty table gives an empty result; labels, ids and other
    columns are never inputs of a score.
    """
    model = fit(docs, labels, id_col, text_col, label_col, **how)
    rows = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x")), model, "x")
    return rows.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns.

    Defined cases: null, empty and wordless texts have the score of the intercept,
    and without any row to learn from every score is 0.5; null ids and repeated
    rows are judged like any other; an empty table gives an empty result; columns
    may have any name.
    """
    model = fit(docs, labels, id_col, text_col, label_col, **how)
    name = fresh(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)
