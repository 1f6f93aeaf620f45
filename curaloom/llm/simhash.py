"""Near-duplicates by SimHash fingerprints, found with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments.  Of two differing bits at
most, some segment holds none and another holds one at most.  So for each of the
six ordered pairs of segments a key is made of the first one as it is and a
Golay codeword index of the second: the nearest one on the side that is stored,
that and up to five further ones on the side that asks.  Fingerprints that link
meet under some key; the join then verifies the distance.

Equal fingerprints are one node before any key is made, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .components import components
from .shared import rest_of, small_batches, store

#: Lowest bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles hashed at once, to bound memory on very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text as an unsigned number; zero for a text without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    line, n = b" ".join(w), len(w) - words + 1
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[words - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a signed long), one row per input row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x, words, seed) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def keys(fps: DataFrame) -> DataFrame:
    """``fp``, ``key``, ``stored`` for each fingerprint: 6 keys to store, up to 30 more to ask with."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            bits = fp.view(np.uint64)
            part = [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
            out = []
            for i in range(3):
                for j in range(3):
                    if i != j:
                        head = ((i * 3 + j) << 34) | (part[i] << 12)
                        out.append((fp, head | golay.nearest_index(part[j]), True))
                        far = golay.further_indices(part[j])
                        for c in range(5):
                            here = far[:, c] >= 0
                            out.append((fp[here], head[here] | far[here, c], False))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([np.full(len(o[0]), o[2]) for o in out]))], names=["fp", "key", "stored"])

    return fps.select("fp").mapInArrow(run, "fp bigint, key bigint, stored boolean")


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints at ``bits`` (2 at most) or fewer differing bits.

    Defined cases: a null fingerprint has no key and no link; repeated ones are
    linked once; an empty table gives no pairs; other columns aren't read.

    A fingerprint has at most 2,080 others within two bits, so pairs grow with the
    number of different fingerprints, however many documents share one.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the segments and keys are made for two differing bits at most")
    made = store(keys(fps.where("fp IS NOT NULL")), "keys")
    near = (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") != F.col("r.fp")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= bits)
    pairs = made.where("stored").alias("l").join(made.alias("r"), near)
    return pairs.select(F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits), ``component_id`` per input row.

    ``component_id`` is the smallest id that links reach, the row's own included.

    Defined cases: a null text and one without words have fingerprint zero and
    link like any other; a null id keeps its row, and is the smallest of a group
    only where all its ids are null; repeated rows are equal nodes; an empty
    table gives an empty result; other columns aren't read.
    """
    base = store(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = store(base.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes, bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = store(named, "named")
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = store(named.join(whole, "root").select("fp", "component_id"), "components")
    return base.join(found, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, all columns kept.

    Defined cases: rows without an id stay; rows that share an id stay together if
    the id is the smallest of any of their groups; null and empty texts and texts
    without words are one group; an empty table gives an empty result; columns may
    have any name.
    """
    by_id = near_groups(docs, id_col, text_col, **how).where("id IS NOT NULL").groupBy("id").agg(F.bool_or(F.col("id") == F.col("component_id")).alias("stays"))
    return rest_of(docs, id_col, by_id.where("NOT stays").select("id"))
