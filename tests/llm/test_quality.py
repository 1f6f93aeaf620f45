import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from curaloom.llm import quality
from curaloom.llm.queries import QUERIES

from .helpers import awkward, empty


def test_contract_and_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op2_quality_ftrl"](spark, d).toPandas()
    docs, labels = pd.read_parquet(f"{d}/documents.parquet"), pd.read_parquet(f"{d}/labels.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.95 and both.predicted[both.quality == 1].mean() > 0.99


def test_leader_learns_a_plain_rule():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        label = int(rng.random() < 0.5)
        rows.append((np.unique(np.append(rng.integers(10, 200, 20), label)).astype(np.int32), None, label))
    rows = [(p, np.ones(len(p), np.float32), y) for p, _, y in rows]
    m = quality.follow_leader(rows, 8, 0.5, 1.0, 0.0, 1e-4)
    assert np.mean([(m.score(p, v) > 0.5) == y for p, v, y in rows]) > 0.98


def test_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["id"] in (0, 1, 2)}) == 1  # no words: the intercept
    assert quality.classify(empty(spark), labels).count() == 0
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_order_of_rows_does_not_matter(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    a = quality.fit(docs, labels)
    b = quality.fit(docs.repartition(5, "source"), labels.orderBy("quality"))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


MASK = (1 << 64) - 1


def plain_vector(text, bits):
    """Counts of hashed n-grams in plain integers, damped and scaled."""
    kinds, ones = [], []
    for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+", text):
        sign = not re.match(rb"[A-Za-z0-9\x80-\xff]", w)
        letters = [c for c in w if chr(c).isascii() and chr(c).isalpha()]
        upper = bool(letters) and all(65 <= c <= 90 for c in letters)
        kinds.append(0 if sign else 1 if any(48 <= c <= 57 for c in w) else 2 if upper and len(w) > 1 else 3 if 65 <= w[0] <= 90 else 4)
        ones.append(zlib.crc32(w))
    grams = [a * 0xD6E8FEB86659FD93 for a in ones]
    grams += [(a * 0x9E3779B97F4A7C15 & MASK) ^ (b * 0xC2B2AE3D27D4EB4F & MASK) for a, b in zip(ones, ones[1:], strict=False)]
    grams += [(16 * k + 2 * m + (a == b) + 1) * 0x165667B19E3779F9 for k, m, a, b in zip(kinds, kinds[1:], ones, ones[1:], strict=False)]
    counts = Counter((g & MASK) >> (64 - bits) for g in grams)
    values = {p: math.log1p(n) for p, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {p: 8 * v / norm for p, v in values.items()}


def plain_leader(rows, size, alpha, beta, l1, l2):
    """FTRL-proximal, coordinate by coordinate on dense lists; the last place is the intercept."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for x, label in rows:
        x = {**x, size: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def some_texts(sf_dir):
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").text.tolist()[:60]
    return texts + ["", "one", "A b. c!! 12 x1 ÄÖ é 日本語 WORD Word word word", "\x00 \x1f", "a " * 500]


def test_vectors_against_plain_counts(sf_dir):
    known = {}
    for text in some_texts(sf_dir):
        places, values = quality.vector(text.encode(), 18, known)
        want = plain_vector(text.encode(), 18)
        assert dict(zip(places.tolist(), values.tolist(), strict=True)).keys() == want.keys()
        assert all(abs(want[p] - v) < 1e-4 for p, v in zip(places.tolist(), values.tolist(), strict=True))


def test_leader_against_a_dense_one(sf_dir):
    bits, known = 10, {}
    texts = [(t.encode(), i % 2) for i, t in enumerate(some_texts(sf_dir))] * 2
    for l1 in (0.0, 0.3):
        model = quality.follow_leader(((*quality.vector(t, bits, known), y) for t, y in texts), bits, 0.7, 1.0, l1, 1e-3)
        want = plain_leader([(plain_vector(t, bits), y) for t, y in texts], 1 << bits, 0.7, 1.0, l1, 1e-3)
        assert max(abs(a - b) for a, b in zip([*model.weights.tolist(), model.bias], want, strict=True)) < 1e-3
        t = texts[0][0]
        dot = want[-1] + sum(want[p] * v for p, v in plain_vector(t, bits).items())
        assert abs(model.score(*quality.vector(t, bits, known)) - 1 / (1 + math.exp(-dot))) < 1e-3


def test_an_id_that_repeats_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "good plain words"), (2, "bad bad bad"), *[(3, f"copy {i % 4}") for i in range(400)]], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1)], "doc_id bigint, quality int")
    first = min((quality.vector(f"copy {i}".encode(), 18, {}) for i in range(4)), key=lambda v: (v[0].tobytes(), v[1].tobytes()))
    one = spark.createDataFrame([(1, "good plain words"), (2, "bad bad bad"), *[(3, f"copy {i}") for i in range(4) if np.array_equal(quality.vector(f"copy {i}".encode(), 18, {})[0], first[0])]], "doc_id bigint, text string")
    a, b = quality.fit(docs, labels), quality.fit(one, labels.distinct())
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias and a.weights.any()
