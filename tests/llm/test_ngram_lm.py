import math
from collections import Counter

import numpy as np
import pyarrow as pa

from curaloom.llm import ngram_lm

from .helpers import awkward, empty, words


def plain(texts, order, alpha=0.4):
    docs = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for t in texts]
    grams = [Counter(tuple(d[i : i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1)) for d in docs]
    total, tokens = sum(grams, Counter()), sum(map(len, docs))
    out = []
    for d, own in zip(docs, grams, strict=True):
        c = lambda g: total[g] - own[g]  # noqa: B023, E731
        rest, s = max(tokens - len(d), 1), 0.0
        for i in range(len(d)):
            most = min(order, i + 1)
            for k in range(most, 0, -1):
                g = tuple(d[i - k + 1 : i + 1])
                if c(g) > 0:
                    s += math.log(c(g) / (c(g[:-1]) if k > 1 else rest)) + (most - k) * math.log(alpha)
                    break
            else:
                s += most * math.log(alpha) - math.log(rest)
        out.append((len(d), round(s, 6)))
    return out


def check(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = [(r["tokens"], round(r["log_score"], 6)) for r in ngram_lm.score(docs, **how).orderBy("id").collect()]
    assert got == plain(texts, how.get("order", 3))


TEXTS = [words(30, 1), words(30, 1), words(30, 1) + " end", words(50, 2), "a a a a b", "a a b", None, "", "solo", "ÄB ab AB"]


def test_orders(spark):
    for order in (2, 3, 4):
        check(spark, TEXTS, order=order)


def test_small_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "ROW_GRAMS", 0)
    check(spark, TEXTS * 3, block_tokens=40, partition_grams=16)


def test_several_blocks_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "MOST_BUCKETS", 1)
    monkeypatch.setattr(ngram_lm, "ROW_GRAMS", 0)
    check(spark, TEXTS * 2, block_tokens=30, partition_grams=16)


def test_blocks_without_some_lengths(spark):
    check(spark, [None, "", "one"])
    check(spark, ["one", "two words", "one", "", "one"], block_tokens=1, partition_grams=1)
    check(spark, ["", None])


def test_rows_give_the_same(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    for order in (2, 3):
        got = [(r["tokens"], round(r["log_score"], 6)) for r in ngram_lm.score_rows(docs, order=order).orderBy("id").collect()]
        assert got == plain(TEXTS, order)
    assert ngram_lm.score_rows(docs.limit(0)).count() == 0


def test_counts_beyond_32_bits():
    """A word of three blocks with nearly 2 ** 32 occurrences each, and the score that uses its count."""
    big = np.array([(1 << 32) - 2, 1], np.uint64)
    sent = pa.table({"level": pa.array([1] * 3, pa.int32()), "part": pa.array([0] * 3), "block": pa.array([7, 8, 9]), "grams": [np.array([5, 6 + i], np.uint64).tobytes() for i in range(3)], "counts": [ngram_lm.planes(big)] * 3})
    got = ngram_lm.partition_totals(sent)
    assert [ngram_lm.unplanes(t).tolist() for t in got.column("totals").to_pylist()] == [[3 * ((1 << 32) - 2), 1]] * 3
    block = ngram_lm.Block({"lengths": np.array([2], np.int32).tobytes(), "words": ngram_lm.planes(np.array([0, 0])), "vocabulary": np.array([5], np.uint64).tobytes(), "tokens": 2}, 2)
    for k in (1, 2):
        block.level(k)
    block.learn(1, np.array([3 * ((1 << 32) - 2)]))
    block.learn(2, np.array([1]))
    one = math.log(3 * ((1 << 32) - 2) - 2) - math.log(1 << 40)
    assert abs(block.scores((1 << 40) + 2, 0.4)[0] - (2 * one + math.log(0.4))) < 1e-9


def test_rows_of_blocks_stay_filled():
    """Blocks and partitions grow with the root of the corpus, and not below it."""
    assert ngram_lm.scaled(10**9, 1 << 20, 1 << 20) == (1 << 20, 1 << 20)
    for size in (10**14, 10**16):
        b, g = ngram_lm.scaled(size, 1 << 20, 1 << 20)
        assert b * g / (size / 6) >= 63 and b < 2 * math.sqrt(64 * size / 6)


def test_nothing_is_left_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    assert ngram_lm.score(docs).count() == len(TEXTS)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_awkward(spark):
    got = ngram_lm.score(awkward(spark), block_tokens=1000, partition_grams=500).collect()
    assert len(got) == awkward(spark).count() and all(r["log_score"] <= 0 for r in got)
    assert {r["tokens"] for r in got if r["id"] in (0, 1, 2)} == {0}
    assert ngram_lm.score(empty(spark)).count() == 0
