import itertools
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from curaloom.llm import golay, simhash
from curaloom.llm.components import components

from .helpers import awkward, empty


def plain_fingerprint(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Smallest id by union and find over all pairs; rows are (id, fingerprint)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return [least[find(i)] for i in range(len(rows))]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = {(k, f"{fp:016x}", c) for (k, fp), c in zip(rows, plain_groups(rows), strict=True)}
    assert {tuple(r) for r in simhash.near_groups(docs).collect()} == want


def test_links_of_planted_neighbours(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(6):
            other = base
            for b in rng.sample(range(64), rng.randint(1, 3)):
                other ^= 1 << b
            fps.add(other)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(3)).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want and len(want) > 100


@settings(max_examples=300, deadline=None)
@given(st.integers(0, (1 << 23) - 1), st.integers(-1, 22))
def test_neighbours_share_a_codeword(x, bit):
    y = x if bit < 0 else x ^ 1 << bit
    pair = np.array([x, y])
    near, far = golay.nearest_index(pair), golay.further_indices(pair)
    assert near[0] in {near[1], *far[1]} or near[1] in {near[0], *far[0]}


def test_code_is_perfect():
    nearest, five = golay.tables()
    assert sorted({bin(int(p)).count("1") for p in nearest}) == [0, 1, 2, 3] and len(set(nearest.tolist())) == 2048
    assert (five != 0).all(axis=1).sum() == 1771


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i * 7919 % 501}" for i in range(3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = dict((r["node"], r["root"]) for r in components(edges).collect())
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_awkward(spark):
    got = simhash.near_groups(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    blank = {r["id"]: r for r in got if r["fingerprint"] == "0" * 16}
    assert {0, 1, 2} <= set(blank) and {r["component_id"] for r in blank.values()} == {0}
    assert simhash.near_groups(empty(spark)).count() == 0
    kept = simhash.keep_one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 1 not in ids and ids.count(5) == 3 and 6 not in ids and 7 not in ids  # repeated rows share their id
