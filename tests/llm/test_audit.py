import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curaloom.llm import audit

from .helpers import awkward, empty


def plain_fails(rows):
    """The letters of the filters that each (id, text, part) fails."""
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    out = []
    for k, t, part in rows:
        x, ws = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        hit = [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", x)) > 3 * len(x), bool(re.search("[#$%&*|]", x)), k is not None and least[x] < k]
        out.append((k, part or "", {f for f, h in zip("ABCDE", hit, strict=True) if h}))
    return out


def plain(rows, labels):
    """Every order applied one step after the other."""
    good, toxic = ({k for k, *v in labels if k is not None and v[i] == 1} for i in (0, 1))
    parts = defaultdict(list)
    for k, part, fails in plain_fails(rows):
        parts[part].append((k, fails))
    out = []
    for part, docs in parts.items():
        told, shares = [], Counter()
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                shares[f] += len(gone)
                redundant = sum(f in fails for _, fails in docs) - sum(f in fails for _, fails in left)
                left = [d for d in left if f not in d[1]]
                told.append((part, "".join(order), step, len(left), len(gone), redundant, sum(fails == {f} for _, fails in docs), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)))
        out += [(*t, shares[t[1][t[2] - 1]]) for t in told]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_awkward(spark):
    docs = awkward(spark)
    labels = [(0, 1, 0), (5, 1, 1), (5, 0, None), (6, None, 1), (8, 1, 0), (None, 1, 1), (99, 1, 1)]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert got(audit.audit(docs, labels_of(spark, labels))) == plain(rows, labels)
    assert audit.audit(empty(spark), labels_of(spark, labels)).count() == 0
    assert got(audit.audit(docs, labels_of(spark, []))) == plain(rows, [])


TEXTS = ["a " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(220)), "x # y", "", None, "ONE", " ".join(f"w{i}" for i in range(200)) + " %"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(TEXTS), st.sampled_from([None, "", "en", "de"])), max_size=14), st.lists(st.tuples(st.integers(0, 6), st.sampled_from([0, 1, None]), st.sampled_from([0, 1, None])), max_size=5))
def test_any_documents(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert got(audit.audit(docs, labels_of(spark, labels))) == plain(rows, labels)


def test_bounds_are_exact(spark):
    """199 and 200 words, half of the words distinct, three capitals in a hundred characters."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (199, 200)] + ["a b " * 1, "a a a b ", "a a b b", "ABC" + "x" * 97, "ABCD" + "x" * 96, "a b c", "a\x0bb\x1cc"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["id"]: {f for i, f in enumerate("ABCDE") if r["mask"] >> i & 1} for r in audit.failures(docs).collect()}
    assert found == {k: fails for k, _, fails in plain_fails(rows)}


@pytest.mark.parametrize("name", ["kept", "removed", "redundant", "unique"])
def test_matrices(name):
    m = audit.incidence()
    assert m[name].shape == (32, 600) and set(m[name].ravel()) <= {0, 1}
    # what is neither kept after a step nor removed there was removed before
    assert ((m["kept"] + m["removed"]) <= 1).all() and (m["redundant"] * m["removed"] == 0).all()
