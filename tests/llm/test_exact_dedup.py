import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from curaloom.llm import exact_dedup

from .helpers import awkward, empty


def plain(rows):
    """(id, keep, size, sha) per row, and how many rows stay."""
    groups = defaultdict(list)
    for k, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k is None, k if k is not None else 0, k))
    out = []
    for norm, own in groups.items():
        keep = min(own)[3]
        out += [(k, keep, len(own), hashlib.sha256(norm.encode()).hexdigest()) for *_, k in own]
    return sorted(out, key=str), len(groups)


def check(spark, docs, **how):
    got = exact_dedup.exact_groups(docs, **how).collect()
    want, groups = plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == groups


def test_awkward(spark):
    check(spark, awkward(spark))
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_identifiers_that_collide_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, docs, id_bits=4, at_least=16, at_most=64)
    check(spark, awkward(spark), id_bits=1)


def test_rows_that_stay(spark):
    docs = awkward(spark)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.select("text").collect()]
    assert len(norms) == len(set(norms)) == plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])[1]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab.,;é😀\n ", max_size=60), max_size=8))
def test_chunks_join_to_the_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", exact_dedup.chunks(rows["t"], 3, 9).alias("c")).collect():
        assert "".join(r["c"]) == r["t"] and all(len(c) <= 10 for c in r["c"])
