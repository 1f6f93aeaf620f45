import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curaloom.llm import sharding

from .helpers import awkward, empty


def check(rows, texts, shards, one_in=100):
    """Sizes and checksums, gapless slots, and shards as near to an equal share as their rows allow."""
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in rows) == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in texts)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(sizes.values()) / shards, max((r["size"] for r in rows), default=0)
    spare = 2 * max(share / one_in, largest / 2) + 2
    assert all(abs(sizes[s] - share) <= spare for s in range(shards))


def test_awkward(spark):
    docs = awkward(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for shards in (1, 7, 40):
        check(sharding.assign(docs, shards).collect(), texts, shards)
    assert sharding.assign(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, 0)


def test_a_third_of_all_rows_is_one_text(spark):
    """Rows that are equal in text, or in id as well, are cut where they must be; other equal texts stay together."""
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).when(F.col("id") % 3 == 1, F.concat(F.lit("own "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("pair "), F.floor(F.col("id") / 6).cast("string"))).alias("text"))
    found = sharding.assign(rows, 12).collect()
    check(found, [(r["doc_id"], r["text"]) for r in rows.collect()], 12)
    assert len({r["shard"] for r in found if r["id"] is None}) > 6


def test_copies_share_a_shard_where_sizes_allow(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sharding.assign(docs, 4, one_in=10).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").collect()
    by = defaultdict(set)
    for r in found:
        by[r["text"]].add(r["shard"])
    assert sum(len(s) > 1 for s in by.values()) <= 3  # of three splitters each cuts one group at most


@settings(max_examples=7, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=40), st.integers(1, 9))
def test_any_sizes(spark, sizes, shards):
    rows = [(i % 5, "x" * n) for i, n in enumerate(sizes)]
    check(sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), shards).collect(), rows, shards)


def test_splitters_are_where_sorting_puts_them(spark):
    keys = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), (F.col("id") % 50 + 16).alias("size")).select(F.substr("k", F.lit(1), F.lit(48)).alias("key"), "size")
    bounds, rows = sharding.splitters(keys, 16, one_in=1000), sorted((r["key"], r["size"]) for r in keys.collect())
    total, below, place = sum(s for _, s in rows), 0, 0
    for k, bound in enumerate(bounds, 1):
        while place < len(rows) and rows[place][0] < bound:
            below, place = below + rows[place][1], place + 1
        assert abs(below - total * k / 16) <= 33  # half of the largest row


def test_files(spark, tmp_path):
    docs = awkward(spark)
    back = sharding.write_shards(docs, f"{tmp_path}/shards", 3)
    assert sorted(back.columns) == sorted([*docs.columns, "shard"])
    plain = lambda df: Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    assert plain(back) == plain(docs)
    sizes = [r["n"] for r in back.groupBy("shard").agg(F.sum(sharding.row_size("text")).alias("n")).collect()]
    largest = max(len((r["text"] or "").encode()) + 16 for r in docs.collect())
    assert max(sizes) - min(sizes) <= 2 * largest
