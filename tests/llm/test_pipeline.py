"""Each stage of the pipeline against a plain version of it, on what its predecessor kept."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from curaloom.llm import quality
from curaloom.storage import store

from .helpers import awkward, empty, words
from .test_near_dedup import plain_fingerprint, plain_groups


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), "test")
        kept[name] = (before, docs)
        if name != names[-1]:
            assert docs.columns == columns
            assert docs.exceptAll(before).isEmpty()
    rows = {n: ({r["doc_id"]: r["text"] for r in a.collect()}, {r["doc_id"] for r in b.collect()}) for n, (a, b) in kept.items() if n != names[-1]}

    model = quality.fit(kept["quality"][0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    before, after = rows["quality"]
    assert after == {k for k, t in before.items() if model.score(*quality.vector(t.encode(), model.bits, {})) >= 0.3}

    before, after = rows["exact_dedup"]
    best = {}
    for k, t in before.items():
        n = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[n] = min(best.get(n, (0, 1 << 62)), (-len(t), k))
    assert after == {k for _, k in best.values()}

    before, after = rows["near_dedup"]
    fps = [(k, plain_fingerprint(t)) for k, t in before.items()]
    assert after == {k for (k, _), c in zip(fps, plain_groups(fps), strict=True) if k == c}

    before, after = rows["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = {k for k, t in before.items() if any(i in t for i in items)}
    assert not whole & after and set(before) - after == whole

    before, _ = kept["packing"]
    assert {r["doc_id"] for r in kept["packing"][1].collect()} == rows["decontamination"][1]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


TAKEN = ("__key", "__id", "__sha", "__points", "__score", "__nth", "key", "of_id", "of_sha", "of_points", "nth", "score", "gone")


def test_awkward_documents(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows and columns with the names that the work could use."""
    docs = awkward(spark)
    for name in TAKEN:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(name))
    docs, columns = store(docs, "test"), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns and docs.exceptAll(before).isEmpty(), name
        assert docs.where(F.col("key") != "c").isEmpty() and docs.where(F.col("__key") != "__key").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("start = 0").count() == docs.count()


def test_rows_without_an_id_are_never_lost_to_each_other(spark, sf_dir):
    docs = spark.createDataFrame([(None, words(30, i)) for i in range(5)] * 2 + [(7, words(30, 2)), (7, words(30, 9)), (7, words(30, 9))], "doc_id bigint, text string")
    kept = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, words(30, i)) for i in range(5) if i != 2] + [(7, words(30, 2)), (7, words(30, 9))])
    assert corpus_pipeline.drop_near_copies(spark, docs, sf_dir).count() == docs.count()


def test_empty_documents(spark, sf_dir):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0 and docs.columns == awkward(spark).columns
    assert corpus_pipeline.pack(spark, docs, sf_dir).count() == 0


def test_no_text_is_shuffled_to_drop_rows(spark, sf_dir):
    """The plans of the three stages that drop rows bring keys to the texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_benchmark_leaks):
        plan = stage(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
