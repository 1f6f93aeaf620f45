import pytest
from pyspark.sql import functions as F

from curaloom import schemas
from curaloom.operators import evaluate, lifecycle, ranking, sampling
from curaloom.config import Publish, Train
from curaloom.functions import text
from curaloom.plans import evaluation
from curaloom.vocabulary import LANGUAGES, PREFIX


def tasks(spark, count=50):
    rows = [(f"ho-{PREFIX[name]}-{i + 1:03d}", name, "T", "do it", ["held-out", "L3-composite"], (True, [f"word{i}", f"term{i}"], ["TODO", "FIXME"]), i) for name in LANGUAGES for i in range(count)]
    return spark.createDataFrame(rows, schemas.HELD_OUT_TASK + ", task_index int")


@pytest.mark.parametrize("method,first,any_", [("LoRA", 0.8, 1.0), ("DoRA", 0.8, 1.0), ("QLoRA", 0.7, 1.0), ("FewShot", 0.5, 0.9)])
def test_benchmark_of_the_stand_in(spark, method, first, any_):
    scored = evaluate.score_benchmark(tasks(spark), evaluate.PASS_RATIO[method], 5)
    got = {r["targetLanguage"]: r for r in evaluate.rates(scored).collect()}
    assert set(got) == {*LANGUAGES, None} and got[None]["taskCount"] == 150
    for r in got.values():
        assert (round(r["passAt1"], 9), round(r["passAtK"], 9), r["syntaxValid"]) == (first, any_, 1.0)


def test_acceptance(spark):
    rows = spark.createDataFrame([("function f() {} // Word", (True, ["word"], ["todo"])), ("function f() {}", (True, ["word", "x"], [])), ("function f() { TODO word", (False, ["word"], ["todo"])), ("word", (True, ["word"], [])), ("any", None)], "c string, a struct<mustParse:boolean,mustContain:array<string>,mustNotContain:array<string>>")
    got = [r[0] for r in rows.select(evaluate.acceptance_fault(F.col("a"), F.lit("JavaScript"), F.col("c"))).collect()]
    assert got == [None, "missing keyword: word", "forbidden keyword: todo", "syntax: missing export or function declaration", None]


def test_smoke_gate(spark):
    made = tasks(spark, 20).where("targetLanguage = 'HTML'").withColumn("sample", F.lit(0)).withColumn("code", evaluate.mock_response(F.lit(0.7)))
    one = evaluate.smoke_summary(made.select(evaluate.acceptance_fault(F.col("acceptanceCriteria"), F.col("targetLanguage"), F.col("code")).isNull().alias("passed")), 0.6).first()
    assert (one["taskCount"], one["passedCount"], one["passAt1"], one["gateSatisfied"]) == (20, 14, 0.7, True)
    none = evaluate.smoke_summary(made.limit(0).select(F.lit(True).alias("passed")), 0.6).first()
    assert none["passAt1"] == 0.0 and not none["gateSatisfied"]


def test_weighted_rate(spark):
    groups = spark.createDataFrame([("a", 50, 0.8), ("b", 50, 0.6)], "g string, taskCount bigint, passAt1 double")
    assert evaluate.weighted_rate(groups, "passAt1").first()[0] == pytest.approx(0.7)
    assert evaluate.weighted_rate(groups.limit(0), "passAt1").first()[0] == 0.0


def test_tag_buckets(spark):
    rows = spark.createDataFrame([(["held-out", "L3-composite"], True, True), (["L3-composite"], False, True), (["x"], None, False)], "tags array<string>, passAt1 boolean, passAt5 boolean")
    assert [tuple(r) for r in evaluate.tag_buckets(rows).collect()] == [("L3-composite", 2, 0.5, 1.0), ("untagged", 1, 0.0, 0.0)]


def test_parameter_match(spark):
    rows = spark.createDataFrame([(1101004, 1048576), (0, 1048576), (None, 5), (5, 0)], "p bigint, a bigint")
    got = [r[0] for r in rows.select(evaluate.param_match(F.col("p"), F.col("a"), 10.0)).collect()]
    assert (got[0]["deltaPercent"], got[0]["matched"]) == (5.0, True) and got[1]["footnoteRequired"] and got[2] is None and got[3] is None


def test_mock_costs(spark):
    rows = spark.createDataFrame([("LoRA", "smoke"), ("QLoRA", "ci"), ("DoRA", "smoke"), ("FewShot", "ci"), ("Other", "smoke")], "m string, p string")
    cost = evaluate.mock_costs(F.col("m"), F.col("p"), F.lit(16), F.lit(100))
    got = [tuple(r) for r in rows.select(cost["trainableParamCount"], cost["peakVramGb"], F.round(cost["durationSeconds"], 6), cost["passRatio"]).collect()]
    assert got == [(1048576, 3.2, 0.15, 0.72), (1048576, 3.1, 0.1725, 0.68), (1101004, 3.4, 0.162, 0.74), (1048576, 0.0, 0.15, 0.42), (1048576, 3.2, 0.15, 0.70)]
    speed = evaluate.mock_inference(F.col("m"), 12.5, 82.0, 1024)
    assert tuple(rows.where("m = 'QLoRA'").select(*speed.values()).first()) == (14.0, 75.44, 563.2)


def runs(spark):
    rows = [("r1", "LoRA", "Established", 0.8, 3.2, 10.0, 100, 16), ("r2", "DoRA", "Speculative", 0.8, 3.4, None, None, None), ("r3", "QLoRA", "NovelApplication", 0.7, None, None, None, 8), ("r4", "A", "Odd", 0.8, None, 1.0, 1, None), ("r5", "B", "Established", 0.7, None, None, None, None)]
    full = [(i, *r, "ds", "held-out-v1", "m", r[3], {"JavaScript": (50, r[3], 1.0, 1.0)}, (True, 0.0, 1, 1, r[0] == "r3"), [("L3", 2, 0.5, 1.0)] if r[0] == "r1" else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, f"ord int, runId string, compressionMethod string, evidenceLevel string, passAt1 double, peakVramGb double, durationSeconds double, trainableParamCount bigint, loraRank int, datasetVersion string, heldOutTestSetVersion string, studentModel string, passAt5 double, byLanguage map<string,{schemas.RATES}>, paramMatch struct<matched:boolean,deltaPercent:double,anchorParamCount:bigint,trainableParamCount:bigint,footnoteRequired:boolean>, tagBuckets array<struct<tag:string,taskCount:bigint,passAt1:double,passAt5:double>>")


def test_ranking_puts_nulls_last_and_keeps_order(spark):
    got = [r["runId"] for r in ranking.ranked(runs(spark), ord_col="ord").orderBy("rank").collect()]
    assert got == ["r1", "r2", "r4", "r3", "r5"]


def test_report(spark):
    order = ranking.ranked(runs(spark), ord_col="ord")
    notes = ranking.footnotes(runs(spark), "ord")
    assert [(n["runId"], n["reason"][:6]) for n in notes.collect()] == [("r2", "L4 Spe"), ("r3", "BR-014")]
    first = ranking.summaries(order).first()
    assert (first["rank"], first["evidenceLabel"], first["rankParameter"], first["jsPassAt1"], first["htmlPassAt1"]) == (1, "L1", "r=16", 0.8, None)
    page = ranking.markdown(order, ["w"], notes)
    assert "| 1 | LoRA | L1 | r=16 | 80.0% | — | — | 3.2 | 10.0 | 100 |" in page and "| 3 | A | Odd | — | 80.0% | — | — | — | 1.0 | 1 |" in page
    assert "## Warnings\n\n- w\n" in page and "| L3 | 2 | 50.0% | 100.0% |" in page


def test_comparability(spark):
    r = runs(spark)
    assert ranking.check_comparable(r) == []
    other = r.withColumn("datasetVersion", F.concat(F.lit("d"), "ord"))
    with pytest.raises(ranking.IncomparableRuns, match="dataset versions differ"):
        ranking.check_comparable(other)
    assert len(ranking.check_comparable(other, allow_mixed=True)) == 1
    with pytest.raises(ranking.IncomparableRuns, match="student models"):
        ranking.check_comparable(r.withColumn("studentModel", F.col("runId")), allow_mixed=True)
    assert ranking.check_comparable(other.limit(1)) == [] and ranking.check_comparable(r.limit(0)) == []


def test_states(spark):
    assert lifecycle.step("training", "Pending", "Running") == "Running"
    with pytest.raises(lifecycle.InvalidTransition, match="Pending -> Completed"):
        lifecycle.step("generation", "Pending", "Completed")
    log = spark.createDataFrame([("a", 1, "Running"), ("a", 2, "Completed"), ("b", 1, "Completed")], "run string, t int, s string")
    bad = lifecycle.illegal_transitions(log, lifecycle.transition_table(spark, "training"), "run", "s", ["t"])
    assert [(r["run"], r["previous"], r["s"]) for r in bad.collect()] == [("b", "Pending", "Completed")]
    assert [r[0] for r in log.select(lifecycle.is_terminal(F.col("s"))).collect()] == [False, False, False]


def test_budget(spark):
    calls = spark.createDataFrame([(i, 1.0) for i in range(5)], "ord int, c double")
    costed = lifecycle.running_cost(calls, [], ["ord"], F.col("c"), 3.0)
    assert [r["over"] for r in costed.orderBy("ord").collect()] == [False, False, False, True, True]
    assert lifecycle.within_budget(costed, [], ["ord"]).count() == 3


def test_sample_sizes(spark):
    assert [sampling.sample_size(n, 0.05, 1) for n in (100, 10, 0, 21)] == [5, 1, 0, 2]
    got = spark.createDataFrame([(100,), (10,), (0,), (21,)], "n bigint").select(sampling.sample_size_column(F.col("n"), 0.05, 1)).collect()
    assert [r[0] for r in got] == [5, 1, 0, 2]


def test_samples_repeat(spark):
    rows = spark.range(100).select(F.col("id"), F.col("id").alias("ord"))
    a = [r["id"] for r in sampling.review_sample(rows, "id", "run-x").collect()]
    assert len(a) == 5 and a == [r["id"] for r in sampling.review_sample(rows.repartition(7), "id", "run-x").collect()]
    drawn = [r["id"] for r in sampling.parity_sample(rows, "ord", "run-x").collect()]
    assert drawn == sampling.random_places(100, "run-x", 5)
    assert sorted(sampling.shuffled_places(10, 42, 10)) == list(range(10))


def test_reviews(spark):
    raw = spark.createDataFrame([('{"decisions": {"a": "Accept", "b": "REJECT", "c": "maybe"}}',)], "value string")
    said = lifecycle.decisions(raw)
    assert {(r["exampleId"], r["decision"], r["valid"]) for r in said.collect()} == {("a", "accept", True), ("b", "reject", True), ("c", "maybe", False)}
    sample = spark.createDataFrame([("a",), ("b",)], "id string")
    one = lifecycle.review_outcome(sample, said.where("valid"), F.lit(40), 0.05).first()
    assert (one["sampleSize"], one["acceptedInSample"], one["rejectedInSample"], one["approved"], one["finalState"]) == (2, 1, 1, False, "Failed")
    fine = lifecycle.review_outcome(sample, lifecycle.auto_accept(sample), F.lit(40), 0.05).first()
    assert fine["approved"] and fine["br005ManualReviewSatisfied"]
    assert not lifecycle.review_outcome(sample, lifecycle.auto_accept(sample), F.lit(400), 0.05).first()["br005ManualReviewSatisfied"]
    assert lifecycle.review_outcome(sample, said.where("exampleId = 'a'"), F.lit(40), 0.05).first()["missing"] == 1


def test_publishing_rules(spark):
    cols = "state string, syntaxPassRate double, br005 boolean, reviewed boolean, reviewStatus string, reviewBr005 boolean, acceptedCount bigint"
    rows = spark.createDataFrame([("Completed", 0.95, False, True, "Approved", True, 1500), ("Filtering", None, None, False, None, None, 10)], cols)
    good, bad = [r[0] for r in rows.select(lifecycle.publish_failures(Publish())).collect()]
    assert good == []
    assert bad == ["run state must be Completed, got Filtering", "manual-review-manifest.json is required", "manual review BR-005 threshold not satisfied", "accepted count 10 below minimum 1500", "syntax pass rate 0.00% below minimum 90%"]
    versions = spark.createDataFrame([("ds-2026-01-01-js-v1", "JavaScript"), ("ds-2026-01-01-js-v1", "HTML"), ("ds-2026-01-01-mixed-v2", "HTML"), ("ds-26-01-01-js-v1", "HTML"), (None, "HTML")], "v string, l string")
    got = [r[0] for r in versions.select(lifecycle.version_fault(F.col("v"), F.col("l"), Publish().version_pattern)).collect()]
    assert [g and g[:22] for g in got] == [None, "dataset version suffix", None, "dataset version must m", "dataset version must m"]


def test_samples_of_all_sizes_are_the_smallest_hashes(spark):
    import hashlib

    rows = spark.range(300).withColumnRenamed("id", "k").repartition(5)
    order = sorted(range(300), key=lambda k: hashlib.sha256(f"s|{k}".encode()).hexdigest())
    for size in (0, 1, 7, 299, 300, 500):
        assert [r["k"] for r in sampling.hash_sample(rows, "k", "s", size).collect()] == order[:size]


def test_places_are_those_of_one_sorted_list(spark):
    rows = spark.createDataFrame([(i * 7 % 101, "ab"[i % 10 == 0]) for i in range(101)], "k int, g string").repartition(4)
    assert {(r["k"], r["place"]) for r in sampling.numbered(rows, ["k"]).collect()} == {(i, i) for i in range(101)}
    got = sampling.numbered(rows, ["k"], group="g").collect()
    for g in "ab":
        own = sorted((r["k"], r["place"]) for r in got if r["g"] == g)
        assert [p for _, p in own] == list(range(len(own)))
    assert sampling.numbered(rows.limit(0), ["k"]).count() == 0


def test_a_method_with_adapters_needs_a_rank(spark, tmp_path):
    rows = spark.createDataFrame([("LoRA", None), ("DoRA", 8), ("FewShot", None), (None, None)], "m string, r int")
    assert [r[0] for r in rows.select(evaluate.hyper_parameter_fault(F.col("m"), F.col("r"))).collect()] == ["lora-rank required for LoRA", None, None, None]
    with pytest.raises(ValueError, match="lora-rank required for QLoRA"):
        evaluation.train(spark, "r", "v", "QLoRA", str(tmp_path), str(tmp_path), Train(lora_rank=None), "smoke", "2026-06-20")


def test_shares_halfway_go_to_the_even_digit(spark):
    shares = [0.0625, 0.1875, 0.5, 1 / 3, 0.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "x double").select(text.percent(F.col("x"))).collect()]
    assert got == [f"{x:.1%}" for x in shares]
