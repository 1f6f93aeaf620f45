"""Whole flows over temporary folders: files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from curaloom import cli, config, schemas
from curaloom.config import Benchmark, Expansion, Gates, Phase, Publish, Review, Scope, Smoke, Train
from curaloom.operators import generate
from curaloom.plans import curation, evaluation
from curaloom.sources import readers, writers
from curaloom.streaming import events as streams
from curaloom.vocabulary import LANGUAGES, PREFIX

NOW = "2026-06-20T10:00:00+00:00"
SCOPE = Scope("v1", "held-out-v1", ({"id": "JS-001", "language": "JavaScript", "difficulty": "L1", "tags": ["array"], "pattern": "Map"},), tuple({"id": f"HO-{PREFIX[n].upper()}-{i:03d}", "language": n, "pattern": f"Thing {i}", "keywords": [f"Zword{i}", f"zterm{i}", "extra"]} for n in LANGUAGES for i in range(12)), {n: ("frameworks",) for n in LANGUAGES})
LOOSE = Gates(duplicate=False)


def scope_yaml(tmp_path):
    yaml = pytest.importorskip("yaml")
    raw = {"version": "v1", "heldOutTestSetVersion": "held-out-v1", "targetLanguages": {n: {"outOfScopePhase1": ["frameworks"]} for n in LANGUAGES}, "trainingTopics": list(SCOPE.training), "heldOutTopics": list(SCOPE.held_out)}
    (tmp_path / "scope.yaml").write_text(yaml.safe_dump(raw))
    return tmp_path / "scope.yaml"


def seed(i, language="JavaScript", prefix="seed"):
    return {"id": f"{prefix}-{PREFIX[language]}-{i:03d}", "targetLanguage": language, "instruction": f"Write something useful number {i}", "code": "export const a = {};", "tags": ["array", "L1-trivial"], "metadata": {"author": "me", "created": "2026-01-01", "source": "manual"}}


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_seeds_come_in_the_order_of_their_paths(spark, tmp_path):
    for i in (2, 1):
        write(tmp_path / "javascript" / f"seed-js-00{i}.json", seed(i))
    write(tmp_path / "javascript" / "REF-js-001.json", seed(1, prefix="REF"))
    write(tmp_path / "html" / "seed-html-001.json", seed(1, "HTML"))
    write(tmp_path / "javascript" / "sub" / "broken.json", "{ not json")
    got = readers.seeds(spark, f"file://{tmp_path}/javascript").orderBy("ord").collect()
    assert [r["id"] for r in got] == ["seed-js-001", "seed-js-002", None] and got[2]["corrupt"]
    assert readers.seeds(spark, f"file://{tmp_path}/javascript", True).count() == 4
    assert readers.draft_seeds(spark, f"file://{tmp_path}").count() == 4
    assert readers.examples(spark, f"file://{tmp_path}/html/seed-html-001.json").first()["id"] == "seed-html-001"


def test_candidates_keep_file_and_line_order(spark, tmp_path):
    odd = json.dumps(seed(1) | {"instruction": "line break"}, ensure_ascii=False)
    write(tmp_path / "batch-002.jsonl", json.dumps(seed(3)) + "\n")
    write(tmp_path / "batch-001.jsonl", odd + "\n\n  \n{bad\n" + json.dumps(seed(2)) + "\r\n")
    write(tmp_path / "other.jsonl", json.dumps(seed(9)))
    got = readers.raw_candidates(spark, f"file://{tmp_path}").orderBy("ord").collect()
    assert [r["id"] for r in got] == ["seed-js-001", None, "seed-js-002", "seed-js-003"] and " " in got[0]["instruction"]
    assert readers.json_lines(spark, f"file://{tmp_path}/none.jsonl", schemas.EXAMPLE).isEmpty()


def held_out(spark, folder):
    tasks = generate.held_out_tasks(SCOPE.held_out_table(spark))
    for name in LANGUAGES:
        rows = [json.loads(r["j"]) for r in tasks.where(F.col("targetLanguage") == name).orderBy("task_index").select(F.to_json(F.struct("id", "targetLanguage", "topicId", "instruction", "tags", "acceptanceCriteria")).alias("j")).collect()]
        write(folder / f"{PREFIX[name]}.jsonl", "\n".join(map(json.dumps, rows)) + "\n")
    write(folder / "manifest.json", {"heldOutTestSetVersion": "held-out-v1", "taskCount": 36, "immutable": True})
    return f"file://{folder}"


def test_held_out_tasks(spark, tmp_path):
    root = held_out(spark, tmp_path / "ho")
    assert readers.held_out_tasks(spark, root).count() == 36
    few = readers.held_out_tasks(spark, root, 2, "HTML").orderBy("task_index").collect()
    assert [(r["id"], r["task_index"]) for r in few] == [("ho-html-001", 0), ("ho-html-002", 1)]
    assert few[0]["acceptanceCriteria"]["mustContain"] == ["zword0", "zterm0"] and few[0]["instruction"] == "Build a complete HTML5 page for: Thing 0."
    with pytest.raises(readers.VersionMismatch):
        readers.held_out_manifest(spark, root, "held-out-v2")
    with pytest.raises(FileNotFoundError):
        readers.held_out_tasks(spark, f"file://{tmp_path}")


def test_from_generation_to_a_report(spark, tmp_path):
    root = f"file://{tmp_path}"
    expansion = Expansion(target_count=30, batch_size=25, min_gold_seeds=0)
    versions = {}
    for name in LANGUAGES[:2]:
        code = PREFIX[name]
        versions[name] = f"ds-2026-06-20-{code}-v1"
        log = curation.run_language(spark, name, root, SCOPE, NOW, expansion, LOOSE, Review(), Publish(min_accepted=10), f"gen-{code}-v1", versions[name], auto_approve=True)
        assert not log.failed and [s for s, _, _ in log.rows] == ["generate", "filter", "prepare-review", "submit-review", "publish"], log.rows
    rows, manifest = readers.published(spark, f"{root}/published", versions["HTML"])
    assert rows.count() == 30 and manifest["languages"] == ["HTML"] and manifest["filterManifestSnapshot"]["runId"] == "gen-html-v1"
    with pytest.raises(writers.PublishError, match="already exists"):
        curation.publish(spark, f"{root}/drafts/gen-js-v1", versions["JavaScript"], f"{root}/published", Publish(min_accepted=10), "me", NOW)
    with pytest.raises(writers.PublishError, match="does not match language"):
        curation.publish(spark, f"{root}/drafts/gen-js-v1", "ds-2026-06-20-html-v9", f"{root}/published", Publish(min_accepted=10), "me", NOW)
    with pytest.raises(writers.PublishError, match="at least two"):
        curation.publish_mixed(spark, [versions["HTML"]], "ds-2026-06-20-mixed-v9", f"{root}/published", Publish(), "me", NOW)
    mixed = curation.publish_mixed(spark, list(versions.values()), "ds-2026-06-20-mixed-v1", f"{root}/published", Publish(), "me", NOW, f"{root}/events")
    assert mixed["countsByLanguage"] == {"JavaScript": 30, "HTML": 30} and not mixed["br005Satisfied"]
    assert readers.published(spark, f"{root}/published", "ds-2026-06-20-mixed-v1")[1]["languages"] == ["HTML", "JavaScript"]
    assert len(readers.read_json(spark, f"{root}/published/published-index.json")) == 3
    with pytest.raises(readers.NotPublished):
        readers.published(spark, f"{root}/published", "ds-none")
    assert readers.manifests(spark, f"{root}/published").count() == 3

    tasks = held_out(spark, tmp_path / "ho")
    phase3 = Phase("v1", {}, {"experiments": {m: {"compressionMethod": m, "evidenceLevel": "Established", "skipTrain": m == "FewShot", "runIdTemplates": {"train": f"train-{m}-{{profile}}", "benchmark": f"bench-{m}-{{profile}}"}} for m in ("LoRA", "QLoRA", "DoRA", "FewShot")}})
    common = dict(version="ds-2026-06-20-mixed-v1", profile="smoke", published=f"{root}/published", checkpoints=f"{root}/checkpoints", held_out=tasks, benchmarks=f"{root}/bench", config=Train(), bench=Benchmark(), now=NOW, events=f"{root}/events")
    wave = evaluation.run_wave(spark, ["LoRA", "QLoRA", "DoRA", "FewShot", "Nope"], phase3, **common)
    assert [ok for _, ok, _ in wave] == [True] * 4 + [False]
    ids = phase3.run_ids("benchmark", "smoke")
    anchor = evaluation.anchor_count(spark, phase3, "LoRA", f"{root}/bench", f"{root}/checkpoints", "smoke")
    assert anchor == 1048576
    phase4 = Phase("v1", {"heldOutTestSetVersion": "held-out-v1", "paramMatchTolerancePercent": 10}, {})
    out = evaluation.evaluate_runs(spark, ids, tasks, f"{root}/bench", phase4, anchor, f"{root}/review/phase4.json", NOW)
    assert out["readinessPassed"] and len(out["evaluations"]) == 4
    lost = evaluation.evaluate_runs(spark, [*ids, "none"], tasks, f"{root}/bench", phase4, anchor, f"{root}/review/x.json", NOW)
    assert not lost["readinessPassed"] and lost["evaluations"] == []
    table = evaluation.report(spark, ids, f"{root}/bench", f"{root}/reports/wave.md", NOW, events=f"{root}/events")
    assert [r["compressionMethod"] for r in table["ranking"]] == ["LoRA", "DoRA", "QLoRA", "FewShot"]
    assert [n["compressionMethod"] for n in table["footnotes"]] == ["FewShot"]
    page = (tmp_path / "reports" / "wave.md").read_text()
    assert "# Wave 1 Method Ranking" in page and "| L3-composite | 36 |" in page
    log = readers.events(spark, f"{root}/events")
    counts = {r["event"]: r["count"] for r in log.groupBy("event").count().collect()}
    assert counts == {"DatasetPublished": 3, "TrainingRunStarted": 3, "TrainingRunCompleted": 3, "FewShotBaselineRegistered": 1, "BenchmarkRunStarted": 4, "BenchmarkRunCompleted": 4, "ExperimentReportGenerated": 1}
    smoke = evaluation.smoke(spark, "smoke-1", versions["HTML"], "HTML", f"{root}/published", tasks, f"{root}/smoke", Smoke(eval_tasks=10, min_pass_at_1=0.9, hints=("more seeds",)), NOW)
    assert smoke["passAt1"] == 0.7 and smoke["iterationHints"] == ["more seeds"]


def test_filter_writes_what_it_decides(spark, tmp_path):
    made = generate.mock_candidates(spark, "JavaScript", 8, "2026-06-20").drop("batch", "method", "inputTokens", "outputTokens")
    root = f"file://{tmp_path}"
    found = curation.filter_run(made, "r1", f"{root}/drafts", config.Taxonomy(), SCOPE, Gates(similarity=0.6), NOW, rejected_log=f"{root}/log")
    assert (found["candidateCount"], found["acceptedCount"], found["rejectionsByReason"], found["state"]) == (8, 1, {"DUPLICATE": 7}, "Filtering")
    rejected = spark.read.json(f"{root}/drafts/r1/rejected.jsonl")
    assert rejected.count() == 7 and "code" in rejected.schema["example"].dataType.names
    assert spark.read.json(f"{root}/log").where("runId = 'r1'").count() == 7
    with pytest.raises(writers.PublishError):
        curation.filter_run(made, "r2", f"{root}/drafts", config.Taxonomy(), SCOPE, Gates(), NOW, upstream_state="Failed")
    with pytest.raises(ValueError, match="cannot infer"):
        curation.filter_run(made.limit(0), "r3", f"{root}/drafts", config.Taxonomy(), SCOPE, Gates(), NOW)
    empty = curation.filter_run(made.limit(0), "r4", f"{root}/drafts", config.Taxonomy(), SCOPE, Gates(), NOW, language="HTML")
    assert empty["syntaxPassRate"] == 0.0 and empty["targetLanguage"] == "HTML"


def test_budget_ends_a_generation(spark, tmp_path):
    expansion = Expansion(target_count=100, batch_size=10, min_gold_seeds=0, max_budget_usd=0.05)
    seeds = spark.createDataFrame([], schemas.EXAMPLE)
    done = curation.expand(spark, "r", "JavaScript", f"file://{tmp_path}", expansion, seeds, "2026-06-20")
    assert done["failed"] and done["state"] == "Failed" and 0 < done["candidateCount"] < 10 and done["spentUsd"] > 0.05
    with pytest.raises(curation.SeedsInsufficient):
        curation.expand(spark, "r", "JavaScript", f"file://{tmp_path}", Expansion(), seeds, "2026-06-20")


def test_rejected_review(spark, tmp_path):
    root = f"file://{tmp_path}"
    made = generate.mock_candidates(spark, "HTML", 40, "2026-06-20").drop("batch", "method", "inputTokens", "outputTokens")
    curation.filter_run(made, "r1", f"{root}/drafts", config.Taxonomy(), SCOPE, LOOSE, NOW)
    queue = curation.prepare_review(spark, "r1", f"{root}/drafts/r1", f"{root}/review", Review(), NOW)
    assert queue["sampleSize"] == 2 and queue["status"] == "Pending"
    said = spark.createDataFrame([(queue["sampleExampleIds"][0], "accept")], "exampleId string, decision string")
    with pytest.raises(ValueError, match="missing decisions for 1"):
        curation.submit_review(spark, "r1", f"{root}/drafts/r1", f"{root}/review", Review(), said, "me", NOW)
    both = said.union(spark.createDataFrame([(queue["sampleExampleIds"][1], "reject")], "exampleId string, decision string"))
    done = curation.submit_review(spark, "r1", f"{root}/drafts/r1", f"{root}/review", Review(), both, "me", NOW)
    assert done["status"] == "Rejected" and done["finalState"] == "Failed"
    assert readers.read_json(spark, f"{root}/drafts/r1/filter-manifest.json")["state"] == "Failed"
    with pytest.raises(ValueError, match="not pending"):
        curation.submit_review(spark, "r1", f"{root}/drafts/r1", f"{root}/review", Review(), both, "me", NOW)
    with pytest.raises(writers.PublishError, match="was not approved"):
        curation.publish(spark, f"{root}/drafts/r1", "ds-2026-06-20-html-v1", f"{root}/published", Publish(min_accepted=1), "me", NOW)


def test_benchmark_prefers_the_evaluation(spark, tmp_path):
    write(tmp_path / "a" / "results.json", {"runId": "a", "passAt1": 0.5, "compressionMethod": "LoRA"})
    write(tmp_path / "a" / "evaluation.json", {"runId": "a", "passAt1": 0.6})
    write(tmp_path / "b" / "results.json", {"runId": "b", "trainableParamCount": 7})
    got = readers.benchmark_runs(spark, f"file://{tmp_path}", ["b", "a"]).orderBy("ord").collect()
    assert [(r["runId"], r["passAt1"], r["compressionMethod"], r["evidenceLevel"]) for r in got] == [("b", 0.0, "Unknown", "Established"), ("a", 0.6, "Unknown", "Established")]
    with pytest.raises(FileNotFoundError):
        readers.benchmark_runs(spark, f"file://{tmp_path}", ["c"])


def test_topics(spark, tmp_path):
    training, held = SCOPE.training_table(spark), SCOPE.held_out_table(spark)
    matrix = generate.topic_matrix(training, held)
    assert matrix.count() == 37 and generate.shared_topics(training, held).isEmpty()
    writers.csv(matrix, f"file://{tmp_path}/matrix")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/matrix").where("in_held_out = 'yes'").count() == 36
    writers.text_lines(generate.blocklist(held), f"file://{tmp_path}/block.txt", ["# head"])
    text = (tmp_path / "block.txt").read_text().split("\n")
    assert text[0] == "# head" and text[1] == "HO-JS-000 [JavaScript]: Thing 0 | zword0, zterm0, extra"
    assert generate.held_out_summary(SCOPE, "HTML").endswith("(and 4 more held-out patterns — see config/scope-boundary.yaml)")
    shots = generate.few_shots(spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")).first()[0]
    assert [json.loads(x)["id"] for x in shots.split("\n\n---\n\n")] == ["a", "b"]


def test_configuration(tmp_path):
    found = config.scope(scope_yaml(tmp_path))
    assert found.held_out[0]["id"] == "HO-JS-000" and found.keywords()[0] == ("JavaScript", 0, "HO-JS-000", 0, "zword0") and len(found.keywords()) == 108
    import yaml

    write(tmp_path / "gates.yaml", yaml.safe_dump({"version": "v2", "gates": {k: True for k in ("schemaValidation", "syntaxValidation", "lintPass", "instructionQuality", "duplicateCheck", "heldOutLeak")} | {"llmJudge": {"enabled": True, "minScore": 0.5}}, "thresholds": {"duplicateSimilarity": 0.9, "instructionMinLength": 5}, "vaguePhrases": ["Help Me"], "imperativeVerbs": ["Write"], "publishDefaults": {"minAcceptedPerLanguage": 3, "minSyntaxPassRate": 0.5}}))
    own = config.gates(tmp_path / "gates.yaml")
    assert own.judge and own.similarity == 0.9 and own.vague_phrases == ("help me",) and own.min_accepted == 3
    write(tmp_path / "train.yaml", yaml.safe_dump({"defaultProfile": "ci", "defaults": {"studentModel": "s", "dataSchedule": "MixedLanguages", "compressionMethod": "LoRA", "loraRank": 8, "batchSize": 2, "learningRate": 1e-3, "epochs": 2}, "profiles": {"ci": {"maxSteps": 1, "maxTrainExamples": 2, "seeds": [1]}}}))
    assert config.train(tmp_path / "train.yaml").profile("ci")["maxSteps"] == 1
    with pytest.raises(ValueError):
        config.Train().profile("none")
    assert config.run_id("gen-{lang}-v{wave}", lang="js", wave=1) == "gen-js-v1" and config.first_filled([], lambda: None, lambda: ["x"], ["y"]) == ["x"]


def test_command_line(tmp_path):
    a = cli.parser().parse_args(["report", "export", "--run-ids", "a", "b", "--benchmarks", "x", "--output", "y.md"])
    assert a.run_ids == ["a", "b"] and not a.allow_mixed
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["train"])


def test_event_stream(spark, tmp_path):
    log = f"file://{tmp_path}/events"
    made = [{"event": "A", "timestamp": f"2026-06-{d:02d}T10:00:00+00:00", "runId": "r"} for d in (1, 1, 2)]
    writers.append_events(made, spark, log)
    writers.append_events([{"event": "B", "timestamp": "2026-06-05T00:00:00+00:00"}], spark, log)
    writers.append_events([{"event": "B", "timestamp": "2026-06-09T00:00:00+00:00"}], spark, log)
    query = streams.counts(streams.once_each(streams.read_log(spark, log)), delay=None).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(str(r["start"])[:10], r["event"]): r["events"] for r in spark.table("daily").collect()}
    assert got[("2026-06-01", "A")] == 1 and got[("2026-06-02", "A")] == 1  # the repeated event counts once


def test_gates_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [seed(i) | {"id": f"syn-js-{i:04d}", "tags": ["array", "L1-trivial"], "metadata": {"author": "a", "created": "b", "source": "synthetic"}} for i in range(3)] + [{"id": "bad"}]
    write(tmp_path / "in" / "x.jsonl", "\n".join(map(json.dumps, rows)))
    from curaloom.operators import gates as gating

    gate = lambda batch: gating.cascade(batch, config.Taxonomy(), LOOSE, SCOPE.keywords())
    place = f"file://{tmp_path}"
    streams.filter_stream(spark, f"{place}/in", f"{place}/cp", gate, f"{place}/ok", f"{place}/no").awaitTermination(180)
    assert spark.read.parquet(f"{place}/ok").count() == 3 and spark.read.parquet(f"{place}/no").first()["reasonCode"] == "SCHEMA_INVALID"


def test_replies_of_a_teacher(spark):
    def teacher(system, user):
        return ("no object" if user == "silent" else '```json\n{"id": "syn-js-0001", "instruction": "' + user + '"}\n```'), 10, 5, "fake"

    prompts = spark.createDataFrame([(0, "s", "do it"), (1, "s", "silent")], "ord bigint, system string, user string")
    said = generate.replies(prompts, teacher, attempts=3).orderBy("ord").collect()
    assert [(r["inputTokens"], r["candidate"] is None) for r in said] == [(10, False), (30, True)]
    got = generate.parsed_replies(generate.replies(prompts, teacher), "JavaScript", "2026-06-20").collect()
    assert [(r["instruction"], r["targetLanguage"], r["metadata"]["source"]) for r in got] == [("do it", "JavaScript", "synthetic")]
    pool = generate.shot_pool(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",)], "id string"))
    assert [r["id"] for r in pool.collect()] == ["b"]
    assert generate.system_prompt("{{OUT_OF_SCOPE}}|{{HELD_OUT_SUMMARY}}", SCOPE, "HTML").startswith("- frameworks|- Thing 0\n")


def test_rules(spark):
    from curaloom.operators import rules

    words = spark.createDataFrame([("dedup",), ("sql query",)], "keyword string")
    own = spark.createDataFrame([(3, "c", "deduplicate", False), (1, "a", "", True), (2, "b", "SQL", False), (4, "d", "other", False), (5, "c", "dedup", False)], "ord int, rule string, trigger string, always boolean")
    assert [r["rule"] for r in rules.resolve(words, own).collect()] == ["a", "b", "c"]


def test_smoke_step_ends_the_pipeline(spark, tmp_path):
    root = f"file://{tmp_path}"
    fine = dict(spark=spark, language="HTML", root=root, scope=SCOPE, now=NOW, expansion=Expansion(target_count=5, min_gold_seeds=0), gates=LOOSE, review=Review(), rules=Publish(min_accepted=1), run_id="r", version="ds-2026-06-20-html-v1", auto_approve=True)
    log = curation.run_language(**fine, smoke=lambda: {"gateSatisfied": False, "passAt1": 0.5})
    assert log.rows[-1] == ("smoke-train", False, "pass@1 50.0%") and log.failed
    again = curation.run_language(**fine | {"run_id": "r2"})
    assert again.rows[-1][:2] == ("publish", False)  # the version exists
    few = curation.run_language(**fine | {"run_id": "r3", "expansion": Expansion(min_gold_seeds=50)})
    assert few.rows[0][:2] == ("generate", False) and "need >= 50" in few.rows[0][2]
