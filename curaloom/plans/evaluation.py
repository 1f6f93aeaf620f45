"""Train (as a stand-in), benchmark, analyse and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Benchmark, Phase, Smoke, Train
from ..operators import evaluate, lifecycle, ranking, sampling
from ..sources import readers, writers
from ..storage import store
from ..vocabulary import COMPRESSION_METHODS, LANGUAGES, RANKED_METHODS

# The layout of the Markdown documents.
SUMMARY = """\
# Benchmark {runId}

- Checkpoint: `{checkpointRunId}`
- Method: {compressionMethod}
- Dataset: {datasetVersion}
- Test set: {heldOutTestSetVersion}

## Aggregate

- Pass@1: **{passAt1:.1%}**
- Pass@5: **{passAt5:.1%}**
- Syntax validity: {syntaxValidityRate:.1%}

## By language

| Language | Pass@1 | Pass@5 | Syntax |
|----------|--------|--------|--------|
{lines}
"""
EVALUATION = """\
# Evaluation {runId}

- Method: {compressionMethod}
- Pass@1: **{passAt1:.1%}**
- Pass@5: **{passAt5:.1%}**
- Syntax validity: {syntaxValidityRate:.1%}
"""
INFERENCE = """\
## Inference cost

- Latency: {meanLatencyMsPerToken} ms/token
- Throughput: {throughputTokensPerSec} tokens/s
- Model size: {modelSizeMb} MB
"""
BUCKETS = """\
## Tag buckets

| Tag | Tasks | Pass@1 | Pass@5 |
|-----|-------|--------|--------|
{lines}
"""
BUCKET = "| {tag} | {taskCount} | {passAt1:.1%} | {passAt5:.1%} |"
FOOTNOTE = """\
## BR-014 footnote

The trained parameters are {deltaPercent:.1f}% away from the anchor's: read this comparison with that in mind.
"""
OVERVIEW = """\
# Evaluation Results Summary

Profile: **{profile}**

| Method | Pass@1 | Evaluation |
|--------|--------|------------|
{lines}"""


def training_rows(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """A fixed part of a dataset to train on."""
    return sampling.hash_sample(rows, "id", seed, limit)


def train(spark: SparkSession, run_id: str, version: str, method: str, published: str, checkpoints: str, config: Train, profile: str, now: str, rank: int | None = None, seed: int | None = None, events: str | None = None, evidence: str = "Established", student: str | None = None, schedule: str | None = None) -> dict:
    """A checkpoint manifest of a stand-in run over a published dataset; written, with its events."""
    if method not in COMPRESSION_METHODS:
        raise ValueError(f"unknown compression method: {method}")
    rank = config.lora_rank if rank is None else rank
    if rank is None and method in RANKED_METHODS:
        raise ValueError(f"lora-rank required for {method}")
    if rank is not None and rank <= 0 and method != "FewShot":
        raise ValueError("loraRank must be positive")
    own = config.profile(profile)
    seed = own["seeds"][0] if seed is None else seed
    rows, source = readers.published(spark, published, version)
    count = training_rows(rows, own["maxTrainExamples"], seed).count()
    state = lifecycle.step("training", "Pending", "Running")
    one = spark.createDataFrame([(method, profile, rank, count)], "method string, profile string, rank int, n bigint")
    one = one.withColumn("steps", evaluate.steps(F.col("n"), config.batch_size, config.epochs, own["maxSteps"]))
    row = one.select("steps", *[c.alias(k) for k, c in evaluate.mock_costs(F.col("method"), F.col("profile"), F.col("rank"), F.col("steps")).items()]).first()
    manifest = {
        "runId": run_id, "datasetVersion": version, "studentModel": student or config.student_model, "compressionMethod": method, "loraRank": rank, "profile": profile, "trainExampleCount": count, "epochs": config.epochs,
        "steps": row["steps"], "seed": seed, "finalLoss": 0.38, "trainableParamCount": row["trainableParamCount"], "peakVramGb": row["peakVramGb"], "durationSeconds": round(row["durationSeconds"], 3), "backend": "mock-trainer", "completedAt": now,
        **({"targetLanguage": source["languages"][0]} if len(source["languages"]) == 1 else {}), "dataSchedule": schedule or config.data_schedule,
        "trainingState": lifecycle.step("training", state, "Completed"), "dryRun": True, "evidenceLevel": evidence, "heldOutTestSetVersion": "held-out-v1",
    }
    writers.write_json(spark, f"{checkpoints}/{run_id}/checkpoint-manifest.json", manifest)
    writers.write_json(spark, f"{checkpoints}/{run_id}/adapter-config.json", {"method": method, "rank": rank, "targetModules": ["q_proj", "v_proj"]})
    if events:
        head = {"timestamp": now, "runId": run_id, "datasetVersion": version}
        writers.append_events([{"event": "TrainingRunStarted", **head, "compressionMethod": method, "profile": profile, "seed": seed}, {"event": "TrainingRunCompleted", **head, **{k: manifest[k] for k in ("durationSeconds", "peakVramGb", "trainableParamCount")}}], spark, events)
    return manifest


def few_shot_baseline(spark: SparkSession, run_id: str, version: str, published: str, checkpoints: str, config: Train, profile: str, now: str, events: str | None = None, evidence: str = "Established") -> dict:
    """A checkpoint manifest of a model that isn't trained."""
    readers.published(spark, published, version)
    manifest = {"runId": run_id, "datasetVersion": version, "studentModel": config.student_model, "compressionMethod": "FewShot", "profile": profile, "trainableParamCount": 0, "peakVramGb": 0.0, "durationSeconds": 0.0, "backend": "few-shot", "completedAt": now, "trainingState": "Completed", "dryRun": True, "evidenceLevel": evidence}
    writers.write_json(spark, f"{checkpoints}/{run_id}/checkpoint-manifest.json", manifest)
    if events:
        writers.append_events([{"event": "FewShotBaselineRegistered", "timestamp": now, "runId": run_id, "datasetVersion": version}], spark, events)
    return manifest


def smoke(spark: SparkSession, run_id: str, version: str, language: str, published: str, held_out: str, out: str, config: Smoke, now: str) -> dict:
    """Train the stand-in on a part of one dataset and score a few held-out tasks; hints where it isn't enough."""
    rows, _ = readers.published(spark, published, version)
    count = training_rows(rows, config.max_examples, config.seed).count()
    tasks = readers.held_out_tasks(spark, held_out, config.eval_tasks, language)
    made = tasks.withColumn("sample", F.lit(0)).withColumn("code", evaluate.mock_response(F.lit(evaluate.OTHER_RATIO)))
    made = made.withColumn("reason", evaluate.acceptance_fault(F.col("acceptanceCriteria"), F.col("targetLanguage"), F.col("code")))
    results = store(made.select(F.col("id").alias("taskId"), "task_index", F.col("reason").isNull().alias("passed"), "reason"), "smoke")
    writers.json_lines(results.orderBy("task_index").drop("task_index"), f"{out}/{run_id}/smoke-eval.jsonl")
    one = evaluate.smoke_summary(results, config.min_pass_at_1).first()
    steps = max(1, count // config.batch_size) * config.epochs
    manifest = {"runId": run_id, "datasetVersion": version, "targetLanguage": language, "trainExampleCount": count, "steps": steps, "taskCount": one["taskCount"], "passedCount": one["passedCount"], "passAt1": one["passAt1"], "gateSatisfied": one["gateSatisfied"], "completedAt": now, **({} if one["gateSatisfied"] else {"iterationHints": list(config.hints)})}
    writers.write_json(spark, f"{out}/{run_id}/smoke-manifest.json", manifest)
    return manifest


def benchmark(spark: SparkSession, run_id: str, checkpoint: str, held_out: str, out: str, config: Benchmark, now: str, events: str | None = None, max_tasks: int | None = None) -> dict:
    """Score the stand-in of a checkpoint on all held-out tasks; results, summary and events are written."""
    readers.held_out_manifest(spark, held_out, config.test_set_version)
    own = readers.checkpoint(spark, checkpoint)
    method = own.get("compressionMethod", "LoRA")
    state = lifecycle.step("benchmark", "Pending", "Running")
    tasks = readers.held_out_tasks(spark, held_out, max_tasks)
    scored = store(evaluate.score_benchmark(tasks, evaluate.PASS_RATIO.get(method, evaluate.OTHER_RATIO), config.samples_per_task), "scored")
    groups = {r["targetLanguage"]: r for r in evaluate.rates(scored).collect()}
    zero = {"taskCount": 0, "passAt1": 0.0, "passAtK": 0.0, "syntaxValid": 0.0}

    def shown(row) -> dict:
        return {"taskCount": row["taskCount"], "passAt1": round(row["passAt1"], 4), "passAt5": round(row["passAtK"], 4), "syntaxValidityRate": round(row["syntaxValid"], 4)}

    details = scored.select(F.col("id").alias("taskId"), "targetLanguage", "tags", "passAt1", F.col("passAtK").alias("passAt5")).orderBy("targetLanguage", "taskId").collect()
    results = {
        "runId": run_id, "checkpointRunId": own.get("runId"), "compressionMethod": own.get("compressionMethod"), "datasetVersion": own.get("datasetVersion"), "studentModel": own.get("studentModel"), "heldOutTestSetVersion": config.test_set_version,
        "dryRun": True, **shown(groups.get(None, zero)), "byLanguage": {name: shown(groups.get(name, zero)) for name in LANGUAGES},
        **{k: own.get(k) for k in ("peakVramGb", "durationSeconds", "trainableParamCount", "evidenceLevel", "loraRank")}, "tasks": [r.asDict() for r in details], "completedAt": now,
    }
    lifecycle.step("benchmark", state, "Completed")
    writers.write_json(spark, f"{out}/{run_id}/results.json", results)
    writers.write_text(spark, f"{out}/{run_id}/summary.md", summary(results))
    if events:
        writers.append_events([{"event": "BenchmarkRunStarted", "timestamp": now, "runId": run_id, "checkpointRunId": own.get("runId"), "heldOutTestSetVersion": config.test_set_version}, {"event": "BenchmarkRunCompleted", "timestamp": now, "runId": run_id, "passAt1": results["passAt1"], "passAt5": results["passAt5"]}], spark, events)
    return results


def summary(r: dict) -> str:
    """The results as Markdown."""
    line = "| {name} | {passAt1:.1%} | {passAt5:.1%} | {syntaxValidityRate:.1%} |"
    return SUMMARY.format_map(r | {"lines": "\n".join(line.format(name=k, **v) for k, v in r["byLanguage"].items())})


def anchor_count(spark: SparkSession, phase3: Phase, anchor: str, benchmarks: str, checkpoints: str, profile: str) -> int | None:
    """The anchor method's trainable parameters: from its benchmark, else from its checkpoint."""
    spec = next((e for e in phase3.experiments().values() if e["compressionMethod"] == anchor), None)
    if spec is None:
        return None
    ids = {k: v.replace("{profile}", profile) for k, v in spec["runIdTemplates"].items()}
    for path in (f"{benchmarks}/{ids['benchmark']}/results.json", f"{checkpoints}/{ids['train']}/checkpoint-manifest.json"):
        if readers.exists(spark, path) and (count := readers.read_json(spark, path).get("trainableParamCount")) is not None:
            return int(count)
    return None


def analyse(spark: SparkSession, run_id: str, benchmarks: str, phase4: Phase, anchor: int | None, now: str) -> dict:
    """Tag buckets, inference cost and parameter match of a run's results; everything of the results is carried on."""
    results = readers.read_json(spark, f"{benchmarks}/{run_id}/results.json")
    wanted, mock = phase4.raw.get("evaluation", {}), phase4.raw.get("inferenceMock", {})
    run = readers.benchmark_runs(spark, benchmarks, [run_id]) if not readers.exists(spark, f"{benchmarks}/{run_id}/evaluation.json") else readers.parsed(spark.read.text(f"{benchmarks}/{run_id}/results.json", wholetext=True), readers.schemas.BENCHMARK)
    out = {k: v for k, v in results.items() if k not in ("tasks", "completedAt", "checkpointRunId", "dryRun")} | {"analyzedAt": now}
    if wanted.get("includeTagBuckets", True):
        buckets = evaluate.tag_buckets(run.select(F.explode("tasks").alias("t")).select("t.*")).collect()
        if buckets:
            out["tagBuckets"] = [{"tag": b["tag"], "taskCount": b["taskCount"], "passAt1": round(b["passAt1"], 4), "passAt5": round(b["passAt5"], 4)} for b in buckets]
    if wanted.get("includeInferenceMetrics", True):
        cost = evaluate.mock_inference(F.col("compressionMethod"), float(mock.get("meanLatencyMsPerToken", 12.5)), float(mock.get("throughputTokensPerSec", 82.0)), float(mock.get("baseModelSizeMb", 1024)))
        out["inference"] = run.select(*[c.alias(k) for k, c in cost.items()]).first().asDict()
    if wanted.get("includeParamMatchFootnotes", True):
        match = run.select(evaluate.param_match(F.col("trainableParamCount"), F.lit(anchor).cast("bigint"), float(phase4.defaults.get("paramMatchTolerancePercent", 10))).alias("m"), "trainableParamCount").first()
        if match["m"] is not None:
            out["paramMatch"] = {**match["m"].asDict(), "anchorParamCount": anchor, "trainableParamCount": match["trainableParamCount"]}
    out["judgeSampleRate"] = wanted.get("judgeSampleRate", 0.1)
    writers.write_json(spark, f"{benchmarks}/{run_id}/evaluation.json", out)
    writers.write_text(spark, f"{benchmarks}/{run_id}/evaluation-summary.md", evaluation_markdown(out))
    return out


def evaluation_markdown(e: dict) -> str:
    """An analysis as Markdown; a section stands where there is something to say."""
    parts = [EVALUATION.format_map({"compressionMethod": None, "passAt1": 0.0, "passAt5": 0.0, "syntaxValidityRate": 0.0} | e)]
    if e.get("inference"):
        parts.append(INFERENCE.format_map(e["inference"]))
    if e.get("tagBuckets"):
        parts.append(BUCKETS.format(lines="\n".join(BUCKET.format_map(b) for b in e["tagBuckets"])))
    if e.get("paramMatch", {}).get("footnoteRequired"):
        parts.append(FOOTNOTE.format_map(e["paramMatch"]))
    return "\n".join(parts)


def readiness_checks(spark: SparkSession, held_out: str, benchmarks: str, run_ids: list[str], version: str) -> DataFrame:
    """``name, passed, detail``: the test set's version and immutability, and each run's results."""
    rows: list[tuple[str, bool, str]] = []
    try:
        manifest = readers.held_out_manifest(spark, held_out, version)
        rows.append((version, True, f"{manifest.get('taskCount', 0)} tasks immutable"))
    except (FileNotFoundError, readers.VersionMismatch) as e:
        rows.append((version, False, str(e)))
    if readers.exists(spark, f"{held_out}/manifest.json") and readers.read_json(spark, f"{held_out}/manifest.json").get("immutable") is True:
        rows.append(("BR-004 isolation", True, "held-out test set marked immutable"))
    for run_id in run_ids:
        path = f"{benchmarks}/{run_id}/results.json"
        there = readers.exists(spark, path)
        rows.append((f"benchmark {run_id}", there, path if there else "results.json missing"))
    return spark.createDataFrame(rows, "name string, passed boolean, detail string")


def evaluate_runs(spark: SparkSession, run_ids: list[str], held_out: str, benchmarks: str, phase4: Phase, anchor: int | None, report: str, now: str) -> dict:
    """Readiness, then the analysis of each run; nothing is analysed where a check fails."""
    checks = readiness_checks(spark, held_out, benchmarks, run_ids, phase4.defaults.get("heldOutTestSetVersion", "held-out-v1"))
    ready = lifecycle.readiness(checks).where("name = 'overall'").first()["passed"]
    done = [analyse(spark, r, benchmarks, phase4, anchor, now) for r in run_ids] if ready else []
    out = {"profile": phase4.defaults.get("profile"), "failed": not ready, "readinessPassed": ready, "benchmarkRunIds": run_ids, "completedAt": now, "readinessChecks": [r.asDict() for r in checks.collect()], "evaluations": [{"runId": e["runId"], "compressionMethod": e.get("compressionMethod") or "Unknown", "passAt1": e.get("passAt1", 0.0), "evaluationPath": f"{benchmarks}/{e['runId']}/evaluation.json"} for e in done]}
    writers.write_json(spark, report, out)
    writers.write_text(spark, report.rsplit(".", 1)[0] + "-summary.md", operator_summary(out))
    return out


def operator_summary(r: dict) -> str:
    return OVERVIEW.format(profile=r["profile"], lines="".join(f"| {e['compressionMethod']} | {e['passAt1']:.1%} | `{e['evaluationPath']}` |\n" for e in r["evaluations"]))


def report(spark: SparkSession, run_ids: list[str], benchmarks: str, path: str, now: str, tie_breakers: tuple[str, ...] = ranking.TIE_BREAKERS, allow_mixed: bool = False, events: str | None = None) -> dict:
    """The ranking of runs as Markdown and JSON, with warnings and footnotes."""
    runs = store(readers.benchmark_runs(spark, benchmarks, run_ids), "runs")
    warnings = ranking.check_comparable(runs, allow_mixed)
    notes, order = ranking.footnotes(runs, "ord"), store(ranking.ranked(runs, tie_breakers, "ord"), "ranked")
    out = {"generatedAt": now, "runIds": run_ids, "warnings": warnings, "footnotes": [n.asDict() for n in notes.collect()], "ranking": [r.asDict() for r in ranking.summaries(order).collect()]}
    writers.write_text(spark, path, ranking.markdown(order, warnings, notes))
    writers.write_json(spark, path.rsplit(".", 1)[0] + ".json", out)
    if events:
        writers.append_events([{"event": "ExperimentReportGenerated", "timestamp": now, "runIds": run_ids, "outputPath": path, "recordCount": len(run_ids)}], spark, events)
    return out


def run_method(spark: SparkSession, spec: dict, version: str, profile: str, published: str, checkpoints: str, held_out: str, benchmarks: str, config: Train, bench: Benchmark, now: str, events: str | None = None) -> dict:
    """One experiment: train or register the method, then benchmark it.

    The results get the experiment's id, evidence level and rank; one that isn't trained has no rank.
    """
    evidence = spec.get("evidenceLevel", "Established")
    ids = {k: v.replace("{profile}", profile) for k, v in spec["runIdTemplates"].items()}
    if spec.get("skipTrain"):
        few_shot_baseline(spark, ids["train"], version, published, checkpoints, config, profile, now, events, evidence)
    else:
        train(spark, ids["train"], version, spec["compressionMethod"], published, checkpoints, config, profile, now, spec.get("loraRank"), events=events, evidence=evidence)
    results = benchmark(spark, ids["benchmark"], f"{checkpoints}/{ids['train']}", held_out, benchmarks, bench, now, events)
    own = {"experimentId": spec.get("experimentId"), "evidenceLevel": evidence, "loraRank": None if spec.get("skipTrain") else spec.get("loraRank", config.lora_rank)}
    writers.write_json(spark, f"{benchmarks}/{ids['benchmark']}/results.json", results | own)
    return results | own


def run_wave(spark: SparkSession, names: list[str], phase3: Phase, **how) -> list[tuple[str, bool, str]]:
    """Experiments by name as ``(name, success, message)``; an unknown name fails on its own."""
    out = []
    for name in names:
        spec = phase3.experiments().get(name)
        if spec is None:
            out.append((name, False, "unknown experiment"))
            continue
        try:
            out.append((name, True, run_method(spark, {"experimentId": name} | spec, **how)["runId"]))
        except (ValueError, FileNotFoundError, readers.NotPublished, readers.VersionMismatch) as e:
            out.append((name, False, str(e)))
    return out
