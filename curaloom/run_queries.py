"""Registered queries of runs: versions published, methods trained and benchmarked on them, analysed and reported.

Whole tables stand in for records and held-out tasks; files lie in the shared
folder, a new one for each call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Benchmark, Phase, Publish, Smoke, Taxonomy, Train, run_id_column
from .flow_queries import CASCADE, HELD_NO, NOW, RULES, SCOPE, records, table, topics
from .functions import text
from .operators import evaluate, generate, lifecycle
from .plans import curation, evaluation
from .sources import readers, writers
from .storage import new_path
from .vocabulary import COMPRESSION_METHODS, DIRECTORY, PREFIX

# Fixed values of these queries: versions, a test set, and experiments with their evidence.
VERSION, MIXED, TEST_SET = "ds-2026-06-20-js-v1", "ds-2026-06-20-mixed-v1", "held-out-v1"
EVIDENCE = {"FewShot": "Established", "LoRA": "Established", "QLoRA": "NovelApplication", "DoRA": "Speculative"}
WAVE = Phase("v1", {}, {"experiments": {f"EXP-{m}": {"compressionMethod": m, "evidenceLevel": EVIDENCE[m], "loraRank": 8, "skipTrain": m == "FewShot", "runIdTemplates": {"train": f"train-{m}-{{profile}}", "benchmark": f"bench-{m}-{{profile}}"}} for m in COMPRESSION_METHODS}})


def version_of(spark: SparkSession, rows: DataFrame, root: str, version: str, language: str) -> None:
    """``rows`` as a published version with its entry in the index."""
    count = rows.count()
    own = {"datasetVersion": version, "draftId": "run-1", "state": "Published", "targetLanguage": language, "exampleCount": count, "publishedAt": NOW, "publishedBy": "me"}
    writers.publish_snapshot(rows.select(*curation.COLUMNS), root, version, own)
    writers.append_index(spark, root, own)


def test_set(spark: SparkSession, d: str, root: str) -> None:
    """Benchmark items as held-out tasks on disk, with the manifest of the test set."""
    tasks = generate.held_out_tasks(topics(spark, d))
    for name, code in PREFIX.items():
        own = tasks.where(F.col("targetLanguage") == name).orderBy("task_index")
        writers.text_lines(own.select(F.to_json(F.struct("id", "targetLanguage", "topicId", "instruction", "tags", "acceptanceCriteria"))), f"{root}/{code}.jsonl")
    writers.write_json(spark, f"{root}/manifest.json", {"heldOutTestSetVersion": TEST_SET, "immutable": True, "taskCount": tasks.count()})


def wave(spark: SparkSession, d: str) -> tuple[str, list[tuple[str, bool, str]]]:
    """All experiments and an unknown one over the documents' version; the folder and what came of each."""
    root = new_path(spark, "wave")
    version_of(spark, records(spark, d), f"{root}/published", VERSION, "JavaScript")
    test_set(spark, d, f"{root}/held-out")
    done = evaluation.run_wave(spark, [*WAVE.experiments(), "EXP-none"], WAVE, version=VERSION, profile="smoke", published=f"{root}/published", checkpoints=f"{root}/checkpoints", held_out=f"{root}/held-out", benchmarks=f"{root}/bench", config=Train(), bench=Benchmark(), now=NOW)
    return root, done


def analysed(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """A wave with the analysis of each run; the folder and the runs."""
    root, _ = wave(spark, d)
    runs = WAVE.run_ids("benchmark", "smoke")
    anchor = evaluation.anchor_count(spark, WAVE, "LoRA", f"{root}/bench", f"{root}/checkpoints", "smoke")
    evaluation.evaluate_runs(spark, runs, f"{root}/held-out", f"{root}/bench", Phase("v1", {"heldOutTestSetVersion": TEST_SET}, {}), anchor, f"{root}/review/phase4.json", NOW)
    return root, runs


def filter_rejections(spark, d):
    """The log of rejected records that a filter run appends to."""
    root = new_path(spark, "filter")
    curation.filter_run(records(spark, d), "run-1", f"{root}/drafts", Taxonomy(), SCOPE, RULES, NOW, rejected_log=f"{root}/rejected")
    log = readers.json_lines(spark, f"{root}/rejected", "exampleId STRING, reasonCode STRING, message STRING, gatesPassed ARRAY<STRING>, rejectedAt STRING, runId STRING, example STRUCT<instruction: STRING, targetLanguage: STRING>")
    return log.select("runId", "exampleId", "reasonCode", "message", F.array_join("gatesPassed", ",").alias("passed"), "rejectedAt", F.sha2("example.instruction", 256).alias("instruction_sha256"), "example.targetLanguage")


def mixed_flow(spark, d):
    """Documents of two languages as two versions, published together as a mixed one."""
    root, rows = new_path(spark, "mixed"), records(spark, d, more=(F.col("lang"),))
    made = {"en": "JavaScript", "de": "HTML"}
    for lang, name in made.items():
        version_of(spark, rows.where(F.col("lang") == lang).withColumn("targetLanguage", F.lit(name)), root, f"ds-2026-06-20-{PREFIX[name]}-v1", name)
    curation.publish_mixed(spark, [f"ds-2026-06-20-{PREFIX[n]}-v1" for n in made.values()], MIXED, root, Publish(), "me", NOW)
    back, manifest = readers.published(spark, root, MIXED)
    counts = F.create_map(*[F.lit(x) for pair in manifest["countsByLanguage"].items() for x in pair])
    return back.select("id", "targetLanguage", F.sha2("instruction", 256).alias("instruction_sha256"), counts[F.col("targetLanguage")].cast("bigint").alias("published"), F.lit(",".join(manifest["languages"])).alias("languages"))


def published_readiness(spark, d):
    """Checks of required versions against the published manifests, one of them missing, with the verdict over all."""
    root, rows = new_path(spark, "ready"), records(spark, d)
    version_of(spark, rows, root, VERSION, "JavaScript")
    version_of(spark, rows.withColumn("targetLanguage", F.lit("HTML")), root, "ds-2026-06-20-html-v1", "HTML")
    asked = spark.createDataFrame([(name, f"ds-2026-06-20-{code}-v1") for name, code in PREFIX.items()], "language string, version string")
    return lifecycle.readiness(lifecycle.published_checks(asked, readers.manifests(spark, root)))


def wave_results(spark, d):
    """What each experiment scored by language, as its results say."""
    root, done = wave(spark, d)
    told = spark.createDataFrame(done, "experimentId string, success boolean, message string")
    raw = spark.read.text([f"{root}/bench/{r}/results.json" for r in WAVE.run_ids("benchmark", "smoke")], wholetext=True)
    found = readers.parsed(raw, schemas.BENCHMARK).select("experimentId", "runId", "evidenceLevel", "loraRank", "trainableParamCount", "peakVramGb", F.explode("byLanguage").alias("language", "r"))
    return told.join(found, "experimentId", "left").select("experimentId", "success", "message", "evidenceLevel", "loraRank", "trainableParamCount", "peakVramGb", "language", "r.taskCount", "r.passAt1", "r.passAt5", "r.syntaxValidityRate")


def checkpoints(spark, d):
    """The manifests of the checkpoints that a wave leaves."""
    root, _ = wave(spark, d)
    rows = readers.documents_of(spark, f"{root}/checkpoints", "checkpoint-manifest.json", schemas.CHECKPOINT, recursive=True)
    return rows.select("runId", "compressionMethod", "loraRank", F.col("trainExampleCount").cast("bigint").alias("trainExampleCount"), F.col("steps").cast("bigint").alias("steps"), F.col("trainableParamCount").cast("bigint").alias("trainableParamCount"), F.round("durationSeconds", 3).alias("durationSeconds"), "trainingState", "evidenceLevel", F.col("corrupt").isNull().alias("whole"))


def wave_analysis(spark, d):
    """Tag buckets, cost of inference and match of parameters of each run of a wave."""
    root, runs = analysed(spark, d)
    schema = f"{schemas.BENCHMARK}, inference STRUCT<meanLatencyMsPerToken: DOUBLE, throughputTokensPerSec: DOUBLE, modelSizeMb: DOUBLE>"
    raw = spark.read.text([f"{root}/bench/{r}/evaluation.json" for r in runs], wholetext=True)
    rows = readers.parsed(raw, schema).withColumn("b", F.explode("tagBuckets"))
    return rows.select("runId", "experimentId", "b.tag", "b.taskCount", "b.passAt1", "b.passAt5", "inference.*", "paramMatch.deltaPercent", "paramMatch.matched", "paramMatch.footnoteRequired", F.col("paramMatch.anchorParamCount").alias("anchor"))


def wave_report(spark, d):
    """The ranking of a wave as its report says, with the footnotes of each run."""
    root, runs = analysed(spark, d)
    out = evaluation.report(spark, runs, f"{root}/bench", f"{root}/report.md", NOW)
    ranking = spark.createDataFrame([(r["rank"], r["runId"], r["evidenceLabel"], r["rankParameter"], r["passAt1"], r["jsPassAt1"]) for r in out["ranking"]], "rank int, runId string, evidenceLabel string, rankParameter string, passAt1 double, jsPassAt1 double")  # a row per run of a report
    notes = spark.createDataFrame([(n["runId"], n["reason"].split(" ")[0]) for n in out["footnotes"]], "runId string, note string")
    page = spark.read.text(f"{root}/report.md", wholetext=True).first()["value"]
    return ranking.join(notes, "runId", "left").withColumn("first_line", F.lit("| 1 | LoRA | L1 | r=8 |" in page))


def smoke_flow(spark, d):
    """A smoke run over a whole version and all tasks of its language: which tasks pass, beside the verdict."""
    root = new_path(spark, "smoke")
    version_of(spark, records(spark, d), f"{root}/published", VERSION, "JavaScript")
    test_set(spark, d, f"{root}/held-out")
    tasks = table(spark, d, "benchmark").count()
    one = evaluation.smoke(spark, "smoke-1", VERSION, "JavaScript", f"{root}/published", f"{root}/held-out", f"{root}/smoke", Smoke(eval_tasks=tasks, max_examples=table(spark, d, "documents").count()), NOW)
    rows = readers.json_lines(spark, f"{root}/smoke/smoke-1/smoke-eval.jsonl", "taskId STRING, passed BOOLEAN, reason STRING")
    return rows.select("taskId", "passed", F.col("reason").isNull().alias("faultless"), F.lit(one["steps"]).cast("bigint").alias("steps"), F.lit(one["trainExampleCount"]).cast("bigint").alias("examples"), F.lit(one["gateSatisfied"]).alias("gate"))


def run_ids(spark, d):
    """Ids of runs from the templates of a phase, for every source as a profile."""
    templates = spark.createDataFrame([(m, spec["runIdTemplates"]["train"]) for m, spec in WAVE.experiments().items()], "experimentId string, template string")
    profiles = table(spark, d, "documents").select(F.col("source").alias("profile")).distinct()
    named = profiles.join(F.broadcast(templates))  # one row for each experiment of a configuration
    return named.select("experimentId", "profile", run_id_column(F.col("template"), profile=F.col("profile")).alias("runId"))


def mixed_order(spark, d):
    """All documents as versions of three languages, published together; every row with its place in the mixed version."""
    root, rows = new_path(spark, "mixed-order"), records(spark, d, more=(F.col("lang"),))
    made = {"JavaScript": ("en",), "HTML": ("de",), "FreeMarker": ("es", "fr")}
    for name, langs in made.items():
        own = rows.where(F.col("lang").isin(*langs)).withColumns({"targetLanguage": F.lit(name), "topicId": F.col("ord").cast("string")}).orderBy("ord")
        version_of(spark, own, root, f"ds-2026-06-20-{PREFIX[name]}-v1", name)
    curation.publish_mixed(spark, [f"ds-2026-06-20-{PREFIX[n]}-v1" for n in made], MIXED, root, Publish(), "me", NOW)
    return readers.published_in_order(spark, root, MIXED).select(F.col("topicId").cast("bigint").alias("doc_id"), "targetLanguage", F.col("ord").alias("place"), F.sha2("instruction", 256).alias("instruction_sha256"))


def training_faults(spark, d):
    """Methods with and without a rank."""
    method = F.element_at(F.array(*map(F.lit, COMPRESSION_METHODS)), (F.col("doc_id") % 4 + 1).cast("int"))
    rank = F.when(F.col("doc_id") % 3 > 0, F.lit(16))
    return table(spark, d, "documents").select("doc_id", evaluate.hyper_parameter_fault(method, rank).alias("fault"))


def review_decisions(spark, d):
    """Decisions as reviewers write them, a document of JSON for each example."""
    said = F.element_at(F.array(*map(F.lit, ("Accept", "REJECT", "maybe", "accept"))), (F.col("doc_id") % 4 + 1).cast("int"))
    entry = F.map_from_arrays(F.array(F.col("doc_id").cast("string")), F.array(said))
    raw = table(spark, d, "documents").select(F.to_json(F.struct(entry.alias("decisions"))).alias("value"))
    return lifecycle.decisions(raw)


def percent_labels(spark, d):
    """Shares of good documents by source and language, as a report shows them."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(spark, d, "documents").join(labels, "doc_id").groupBy("source", "lang").agg(F.avg(F.col("quality").cast("double")).alias("share"))
    return rows.select("source", "lang", text.percent(F.col("share")).alias("shown"))


def optional_numbers(spark, d):
    """Numbers that a document of JSON may lack, hold as null or break off in."""
    n = F.col("doc_id")
    rank = F.concat(F.lit('{"runId": "r'), n.cast("string"), F.lit('", "loraRank": '), (n % 64).cast("string"))
    value = F.when(n % 5 == 0, rank).when(n % 5 == 1, F.concat(rank, F.lit(', "peakVramGb": null}'))).when(n % 5 == 2, F.lit("{}")).otherwise(F.concat(rank, F.lit(', "peakVramGb": '), (n % 10 / F.lit(4.0)).cast("string"), F.lit("}")))
    rows = readers.parsed(table(spark, d, "documents").select("doc_id", value.alias("value")), "runId STRING, loraRank INT, peakVramGb DOUBLE")
    whole = F.col("corrupt").isNull()
    return rows.select("doc_id", whole.alias("whole"), F.when(whole, F.col("runId")).alias("runId"), F.when(whole, F.col("loraRank")).alias("loraRank"), F.when(whole, F.col("peakVramGb")).alias("peakVramGb"))


def seed_union(spark, d):
    """Draft seeds of all languages, a folder each, read as one table."""
    root = new_path(spark, "drafts")
    own = records(spark, d, "seed", 3).withColumn("targetLanguage", F.element_at(F.array(*map(F.lit, DIRECTORY)), (F.col("ord") % 3 + 1).cast("int")))
    writers.promoted_seeds(own.withColumn("topicId", F.col("ord").cast("string")).drop("ord"), root)
    found = None
    for name in DIRECTORY:
        rows = readers.json_lines(spark, f"{root}/targetLanguage={name}", schemas.EXAMPLE).withColumn("targetLanguage", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found.select(F.col("topicId").cast("bigint").alias("doc_id"), "id", "targetLanguage", F.sha2("code", 256).alias("code_sha256"))


QUERIES = {f.__name__: f for f in (filter_rejections, mixed_flow, published_readiness, wave_results, checkpoints, wave_analysis, wave_report, smoke_flow, run_ids, mixed_order, training_faults, review_decisions, percent_labels, optional_numbers, seed_union)}

METHODS = "(VALUES ('FewShot', 0.42, 'Established', NULL, 0, 0.0, 100.0), ('LoRA', 0.72, 'Established', 8, 262144, 3.2, 0.0), ('QLoRA', 0.68, 'NovelApplication', 8, 262144, 2.4, 0.0), ('DoRA', 0.74, 'Speculative', 8, 275251, 3.4, 5.0)) m(method, ratio, evidence, r, params, vram, delta)"
TASKS = f"(SELECT language, c, {HELD_NO} - 1 AS n FROM (SELECT item_id AS ord, ['JavaScript', 'HTML', 'FreeMarker'][item_id % 3 + 1] AS language, ['js', 'html', 'fmt'][item_id % 3 + 1] AS c FROM benchmark))"
SCORED = f"(SELECT method, language, (n % 10) / 10.0 < ratio AS p1, EXISTS (SELECT 1 FROM range(5) k(k) WHERE ((n + k) % 10) / 10.0 < ratio) AS p5 FROM {TASKS} CROSS JOIN {METHODS})"

ORACLE_SQL = {
    "filter_rejections": f"""{CASCADE} SELECT 'run-1' AS "runId", 'syn-js-' || four AS "exampleId", ['SCHEMA_INVALID', 'SYNTAX_FAIL', 'QUALITY_BAR', 'HELD_OUT_LEAK'][n + 1] AS "reasonCode",
        CASE n WHEN 0 THEN 'SeedValidationError [syn-js-' || four || '] ' || f1 WHEN 1 THEN f2 WHEN 2 THEN f3 ELSE 'HeldOutLeakDetected: example ''syn-js-' || four || ''' matches held-out topic ''' || f4 END AS message,
        array_to_string(['SchemaValidation', 'SyntaxValidation', 'InstructionQuality', 'HeldOutLeak'][1:n], ',') AS passed, '{NOW}' AS "rejectedAt", sha256(i) AS instruction_sha256, 'JavaScript' AS "targetLanguage" FROM k WHERE n < 4""",
    "mixed_flow": """WITH r AS (SELECT *, CASE lang WHEN 'en' THEN 'JavaScript' ELSE 'HTML' END AS language FROM documents WHERE lang IN ('en', 'de'))
        SELECT 'syn-js-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS id, language AS "targetLanguage", sha256(text) AS instruction_sha256, count(*) OVER (PARTITION BY language) AS published, 'HTML,JavaScript' AS languages FROM r""",
    "published_readiness": """WITH n AS (SELECT count(*) AS c FROM documents) SELECT 'published dataset JavaScript' AS name, true AS passed, 'ds-2026-06-20-js-v1 — ' || c || ' examples' AS detail FROM n
        UNION ALL SELECT 'published dataset HTML', true, 'ds-2026-06-20-html-v1 — ' || c || ' examples' FROM n UNION ALL SELECT 'published dataset FreeMarker', false, 'dataset not published: ds-2026-06-20-fmt-v1' UNION ALL SELECT 'overall', false, '2/3'""",
    "wave_results": f"""SELECT 'EXP-' || method AS "experimentId", true AS success, 'bench-' || method || '-smoke' AS message, evidence AS "evidenceLevel", CAST(r AS INT) AS "loraRank", CAST(params AS BIGINT) AS "trainableParamCount", CAST(vram AS DOUBLE) AS "peakVramGb", language,
        count(*) AS "taskCount", round(avg(p1::INT), 4) AS "passAt1", round(avg(p5::INT), 4) AS "passAt5", 1.0::DOUBLE AS "syntaxValidityRate" FROM {SCORED} JOIN {METHODS} USING (method) GROUP BY ALL
        UNION ALL SELECT 'EXP-none', false, 'unknown experiment', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
    "checkpoints": f"""WITH n AS (SELECT least(200, count(*)) AS c FROM documents), s AS (SELECT c, least(100, greatest(1, c // 4)) AS s FROM n)
        SELECT 'train-' || method || '-smoke' AS "runId", method AS "compressionMethod", CAST(r AS INT) AS "loraRank", CASE WHEN method <> 'FewShot' THEN c END AS "trainExampleCount", CASE WHEN method <> 'FewShot' THEN s END AS steps, CAST(params AS BIGINT) AS "trainableParamCount",
        round((0.05 + s * 0.001) * CASE method WHEN 'FewShot' THEN 0 WHEN 'QLoRA' THEN 1.15 WHEN 'DoRA' THEN 1.08 ELSE 1 END, 3)::DOUBLE AS "durationSeconds", 'Completed' AS "trainingState", evidence AS "evidenceLevel", true AS whole FROM s CROSS JOIN {METHODS}""",
    "wave_analysis": f"""SELECT 'bench-' || method || '-smoke' AS "runId", 'EXP-' || method AS "experimentId", 'L3-composite' AS tag, count(*) AS "taskCount", round(avg(p1::INT), 4) AS "passAt1", round(avg(p5::INT), 4) AS "passAt5",
        CASE method WHEN 'QLoRA' THEN 14.0 WHEN 'FewShot' THEN 11.88 ELSE 12.5 END::DOUBLE AS "meanLatencyMsPerToken", CASE method WHEN 'QLoRA' THEN 75.44 WHEN 'FewShot' THEN 86.1 ELSE 82.0 END::DOUBLE AS "throughputTokensPerSec", CASE method WHEN 'QLoRA' THEN 563.2 ELSE 1024.0 END::DOUBLE AS "modelSizeMb",
        CAST(delta AS DOUBLE) AS "deltaPercent", delta <= 10 AS matched, delta > 10 AS "footnoteRequired", 262144::BIGINT AS anchor FROM {SCORED} JOIN {METHODS} USING (method) GROUP BY method, delta""",
    "wave_report": f"""WITH a AS (SELECT method, vram, r, round(avg(p1::INT), 4) AS p, round(avg(p1::INT) FILTER (language = 'JavaScript'), 4) AS js FROM {SCORED} JOIN {METHODS} USING (method) GROUP BY ALL)
        SELECT CAST(row_number() OVER (ORDER BY p DESC, vram) AS INT) AS rank, 'bench-' || method || '-smoke' AS "runId", CASE method WHEN 'DoRA' THEN 'L4' WHEN 'QLoRA' THEN 'L3' ELSE 'L1' END AS "evidenceLabel", coalesce('r=' || r, '—') AS "rankParameter", p AS "passAt1", js AS "jsPassAt1",
        CASE method WHEN 'FewShot' THEN 'BR-014' WHEN 'DoRA' THEN 'L4' END AS note, true AS first_line FROM a""",
    "smoke_flow": f"""WITH c AS (SELECT count(*) AS c FROM documents), t AS (SELECT c AS code, n, n % 10 < 7 AS ok FROM {TASKS} WHERE language = 'JavaScript')
        SELECT 'ho-js-' || lpad(CAST(n + 1 AS VARCHAR), 3, '0') AS "taskId", ok AS passed, ok AS faultless, greatest(1, c.c // 4) AS steps, c.c AS examples, avg(ok::INT) OVER () >= 0.6 AS gate FROM t CROSS JOIN c""",
    "run_ids": f"""SELECT 'EXP-' || method AS "experimentId", source AS profile, 'train-' || method || '-' || source AS "runId" FROM (SELECT DISTINCT source FROM documents) CROSS JOIN {METHODS}""",
    "mixed_order": """WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS o, text FROM documents WHERE lang IN ('en', 'de', 'es', 'fr'))
        SELECT doc_id, ['JavaScript', 'HTML', 'FreeMarker'][o + 1] AS "targetLanguage", row_number() OVER (ORDER BY o, doc_id) - 1 AS place, sha256(text) AS instruction_sha256 FROM r""",
    "training_faults": "SELECT doc_id, CASE WHEN doc_id % 4 > 0 AND doc_id % 3 = 0 THEN 'lora-rank required for ' || ['FewShot', 'LoRA', 'QLoRA', 'DoRA'][doc_id % 4 + 1] END AS fault FROM documents",
    "review_decisions": "SELECT CAST(doc_id AS VARCHAR) AS \"exampleId\", ['accept', 'reject', 'maybe', 'accept'][doc_id % 4 + 1] AS decision, doc_id % 4 <> 2 AS valid FROM documents",
    "percent_labels": "WITH l AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) SELECT source, lang, printf('%.1f%%', avg(CAST(q AS DOUBLE)) * 100) AS shown FROM documents JOIN l USING (doc_id) GROUP BY source, lang",
    "optional_numbers": """SELECT doc_id, doc_id % 5 > 0 AS whole, CASE WHEN doc_id % 5 IN (1, 3, 4) THEN 'r' || doc_id END AS "runId", CASE WHEN doc_id % 5 IN (1, 3, 4) THEN CAST(doc_id % 64 AS INT) END AS "loraRank", CASE WHEN doc_id % 5 > 2 THEN (doc_id % 10) / 4.0::DOUBLE END AS "peakVramGb" FROM documents""",
    "seed_union": "SELECT doc_id, 'seed-js-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS id, ['JavaScript', 'HTML', 'FreeMarker'][doc_id % 3 + 1] AS \"targetLanguage\", sha256(CASE WHEN doc_id % 3 = 0 THEN 'var a; ' ELSE 'export ' END || text) AS code_sha256 FROM documents",
}
