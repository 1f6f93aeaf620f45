"""Registered queries of whole flows: files written through the sinks and read back through the scans, and what runs over them.

Documents stand in for JavaScript records.  Files lie in the shared folder, a new
one for each call.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Expansion, Gates, Publish, Review, Scope, Taxonomy
from .functions import text
from .operators import evaluate, gates, generate, lifecycle, ranking, rules, sampling
from .operators.dedup import ordered_duplicates
from .operators.similarity import duplicate_pairs
from .plans import curation
from .sources import readers, writers
from .storage import new_path
from .vocabulary import DIRECTORY

NOW = "2026-06-20T10:00:00+00:00"
# Fixed values of these queries: held-out keywords, verbs and a scope.
KEYWORDS = [("JavaScript", 0, "HO-JS-001", 0, "that"), ("JavaScript", 0, "HO-JS-001", 1, "of the"), ("JavaScript", 1, "HO-JS-002", 0, "nicht")]
SCOPE = Scope("v1", "held-out-v1", (), ({"id": "HO-JS-001", "language": "JavaScript", "pattern": "p", "keywords": ["that", "of the"]}, {"id": "HO-JS-002", "language": "JavaScript", "pattern": "q", "keywords": ["nicht"]}), {})
VERBS = ("the", "der", "de", "la", "und", "que")
RULES = Gates(duplicate=False, vague_phrases=("haha",), verbs=VERBS, instruction_length=40)
DIFFICULTY = "L1-trivial"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, d: str, kind: str = "syn", digits: int = 4, more: tuple[Column, ...] = ()) -> DataFrame:
    """Every document as a JavaScript record; code lacks its declaration in one of three, a tag in one of five.  ``more`` are columns of the documents beside it."""
    n = F.col("doc_id")
    source = "synthetic" if kind == "syn" else "manual"
    tags = F.when(n % 5 == 0, F.array(F.lit(DIFFICULTY), F.lit("zzz"))).otherwise(F.array(F.lit(DIFFICULTY), F.lit("array")))
    meta = F.struct(F.lit("a").alias("author"), F.lit("2026-01-01").alias("created"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("notes"))
    return table(spark, d, "documents").select(
        n.alias("ord"), F.concat(F.lit(f"{kind}-js-"), F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0")).alias("id"), F.lit("JavaScript").alias("targetLanguage"), F.col("text").alias("instruction"),
        F.concat(F.when(n % 3 == 0, F.lit("var a; ")).otherwise("export "), F.col("text")).alias("code"), tags.alias("tags"), meta.alias("metadata"), F.lit(None).cast("double").alias("judgeScore"), F.lit(None).cast("string").alias("topicId"), *more,
    )


def cascade_rows(spark, d):
    """Every record through the gates, with message and passed gates."""
    rows = gates.cascade(records(spark, d), Taxonomy(), RULES, KEYWORDS)
    return rows.select(F.col("ord").alias("doc_id"), "accepted", "reasonCode", "message", F.array_join("gatesPassed", ",").alias("passed"))


def cascade_summary(spark, d):
    """Counts, syntax rate and thresholds of a filter run."""
    one = gates.gate_summary(gates.cascade(records(spark, d), Taxonomy(), RULES, KEYWORDS), RULES)
    return one.withColumn("syntaxPassRate", F.round("syntaxPassRate", 6))


def promotion_failures(spark, d):
    """Every gate that documents fail as gold seeds, similar ones among them."""
    seeds = records(spark, d, "seed", 3)
    pairs = duplicate_pairs(table(spark, d, "documents"), "doc_id", "text", 0.95)
    named = pairs.select(F.concat(F.lit("seed-js-"), F.lpad(F.pmod("left_key", F.lit(1000)).cast("string"), 3, "0")).alias("left_id"), F.concat(F.lit("seed-js-"), F.lpad(F.pmod("right_key", F.lit(1000)).cast("string"), 3, "0")).alias("right_id"), F.round("similarity", 6).alias("similarity"))
    return gates.promotion_failures(seeds, Taxonomy(), KEYWORDS, named)


def baseline_dedup(spark, d):
    """Documents of other sources against those of one source, which come first and stay."""
    docs = table(spark, d, "documents")
    rows, old = docs.where("source <> 'src0'"), docs.where("source = 'src0'")
    return ordered_duplicates(rows, "doc_id", "doc_id", "text", "true", 0.95, baseline=old).select(F.col("key").alias("doc_id"), "duplicate")


def resolved(spark: SparkSession, d: str, words) -> DataFrame:
    own = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("rule-"), (F.col("item_id") % 50).cast("string")).alias("rule"), F.posexplode(words).alias("nth", "trigger"), (F.col("item_id") % 25 == 0).alias("always"))
    asked = spark.createDataFrame([("The",), ("and some of them",), ("del",), ("",)], "keyword string")
    return rules.resolve(asked, own.drop("nth"))


def rule_resolver(spark, d):
    return resolved(spark, d, F.slice(F.split(F.lower("text"), " "), 1, 3))


def rule_resolver_whole(spark, d):
    """Rules with all words of their items as triggers."""
    return resolved(spark, d, F.split(F.lower("text"), " "))


def response_extraction(spark, d):
    n = F.col("doc_id") % 3
    decoded = F.when(n == 0, F.concat(F.lit("ask ### Response: "), F.col("text"), F.lit(" \n"))).when(n == 1, F.concat(F.lit("prompt: "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.response_of(decoded, F.lit("prompt: ")), 256).alias("response_sha256"))


def hub_ids(spark, d):
    model = F.element_at(F.array(*map(F.lit, ("Qwen2.5-Coder-0.5B", "own/model", "unknown", "Qwen2.5-Coder-1.5B"))), (F.col("doc_id") % 4 + 1).cast("int"))
    from .vocabulary import STUDENT_MODELS

    return table(spark, d, "documents").select("doc_id", text.hub_id(model, STUDENT_MODELS).alias("hub_id"), text.number_prefix(F.col("source"), 12).cast("bigint").alias("source_number"), F.round(text.gigabytes(F.col("n_chars")), 12).alias("gb"))


def smoke_summary(spark, d):
    found = table(spark, d, "labels").select((F.col("quality") == 1).alias("passed"))
    return evaluate.smoke_summary(found, 0.6).withColumn("passAt1", F.round("passAt1", 6))


def shot_pool(spark, d):
    """Documents that are no labelled references."""
    return generate.shot_pool(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def parity_sample(spark, d):
    """The review sample as Python's own generator draws it."""
    rows = sampling.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"], "ord")
    return sampling.parity_sample(rows, "ord", "run-001", 0.05, 1).select("drawn", "doc_id")


def json_lines_round_trip(spark, d):
    """Records through the sink of JSON lines, by language, and back through the scan."""
    path = new_path(spark, "lines")
    writers.json_lines(records(spark, d).drop("ord"), path)
    back = readers.json_lines(spark, path, schemas.EXAMPLE)
    return back.select("id", "targetLanguage", F.sha2("instruction", 256).alias("instruction_sha256"), F.length("code").alias("code_length"), F.array_join("tags", ",").alias("tags"), F.col("metadata.source").alias("source"), F.col("judgeScore").isNull().alias("unjudged"))


def ordered_lines(spark, d):
    """Records in the files of a folder, read in the order of files and lines."""
    path = new_path(spark, "run")
    writers.json_lines(records(spark, d).withColumn("topicId", F.col("ord").cast("string")).orderBy("ord").drop("ord"), path)
    back = readers.ordered_records(spark, path, schemas.EXAMPLE)
    return back.select(F.col("topicId").cast("bigint").alias("doc_id"), F.col("ord").alias("place"), "id", F.col("corrupt").isNull().alias("whole"))


def raw_candidates(spark, d):
    """Records as the batch files of a run, read back whole and in their order."""
    path = new_path(spark, "raw")
    writers.batch_files(records(spark, d).withColumn("topicId", F.col("ord").cast("string")), path)
    back = readers.raw_candidates(spark, path)
    return back.select(F.col("topicId").cast("bigint").alias("doc_id"), F.col("ord").alias("place"), F.startswith(F.substring_index("file", "/", -1), F.lit("batch-")).alias("batched"), F.sha2("instruction", 256).alias("instruction_sha256"), F.sha2("code", 256).alias("code_sha256"))


def seed_folders(spark, d):
    """Benchmark items as seed files, one document each, with reference seeds among them."""
    path = new_path(spark, "seeds")
    name = F.concat(F.when(F.col("item_id") % 10 == 0, "REF").otherwise("seed"), F.lit("-js-"), F.lpad(F.col("item_id").cast("string"), 3, "0"))
    own = table(spark, d, "benchmark").select(name.alias("id"), F.lit("JavaScript").alias("targetLanguage"), F.col("text").alias("instruction"), F.lit("export {}").alias("code"), F.array(F.lit(DIFFICULTY), F.lit("array")).alias("tags"))
    writers.record_files(own, f"{path}/javascript", "id")
    return readers.seeds(spark, f"{path}/javascript").select("id", "ord", F.sha2("instruction", 256).alias("instruction_sha256"))


def held_out_round_trip(spark, d):
    """Held-out tasks written by language and read back with their index."""
    path, tasks = new_path(spark, "held-out"), generate.held_out_tasks(topics(spark, d))
    for code, name in (("js", "JavaScript"), ("html", "HTML"), ("fmt", "FreeMarker")):
        own = tasks.where(F.col("targetLanguage") == name).orderBy("task_index")
        writers.text_lines(own.select(F.to_json(F.struct("id", "targetLanguage", "topicId", "instruction", "tags", "acceptanceCriteria"))), f"{path}/{code}.jsonl")
    back = readers.held_out_tasks(spark, path)
    return back.select("id", "targetLanguage", "topicId", F.sha2("instruction", 256).alias("instruction_sha256"), F.array_join("acceptanceCriteria.mustContain", ",").alias("must"), F.col("task_index").cast("bigint").alias("task_index"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as held-out topics: the whole text as pattern, all of its words as keywords."""
    language = F.element_at(F.array(*map(F.lit, ("JavaScript", "HTML", "FreeMarker"))), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("HO-"), F.col("item_id").cast("string")).alias("id"), language.alias("language"), F.col("text").alias("pattern"), F.split(F.lower("text"), " ").alias("keywords"))


def event_log(spark, d):
    """Events as lines of the log, read back by kind and day."""
    path = new_path(spark, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("user_id").cast("string").alias("runId")))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    back = readers.events(spark, path)
    return back.groupBy("event", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("runId").alias("runs"))


def source_runs(spark: SparkSession, d: str) -> DataFrame:
    """Sources as benchmark runs, ranked: results written as documents and read back."""
    path = new_path(spark, "bench")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").withColumn("ok", F.coalesce("quality", F.lit(0)).cast("double"))
    by = rows.groupBy("source").agg(F.round(F.avg("ok"), 3).alias("p"), F.round(F.avg(F.when(F.col("lang") == "en", F.col("ok"))), 3).alias("en"), F.count(F.lit(1)).alias("n")).collect()  # a row per source
    for r in by:
        writers.write_json(spark, f"{path}/{r['source']}/results.json", {"runId": r["source"], "compressionMethod": "LoRA", "evidenceLevel": "Speculative", "loraRank": 8, "passAt1": r["p"], "passAt5": 1.0, "durationSeconds": float(r["n"]), "byLanguage": {"HTML": {"taskCount": r["n"], "passAt1": r["en"]}}})
    return ranking.ranked(readers.benchmark_runs(spark, path, sorted(r["source"] for r in by)), ord_col="ord")


def run_summaries(spark, d):
    """Sources as benchmark runs, laid out as a report's rows."""
    shown = ranking.summaries(source_runs(spark, d))
    return shown.select("rank", "runId", "evidenceLabel", "rankParameter", "passAt1", "passAt5", "durationSeconds", "jsPassAt1", "htmlPassAt1")


def report_page(spark, d):
    """The ranking report of all sources as its page is written, line by line."""
    path, runs = new_path(spark, "page"), source_runs(spark, d)
    writers.write_text(spark, f"{path}/report.md", ranking.markdown(runs, [], ranking.footnotes(runs, "ord")))
    return readers.numbered_lines(spark, f"{path}/report.md").select("line", "value")


def published(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Documents through filter, review and publication; the version's rows and manifest."""
    root = new_path(spark, "flow")
    curation.filter_run(records(spark, d), "run-1", f"{root}/drafts", Taxonomy(), SCOPE, RULES, NOW, rejected_log=f"{root}/rejected")
    queue = curation.prepare_review(spark, "run-1", f"{root}/drafts/run-1", f"{root}/review", Review(), NOW)
    said = lifecycle.auto_accept(readers.json_lines(spark, queue["samplePath"], schemas.EXAMPLE))
    curation.submit_review(spark, "run-1", f"{root}/drafts/run-1", f"{root}/review", Review(), said, "me", NOW)
    curation.publish(spark, f"{root}/drafts/run-1", "ds-2026-06-20-js-v1", f"{root}/published", Publish(), "me", NOW, f"{root}/events", skip_thresholds=True)
    return readers.published(spark, f"{root}/published", "ds-2026-06-20-js-v1")


def publish_flow(spark, d):
    rows, manifest = published(spark, d)
    return rows.select("id", F.sha2("instruction", 256).alias("instruction_sha256"), F.lit(manifest["exampleCount"]).cast("bigint").alias("published"), F.lit(manifest["state"]).alias("state"))


def budget_batches(spark, d):
    """Documents as replies of a teacher, paid by their length, until three fifths of the whole cost are spent; the batches as written, with the run's manifest."""
    root, config = new_path(spark, "spend"), Expansion()
    replies = records(spark, d, more=(F.col("n_chars").alias("inputTokens"), F.lit(400).alias("outputTokens")))
    whole = replies.agg(F.sum(text.cost_usd(F.col("inputTokens"), F.col("outputTokens"), config.input_usd, config.output_usd).cast("decimal(30,12)")).alias("usd")).first()["usd"]
    one = curation.spend(replies, "run-1", "JavaScript", root, replace(config, max_budget_usd=round(float(whole) * 0.6, 4)))
    back = spark.read.schema(f"ord BIGINT, batch BIGINT, {schemas.EXAMPLE}").json(f"{root}/run-1/batches")
    told = readers.parsed(spark.read.text(f"{root}/run-1/manifest.json", wholetext=True), "candidateCount BIGINT, batchCount BIGINT, spentUsd DOUBLE, inputTokens BIGINT, outputTokens BIGINT, state STRING")
    return back.select(F.col("ord").alias("doc_id"), "batch", F.sha2("instruction", 256).alias("instruction_sha256")).join(F.broadcast(told.select("candidateCount", "batchCount", F.lit(one["spentUsd"]).alias("spentUsd"), "inputTokens", "outputTokens", "state")))  # one manifest


def published_index(spark, d):
    """Documents published by language as versions, two publishers at a time, the English ones twice; the log as it is read back."""
    root, docs = new_path(spark, "index"), table(spark, d, "documents")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    entry = lambda lang, n: {"datasetVersion": f"ds-2026-06-20-{lang}-v1", "draftId": "run-1", "state": "Published", "exampleCount": n, "publishedAt": NOW, "publishedBy": "me"}
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda lang: writers.append_index(spark, root, entry(lang, counts[lang])), sorted(counts)))
    writers.append_index(spark, root, entry("en", counts.get("en", 0) + 1))
    last = readers.latest_published(spark, root).select("datasetVersion", F.col("exampleCount").alias("latest"))
    return readers.published_index(spark, root).join(last, "datasetVersion").select("datasetVersion", "exampleCount", "latest", "state")


def language_run(spark, d):
    """The whole of a language's run over documents as replies: spend, filter, review, publish; the version's rows with each step of the log."""
    root = new_path(spark, "language")
    replies = records(spark, d, more=(F.col("n_chars").alias("inputTokens"), F.lit(400).alias("outputTokens")))
    log = curation.run_language(spark, "JavaScript", root, SCOPE, NOW, Expansion(max_budget_usd=1e9), RULES, Review(), Publish(), "run-1", "ds-2026-06-20-js-v1", auto_approve=True, skip_thresholds=True, replies=replies)
    steps = F.lit(",".join(f"{s}:{'ok' if ok else 'failed'}" for s, ok, _ in log.rows))
    rows, _ = readers.published(spark, f"{root}/published", "ds-2026-06-20-js-v1")
    events = readers.events(spark, f"{root}/events").agg(F.count_if(F.col("event") == "DatasetPublished").alias("events"))
    return rows.select("id", F.sha2("instruction", 256).alias("instruction_sha256"), steps.alias("steps")).join(F.broadcast(events))  # one count


def example_files(spark, d):
    """Documents as files of JSON lines of three languages, read by the scan of examples."""
    root = new_path(spark, "example-files")
    own = records(spark, d, "seed", 3).withColumn("targetLanguage", F.element_at(F.array(*map(F.lit, DIRECTORY)), (F.col("ord") % 3 + 1).cast("int"))).withColumn("topicId", F.col("ord").cast("string"))
    for name, folder in DIRECTORY.items():
        writers.json_lines(own.where(F.col("targetLanguage") == name).drop("ord"), f"{root}/lines/{folder}.jsonl")
    parts = [readers.examples(spark, f"{root}/lines/{folder}.jsonl").withColumn("folder", F.lit(folder)) for folder in DIRECTORY.values()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.col("topicId").cast("bigint").alias("doc_id"), "id", "targetLanguage", "folder", F.sha2("code", 256).alias("code_sha256"))


def seed_drafts(spark, d):
    """Benchmark items as seed files in the folders of their languages, read as a draft's seeds."""
    root = new_path(spark, "seed-drafts")
    own = topics(spark, d).select(F.concat(F.lit("seed-"), F.col("ord").cast("string")).alias("id"), F.col("language").alias("targetLanguage"), F.col("pattern").alias("instruction"))
    for name, folder in DIRECTORY.items():
        writers.record_files(own.where(F.col("targetLanguage") == name), f"{root}/{folder}", "id")
    return readers.draft_seeds(spark, root).select("id", "targetLanguage", F.sha2("instruction", 256).alias("instruction_sha256"))


def reply_defaults(spark, d):
    """Answers of the conversations as candidates, language and metadata filled in where a reply left them out."""
    said = table(spark, d, "conversations").where("role = 'assistant'")
    language = F.when(F.col("conv_id") % 2 == 0, "HTML")
    meta = F.when(F.col("conv_id") % 3 == 0, F.struct(F.lit("me").alias("author"), F.lit("2026-01-01").alias("created"), F.lit("synthetic").alias("source"), F.lit(None).cast("string").alias("notes")))
    rows = said.select("conv_id", "turn", F.col("text").alias("instruction"), language.alias("targetLanguage"), meta.alias("metadata"))
    return generate.with_defaults(rows, "FreeMarker", "2026-06-20").select("conv_id", "turn", "targetLanguage", "metadata.author", "metadata.created", F.sha2("instruction", 256).alias("instruction_sha256"))


def few_shots(spark, d):
    """All benchmark items as few-shots of a prompt."""
    return generate.few_shots(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")).select(F.sha2("few_shots", 256).alias("few_shots_sha256"), F.length("few_shots").cast("bigint").alias("characters"))


def topic_counts(spark, d):
    """Held-out topics and their keywords by language."""
    return topics(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("topics"), F.sum(F.size("keywords")).cast("bigint").alias("keywords"))


def logged_events(spark, d):
    """Runs of two events each for every source, appended one after the other to the log by its sink and read back."""
    path = new_path(spark, "event-sink")
    counts = sorted((r["source"], r["n"]) for r in table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per source
    for kind in ("TrainingRunStarted", "TrainingRunCompleted"):
        writers.append_events([{"event": kind, "timestamp": NOW, "runId": source, "examples": n} for source, n in counts], spark, path)
    back = readers.events(spark, path)
    return back.select("event", "runId", F.from_json("payload", "examples BIGINT")["examples"].alias("examples"))


def shuffled_subset(spark, d):
    """A subset to train on as a seeded shuffle by Python's own generator draws it."""
    rows = sampling.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"], "ord")
    return sampling.shuffled_subset(rows, "ord", 42, 200).select("drawn", "doc_id")


QUERIES = {f.__name__: f for f in (language_run, example_files, seed_drafts, reply_defaults, few_shots, topic_counts, logged_events, shuffled_subset, budget_batches, published_index, cascade_rows, cascade_summary, promotion_failures, baseline_dedup, rule_resolver, rule_resolver_whole, response_extraction, hub_ids, smoke_summary, shot_pool, parity_sample, json_lines_round_trip, ordered_lines, raw_candidates, seed_folders, held_out_round_trip, event_log, run_summaries, report_page, publish_flow)}

STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x1c-\x1f\x0b\x85\x{{a0}}]+', ''), '[\s\x1c-\x1f\x0b\x85\x{{a0}}]+$', '')"
RECORDS = f"""(SELECT doc_id, lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS four, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS three, text AS i, CASE WHEN doc_id % 3 = 0 THEN 'var a; ' ELSE 'export ' END || text AS c,
    doc_id % 5 <> 0 AS tagged, {STRIP.format('text')} = '' AS blank FROM documents)"""
LEAK = r"""CASE WHEN regexp_matches(lower(i || chr(10) || c), '(^|[^a-z0-9_])that($|[^a-z0-9_])') THEN 'HO-JS-001'' via keyword ''that''' WHEN contains(lower(i || chr(10) || c), 'of the') THEN 'HO-JS-001'' via keyword ''of the'''
    WHEN regexp_matches(lower(i || chr(10) || c), '(^|[^a-z0-9_])nicht($|[^a-z0-9_])') THEN 'HO-JS-002'' via keyword ''nicht''' END"""
SCHEMA = "CASE WHEN blank THEN 'instruction: must be a non-empty string' WHEN length(i) < 20 THEN 'instruction: must be at least 20 characters' WHEN length(c) < 10 THEN 'code: must be at least 10 characters' WHEN NOT tagged THEN 'tags: must include at least one domain tag for JavaScript' END"
SYNTAX = "CASE WHEN NOT contains(c, 'export ') AND NOT contains(c, 'function ') THEN 'missing export or function declaration' WHEN length(replace(c, '{', '')) <> length(replace(c, '}', '')) THEN 'unbalanced braces' END"
VERB = "[" + ", ".join(f"'{v}'" for v in VERBS) + "]"
QUALITY = f"""CASE WHEN length(i) < 40 THEN 'instruction shorter than 40 characters' WHEN contains(lower(i), 'haha') THEN 'instruction contains vague phrase ''haha'''
    WHEN NOT list_has_any(regexp_split_to_array(replace(lower(i), '-', ' '), '\\s+'), {VERB}) THEN 'instruction must start with an imperative verb (write, create, build, …)' END"""
CASCADE = f"""WITH r AS (SELECT *, {SCHEMA} AS f1, {SYNTAX} AS f2, {QUALITY} AS f3, {LEAK} AS f4 FROM {RECORDS}),
    k AS (SELECT *, CASE WHEN f1 IS NOT NULL THEN 0 WHEN f2 IS NOT NULL THEN 1 WHEN f3 IS NOT NULL THEN 2 WHEN f4 IS NOT NULL THEN 3 ELSE 4 END AS n FROM r)"""
TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
PAIRS = f"""t AS (SELECT doc_id, source, list_sort({TOKENS}) AS ts FROM documents),
    q AS (SELECT x, y, sx, sy, CASE WHEN s = 0 THEN 1.0 ELSE CAST(i AS DOUBLE) / (s - i) END AS sim FROM (
        SELECT a.doc_id AS x, b.doc_id AS y, a.source AS sx, b.source AS sy, len(list_intersect(a.ts, b.ts)) AS i, len(a.ts) + len(b.ts) AS s FROM t a JOIN t b ON a.doc_id < b.doc_id AND least(len(a.ts), len(b.ts)) >= 0.95 * greatest(len(a.ts), len(b.ts)) - 1e-9))"""
HELD = "(SELECT item_id AS ord, 'HO-' || item_id AS id, ['JavaScript', 'HTML', 'FreeMarker'][item_id % 3 + 1] AS language, ['js', 'html', 'fmt'][item_id % 3 + 1] AS c, text, string_split(lower(text), ' ') AS ws FROM benchmark)"
HELD_NO = "row_number() OVER (PARTITION BY language ORDER BY ord)"



def page_sql() -> str:
    """The lines of the report: those of its layout, a line for each run and a footnote for each."""
    heads = list(ranking.HEADS.values())
    layout = ranking.REPORT.format(warnings="", heads=" | ".join(heads), rules=" | ".join("---" for _ in heads), lines="@runs", footnotes="\n## Footnotes\n\n@notes\n", buckets="").split("\n")
    rows = ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(layout))
    return f"""WITH l AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id), s AS (SELECT source, round(avg(coalesce(q, 0)), 3) AS p, round(avg(CASE WHEN lang = 'en' THEN coalesce(q, 0) END), 3) AS en, CAST(count(*) AS DOUBLE) AS n FROM documents LEFT JOIN l USING (doc_id) GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY p DESC, n, source) AS rank, row_number() OVER (ORDER BY source) AS ord FROM s), y(i, x) AS (VALUES {rows}),
        e AS (SELECT i, 0 AS k, x AS value FROM y WHERE x NOT IN ('@runs', '@notes')
              UNION ALL SELECT i, rank, '| ' || rank || ' | LoRA | L4 | r=8 | — | ' || coalesce(printf('%.1f%%', en * 100), '—') || ' | — | — | ' || printf('%.1f', n) || ' | — |' FROM r, y WHERE x = '@runs'
              UNION ALL SELECT i, ord, '- **LoRA** (`' || source || '`): L4 Speculative — not ranked as best without explicit label' FROM r, y WHERE x = '@notes')
        SELECT row_number() OVER (ORDER BY i, k) - 1 AS line, value FROM e QUALIFY line < (SELECT count(*) FROM e) - 1 OR value <> ''"""


ORACLE_SQL = {
    "cascade_rows": f"""{CASCADE} SELECT doc_id, n = 4 AS accepted, ['SCHEMA_INVALID', 'SYNTAX_FAIL', 'QUALITY_BAR', 'HELD_OUT_LEAK', NULL][n + 1] AS "reasonCode",
        CASE n WHEN 0 THEN 'SeedValidationError [syn-js-' || four || '] ' || f1 WHEN 1 THEN f2 WHEN 2 THEN f3 WHEN 3 THEN 'HeldOutLeakDetected: example ''syn-js-' || four || ''' matches held-out topic ''' || f4 END AS message,
        array_to_string(['SchemaValidation', 'SyntaxValidation', 'InstructionQuality', 'HeldOutLeak'][1:n], ',') AS passed FROM k""",
    "cascade_summary": f"""{CASCADE} SELECT count(*) AS "candidateCount", count(*) FILTER (n = 4) AS "acceptedCount", count(*) FILTER (n < 4) AS "rejectedCount", count(*) FILTER (n >= 2) AS "syntaxPassCount", round(count(*) FILTER (n >= 2) / count(*), 6) AS "syntaxPassRate",
        count(*) FILTER (n >= 2) / count(*) >= 0.9 AS "br005SyntaxSatisfied", count(*) FILTER (n = 4) >= 1500 AS "br005CountSatisfied", count(*) FILTER (n = 4) > 0 AS "readyForManualReview" FROM k""",
    "promotion_failures": f"""WITH r AS (SELECT *, {SCHEMA} AS f1, {SYNTAX} AS f2, {LEAK} AS f4 FROM {RECORDS}), {PAIRS}, e AS (SELECT ts, min(doc_id) AS least FROM t GROUP BY ts)
        SELECT 'seed-js-' || three AS seed_id, 'SchemaValidation' AS gate, 'SeedValidationError [seed-js-' || three || '] ' || f1 AS message FROM r WHERE f1 IS NOT NULL
        UNION ALL SELECT 'seed-js-' || three, 'SyntaxValidation', f2 FROM r WHERE f1 IS NULL AND f2 IS NOT NULL
        UNION ALL SELECT 'seed-js-' || three, 'HeldOutLeak', 'HeldOutLeakDetected: example ''seed-js-' || three || ''' matches held-out topic ''' || f4 FROM r WHERE f1 IS NULL AND f4 IS NOT NULL
        UNION ALL SELECT 'seed-js-' || lpad(CAST(x % 1000 AS VARCHAR), 3, '0'), 'DuplicateCheck', 'instruction similarity ' || printf('%.2f', round(sim, 6)) || ' with seed-js-' || lpad(CAST(y % 1000 AS VARCHAR), 3, '0')
        FROM q WHERE sim >= 0.95 AND sim < 1 AND x IN (SELECT least FROM e) AND y IN (SELECT least FROM e)""",
    "baseline_dedup": f"WITH {PAIRS} SELECT doc_id, EXISTS (SELECT 1 FROM q WHERE sim >= 0.95 AND ((y = doc_id) OR (x = doc_id AND sy = 'src0'))) AS duplicate FROM t WHERE source <> 'src0'",
    "rule_resolver": """WITH b AS (SELECT item_id, 'rule-' || (item_id % 50) AS rule, unnest(string_split(lower(text), ' ')[1:3]) AS trig, item_id % 25 = 0 AS always FROM benchmark), w(k) AS (VALUES ('the'), ('and some of them'), ('del'))
        SELECT rule, min(item_id) AS ord FROM b WHERE always OR (trig <> '' AND EXISTS (SELECT 1 FROM w WHERE contains(trig, k) OR contains(k, trig))) GROUP BY rule""",
    "rule_resolver_whole": """WITH b AS (SELECT item_id, 'rule-' || (item_id % 50) AS rule, unnest(string_split(lower(text), ' ')) AS trig, item_id % 25 = 0 AS always FROM benchmark), w(k) AS (VALUES ('the'), ('and some of them'), ('del'))
        SELECT rule, min(item_id) AS ord FROM b WHERE always OR (trig <> '' AND EXISTS (SELECT 1 FROM w WHERE contains(trig, k) OR contains(k, trig))) GROUP BY rule""",
    "response_extraction": f"SELECT doc_id, sha256({STRIP.format('text')}) AS response_sha256 FROM documents",
    "hub_ids": "SELECT doc_id, [ 'Qwen/Qwen2.5-Coder-0.5B', 'own/model', NULL, 'Qwen/Qwen2.5-Coder-1.5B'][doc_id % 4 + 1] AS hub_id, CAST('0x' || substr(sha256(source), 1, 12) AS BIGINT) AS source_number, round(n_chars / 1073741824.0, 12) AS gb FROM documents",
    "smoke_summary": "SELECT count(*) AS \"taskCount\", count(*) FILTER (quality = 1) AS \"passedCount\", round(count(*) FILTER (quality = 1) / count(*), 6) AS \"passAt1\", count(*) FILTER (quality = 1) / count(*) >= 0.6 AS \"gateSatisfied\" FROM labels",
    "shot_pool": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "json_lines_round_trip": f"SELECT 'syn-js-' || four AS id, 'JavaScript' AS \"targetLanguage\", sha256(i) AS instruction_sha256, CAST(length(c) AS INT) AS code_length, CASE WHEN tagged THEN 'L1-trivial,array' ELSE 'L1-trivial,zzz' END AS tags, 'synthetic' AS source, true AS unjudged FROM {RECORDS}",
    "ordered_lines": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, 'syn-js-' || four AS id, true AS whole FROM {RECORDS}",
    "budget_batches": f"""WITH c AS (SELECT doc_id, n_chars, text, CAST(n_chars * 3.0 / 1e6 + 400 * 15.0 / 1e6 AS DECIMAL(30, 12)) AS usd FROM documents),
        s AS (SELECT *, sum(usd) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent, round(CAST(sum(usd) OVER () AS DOUBLE) * 0.6, 4) AS most FROM c),
        o AS (SELECT *, CAST(spent AS DOUBLE) > most AS over, spent - usd <= most AS called FROM s),
        m AS (SELECT count(*) FILTER (NOT over) AS n, count(DISTINCT doc_id // 25) FILTER (NOT over) AS b, round(CAST(max(spent) AS DOUBLE), 4) AS usd, CAST(sum(n_chars) AS BIGINT) AS i, count(*) * 400 AS o, CASE WHEN bool_or(over) THEN 'Failed' ELSE 'Filtering' END AS state FROM o WHERE called)
        SELECT doc_id, doc_id // 25 AS batch, sha256(text) AS instruction_sha256, n AS "candidateCount", b AS "batchCount", m.usd AS "spentUsd", i AS "inputTokens", m.o AS "outputTokens", state FROM o CROSS JOIN m WHERE NOT over""",
    "language_run": f"{CASCADE} SELECT 'syn-js-' || four AS id, sha256(i) AS instruction_sha256, 'generate:ok,filter:ok,prepare-review:ok,submit-review:ok,publish:ok' AS steps, 1::BIGINT AS events FROM k WHERE n = 4",
    "example_files": """SELECT doc_id, 'seed-js-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS id, ['JavaScript', 'HTML', 'FreeMarker'][doc_id % 3 + 1] AS "targetLanguage", ['javascript', 'html', 'freemarker'][doc_id % 3 + 1] AS folder,
        sha256(CASE WHEN doc_id % 3 = 0 THEN 'var a; ' ELSE 'export ' END || text) AS code_sha256 FROM documents""",
    "seed_drafts": "SELECT 'seed-' || item_id AS id, ['JavaScript', 'HTML', 'FreeMarker'][item_id % 3 + 1] AS \"targetLanguage\", sha256(text) AS instruction_sha256 FROM benchmark",
    "reply_defaults": """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'HTML' ELSE 'FreeMarker' END AS "targetLanguage", CASE WHEN conv_id % 3 = 0 THEN 'me' ELSE 'teacher-model' END AS author, CASE WHEN conv_id % 3 = 0 THEN '2026-01-01' ELSE '2026-06-20' END AS created, sha256(text) AS instruction_sha256
        FROM conversations WHERE role = 'assistant'""",
    "few_shots": """WITH j AS (SELECT string_agg('{' || chr(10) || '  "id" : ' || item_id || ',' || chr(10) || '  "text" : ' || CAST(to_json(text) AS VARCHAR) || chr(10) || '}', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY item_id) AS f FROM benchmark)
        SELECT sha256(f) AS few_shots_sha256, length(f) AS characters FROM j""",
    "topic_counts": f"SELECT language, count(*) AS topics, CAST(sum(len(ws)) AS BIGINT) AS keywords FROM {HELD} GROUP BY language",
    "logged_events": "SELECT e AS event, source AS \"runId\", count(*) AS examples FROM documents, (VALUES ('TrainingRunStarted'), ('TrainingRunCompleted')) v(e) GROUP BY ALL",
    "published_index": """WITH c AS (SELECT 'ds-2026-06-20-' || lang || '-v1' AS v, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT v, n FROM c UNION ALL SELECT v, n + 1 FROM c WHERE v LIKE '%-en-%')
        SELECT v AS "datasetVersion", n AS "exampleCount", max(n) OVER (PARTITION BY v) AS latest, 'Published' AS state FROM e""",
    "raw_candidates": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, true AS batched, sha256(i) AS instruction_sha256, sha256(c) AS code_sha256 FROM {RECORDS}",
    "seed_folders": "SELECT 'seed-js-' || lpad(CAST(item_id AS VARCHAR), 3, '0') AS id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS ord, sha256(text) AS instruction_sha256 FROM benchmark WHERE item_id % 10 <> 0",
    "held_out_round_trip": f"""SELECT 'ho-' || c || '-' || lpad(CAST({HELD_NO} AS VARCHAR), 3, '0') AS id, language AS "targetLanguage", id AS "topicId", sha256(CASE c WHEN 'js' THEN 'Implement ' || lower(text) || ' in plain JavaScript (ES modules).' WHEN 'html' THEN 'Build a complete HTML5 page for: ' || text || '.'
        ELSE 'Write a FreeMarker template for: ' || text || '.' END) AS instruction_sha256, array_to_string(ws[1:2], ',') AS must, {HELD_NO} - 1 AS task_index FROM {HELD}""",
    "event_log": "SELECT event_type AS event, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS events, count(DISTINCT user_id) AS runs FROM events GROUP BY ALL",
    "run_summaries": """WITH l AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id), s AS (SELECT source, round(avg(coalesce(q, 0)), 3) AS p, round(avg(CASE WHEN lang = 'en' THEN coalesce(q, 0) END), 3) AS en, CAST(count(*) AS DOUBLE) AS n FROM documents LEFT JOIN l USING (doc_id) GROUP BY source)
        SELECT CAST(row_number() OVER (ORDER BY p DESC, n, source) AS INT) AS rank, source AS "runId", 'L4' AS "evidenceLabel", 'r=8' AS "rankParameter", p AS "passAt1", 1.0::DOUBLE AS "passAt5", n AS "durationSeconds", NULL::DOUBLE AS "jsPassAt1", en AS "htmlPassAt1" FROM s""",
    "report_page": page_sql(),
    "publish_flow": f"{CASCADE} SELECT 'syn-js-' || four AS id, sha256(i) AS instruction_sha256, count(*) OVER () AS published, 'Published' AS state FROM k WHERE n = 4",
}
