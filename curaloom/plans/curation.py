"""From candidates to a published dataset: expand, filter, review, publish.

Each step is one DataFrame plan with small documents around it.  Times come in as
arguments, so a run can be repeated exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Expansion, Gates, Publish, Review, Scope, Taxonomy
from ..functions.text import cost_usd
from ..operators import gates as gating
from ..operators import generate, lifecycle, sampling
from ..sources import readers, writers
from ..storage import store
from ..vocabulary import DIRECTORY

#: Ids and decisions that a review's documents list; beyond that the sample's file holds them.
LISTED = 10_000
COLUMNS = ["id", "targetLanguage", "instruction", "code", "tags", "metadata", "judgeScore", "topicId"]


class SeedsInsufficient(Exception):
    """Fewer gold seeds than an expansion needs."""


def expand(spark: SparkSession, run_id: str, language: str, folder: str, config: Expansion, seeds: DataFrame, created: str, target: int | None = None, max_batches: int | None = None) -> dict:
    """Candidates of the stand-in, within the budget, in batches; returns the manifest, which it also writes."""
    have = seeds.count()
    if have < config.min_gold_seeds:
        raise SeedsInsufficient(f"SeedCountInsufficient: {language} has {have} seeds, need >= {config.min_gold_seeds}")
    goal = target or config.target_count
    return spend(generate.mock_candidates(spark, language, goal, created, config.batch_size), run_id, language, folder, config, goal, max_batches)


def spend(replies: DataFrame, run_id: str, language: str, folder: str, config: Expansion, target: int | None = None, max_batches: int | None = None) -> dict:
    """Replies within the budget, in batches; returns the manifest, which it also writes.

    Replies have ``ord`` (the order of the calls), ``inputTokens``, ``outputTokens``
    and the columns of an example.  The call that goes over the budget is paid, but
    its reply isn't used and no later call is made.  Any number of replies is summed
    by many tasks.
    """
    spark = replies.sparkSession
    made = replies if "batch" in replies.columns else replies.withColumn("batch", generate.batch_of(F.col("ord"), config.batch_size))
    if max_batches is not None:
        made = made.where(F.col("batch") < max_batches)
    made = store(made, "replies", "zstd")  # replies are asked for once
    cost = cost_usd(F.col("inputTokens"), F.col("outputTokens"), config.input_usd, config.output_usd)
    costed = store(lifecycle.running_cost(made.select("ord", "batch", "inputTokens", "outputTokens"), [], ["ord"], cost, config.max_budget_usd), "costed")  # texts stay where they are
    end = costed.where("over").agg(F.min("ord").alias("ord")).first()["ord"]
    kept = made if end is None else made.where(F.col("ord").isNull() | (F.col("ord") < end))
    writers.batches(kept.select("batch", "ord", *COLUMNS), f"{folder}/{run_id}/batches")
    calls = costed if end is None else costed.where(F.col("ord") <= end)
    used = F.lit(True) if end is None else F.col("ord") < end
    paid = calls.agg(F.count_if(used).alias("n"), F.count_distinct(F.when(used, F.col("batch"))).alias("b"), F.coalesce(F.max("spent"), F.lit(0.0)).alias("usd"), F.coalesce(F.sum("inputTokens"), F.lit(0)).alias("i"), F.coalesce(F.sum("outputTokens"), F.lit(0)).alias("o")).first()
    failed = end is not None
    state = lifecycle.step("generation", lifecycle.step("generation", "Pending", "Generating"), "Failed" if failed else "Filtering")
    reason = f"BudgetExceeded: spent ${paid['usd']:.4f} exceeds max ${config.max_budget_usd:.2f}" if failed else None
    manifest = {"runId": run_id, "targetLanguage": language, "promptVersion": config.prompt_version, "teacherModel": config.model, "candidateCount": paid["n"], "batchCount": paid["b"], "targetCount": target or config.target_count, "spentUsd": round(paid["usd"], 4), "inputTokens": paid["i"], "outputTokens": paid["o"], "state": state, "failed": failed, "failureReason": reason}
    writers.write_json(spark, f"{folder}/{run_id}/manifest.json", manifest)
    return manifest


def filter_run(candidates: DataFrame, run_id: str, folder: str, tax: Taxonomy, scope: Scope, gates: Gates, filtered_at: str, baseline: DataFrame | None = None, language: str | None = None, rejected_log: str | None = None, upstream_state: str | None = None) -> dict:
    """Candidates through the gates; writes accepted and rejected rows and the manifest, which it returns.

    A run whose generation failed isn't filtered.
    """
    spark = candidates.sparkSession
    if upstream_state == "Failed":
        raise writers.PublishError(f"generation run {run_id} failed; its batches are not filtered")
    decided = store(gating.cascade(candidates, tax, gates, scope.keywords(), baseline), "decided", "zstd")
    first = decided.agg(F.min_by("targetLanguage", "ord").alias("l")).first()["l"] or language
    if first is None:
        raise ValueError("cannot infer target language from empty candidate set")
    place = f"{folder}/{run_id}"
    writers.json_lines(decided.where("accepted").orderBy("ord").select(*COLUMNS), f"{place}/accepted.jsonl")
    rejected = decided.where("NOT accepted").select(*COLUMNS, "accepted", "reasonCode", "message", "gatesPassed")
    nested = rejected.select(F.struct(*COLUMNS).alias("example"), F.col("id").alias("exampleId"), "reasonCode", "message", "gatesPassed", F.lit(filtered_at).alias("rejectedAt"))
    writers.json_lines(nested, f"{place}/rejected.jsonl", codec="gzip")
    if rejected_log:
        writers.append_rejected(rejected, rejected_log, run_id, filtered_at)
    one = gating.gate_summary(decided, gates).first().asDict()
    reasons = {r["reasonCode"]: r["rows"] for r in gating.reason_counts(decided).collect()}
    manifest = {"runId": run_id, "targetLanguage": first, "filteredAt": filtered_at, **one, "syntaxPassRate": round(one["syntaxPassRate"], 4), "rejectionsByReason": reasons, "gatesConfigVersion": gates.version, "state": "Filtering"}
    writers.write_json(spark, f"{place}/filter-manifest.json", manifest)
    return manifest


def update_manifest(spark: SparkSession, draft: str, **more) -> None:
    path = f"{draft}/filter-manifest.json"
    if readers.exists(spark, path):
        writers.write_json(spark, path, readers.read_json(spark, path) | more)


def prepare_review(spark: SparkSession, run_id: str, draft: str, review: str, config: Review, created_at: str) -> dict:
    """A sample of the accepted rows to be looked at; returns the queue, which it also writes."""
    accepted = readers.json_lines(spark, f"{draft}/accepted.jsonl", schemas.EXAMPLE)
    count = accepted.count()
    if not count:
        raise ValueError("cannot prepare manual review for empty accepted set")
    size = sampling.sample_size(count, config.sample_rate, config.min_sample)
    sample = store(sampling.hash_sample(accepted, "id", run_id, size), "review-sample")
    writers.json_lines(sample, f"{review}/{run_id}/sample.jsonl")
    ids = [r["id"] for r in sample.orderBy(sampling.turn(run_id, F.col("id"))).select("id").collect()] if size <= LISTED else []  # what a person can read
    queue = {"runId": run_id, "targetLanguage": sample.first()["targetLanguage"], "acceptedCount": count, "sampleRate": config.sample_rate, "sampleSize": size, "sampleExampleIds": ids, "status": "Pending", "createdAt": created_at, "configVersion": config.version, "reviewCriteria": list(config.criteria), "samplePath": f"{review}/{run_id}/sample.jsonl"}
    writers.write_json(spark, f"{review}/{run_id}/review-queue.json", queue)
    writers.write_json(spark, f"{draft}/review-queue.json", queue)
    update_manifest(spark, draft, state="AwaitingManualReview", manualReviewSampleSize=size)
    return queue


def submit_review(spark: SparkSession, run_id: str, draft: str, review: str, config: Review, decided: DataFrame, reviewed_by: str, reviewed_at: str) -> dict:
    """The outcome of the decisions (``exampleId, decision``); returns the manifest, which it also writes.

    A rejected sample ends the run as failed; missing decisions leave it pending.
    """
    queue = readers.read_json(spark, f"{draft}/review-queue.json")
    if queue["status"] != "Pending":
        raise ValueError(f"review queue is not pending: {queue['status']}")
    sample = readers.json_lines(spark, queue["samplePath"], schemas.EXAMPLE).select("id")
    one = lifecycle.review_outcome(sample, decided, F.lit(queue["acceptedCount"]), config.sample_rate, config.all_accepted).first()
    if one["missing"]:
        raise ValueError(f"missing decisions for {one['missing']} sample example(s)")
    status, final = ("Approved", "Completed") if one["approved"] else ("Rejected", "Failed")
    lifecycle.step("generation", "AwaitingManualReview", final)
    own = decided.join(sample.withColumnRenamed("id", "exampleId"), "exampleId").select("exampleId", "decision")
    writers.json_lines(own, f"{review}/{run_id}/decisions.jsonl")
    said = {r["exampleId"]: r["decision"] for r in own.collect()} if one["sampleSize"] <= LISTED else {}
    manifest = {"runId": run_id, "targetLanguage": queue["targetLanguage"], "status": status, "sampleSize": one["sampleSize"], "acceptedInSample": one["acceptedInSample"], "rejectedInSample": one["rejectedInSample"], "sampleRate": config.sample_rate, "reviewedBy": reviewed_by, "reviewedAt": reviewed_at, "br005ManualReviewSatisfied": one["br005ManualReviewSatisfied"], "decisions": said, "finalState": final}
    writers.write_json(spark, f"{draft}/manual-review-manifest.json", manifest)
    for path in (f"{review}/{run_id}/review-queue.json", f"{draft}/review-queue.json"):
        writers.write_json(spark, path, queue | {"status": status, "reviewedAt": reviewed_at, "reviewedBy": reviewed_by})
    update_manifest(spark, draft, state=final, manualReviewStatus=status, br005ManualReviewSatisfied=one["br005ManualReviewSatisfied"])
    return manifest


def publish_check(spark: SparkSession, filtered: dict, reviewed: dict | None, accepted: int, version: str, rules: Publish, skip_thresholds: bool = False) -> list[str]:
    """All reasons why a draft can't be published."""
    reviewed_row = reviewed or {}
    row = spark.createDataFrame(
        [(filtered.get("state"), filtered.get("syntaxPassRate"), filtered.get("br005ManualReviewSatisfied"), reviewed is not None, reviewed_row.get("status"), reviewed_row.get("br005ManualReviewSatisfied"), accepted, version, filtered.get("targetLanguage"))],
        "state string, syntaxPassRate double, br005 boolean, reviewed boolean, reviewStatus string, reviewBr005 boolean, acceptedCount bigint, version string, targetLanguage string",
    )
    one = row.select(lifecycle.publish_failures(rules, skip_thresholds).alias("f"), lifecycle.version_fault(F.col("version"), F.col("targetLanguage"), rules.version_pattern).alias("v")).first()
    return ([one["v"]] if one["v"] else []) + list(one["f"])


def publish(spark: SparkSession, draft: str, version: str, root: str, rules: Publish, published_by: str, published_at: str, events: str | None = None, skip_thresholds: bool = False) -> dict:
    """A reviewed draft as an immutable version, with an entry in the index and an event."""
    filtered, reviewed = readers.draft(spark, draft)
    rows = readers.json_lines(spark, f"{draft}/accepted.jsonl", schemas.EXAMPLE)
    count = rows.count()
    failures = publish_check(spark, filtered, reviewed, count, version, rules, skip_thresholds)
    if failures:
        raise writers.PublishError("; ".join(failures))
    draft_id, language = filtered["runId"], filtered["targetLanguage"]
    manifest = {
        "datasetVersion": version, "draftId": draft_id, "state": "Published", "targetLanguage": language, "exampleCount": count, "syntaxPassRate": round(filtered.get("syntaxPassRate", 0.0), 4),
        "publishedAt": published_at, "publishedBy": published_by, "sourceRunId": draft_id, "br005Satisfied": bool(reviewed.get("br005ManualReviewSatisfied")),
        "filterManifestSnapshot": {k: filtered.get(k) for k in ("runId", "filteredAt", "gatesConfigVersion")}, "manualReviewSnapshot": {k: reviewed.get(k) for k in ("reviewedBy", "reviewedAt", "sampleSize")},
    }
    writers.publish_snapshot(rows, root, version, manifest)
    writers.append_index(spark, root, {k: manifest[k] for k in ("datasetVersion", "draftId", "targetLanguage", "exampleCount", "state", "publishedAt", "publishedBy")})
    if events:
        writers.append_events([{"event": "DatasetPublished", "timestamp": published_at, "datasetVersion": version, "draftId": draft_id, "targetLanguage": language, "exampleCount": count, "publishedBy": published_by}], spark, events)
    return manifest


def publish_mixed(spark: SparkSession, versions: list[str], mixed: str, root: str, rules: Publish, published_by: str, published_at: str, events: str | None = None) -> dict:
    """Several published versions one after the other as a version of their own; at least two languages."""
    fault = spark.range(1).select(lifecycle.version_fault(F.lit(mixed), F.lit(None).cast("string"), rules.version_pattern)).first()[0]
    if fault:
        raise writers.PublishError(fault)
    merged, counts = None, {}
    for nth, version in enumerate(versions):
        _, manifest = readers.published(spark, root, version)
        rows = readers.published_in_order(spark, root, version).withColumn("src_ord", F.lit(nth))
        merged = rows if merged is None else merged.unionByName(rows)
        for name in manifest["languages"]:
            counts[name] = counts.get(name, 0) + rows.where(F.col("targetLanguage") == name).count()
    if len(counts) < 2:
        raise writers.PublishError("mixed dataset requires at least two source languages")
    total = sum(counts.values())
    manifest = {"datasetVersion": mixed, "draftId": "+".join(versions), "state": "Published", "targetLanguages": sorted(counts), "exampleCount": total, "countsByLanguage": counts, "sourceVersions": versions, "publishedAt": published_at, "publishedBy": published_by, "br005Satisfied": all(n >= 1500 for n in counts.values())}
    writers.publish_snapshot(merged.orderBy("src_ord", "ord").drop("src_ord", "ord"), root, mixed, manifest)
    writers.append_index(spark, root, {k: manifest[k] for k in ("datasetVersion", "draftId", "targetLanguages", "exampleCount", "state", "publishedAt", "publishedBy")})
    if events:
        writers.append_events([{"event": "DatasetPublished", "timestamp": published_at, "datasetVersion": mixed, "draftId": manifest["draftId"], "targetLanguage": "JavaScript", "targetLanguages": manifest["targetLanguages"], "exampleCount": total, "publishedBy": published_by}], spark, events)
    return manifest


@dataclass
class Steps:
    """The log of a pipeline: ``(step, success, message)`` rows."""

    run_id: str
    rows: list[tuple[str, bool, str]] = field(default_factory=list)

    def add(self, step: str, success: bool, message: str) -> bool:
        self.rows.append((step, success, message))
        return success

    @property
    def failed(self) -> bool:
        return any(not ok for _, ok, _ in self.rows)

    def write(self, spark: SparkSession, path: str) -> None:
        writers.write_json(spark, path, {"runId": self.run_id, "failed": self.failed, "steps": [{"step": s, "success": ok, "message": m} for s, ok, m in self.rows]})


def run_language(spark: SparkSession, language: str, root: str, scope: Scope, now: str, expansion: Expansion, gates: Gates, review: Review, rules: Publish, run_id: str, version: str, seeds_root: str | None = None, auto_approve: bool = False, skip_thresholds: bool = False, stop_after: str | None = None, smoke: Callable[[], dict] | None = None, replies: DataFrame | None = None) -> Steps:
    """Expand, filter, prepare and submit the review, publish, and a smoke test if given; stops at the first failure or after ``stop_after``.

    ``replies`` are a teacher's (as ``spend`` takes them); without them the stand-in's are made.
    """
    log = Steps(run_id)
    seeds = readers.seeds(spark, f"{seeds_root}/{DIRECTORY[language]}") if seeds_root else spark.createDataFrame([], schemas.EXAMPLE)

    def steps():
        manifest = spend(replies, run_id, language, f"{root}/raw", expansion) if replies is not None else expand(spark, run_id, language, f"{root}/raw", expansion, seeds, now[:10])
        yield "generate", not manifest["failed"], manifest["failureReason"] or f"{manifest['candidateCount']} candidates"
        rows = spark.read.schema(f"batch BIGINT, ord BIGINT, {schemas.EXAMPLE}").json(f"{root}/raw/{run_id}/batches").drop("batch")
        found = filter_run(rows, run_id, f"{root}/drafts", Taxonomy(), scope, gates, now, seeds if seeds_root else None, language, f"{root}/rejected", manifest["state"])
        yield "filter", found["acceptedCount"] > 0, f"{found['acceptedCount']} accepted, {found['rejectedCount']} rejected"
        queue = prepare_review(spark, run_id, f"{root}/drafts/{run_id}", f"{root}/review", review, now)
        yield "prepare-review", True, f"{queue['sampleSize']} to review"
        if not auto_approve:
            return
        said = lifecycle.auto_accept(readers.json_lines(spark, queue["samplePath"], schemas.EXAMPLE))
        done = submit_review(spark, run_id, f"{root}/drafts/{run_id}", f"{root}/review", review, said, "auto", now)
        yield "submit-review", done["status"] == "Approved", done["status"]
        out = publish(spark, f"{root}/drafts/{run_id}", version, f"{root}/published", rules, "auto", now, f"{root}/events", skip_thresholds)
        yield "publish", True, f"{out['exampleCount']} examples"
        if smoke is not None:
            tried = smoke()
            yield "smoke-train", tried["gateSatisfied"], f"pass@1 {tried['passAt1']:.1%}"

    try:
        for name, ok, message in steps():
            if not log.add(name, ok, message) or name == stop_after:
                break
    except (ValueError, FileNotFoundError, SeedsInsufficient, writers.PublishError) as e:
        log.add(("generate", "filter", "prepare-review", "submit-review", "publish", "smoke-train")[min(len(log.rows), 5)], False, str(e))
    log.write(spark, f"{root}/review/{run_id}-steps.json")
    return log
