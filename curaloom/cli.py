"""Commands: ``filter``, ``promote``, ``review``, ``publish``, ``publish-mixed``, ``train``, ``benchmark`` and ``report export``."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from . import config
from .operators import gates, lifecycle
from .operators.similarity import duplicate_pairs
from .plans import curation, evaluation
from .session import session
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="curaloom")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("filter", help="batches of candidates through the gates")
    for name in ("run-id", "candidates", "drafts", "scope"):
        f.add_argument(f"--{name}", required=True)
    for name in ("gates", "taxonomy", "baseline", "rejected"):
        f.add_argument(f"--{name}")
    m = sub.add_parser("promote", help="draft seeds into a folder for each language, if none fails a gate")
    for name in ("seeds", "out", "scope"):
        m.add_argument(f"--{name}", required=True)
    m.add_argument("--taxonomy")
    m.add_argument("--similarity", type=float, default=0.95)
    v = sub.add_parser("review").add_subparsers(dest="action", required=True)
    for action in ("prepare", "submit"):
        own = v.add_parser(action)
        for name in ("run-id", "drafts", "review"):
            own.add_argument(f"--{name}", required=True)
        own.add_argument("--config")
    said = own.add_mutually_exclusive_group(required=True)
    said.add_argument("--decisions")
    said.add_argument("--approve-all", action="store_true")
    own.add_argument("--by", default="reviewer")
    u = sub.add_parser("publish")
    for name in ("draft", "version", "published"):
        u.add_argument(f"--{name}", required=True)
    x = sub.add_parser("publish-mixed")
    x.add_argument("--versions", nargs="+", required=True)
    for name in ("mixed", "published"):
        x.add_argument(f"--{name}", required=True)
    for own in (u, x):
        own.add_argument("--by", default="publisher")
        own.add_argument("--config")
        own.add_argument("--events")
    u.add_argument("--skip-thresholds", action="store_true")
    t = sub.add_parser("train")
    for name in ("run-id", "dataset-version", "method", "published", "checkpoints"):
        t.add_argument(f"--{name}", required=True)
    t.add_argument("--config")
    t.add_argument("--profile", default="smoke")
    t.add_argument("--rank", type=int)
    t.add_argument("--seed", type=int)
    t.add_argument("--events")
    b = sub.add_parser("benchmark")
    for name in ("run-id", "checkpoint", "held-out", "out"):
        b.add_argument(f"--{name}", required=True)
    b.add_argument("--config")
    b.add_argument("--max-tasks", type=int)
    b.add_argument("--events")
    r = sub.add_parser("report").add_subparsers(dest="action", required=True).add_parser("export")
    r.add_argument("--run-ids", nargs="+", required=True)
    for name in ("benchmarks", "output"):
        r.add_argument(f"--{name}", required=True)
    r.add_argument("--allow-mixed", action="store_true")
    r.add_argument("--events")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark, now = session(a.master), datetime.now(timezone.utc).isoformat()
    own_or = lambda read, path, default: read(path) if path else default()
    if a.command == "filter":
        rows = readers.raw_candidates(spark, a.candidates).select("ord", *curation.COLUMNS)
        base = readers.seeds(spark, a.baseline) if a.baseline else None
        done = curation.filter_run(rows, a.run_id, a.drafts, own_or(config.taxonomy, a.taxonomy, config.Taxonomy), config.scope(a.scope), own_or(config.gates, a.gates, config.Gates), now, base, rejected_log=a.rejected)
        print(f"{done['runId']}: {done['acceptedCount']} accepted, {done['rejectedCount']} rejected")
    elif a.command == "promote":
        rows = readers.draft_seeds(spark, a.seeds)
        pairs = duplicate_pairs(rows.where("corrupt IS NULL"), "id", "instruction", a.similarity).toDF("left_id", "right_id", "similarity")
        failures = gates.promotion_failures(rows, own_or(config.taxonomy, a.taxonomy, config.Taxonomy), config.scope(a.scope).keywords(), pairs)
        shown = failures.orderBy("seed_id", "gate").limit(100).collect()  # what a terminal can show
        for r in shown:
            print(f"{r['seed_id']}: {r['gate']}: {r['message']}")
        if shown:
            return 1
        writers.promoted_seeds(rows.drop("file", "ord", "corrupt"), a.out)
        print(f"seeds promoted to {a.out}")
    elif a.command == "review" and a.action == "prepare":
        done = curation.prepare_review(spark, a.run_id, f"{a.drafts}/{a.run_id}", a.review, own_or(config.review, a.config, config.Review), now)
        print(f"{done['runId']}: {done['sampleSize']} to review in {done['samplePath']}")
    elif a.command == "review":
        sample = readers.json_lines(spark, f"{a.review}/{a.run_id}/sample.jsonl", "id STRING")
        said = lifecycle.auto_accept(sample) if a.approve_all else lifecycle.decisions(spark.read.text(a.decisions, wholetext=True)).where("valid").select("exampleId", "decision")
        done = curation.submit_review(spark, a.run_id, f"{a.drafts}/{a.run_id}", a.review, own_or(config.review, a.config, config.Review), said, a.by, now)
        print(f"{done['runId']}: {done['status']}")
    elif a.command in ("publish", "publish-mixed"):
        rules = own_or(config.publish, a.config, config.Publish)
        done = curation.publish(spark, a.draft, a.version, a.published, rules, a.by, now, a.events, a.skip_thresholds) if a.command == "publish" else curation.publish_mixed(spark, a.versions, a.mixed, a.published, rules, a.by, now, a.events)
        print(f"{done['datasetVersion']}: {done['exampleCount']} examples")
    elif a.command == "train":
        own = config.train(a.config) if a.config else config.Train()
        done = evaluation.train(spark, a.run_id, a.dataset_version, a.method, a.published, a.checkpoints, own, a.profile, now, a.rank, a.seed, a.events)
        print(f"{done['runId']}: {done['trainExampleCount']} examples, {done['steps']} steps")
    elif a.command == "benchmark":
        own = config.benchmark(a.config) if a.config else config.Benchmark()
        done = evaluation.benchmark(spark, a.run_id, a.checkpoint, a.held_out, a.out, own, now, a.events, a.max_tasks)
        print(f"{done['runId']}: pass@1 {done['passAt1']:.1%}, pass@5 {done['passAt5']:.1%}")
    else:
        done = evaluation.report(spark, a.run_ids, a.benchmarks, a.output, now, allow_mixed=a.allow_mixed, events=a.events)
        print(f"{len(done['ranking'])} runs ranked in {a.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
