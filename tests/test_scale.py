"""Operators that must not bring a hot key, a long chain or a large file into one task; each against a plain version."""

import json
import os
import random
import subprocess
import sys
import threading
import time
from decimal import Decimal
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curaloom.operators import contamination, lifecycle, prefix
from curaloom.operators.dedup import accepted_classes, ordered_duplicates
from curaloom.sources import readers, replies, writers
from curaloom.streaming import runs


def plain_sums(rows):
    """Running sums by key in the order of (ord), with what isn't a number counting nothing."""
    out, so_far = {}, {}
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        so_far[k] = so_far.get(k, Decimal(0)) + (Decimal(repr(v)) if v is not None and abs(v) < 1e17 else 0)
        out[k, o] = so_far[k]
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.one_of(st.none(), st.integers(0, 10_000)), st.sampled_from([0.1, 0.25, 1e-6, -3.0, None, float("inf"), float("nan"), 1e30])), max_size=40, unique_by=lambda r: r[:2]))
def test_running_sums(spark, rows):
    df = spark.createDataFrame(rows, "k int, o int, v double")
    got = {(r["k"], r["o"]): r["s"] for r in prefix.running_sums(df, ["k"], ["o"], F.col("v"), "s").collect()}
    want = {key: v for key, v in plain_sums([(k, o, None if v is None or v != v or abs(v) == float("inf") else v) for k, o, v in rows]).items()}
    assert got == want


def test_one_key_over_many_tasks(spark):
    """A key with all rows spans all ranges, and no range has more than its share."""
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), (F.col("id") % 7 / 10).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = prefix.running_sums(rows, ["k"], ["o"], F.col("v"), "s")
        tasks = [n for n in found.rdd.glom().map(len).collect() if n]
        assert len(tasks) >= 8 and max(tasks) < 20_000 / 4
        got = [r["s"] for r in found.orderBy("o").select("s").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == list(accumulate(Decimal(i % 7) / 10 for i in range(20_000)))


def test_budgets_end_where_one_pass_ends_them(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.choice([0.5, 0.25, 2.0, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, c double").repartition(5)
    costed = lifecycle.running_cost(df, ["k"], ["o"], F.col("c"), 20.0)
    want, spent, stopped = set(), {}, set()
    for k, o, c in rows:
        spent[k] = spent.get(k, 0) + (c or 0)
        stopped |= {k} if spent[k] > 20 else set()
        want |= set() if k in stopped else {(k, o)}
    assert {(r["k"], r["o"]) for r in lifecycle.within_budget(costed, ["k"], ["o"]).collect()} == want
    assert lifecycle.within_budget(costed.limit(0), ["k"], ["o"]).count() == 0


def greedy(first, edges):
    order, near, kept = dict(first), {}, set()
    for a, b in edges:
        near.setdefault(a, []).append(b)
    for k in sorted(order, key=order.get):
        if not any(x in kept for x in near.get(k, [])):
            kept.add(k)
    return {(k, order[k]) for k in kept}


@settings(max_examples=2, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(1000, 0), (3, 1), (0, 1)]))
def test_groups_are_decided_as_one_pass_would(spark, seed, how):
    rng, (group, rounds) = random.Random(seed), how
    first = [(f"c{i}", i) for i in range(60)]
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)} | {(i, i + 1) for i in range(20, 30)}
    edges = [(f"c{b}", f"c{a}") for a, b in pairs]
    got = accepted_classes(spark.createDataFrame(first, "class_id string, o bigint"), spark.createDataFrame(edges, "class_id string, other string"), group, rounds)
    assert {tuple(r) for r in got.collect()} == greedy(first, edges)


def test_a_chain_of_five_thousand_classes(spark):
    """Each class is similar to its neighbours alone, so every second one stays."""
    n = 5000
    first = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("class_id"), F.col("id").alias("o"))
    edges = spark.range(1, n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("class_id"), F.concat(F.lit("c"), (F.col("id") - 1).cast("string")).alias("other"))
    began = time.monotonic()
    got = {r["o"] for r in accepted_classes(first, edges).collect()}
    assert got == set(range(0, n, 2)) and time.monotonic() - began < 120


def test_rows_without_neighbours_and_with_equal_order(spark):
    rows = [(1, "a b c", True), (1, "a b c", True), (2, "x y z", True), (3, "", True), (4, "", True), (5, None, True)]
    df = spark.createDataFrame(rows, "k bigint, t string, fit boolean")
    got = sorted((r["key"], r["duplicate"]) for r in ordered_duplicates(df, "k", "k", "t", "fit", 0.9).collect())
    assert got == [(1, False), (1, False), (2, False), (3, False), (4, True), (5, True)]


def test_lines_of_a_file_that_many_tasks_read(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rng = random.Random(1)
        texts = {}
        for name, count in (("batch-2.jsonl", 700), ("batch-1.jsonl", 900), ("batch-3.jsonl", 0), ("batch-10.jsonl", 3)):
            rows = ["" if rng.random() < 0.1 else json.dumps({"id": f"{name}:{i}", "code": "é " * rng.randint(0, 40)}, ensure_ascii=False) for i in range(count)]
            (tmp_path / name).write_text("\n".join(rows) + ("\n" if rng.random() < 0.5 and rows else ""), encoding="utf-8")
            texts[name] = rows
        raw = readers.numbered_lines(spark, f"file://{tmp_path}", "batch-*.jsonl")
        assert raw.rdd.getNumPartitions() > 8
        got = [(r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in raw.orderBy("ord").collect()]
        want = []
        for name in sorted(texts):
            rows = texts[name][:-1] if texts[name] and texts[name][-1] == "" else texts[name]
            want += [(name, i, t) for i, t in enumerate(rows)]
        assert got == want and [r["ord"] for r in raw.select("ord").orderBy("ord").collect()] == list(range(len(want)))
        ids = [r["id"] for r in readers.raw_candidates(spark, f"file://{tmp_path}").orderBy("ord").collect()]
        assert ids == [f"{n}:{i}" for n, i, t in want if t]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_batch_files_keep_the_order(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("ord"), F.concat(F.lit("r"), (F.col("id") * 37 % 1000).cast("string")).alias("id")).repartition(7)
    n = writers.batch_files(rows, f"file://{tmp_path}/run")
    assert sorted(p.name for p in (tmp_path / "run").glob("batch-*.jsonl")) == [f"batch-{i:06d}.jsonl" for i in range(n)]
    assert [r["id"] for r in readers.raw_candidates(spark, f"file://{tmp_path}/run").orderBy("ord").collect()] == [f"r{i}" for i in range(1000)]


def test_publishers_at_one_time_lose_no_entry(spark, tmp_path):
    root, numbers = f"file://{tmp_path}", []

    def publish(who):
        for i in range(4):
            numbers.append(writers.append_index(spark, root, {"datasetVersion": f"v{who}", "exampleCount": i}))

    threads = [threading.Thread(target=publish, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == list(range(1, 13))
    rows = readers.published_index(spark, root).collect()
    assert sorted(r["entry"] for r in rows) == sorted(numbers) and sorted((r["datasetVersion"], r["exampleCount"]) for r in rows) == sorted((f"v{w}", i) for w in range(3) for i in range(4))
    assert {(r["datasetVersion"], r["exampleCount"]) for r in readers.latest_published(spark, root).collect()} == {(f"v{w}", 3) for w in range(3)}
    assert len(json.loads((tmp_path / "published-index.json").read_text())) == 12
    assert not writers.claimed(spark, f"{root}/published-index/00000001.claim")
    assert readers.published_index(spark, f"{root}/none").count() == 0


def test_recorded_replies(spark, tmp_path):
    rows = [{"callId": f"c{i}", "ord": i, "text": "x" * (i % 50) + ' {"id": "é"}', "inputTokens": i, "outputTokens": 1, "model": "m"} for i in range(400)]
    lines = [json.dumps(r, ensure_ascii=False) for r in rows] + ["", "{broken", "[1]", '{"ord": "seven", "text": 5}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:200]) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[200:]), encoding="utf-8")
    (tmp_path / "_hidden").write_text("{}")
    for span in (64, 1000, 1 << 20):
        got = replies.recorded(spark, f"file://{tmp_path}", span)
        assert sorted((r["ord"], r["text"], r["candidate"]) for r in got.where("callId IS NOT NULL").collect()) == sorted((r["ord"], r["text"], '{"id": "é"}') for r in rows)
        assert got.count() == 403 and got.where("text IS NULL").count() == 3
    span = replies.spans(replies.files_of(f"file://{tmp_path}"), {}, 1000)[3]
    again = [[r for b in replies.rows_of(f"file://{tmp_path}", span) for r in b.to_pylist()] for _ in range(2)]
    assert again[0] == again[1] != []


def test_a_stream_of_replies_goes_on_where_it_stood(spark, tmp_path):
    def run():
        said = replies.recorded_stream(spark, f"file://{tmp_path}/in", 100)
        said.select("callId").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["callId"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    (tmp_path / "in").mkdir()
    line = lambda i: json.dumps({"callId": f"c{i:02d}", "ord": i, "text": "t"}) + "\n"
    (tmp_path / "in" / "a").write_text("".join(map(line, range(5))))
    assert run() == [f"c{i:02d}" for i in range(5)]
    with (tmp_path / "in" / "a").open("a") as f:
        f.write("".join(map(line, range(5, 9))))
    (tmp_path / "in" / "b").write_text(line(9))
    assert run() == [f"c{i:02d}" for i in range(10)]


FAILING = '''
import os
import sys
from curaloom.session import session
from curaloom.sources import replies

class Flaky(replies.Batch):
    def read(self, partition):
        open(f"{os.environ['SEEN']}/{os.path.basename(partition.path)}", "a").write("x")
        if partition.path.endswith("b") and os.path.getsize(f"{os.environ['SEEN']}/b") == 1:
            raise OSError("lost")
        yield from super().read(partition)

class Source(replies.RecordedReplies):
    def reader(self, schema):
        return Flaky(*self._told())

spark = session("local[2,4]", **{"spark.sql.shuffle.partitions": "2"})
spark.dataSource.register(Source)
print("ROWS", spark.read.format("recorded_replies").load(sys.argv[1]).count())
'''


def test_a_failed_partition_is_read_again_alone(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "seen").mkdir()
    for name in "abc":
        (tmp_path / "in" / name).write_text('{"callId": "1"}\n' * 3)
    script = tmp_path / "run.py"
    script.write_text(f"import sys\nsys.path.insert(0, {str(readers.__file__.rsplit('/curaloom/', 1)[0])!r})\n{FAILING}")
    done = subprocess.run([sys.executable, str(script), f"file://{tmp_path}/in"], env=os.environ | {"SEEN": str(tmp_path / "seen")}, capture_output=True, text=True, timeout=180)
    assert "ROWS 9" in done.stdout, done.stderr[-2000:]
    assert {p.name: len(p.read_text()) for p in (tmp_path / "seen").iterdir()} == {"a": 1, "b": 2, "c": 1}


def plain_leaks(rows, keywords):
    """The first keyword in order that a text has, by trying each."""
    import re

    out = {}
    for k, lang, text in rows:
        hits = [(to, ko, t, w) for kl, to, t, ko, w in keywords if w and lang is not None and kl == lang and text is not None and (w in text.lower() if " " in w else len(w) >= 4 and re.search(rf"(?<![a-z0-9_]){re.escape(w)}(?![a-z0-9_])", text.lower()))]
        if hits and k is not None:
            out[k] = min(hits)[2:]
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="abX_ .1é+\\", max_size=14), max_size=12), st.lists(st.text(alphabet="abx_ .1é+\\", max_size=9), max_size=12))
def test_keywords_met_by_key(spark, texts, words):
    rows = [(i, random.Random(i).choice(["en", "de", None]), t) for i, t in enumerate([*texts, None])]
    keywords = [("en" if i % 3 else "de", i // 2, f"T{i // 2}", i % 2, w) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "k int, lang string, t string")
    table = spark.createDataFrame(keywords, "language string, topic_ord int, topic_id string, kw_ord int, keyword string")
    got = {r["key"]: (r["topic"], r["keyword"]) for r in contamination.keyword_leaks(df, "k", F.col("t"), "lang", table).collect()}
    assert got == plain_leaks(rows, keywords)


def test_keywords_met_by_key_are_those_of_the_list(spark):
    words = ["api route", "next.js", "express", "c++ is", "...", "++++", "of", "jwt", "héé", "naïve", " lead", "tail ", "a b c d e f g h"]
    keywords = [("en", i, f"T{i}", 0, w) for i, w in enumerate(words)]
    texts = ["Use an API Route here", "next.js!", "nextxjs", "_express express2 express", "my c++ is old", "wait... what", "a ++++ b", "xhéé héé", "naïvely naïve", "the lead", "tail end", "a b c d e f g hi"]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "k int, lang string, t string")
    table = spark.createDataFrame(keywords, "language string, topic_ord int, topic_id string, kw_ord int, keyword string")
    got = {r["key"]: (r["topic"], r["keyword"]) for r in contamination.keyword_leaks(df, "k", F.col("t"), "lang", table).collect()}
    found = df.select("k", contamination.leak(keywords, F.col("t"), F.lit(None), F.col("lang")).alias("f")).where("f IS NOT NULL").collect()
    assert got == {r["k"]: (r["f"]["topic"], r["f"]["keyword"]) for r in found} and len(got) >= 9


def test_rows_bring_one_keyword_each_from_a_common_seam(spark, monkeypatch):
    kept, store = {}, contamination.store
    monkeypatch.setattr(contamination, "store", lambda df, name, *more: kept.setdefault(name, store(df, name, *more)))
    keywords = [("en", i, f"T{i}", 0, f"{'abc'[i % 3]}xon the{i:03d}") for i in range(60)]
    rows = [(i, "en", f"a long axon the{i:03d} and cxon the{i + 20:03d}, bxon then") for i in range(30)]
    df, table = spark.createDataFrame(rows, "k int, lang string, t string"), spark.createDataFrame(keywords, "language string, topic_ord int, topic_id string, kw_ord int, keyword string")
    got = {r["key"]: (r["topic"], r["keyword"]) for r in contamination.keyword_leaks(df, "k", F.col("t"), "lang", table).collect()}
    assert got == plain_leaks(rows, keywords) and len(got) >= 10
    assert kept["met-keywords"].count() <= len(rows)  # before, each keyword with that seam for each row


def test_keywords_in_long_pieces(spark):
    words = ["jwt_1", "...é", "_abc", "e.-.f", "next.js is", "x" * 300]
    keywords = [("en", i, f"T{i}", 0, w) for i, w in enumerate(words)]
    rng = random.Random(3)
    at = [*range(250, 262), *range(505, 570, 3), *(rng.randrange(0, 1500) for _ in range(40))]
    rows = [(i, "en", "é-" * (n // 2) + "." * (n % 2) + lead + words[i % 6] + tail + "-." * rng.randrange(0, 400)) for i, n in enumerate(at) for lead, tail in [rng.choice([("", ""), ("", "."), ("a", ""), ("", "_"), ("__", "."), ("\n", "\n")])]]
    df, table = spark.createDataFrame(rows, "k int, lang string, t string"), spark.createDataFrame(keywords, "language string, topic_ord int, topic_id string, kw_ord int, keyword string")
    got = {r["key"]: (r["topic"], r["keyword"]) for r in contamination.keyword_leaks(df, "k", F.col("t"), "lang", table).collect()}
    assert got == plain_leaks(rows, keywords) and 20 < len(got) < len(rows)


def plain_runs(events, legal, final, patience):
    out, last = [], max((t for _, _, t, _ in events), default=0)
    by = {}
    for run, state, t, n in events:
        by.setdefault(run, []).append((t, n, state))
    for run, own in by.items():
        own.sort()
        before = "Pending"
        for i, (t, _, state) in enumerate(own):
            if (before, state) not in legal:
                out.append((run, "illegal", before, state, t))
            nxt = own[i + 1][0] if i + 1 < len(own) else last
            if state not in final and nxt > t + patience:
                out.append((run, "unfinished", None, state, t))
            before = state
    return sorted(out, key=str)


@pytest.mark.parametrize("files_a_trigger", [1, 100])
def test_runs_are_followed_however_the_log_is_cut(spark, tmp_path, files_a_trigger):
    rng = random.Random(4)
    legal, final = {("Pending", "a"), ("a", "b"), ("b", "b"), ("b", "done")}, {"done"}
    events = [(f"r{rng.randint(0, 5)}", rng.choice(["a", "b", "done"]), rng.randint(0, 4000) * 1000, i) for i in range(120)]
    events = [e for e in events if e[0] not in ("r4", "r5") or e[2] < 1_500_000]  # two runs go silent
    events.sort(key=lambda e: e[2] // 400_000)  # files in the order of time; within one, in any
    stamp = lambda ms: time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(ms / 1000)) + "Z"
    (tmp_path / "log").mkdir()
    cut = [events[i : i + 30] for i in range(0, len(events), 30)] if files_a_trigger > 1 else [[e for e in events if e[2] // 400_000 == k] for k in range(11)]
    for i, part in enumerate(cut):
        (tmp_path / "log" / f"{i:02d}.json").write_text("".join(json.dumps({"run": r, "state": s, "at": stamp(t), "nth": n}) + "\n" for r, s, t, n in part))
        (tmp_path / "log" / f"{i:02d}.json").touch()
        os.utime(tmp_path / "log" / f"{i:02d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    found = runs.follow_log(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/out", f"file://{tmp_path}/state", 600_000, legal, final, files_a_trigger=files_a_trigger)
    got = sorted(((r["run"], r["kind"], r["previous"], r["state"], int(r["at"].timestamp() * 1000) + 0) for r in found.withColumn("at", F.col("at")).collect()), key=str)
    assert got == plain_runs(events, legal, final, 600_000)


def test_texts_are_stored_once_on_their_way_to_a_draft(spark, tmp_path, monkeypatch):
    from curaloom import storage
    from curaloom.config import Expansion, Gates, Scope, Taxonomy
    from curaloom.operators import gates, sampling
    from curaloom.plans import curation

    wide, narrow = [], []

    def seen(df, name, codec=None):
        (wide if "instruction" in df.columns else narrow).append(name)
        return storage.store(df, name, codec)

    for module in (curation, gates, prefix, lifecycle, sampling):
        monkeypatch.setattr(module, "store", seen)
    schema = "ord bigint, id string, targetLanguage string, instruction string, code string, tags array<string>, metadata struct<author: string, created: string, source: string, notes: string>, judgeScore double, topicId string, inputTokens bigint, outputTokens bigint"
    made = spark.createDataFrame([(i, f"syn-js-{i:04d}", "JavaScript", f"write a function that adds {i} numbers", "export const a = 1;" if i % 2 else "let", ["L1-trivial", "array"], ("me", "2026-01-01", "synthetic", None), None, None, 1000, 100) for i in range(40)], schema)
    one = curation.spend(made, "r1", "JavaScript", f"file://{tmp_path}/raw", Expansion(max_budget_usd=0.0999), 40)
    assert (one["candidateCount"], one["state"], wide) == (22, "Failed", ["replies"]) and "costed" in narrow
    back = spark.read.json(f"file://{tmp_path}/raw/r1/batches")
    assert sorted(r["ord"] for r in back.collect()) == list(range(22))
    wide.clear()
    found = curation.filter_run(made.drop("inputTokens", "outputTokens"), "r2", f"file://{tmp_path}/drafts", Taxonomy(), Scope("v1", "held-out-v1", (), (), {}), Gates(duplicate=False), "2026-01-01")
    assert wide == ["decided"] and found["acceptedCount"] + found["rejectedCount"] == 40


def test_high_thresholds_meet_by_parts_of_sets(spark):
    """Every similar pair meets, and little else does, though all words are frequent."""
    from curaloom.operators import similarity

    rng = random.Random(5)
    sets = []
    for n in (1, 5, 18, 19, 20, 38, 39, 40, 60, 150, 400):
        for _ in range(12):
            base = rng.sample([f"w{i}" for i in range(600)], n)
            sets.append(frozenset(base))
            for cut in (1, 2, 4, 8, 16):
                kept = rng.sample(base, max(1, n - rng.randint(0, cut)))
                sets.append(frozenset([*kept, *(f"v{rng.randint(0, 300)}" for _ in range(rng.randint(0, cut)))]))
    sets = sorted(set(sets), key=sorted)
    df = spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in enumerate(sets)], "k int, t string")
    for t in (0.9, 0.95, 1.0):
        want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}
        got = {(r["right_key"], r["left_key"]) for r in similarity.duplicate_pairs(df, "k", "t", t).collect()}
        assert got == want
    _, classes = similarity.token_classes(df, "k", "k", "t")
    met = similarity.met_by_segments(classes.withColumn("no", F.col("ord").cast("bigint")), 0.95).count()
    assert 0 < met < 2000 < len(sets) ** 2 / 200


def test_a_sum_right_at_the_budget_is_compared_as_its_sql_does(spark):
    """Values of cents that make 500 exactly, and more than 500 as doubles."""
    rng = random.Random(1)
    rows, n = [], 0
    for user in range(60):
        cents = [rng.randint(1, 9000) for _ in range(12)]
        for v in [*cents, 50_000 - sum(cents) % 50_000, 700]:
            rows.append((user, n, v / 100))
            n += 1
    for user in range(100, 110):
        rows += [(user, n + i, 0.1) for i in range(5001)]
        n += 5001
    want, so_far = {}, {}
    for user, i, v in rows:
        so_far[user] = so_far.get(user, 0.0) + v
        want[i] = so_far[user] > 500.0
    exact, total = {}, {}
    for user, i, v in rows:
        total[user] = total.get(user, Decimal(0)) + Decimal(repr(v))
        exact[i] = total[user] > 500
    assert exact != want  # doubles do fall on the other side here
    df = spark.createDataFrame(rows, "k int, o int, v double")
    over = lambda **how: {r["o"]: r["over"] for r in lifecycle.running_cost(df, ["k"], ["o"], F.col("v"), 500.0, **how).collect()}
    assert over(doubles=True) == want and over() == exact


def test_one_timer_and_one_pass_for_a_run():
    """A run's events cost one timer a batch, and one pass over what the watermark has passed."""
    from datetime import datetime, timedelta

    calls = {"timers": 0, "puts": 0, "gets": 0}
    held, last = [], []

    class State:
        def __init__(self, box):
            self.box = box

        exists = lambda self: bool(self.box)
        clear = lambda self: self.box.clear()
        appendValue = lambda self, v: self.box.append(v)
        appendList = lambda self, vs: self.box.extend(vs)

        def put(self, vs):
            calls["puts"] += 1
            self.box[:] = vs

        def get(self):
            calls["gets"] += 1
            return list(self.box) if self.box is held else self.box[0]

        def update(self, v):
            self.box[:] = [v]

    class Handle:
        def registerTimer(self, at):
            calls["timers"] += 1

    class Now:
        getExpiryTimeInMs = lambda self: runs.millis(start)
        getCurrentWatermarkInMs = lambda self: runs.millis(start) + 10**9

    start = datetime(2024, 1, 1)
    f = runs.Follower(frozenset({("Pending", "a"), ("a", "a")}), frozenset(), 10**12)
    f.handle, f.early, f.last = Handle(), State(held), State(last)
    list(f.handleInputRows(("r",), iter([{"state": "a", "at": start + timedelta(seconds=(7 * i) % 500), "nth": i} for i in range(500)]), Now()))
    assert list(f.handleExpiredTimer(("r",), Now(), Now())) == []
    assert calls["timers"] <= 2 and calls["puts"] == 0 and not held and last[0][1] == start + timedelta(seconds=499)


def test_a_table_of_keywords_gates_like_a_list(spark):
    from curaloom.config import Gates, Taxonomy
    from curaloom.operators import gates

    row = lambda n, text: (n, f"syn-js-{n:04d}", "JavaScript", text, "export const a = 1;", ["L1-trivial", "array"], ("me", "2026-01-01", "synthetic", None), None, None)
    schema = "ord bigint, id string, targetLanguage string, instruction string, code string, tags array<string>, metadata struct<author: string, created: string, source: string, notes: string>, judgeScore double, topicId string"
    texts = ["write a route for express here", "write an api  route for us now", "write an api route for us now", "short", "create something else without it"]
    rows = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], schema)
    words = [("JavaScript", 0, "A", 0, "express"), ("JavaScript", 1, "B", 0, "api route"), ("HTML", 2, "C", 0, "something")]
    table = spark.createDataFrame(words, "language string, topic_ord int, topic_id string, kw_ord int, keyword string")
    both = [sorted((r["id"], r["accepted"], r["reasonCode"] or "", r["message"] or "") for r in gates.cascade(rows, Taxonomy(), Gates(duplicate=False), k).collect()) for k in (words, table)]
    assert both[0] == both[1] and [r[2] for r in both[0]] == ["HELD_OUT_LEAK", "", "HELD_OUT_LEAK", "SCHEMA_INVALID", ""]


def test_a_shuffled_subset_is_pythons(spark):
    from curaloom.operators import sampling

    places = list(range(500))
    random.Random(7).shuffle(places)
    rows = spark.range(500).select(F.col("id").alias("ord"))
    got = sorted((r["drawn"], r["ord"]) for r in sampling.shuffled_subset(rows, "ord", 7, 60).collect())
    assert got == list(enumerate(places[:60]))
    with pytest.raises(ValueError, match="order of hashes"):
        sampling.shuffled_places(sampling.MOST_SHUFFLED + 1, 1, 1)


def test_a_file_for_each_record(spark, tmp_path):
    rows = spark.createDataFrame([("seed-1", "é"), ("REF-2", None), ("seed 3", "x")], "id string, instruction string")
    assert writers.record_files(rows, f"file://{tmp_path}/seeds", "id") == 3
    back = readers.seeds(spark, f"file://{tmp_path}/seeds", include_reference=True).orderBy("id").collect()
    assert [(r["id"], r["instruction"]) for r in back] == [("REF-2", None), ("seed 3", "x"), ("seed-1", "é")]
    assert not (tmp_path / "seeds" / "_staged").exists()
