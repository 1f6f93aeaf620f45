import random

import pytest
from pyspark.sql import functions as F

from curaloom import schemas
from curaloom.config import Gates, Taxonomy
from curaloom.operators import contamination, gates, similarity
from curaloom.operators.dedup import ordered_duplicates

KEYWORDS = [("JavaScript", 0, "HO-1", 0, "express"), ("JavaScript", 0, "HO-1", 1, "jwt"), ("JavaScript", 1, "HO-2", 0, "api route"), ("JavaScript", 1, "HO-2", 1, "next.js"), ("HTML", 2, "HO-3", 0, "grid")]


def record(**change):
    base = {"id": "syn-js-0001", "targetLanguage": "JavaScript", "instruction": "Write a function that adds two numbers", "code": "export function add(a, b) { return a + b; }", "tags": ["functional", "L2-standard"], "metadata": ("teacher", "2026-01-01", "synthetic", None), "judgeScore": None, "topicId": None}
    return tuple((base | change)[k] for k in ("id", "targetLanguage", "instruction", "code", "tags", "metadata", "judgeScore", "topicId"))


def table(spark, *records):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(records)], f"ord bigint, {schemas.EXAMPLE}")


@pytest.mark.parametrize("change,field,message", [
    ({}, None, None),
    ({"id": None}, "id", "must match syn-(js|html|fmt)-NNNN"),
    ({"id": "syn-js-0001\n"}, "id", "must match syn-(js|html|fmt)-NNNN"),
    ({"targetLanguage": "Rust"}, "targetLanguage", "must be JavaScript, HTML, or FreeMarker"),
    ({"targetLanguage": None}, "targetLanguage", "must be JavaScript, HTML, or FreeMarker"),
    ({"targetLanguage": "HTML"}, "id", "language prefix 'html' must appear in id for HTML"),
    ({"instruction": "\t  "}, "instruction", "must be a non-empty string"),
    ({"instruction": "too short"}, "instruction", "must be at least 20 characters"),
    ({"code": None}, "code", "must be a non-empty string"),
    ({"code": "x"}, "code", "must be at least 10 characters"),
    ({"tags": ["L2-standard"]}, "tags", "must be an array with at least 2 items"),
    ({"tags": None}, "tags", "must be an array with at least 2 items"),
    ({"tags": ["L2-standard", " "]}, "tags", "each tag must be a non-empty string"),
    ({"tags": ["functional", "module"]}, "tags", "must include exactly one difficulty tag (L1-trivial … L4-edge-case)"),
    ({"tags": ["L1-trivial", "L2-standard", "module"]}, "tags", "must include exactly one difficulty tag (L1-trivial … L4-edge-case)"),
    ({"tags": ["L2-standard", "L2-standard", "module"]}, None, None),
    ({"tags": ["L2-standard", "forms"]}, "tags", "must include at least one domain tag for JavaScript"),
    ({"metadata": None}, "metadata", "is required"),
    ({"metadata": ("a", " ", "synthetic", None)}, "metadata.created", "is required"),
    ({"metadata": ("a", "b", "web", None)}, "metadata.source", "invalid source value"),
    ({"metadata": ("a", "b", "manual", None)}, "metadata.source", "must be 'synthetic' for synthetic examples"),
])
def test_schema(spark, change, field, message):
    got = table(spark, record(**change)).select(gates.schema_fault(Taxonomy())).first()[0]
    want_id = change.get("id", "syn-js-0001") or "<unknown>"
    assert got == (None if field is None else f"SeedValidationError [{want_id}] {field}: {message}")


@pytest.mark.parametrize("text,topic,want", [
    ("use express here", None, ("HO-1", "express")), ("use _express and express2", None, None), ("jwt only", None, None), ("an API Route now", None, ("HO-2", "api route")), ("nextxjs", None, None), ("with next.js!", None, ("HO-2", "next.js")),
    ("api route, express", None, ("HO-1", "express")), ("grid", None, None), ("nothing", "HO-3", ("HO-3", "HO-3")), ("nothing", "other", None),
])
def test_leak(spark, text, topic, want):
    row = spark.createDataFrame([(text, "JavaScript", topic)], "t string, l string, topic string")
    got = row.select(contamination.leak(KEYWORDS, F.col("t"), F.lit(None).cast("string"), F.col("l"), F.col("topic"))).first()[0]
    assert (got and tuple(got)) == want


def test_leak_in_any_language(spark):
    row = spark.createDataFrame([("grid",)], "t string")
    assert tuple(row.select(contamination.leak(KEYWORDS, F.col("t"), F.lit(""))).first()[0]) == ("HO-3", "grid")


def test_containing(spark):
    docs = spark.createDataFrame([(1, "aa the quick brown fox bb"), (2, "xthe quick browny"), (3, "the quick"), (4, None), (5, "zz ab yy")], "k bigint, t string")
    items = spark.createDataFrame([(1, "the quick brown"), (2, "ab"), (3, "quick brown fox jumps"), (4, None)], "i bigint, x string")
    got = {tuple(r) for r in contamination.containing(docs, "k", "t", items, "i", "x").collect()}
    assert got == {(1, 1), (2, 1), (5, 2)}


def test_cascade(spark):
    near = "Write a function that adds two numbers"
    rows = table(
        spark,
        record(),  # accepted
        record(id="bad"),
        record(id="syn-js-0002", code="const x = 1; //"),
        record(id="syn-js-0003", instruction="Please help me to write some function"),
        record(id="syn-js-0004", instruction="this instruction has no verb in it at all"),
        record(id="syn-js-0005", instruction=near + "!"),  # copy of the first
        record(id="syn-js-0006", instruction="Create a small express server for two numbers"),  # leak
        record(id="syn-js-0007", instruction="Create a small express server for two numbers."),  # the leak was not accepted, so a leak again
        record(id="syn-js-0008", instruction=near, code="export function x() { return 'express'; }"),  # copy and leak: a copy
        record(id="syn-js-0009", instruction="Build a page of numbers in a list", judgeScore=0.5),
        record(id="syn-js-0010", instruction="Build a page of numbers in a list", judgeScore=0.9),  # the low one does not stand in its way
    )
    got = {r["id"]: r for r in gates.cascade(rows, Taxonomy(), Gates(judge=False), KEYWORDS).collect()}
    reasons = {k[-4:]: r["reasonCode"] for k, r in got.items()}
    assert reasons == {"0001": None, "bad": "SCHEMA_INVALID", "0002": "SYNTAX_FAIL", "0003": "QUALITY_BAR", "0004": "QUALITY_BAR", "0005": "DUPLICATE", "0006": "HELD_OUT_LEAK", "0007": "HELD_OUT_LEAK", "0008": "DUPLICATE", "0009": None, "0010": "DUPLICATE"}
    assert got["syn-js-0006"]["gatesPassed"] == ["SchemaValidation", "SyntaxValidation", "InstructionQuality", "DuplicateCheck"]
    assert got["syn-js-0003"]["message"] == "instruction contains vague phrase 'help me'"
    assert got["syn-js-0001"]["gatesPassed"][-1] == "HeldOutLeak"
    judged = {r["id"][-4:]: (r["reasonCode"], r["message"]) for r in gates.cascade(rows, Taxonomy(), Gates(judge=True), KEYWORDS).collect()}
    assert judged["0009"] == ("LOW_JUDGE_SCORE", "judgeScore 0.50 below minimum") and judged["0010"][0] is None
    assert judged["0001"] == ("LOW_JUDGE_SCORE", "missing judgeScore") and judged["0005"][0] == "LOW_JUDGE_SCORE"
    one = gates.gate_summary(gates.cascade(rows, Taxonomy(), Gates(), KEYWORDS), Gates()).first()
    assert (one["candidateCount"], one["acceptedCount"], one["syntaxPassCount"], one["syntaxPassRate"]) == (11, 2, 9, 9 / 11)


def test_cascade_with_baseline_and_without_rows(spark):
    rows = table(spark, record())
    seeds = table(spark, record(id="seed-js-001", instruction="write A function, that adds two numbers"))
    assert gates.cascade(rows, Taxonomy(), Gates(), KEYWORDS, seeds).first()["reasonCode"] == "DUPLICATE"
    assert gates.cascade(rows, Taxonomy(), Gates(duplicate=False), KEYWORDS, seeds).first()["accepted"]
    nothing = gates.cascade(rows.limit(0), Taxonomy(), Gates(), KEYWORDS)
    one = gates.gate_summary(nothing, Gates()).first()
    assert one["candidateCount"] == 0 and one["syntaxPassRate"] == 0.0


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0


def one_pass(rows, t, base=()):
    kept, out = list(base), {}
    for k, text, fit in rows:
        out[k] = any(jaccard(text, x) >= t for x in kept)
        if fit and not out[k]:
            kept.append(text)
    return out


def test_ordered_duplicates_are_those_of_one_pass(spark):
    rng = random.Random(7)
    for threshold in (0.5, 0.7):
        rows = [(i, " ".join(rng.sample("a b c d e f".split(), rng.randint(0, 6))), rng.random() < 0.8) for i in range(80)]
        base = ["a b c", "d e"]
        df = spark.createDataFrame(rows, "k bigint, t string, fit boolean").repartition(3)
        old = spark.createDataFrame([(x,) for x in base], "t string")
        got = {r["key"]: r["duplicate"] for r in ordered_duplicates(df, "k", "k", "t", "fit", threshold).collect()}
        assert got == one_pass(rows, threshold)
        got = {r["key"]: r["duplicate"] for r in ordered_duplicates(df, "k", "k", "t", "fit", threshold, baseline=old).collect()}
        assert got == one_pass(rows, threshold, base)


def test_chain_keeps_its_ends(spark):
    rows = [(1, "a b c d", True), (2, "b c d e", True), (3, "c d e f", True)]  # 1 ~ 2 ~ 3, 1 not ~ 3
    df = spark.createDataFrame(rows, "k bigint, t string, fit boolean")
    got = {r["key"]: r["duplicate"] for r in ordered_duplicates(df, "k", "k", "t", "fit", 0.6).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_similar_classes_lose_no_pair(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(sorted(rng.sample("a b c d e f g h i".split(), rng.randint(0, 9)))), rng.choice("xy")) for i in range(120)]
    df = spark.createDataFrame(rows, "k bigint, t string, g string")
    for threshold in (0.4, 0.8, 1.0):
        links = {r["key"]: r["links"] for r in similarity.duplicates(df, "k", "t", threshold, "g").collect()}
        assert links == {k: sum(jaccard(t, u) >= threshold and g == h and k != m for m, u, h in rows) for k, t, g in rows}


def test_promotion(spark):
    meta = ("me", "2026-01-01", "manual", None)
    seeds = table(spark, record(id="seed-js-001", metadata=meta), record(id="seed-js-002", metadata=meta, code="const express = 1;"), record(id="x", metadata=meta, code="y"))
    pairs = spark.createDataFrame([("seed-js-001", "seed-js-002", 1.0)], "left_id string, right_id string, similarity double")
    got = {(r["seed_id"], r["gate"]) for r in gates.promotion_failures(seeds, Taxonomy(), KEYWORDS, pairs).collect()}
    assert got == {("seed-js-002", "SyntaxValidation"), ("seed-js-002", "HeldOutLeak"), ("x", "SchemaValidation"), ("seed-js-001", "DuplicateCheck")}
    counts = {r["targetLanguage"]: r["rows"] for r in gates.counts_by_language(seeds).collect()}
    assert counts == {"JavaScript": 3, "HTML": 0, "FreeMarker": 0}


def test_instruction_quality_is_that_of_whole_words(spark):
    rng = random.Random(9)
    own = Gates(instruction_length=3, vague_phrases=("help me", "todo"), verbs=("write", "add"))
    parts = ["write", "add", "Add,", "WRITE", "x-write", "writes", "help", "me", "todo", "\t", " ", "-", "\n", "é", "add "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(0, 5))) for _ in range(300)]

    def plain(t):
        low = t.lower().strip()
        if len(t) < 3:
            return "short"
        if any(p in low for p in own.vague_phrases):
            return "vague"
        return None if set(low.replace("-", " ").split()) & set(own.verbs) else "verb"

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gates.quality_fault(own, F.col("t")).alias("f")).collect()
    kind = lambda f: None if f is None else "short" if "shorter" in f else "vague" if "vague" in f else "verb"
    assert [(r["t"], kind(r["f"])) for r in rows] == [(t, plain(t)) for t in texts]


def test_many_short_items_are_found_without_a_cap(spark):
    docs = spark.createDataFrame([(1, "xab cdy"), (2, "q7 1199 zz"), (3, ""), (4, None), (None, "q7")], "k int, t string")
    items = spark.createDataFrame([(i, f"{i}") for i in range(1000, 2500)] + [(1, "b c"), (2, "q7 1"), (3, ""), (4, None), (5, "zz"), (6, "d")], "i int, x string")
    got = {tuple(r) for r in contamination.containing(docs, "k", "t", items, "i", "x").collect()}
    assert got == {(1, 1), (1, 3), (1, 6), (2, 2), (2, 3), (2, 5), (2, 1199), (3, 3)}


def test_containment_moves_no_text_beside_each_word(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(i, f"{i} {text}") for i in range(20)], "k int, t string")
    items = spark.createDataFrame([(1, "w7 w8 w9"), (2, "w9 w8 w7")], "i int, x string")
    want = {(k, 1) for k in range(20)}
    assert {tuple(r) for r in contamination.containing(docs, "k", "t", items, "i", "x").collect()} == want
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in contamination.containing(docs, "k", "t", items, "i", "x").collect()} == want


def test_a_long_chain_of_similar_rows_is_decided(spark):
    """Each row is similar to its neighbours alone, so every second one stays."""
    n = 12
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(n)]
    got = {r["key"]: r["duplicate"] for r in ordered_duplicates(spark.createDataFrame(rows, "k int, t string"), "k", "k", "t", "true", 39 / 41).collect()}
    assert got == {i: i % 2 == 1 for i in range(n)}
