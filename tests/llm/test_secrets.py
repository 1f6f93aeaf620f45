import hashlib
import re
import time

from pyspark.sql import functions as F

from curaloom.llm import secrets

from .helpers import awkward, empty

BASE = ((r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I, 2, 8), (r"AKIA[A-Z0-9]+", 0, 0, 16), (r"[0-9a-f]+", 0, 0, 32))


def plain(text):
    out = []
    for k, (p, flags, group, least) in enumerate(BASE):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "", flags) if len(m[group]) >= least]
    return sorted(out)


LIVE = "Zx9T" + "aB3dE5fG7hJ9kL1mN3pQ"  # made up, for tests
ROWS = [
    (1, f"token = {LIVE} and {LIVE}", "o1"),
    (2, "Api_Key: 'abcdefgh' PASSWORD=short secret == x", "o2"),
    (3, "AKIA" + "Q" * 12 + " AKIA1 " + "0a" * 16 + " " + "f" * 31, "o1"),
    (4, "copied Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8 here", "o1"),
    (5, "copied Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8 here", "o2"),
    (6, "own Qq1Ww2Ee3Rr4Tt5Yy6Uu7Ii8 here", "o3"),
    (7, "own Qq1Ww2Ee3Rr4Tt5Yy6Uu7Ii8 here", "o3"),
    (8, "token=api_key:abcdefgh12", "o3"),
    (9, "é😀 secret=" + "9" * 20, None),
]


def scan(spark):
    docs = spark.createDataFrame([(a, b, c, "z") for a, b, c in ROWS], "doc_id bigint, text string, source string, id string").repartition(2)
    return secrets.scan(docs, owner=F.col("source"), repo=F.col("source"))


def test_base_spans(spark):
    for r in secrets.digest(scan(spark)).collect():
        want = plain(next(t for k, t, _ in ROWS if k == r["id"]))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in want) for k in range(3)]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(",")) | {""}


def test_ownership_decides_the_wider_patterns(spark):
    spans = {r["id"]: r["spans"] for r in secrets.digest(scan(spark)).collect()}
    assert spans[4] == spans[5] == ""  # two owners have it: a copied example
    assert spans[6] == spans[7] == "opaque:4:28"  # one owner's, in two places
    assert spans[1].startswith("assign:0:32,opaque:")  # the span inside the base one is not repeated
    assert len(spans[1].split(",")) == 2


def test_ownership_counts(spark):
    found = {r["id"]: r["found"] for r in scan(spark).collect()}
    assert {(x["owners"], x["repos"]) for x in found[6]} == {(1, 1)}


def test_many_matches_of_one_text(spark):
    """More matches than a block of sums holds."""
    text = " ".join(f"token=abcdefgh{i}" for i in range(1000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = secrets.scan(docs).first()["found"]
    assert [(x["start"], x["end"]) for x in got if x["kind"] == "assign"] == [(a, b) for a, k, b in plain(text) if k == 0]


def test_repositories_decide_too(spark):
    """A value of one owner in many repositories is a template's."""
    value = "Qq1Ww2Ee3Rr4Tt5Yy6Uu7Ii8"
    rows = [(i, f"own {value}{'x' if i < 2 else ''} here", "o", f"r{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string")
    got = {r["id"]: r for r in secrets.digest(secrets.scan(docs, owner=F.col("source"), repo=F.col("repo"))).collect()}
    assert [got[i]["spans"] for i in range(6)] == ["opaque:4:29", "opaque:4:29", "", "", "", ""]
    assert [(got[i]["most_owners"], got[i]["most_repos"]) for i in (0, 3)] == [(1, 2), (0, 0)]
    wide = {r["id"]: r for r in secrets.digest(secrets.scan(docs, owner=F.col("source"), repo=F.col("repo"), most_repos=4)).collect()}
    assert wide[3]["spans"] == "opaque:4:28" and wide[3]["most_repos"] == 4


def test_places_of_very_many_matches_take_seconds(spark):
    text = " ".join(f"token=abcdefgh{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.monotonic()
    got = secrets.digest(secrets.scan(docs)).first()
    want = plain(text)
    assert got["n_assign"] == 100_000 and got["base_sha256"] == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in want).encode()).hexdigest()
    assert time.monotonic() - began < 60


def test_clashes_of_very_many_spans_take_seconds(spark):
    """Wider spans beside and inside base ones, a hundred thousand in one text; none is held against each other one."""
    n = 50_000
    value = lambda i: f"Aa1{i:021d}"  # noqa: E731  an opaque run of 24 characters
    text = " ".join(f"token={value(i)} {value(n + i)}" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.monotonic()
    got = secrets.scan(docs).first()["found"]
    width = len(f"token={value(0)} {value(0)} ")
    assert [(x["kind"], x["start"], x["end"]) for x in got[:4]] == [("assign", 0, 30), ("opaque", 31, 55), ("assign", width, width + 30), ("opaque", width + 31, width + 55)]
    assert len(got) == 2 * n and time.monotonic() - began < 90


def test_spans_that_touch_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "AKIA" + "A" * 16 + "aB3aB3aB3aB3aB3aB3aB3aB3aB3"), (2, "token=abcdefgh ghp_" + "aB3" * 12)], "doc_id bigint, text string")
    got = {r["id"]: [(x["kind"], x["start"], x["end"]) for x in r["found"]] for r in secrets.scan(docs).collect()}
    assert got == {1: [("access", 0, 20)], 2: [("assign", 0, 14), ("prefixed", 15, 55), ("opaque", 19, 55)]}


def test_awkward(spark):
    got = secrets.scan(awkward(spark), owner=F.col("source"), repo=F.col("lang")).collect()
    assert len(got) == awkward(spark).count()
    assert secrets.scan(empty(spark)).count() == 0
