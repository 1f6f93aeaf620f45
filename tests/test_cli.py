"""Commands over temporary folders, one after the other as an operator runs them."""

import json

import pytest

from curaloom import cli
from curaloom.sources import readers, writers

SCOPE = {"version": "v1", "heldOutTestSetVersion": "held-out-v1", "targetLanguages": {}, "trainingTopics": [], "heldOutTopics": [{"id": "HO-JS-001", "language": "JavaScript", "pattern": "p", "keywords": ["express"]}]}
META = {"author": "me", "created": "2026-01-01", "source": "synthetic"}


def example(i, **more):
    return {"id": f"syn-js-{i:04d}", "targetLanguage": "JavaScript", "instruction": f"write a function for task number {'x' * i}", "code": "export const a = 1;", "tags": ["array", "L1-trivial"], "metadata": META, **more}


def test_from_batches_to_a_version(spark, tmp_path, capsys):
    root = f"file://{tmp_path}"
    (tmp_path / "scope.json").write_text(json.dumps(SCOPE))
    (tmp_path / "raw").mkdir()
    rows = [example(i) for i in range(1, 21)] + [example(21, code="const express = export 1;"), example(22, tags=[])]
    for n in (0, 1):
        (tmp_path / "raw" / f"batch-{n:03d}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows[n * 11 : n * 11 + 11]))
    assert cli.main(["filter", "--run-id", "r1", "--candidates", f"{root}/raw", "--drafts", f"{root}/drafts", "--scope", str(tmp_path / "scope.json"), "--rejected", f"{root}/rejected"]) == 0
    assert "r1: 20 accepted, 2 rejected" in capsys.readouterr().out
    common = ["--run-id", "r1", "--drafts", f"{root}/drafts", "--review", f"{root}/review"]
    assert cli.main(["review", "prepare", *common]) == 0
    ids = readers.read_json(spark, f"{root}/drafts/r1/review-queue.json")["sampleExampleIds"]
    (tmp_path / "said.json").write_text(json.dumps({"decisions": dict.fromkeys(ids, "ACCEPT")}))
    assert cli.main(["review", "submit", *common, "--decisions", f"{root}/said.json"]) == 0
    assert "Approved" in capsys.readouterr().out
    with pytest.raises(writers.PublishError, match="below minimum"):
        cli.main(["publish", "--draft", f"{root}/drafts/r1", "--version", "ds-2026-06-20-js-v1", "--published", f"{root}/published"])
    assert cli.main(["publish", "--draft", f"{root}/drafts/r1", "--version", "ds-2026-06-20-js-v1", "--published", f"{root}/published", "--skip-thresholds"]) == 0
    assert "ds-2026-06-20-js-v1: 20 examples" in capsys.readouterr().out
    with pytest.raises(writers.PublishError, match="at least two"):
        cli.main(["publish-mixed", "--versions", "ds-2026-06-20-js-v1", "--mixed", "ds-2026-06-20-mixed-v1", "--published", f"{root}/published"])


def test_promotion_says_what_fails(spark, tmp_path, capsys):
    (tmp_path / "scope.json").write_text(json.dumps(SCOPE))
    seed = lambda i, **more: example(i, id=f"seed-js-{i:03d}", metadata=META | {"source": "manual"}, **more)
    for name, rows in (("good", [seed(1), seed(2, instruction="create another thing that is not alike")]), ("bad", [seed(1), seed(2, code="no declaration here")])):
        (tmp_path / name / "javascript").mkdir(parents=True)
        for r in rows:
            (tmp_path / name / "javascript" / f"{r['id']}.json").write_text(json.dumps(r))
        done = cli.main(["promote", "--seeds", f"file://{tmp_path}/{name}", "--out", f"file://{tmp_path}/out-{name}", "--scope", str(tmp_path / "scope.json"), "--similarity", "1"])
        assert done == (name == "bad")
    assert "seed-js-002: SyntaxValidation: missing export" in capsys.readouterr().out
    assert spark.read.json(f"file://{tmp_path}/out-good").count() == 2
