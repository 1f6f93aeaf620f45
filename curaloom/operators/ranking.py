"""Comparing benchmark runs: are they comparable, which footnotes apply, how do they rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent
from ..vocabulary import EVIDENCE, LANGUAGES, PREFIX

TIE_BREAKERS = ("peakVramGb", "durationSeconds", "trainableParamCount")


class IncomparableRuns(Exception):
    """Runs of different test sets, models or, unless allowed, datasets."""


def evidence_label(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level), level)


def rank_label(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.concat(F.lit("r="), rank.cast("string"))).otherwise("—")


def language_rate(rates: Column, language: str) -> Column:
    """pass@1 of one language; null where the run has none."""
    return F.try_element_at(rates, F.lit(language))["passAt1"]


def ranked(runs: DataFrame, tie_breakers: tuple[str, ...] = TIE_BREAKERS, ord_col: str | None = None) -> DataFrame:
    """Runs with their ``rank``: pass@1 downwards, then each tie breaker upwards, nulls last, then input order."""
    order = [F.desc("passAt1"), *[F.asc_nulls_last(t) for t in tie_breakers], *([F.asc(ord_col)] if ord_col else [])]
    return runs.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a report's handful of runs


def comparability(runs: DataFrame) -> DataFrame:
    """One row: number of runs, distinct test sets, models and datasets, the datasets in order, and what that means."""
    one = runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("heldOutTestSetVersion").alias("testSets"), F.count_distinct("studentModel").alias("models"),
        F.count_distinct("datasetVersion").alias("datasets"), F.sort_array(F.collect_set("datasetVersion")).alias("datasetVersions"),
    )
    few = F.col("runs") < 2
    verdict = F.when(few, "comparable").when(F.col("testSets") > 1, "held-out test set versions differ across runs").when(F.col("models") > 1, "student models differ across runs").when(F.col("datasets") > 1, "dataset versions differ").otherwise("comparable")
    return one.withColumn("verdict", verdict)


def check_comparable(runs: DataFrame, allow_mixed: bool = False) -> list[str]:
    """Warnings; raises where runs may not be compared."""
    row = comparability(runs).first()
    if row["verdict"] == "comparable":
        return []
    message = row["verdict"]
    if message == "dataset versions differ":
        message = f"{message}: {list(row['datasetVersions'])}"
        if allow_mixed:
            return [message]
    raise IncomparableRuns(message)


def footnotes(runs: DataFrame, ord_col: str) -> DataFrame:
    """``runId, compressionMethod, reason`` in input order: parameter mismatches and speculative evidence."""
    mismatch = F.when(F.coalesce(F.col("paramMatch.footnoteRequired"), F.lit(False)), "BR-014 trainable params differ from anchor by > tolerance")
    wild = F.when(F.col("evidenceLevel") == "Speculative", "L4 Speculative — not ranked as best without explicit label")
    notes = F.filter(F.array(mismatch, wild), lambda n: n.isNotNull())
    return runs.select(F.col(ord_col).alias("ord"), "runId", "compressionMethod", F.posexplode(notes).alias("nth", "reason")).orderBy("ord", "nth").select("runId", "compressionMethod", "reason")


def summaries(runs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """A report row per ranked run, with a column of pass@1 for each language."""
    own = [F.bround(language_rate(F.col("byLanguage"), name), 4).alias(f"{PREFIX.get(name, name)}PassAt1") for name in languages]
    return runs.select(
        "rank", "runId", "compressionMethod", "evidenceLevel", evidence_label(F.col("evidenceLevel")).alias("evidenceLabel"), rank_label(F.col("loraRank")).alias("rankParameter"),
        F.bround("passAt1", 4).alias("passAt1"), F.bround("passAt5", 4).alias("passAt5"), "peakVramGb", "durationSeconds", "trainableParamCount", *own,
    ).orderBy("rank")


def or_dash(c: Column) -> Column:
    return F.coalesce(c, F.lit("—"))


def table_line(languages: tuple[str, ...] = LANGUAGES) -> Column:
    """A row of ``summaries`` as a line of a Markdown table."""
    cells = [percent(F.col(f"{PREFIX.get(name, name)}PassAt1")) for name in languages]
    shown = [F.col("rank").cast("string"), F.col("compressionMethod"), F.col("evidenceLabel"), F.col("rankParameter"), *[F.when(F.col(f"{PREFIX.get(n, n)}PassAt1").isNotNull(), c) for n, c in zip(languages, cells, strict=True)]]
    shown += [F.when(F.col(c).isNotNull(), F.format_string("%.1f", c)) for c in ("peakVramGb", "durationSeconds")] + [F.col("trainableParamCount").cast("string")]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[or_dash(c) for c in shown]), F.lit(" |"))


# The layout of the ranking report.  Fixed values: its title, its table and the heads of its language columns.
REPORT = """\
# Wave 1 Method Ranking

Benchmark runs on one test set, best first.

## How runs are ordered

- The share of tasks whose first sample passes decides.
- Runs with equal shares: less memory first, then less training time, then fewer trained parameters.
- A footnote marks runs whose parameters are too far from the anchor's, and runs with speculative evidence.
{warnings}
## Comparative table

| Rank | Method | Evidence | χ/rank | {heads} | VRAM GB | Train s | Params |
|------|--------|----------|--------|{rules}|---------|---------|--------|
{lines}
{footnotes}
## Tag bucket diagnostics

{buckets}"""
BUCKETS = """\
### {method}

| Tag | Tasks | Pass@1 | Pass@5 |
|-----|-------|--------|--------|
{lines}
"""
HEADS = {"JavaScript": "JS Pass@1", "HTML": "HTML Pass@1", "FreeMarker": "FMT Pass@1"}


def section(title: str, lines: list[str]) -> str:
    """A section with its lines, or nothing without any."""
    return "\n".join(["", f"## {title}", "", *lines, ""]) if lines else ""


def markdown(runs: DataFrame, warnings: list[str], notes: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> str:
    """The ranking report of ranked runs."""
    lines = summaries(runs, languages).select("rank", table_line(languages).alias("line")).orderBy("rank").collect()
    cells = F.transform("tagBuckets", lambda b: F.concat(F.lit("| "), F.concat_ws(" | ", b["tag"], b["taskCount"].cast("string"), percent(F.coalesce(b["passAt1"], F.lit(0.0))), percent(F.coalesce(b["passAt5"], F.lit(0.0)))), F.lit(" |")))
    buckets = runs.where(F.size("tagBuckets") > 0).orderBy("rank").select("compressionMethod", F.array_join(cells, "\n").alias("lines")).collect()
    return REPORT.format(
        warnings=section("Warnings", [f"- {w}" for w in warnings]),
        heads=" | ".join(HEADS.get(name, f"{name} Pass@1") for name in languages),
        rules=" | ".join("---" for _ in languages),
        lines="\n".join(r["line"] for r in lines),
        footnotes=section("Footnotes", [f"- **{n['compressionMethod']}** (`{n['runId']}`): {n['reason']}" for n in notes.collect()]),
        buckets="\n".join(BUCKETS.format(method=b["compressionMethod"], lines=b["lines"]) for b in buckets),
    )
