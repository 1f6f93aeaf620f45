"""Scoring generated code against held-out tasks, and rolling the scores up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import syntax
from ..vocabulary import RANKED_METHODS

# Fixed values of the stand-in for a model: share of passing samples, and its cost.
PASS_RATIO = {"FewShot": 0.42, "LoRA": 0.72, "QLoRA": 0.68, "DoRA": 0.74}
OTHER_RATIO = 0.70
VRAM_GB = {"smoke": {"FewShot": 0.0, "QLoRA": 2.4, "DoRA": 3.4, "LoRA": 3.2}, "other": {"FewShot": 0.0, "QLoRA": 3.1, "DoRA": 5.0, "LoRA": 4.8}}


def acceptance_fault(criteria: Column, language: Column, code: Column) -> Column:
    """Why a sample fails a task, else null: syntax, then a missing keyword, then a forbidden one."""
    lowered = F.lower(code)
    missing = F.try_element_at(F.filter(criteria["mustContain"], lambda k: ~F.contains(lowered, F.lower(k))), F.lit(1))
    forbidden = F.try_element_at(F.filter(criteria["mustNotContain"], lambda k: F.contains(lowered, F.lower(k))), F.lit(1))
    parsed = syntax.fault(language, F.when(criteria["mustParse"], code))
    return F.coalesce(
        F.when(criteria["mustParse"] & parsed.isNotNull(), F.concat(F.lit("syntax: "), parsed)),
        F.when(missing.isNotNull(), F.concat(F.lit("missing keyword: "), missing)),
        F.when(forbidden.isNotNull(), F.concat(F.lit("forbidden keyword: "), forbidden)),
    )


def with_samples(tasks: DataFrame, count: int = 5) -> DataFrame:
    """Each task once for each of ``count`` sample numbers from 0."""
    return tasks.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def mock_response(ratio: Column) -> Column:
    """What the stand-in writes for a task's sample: all keywords if it is to pass, else the first and a TODO.

    Needs ``id, targetLanguage, acceptanceCriteria, task_index, sample``.
    """
    words = F.coalesce(F.col("acceptanceCriteria.mustContain"), F.array().cast("array<string>"))
    passes = F.pmod(F.col("task_index") + F.col("sample"), F.lit(10)) / F.lit(10.0) < ratio
    used = F.when(passes, words).otherwise(F.slice(words, 1, 1))

    def lines(head: str, tail: str) -> Column:
        return F.array_join(F.transform(used, lambda w: F.concat(F.lit(head), w, F.lit(tail))), "\n")

    todo = lambda mark: F.when(passes, "").otherwise(mark)
    script = F.concat(F.lit("/** Mock response for "), F.coalesce("id", F.lit("task")), F.lit(" sample "), F.col("sample").cast("string"), F.lit(" */\nexport function solution() {\n"), lines("  // covers ", ""), F.lit("\n"), todo("  // TODO placeholder\n"), F.lit("  return true;\n}\n"))
    page = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8" /></head>\n<body>\n'), todo("    <!-- TODO -->\n"), lines("    <p>", "</p>"), F.lit("\n</body>\n</html>\n"))
    template = F.concat(todo("<#-- TODO -->\n"), F.lit("<#macro solution>\n"), lines("  <#-- ", " -->"), F.lit("\n</#macro>\n"))
    return F.when(F.col("targetLanguage") == "JavaScript", script).when(F.col("targetLanguage") == "HTML", page).otherwise(template)


def lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def mock_costs(method: Column, profile: Column, rank: Column, steps: Column) -> dict[str, Column]:
    """Trainable parameters, memory, time and pass ratio of the stand-in."""
    base = rank.cast("bigint") * rank * 4096
    seconds = F.lit(0.05) + steps * F.lit(0.001)
    return {
        "trainableParamCount": F.when(method == "DoRA", F.floor(base * F.lit(1.05))).otherwise(base).cast("bigint"),
        "peakVramGb": F.when(profile == "smoke", lookup(VRAM_GB["smoke"], method, 3.2)).otherwise(lookup(VRAM_GB["other"], method, 4.8)),
        "durationSeconds": F.when(method == "QLoRA", seconds * 1.15).when(method == "DoRA", seconds * 1.08).otherwise(seconds),
        "passRatio": lookup(PASS_RATIO, method, OTHER_RATIO),
    }


def hyper_parameter_fault(method: Column, rank: Column) -> Column:
    """Why a run can't be trained, else null: a method with adapters needs their rank."""
    return F.when(method.isin(*RANKED_METHODS) & rank.isNull(), F.concat(F.lit("lora-rank required for "), method))


def steps(examples: Column, batch: int, epochs: int, most: int | None = None) -> Column:
    """Optimizer steps of a run: at least one batch an epoch, at most ``most``."""
    own = F.greatest(F.lit(1), F.floor(examples / batch)) * epochs
    return (F.least(F.lit(most), own) if most is not None else own).cast("bigint")


def mock_inference(method: Column, latency_ms: float, tokens_per_s: float, size_mb: float) -> dict[str, Column]:
    """Latency, throughput and size by method, to two places."""
    few, q = method == "FewShot", method == "QLoRA"
    return {
        "meanLatencyMsPerToken": F.round(F.lit(latency_ms) * F.when(q, 1.12).when(few, 0.95).otherwise(1.0), 2),
        "throughputTokensPerSec": F.round(F.lit(tokens_per_s) * F.when(q, 0.92).when(few, 1.05).otherwise(1.0), 2),
        "modelSizeMb": F.round(F.lit(float(size_mb)) * F.when(q, 0.55).otherwise(1.0), 2),
    }


def pass_at_k(samples: DataFrame, keys: list[str], passed: str = "passed", sample: str = "sample") -> DataFrame:
    """Per task: whether its first sample passed, and whether any did."""
    return samples.groupBy(*keys).agg(F.min_by(passed, sample).alias("passAt1"), F.bool_or(passed).alias("passAtK"))


def rates(tasks: DataFrame, by: str = "targetLanguage", measures: tuple[str, ...] = ("passAt1", "passAtK", "syntaxValid")) -> DataFrame:
    """Rates per group and, with a null group, over all tasks: the mean weighted by tasks is the plain mean."""
    means = [F.coalesce(F.avg(F.col(m).cast("double")), F.lit(0.0)).alias(m) for m in measures]
    return tasks.rollup(by).agg(F.count(F.lit(1)).alias("taskCount"), *means)


def weighted_rate(groups: DataFrame, rate: str, count: str = "taskCount") -> DataFrame:
    """The overall rate from rates by group; 0.0 without tasks."""
    return groups.agg(F.coalesce(F.try_divide(F.sum(F.col(rate) * F.col(count)), F.sum(count).cast("double")), F.lit(0.0)).alias(rate))


def tag_bucket(tags: Column) -> Column:
    """The first tag that begins with L and a digit."""
    return F.coalesce(F.try_element_at(F.filter(tags, lambda t: t.rlike(r"^L\d+")), F.lit(1)), F.lit("untagged"))


def tag_buckets(tasks: DataFrame) -> DataFrame:
    """``tag, taskCount, passAt1, passAt5`` per bucket, in the order of tags."""
    mean = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    return tasks.groupBy(tag_bucket(F.col("tags")).alias("tag")).agg(F.count(F.lit(1)).alias("taskCount"), mean("passAt1"), mean("passAt5")).orderBy("tag")


def smoke_summary(results: DataFrame, least: float) -> DataFrame:
    """One row: tasks, passes, their rate (0.0 without tasks) and whether it is enough."""
    one = results.agg(F.count(F.lit(1)).alias("taskCount"), F.count_if("passed").alias("passedCount"))
    rate = F.coalesce(F.try_divide(F.col("passedCount").cast("double"), F.col("taskCount")), F.lit(0.0))
    return one.withColumn("passAt1", rate).withColumn("gateSatisfied", F.col("passAt1") >= least)


def param_match(own: Column, anchor: Column, tolerance: float) -> Column:
    """``struct<deltaPercent, matched, footnoteRequired>``; null if a count is missing or the anchor is 0."""
    delta = F.abs(own - anchor) / F.nullif(anchor, F.lit(0)) * 100
    return F.when(delta.isNotNull(), F.struct(F.round(delta, 2).alias("deltaPercent"), (delta <= tolerance).alias("matched"), (delta > tolerance).alias("footnoteRequired")))


def score_benchmark(tasks: DataFrame, ratio: float, samples: int = 5) -> DataFrame:
    """Per task: ``passAt1, passAtK, syntaxValid`` of the stand-in's samples.

    Tasks have the columns of ``schemas.HELD_OUT_TASK`` and a ``task_index`` within
    their language.  As everywhere, the syntax rate counts a task whose first
    sample passed or parses.
    """
    made = with_samples(tasks, samples).withColumn("code", mock_response(F.lit(float(ratio))))
    made = made.withColumns({"fault": acceptance_fault(F.col("acceptanceCriteria"), F.col("targetLanguage"), F.col("code")), "broken": syntax.fault(F.col("targetLanguage"), F.when(F.col("sample") == 0, F.col("code")))})
    made = made.withColumns({"passed": F.col("fault").isNull(), "valid": F.col("fault").isNull() | F.col("broken").isNull()})
    return made.groupBy("id", "targetLanguage", "tags").agg(F.min_by("passed", "sample").alias("passAt1"), F.bool_or("passed").alias("passAtK"), F.min_by("valid", "sample").alias("syntaxValid"))
