"""Making candidates, tasks and prompts: rows from a range, with all columns as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Scope
from .. import schemas
from ..functions.text import json_object, rendered
from ..vocabulary import METHOD_CYCLE, PREFIX

# Fixed values of the stand-in for a teacher: tags and code by language.
TAGS = {"JavaScript": ("functional", "module", "L2-standard"), "HTML": ("semantic", "L2-standard"), "FreeMarker": ("macro", "list", "L2-standard")}
CODE = {
    "JavaScript": "/**\n * Mock synthetic utility #{n}\n * @param {number[]} values\n * @returns {number}\n */\nexport function mockSum{n}(values) {\n  if (!Array.isArray(values)) throw new TypeError('values must be an array');\n  return values.reduce((total, n) => total + n, 0);\n}\n",
    "HTML": '<!DOCTYPE html>\n<html lang="en">\n<head>\n  <meta charset="utf-8" />\n  <title>Mock page {n}</title>\n</head>\n<body>\n  <main><h1>Mock {n}</h1></main>\n</body>\n</html>\n',
    "FreeMarker": "<#-- Mock synthetic template #{n} -->\n<#macro mockGreet{n} name>\n  <p>Hello ${name?html}</p>\n</#macro>\n",
}


def batch_of(ord_col: Column, size: int = 25) -> Column:
    """The number of the batch, from 0, of rows counted from 0."""
    return F.floor(ord_col / size).cast("bigint")


def method_of(batch: Column) -> Column:
    """The expansion method of a batch: a fixed cycle of six."""
    return cycled(F.array(*map(F.lit, METHOD_CYCLE)), batch)


def cycled(values: Column, n: Column) -> Column:
    """The element of an array at a counter from 0 that starts again at its end; null for an empty array."""
    return F.when(F.size(values) > 0, F.element_at(values, (F.pmod(n, F.size(values)) + 1).cast("int")))


def mock_candidates(spark: SparkSession, language: str, count: int, created: str, batch_size: int = 25) -> DataFrame:
    """``count`` candidates of the stand-in with their order, batch, method and token counts.

    Token counts are drawn from the hash of the row's number, so runs repeat.
    """
    n = (F.col("ord") + 1).cast("string")
    rows = spark.range(count).select(F.col("id").alias("ord")).withColumn("batch", batch_of(F.col("ord"), batch_size)).withColumn("method", method_of(F.col("batch")))
    meta = F.struct(F.lit("teacher-model").alias("author"), F.lit(created).alias("created"), F.lit("synthetic").alias("source"), F.concat(F.lit("expansion: "), F.col("method"), F.lit("; dry-run mock")).alias("notes"))
    return rows.select(
        "ord", "batch", "method",
        F.format_string(f"syn-{PREFIX[language]}-%04d", F.col("ord") + 1).alias("id"), F.lit(language).alias("targetLanguage"),
        F.concat(F.lit(f"Write a {language} utility variant #"), n, F.lit(" following enterprise clean-code standards.")).alias("instruction"),
        F.replace(F.lit(CODE[language]), F.lit("{n}"), n).alias("code"), F.array(*map(F.lit, TAGS[language])).alias("tags"), meta.alias("metadata"),
        F.lit(None).cast("double").alias("judgeScore"), F.lit(None).cast("string").alias("topicId"),
        (800 + F.pmod(F.xxhash64("ord", F.lit(1)), F.lit(201))).alias("inputTokens"), (400 + F.pmod(F.xxhash64("ord", F.lit(2)), F.lit(101))).alias("outputTokens"),
    )


def with_defaults(rows: DataFrame, language: str, created: str) -> DataFrame:
    """Language and metadata filled in where a reply left them out."""
    meta = F.struct(F.lit("teacher-model").alias("author"), F.lit(created).alias("created"), F.lit("synthetic").alias("source"), F.lit(None).cast("string").alias("notes"))
    return rows.withColumns({"targetLanguage": F.coalesce("targetLanguage", F.lit(language)), "metadata": F.coalesce("metadata", meta)})


def held_out_tasks(topics: DataFrame) -> DataFrame:
    """A task for each held-out topic (``ord, id, language, pattern, keywords``), numbered within its language."""
    nth = F.row_number().over(Window.partitionBy("language").orderBy("ord"))
    prefix = F.create_map(*[F.lit(x) for pair in PREFIX.items() for x in pair])[F.col("language")]
    said = (
        F.when(F.col("language") == "JavaScript", F.concat(F.lit("Implement "), F.lower("pattern"), F.lit(" in plain JavaScript (ES modules).")))
        .when(F.col("language") == "HTML", F.concat(F.lit("Build a complete HTML5 page for: "), F.col("pattern"), F.lit(".")))
        .otherwise(F.concat(F.lit("Write a FreeMarker template for: "), F.col("pattern"), F.lit(".")))
    )
    criteria = F.struct(F.lit(True).alias("mustParse"), F.slice("keywords", 1, 2).alias("mustContain"), F.array(*map(F.lit, ("TODO", "FIXME", "your code here"))).alias("mustNotContain"))
    return topics.withColumn("nth", nth).select(F.format_string("ho-%s-%03d", prefix, "nth").alias("id"), F.col("language").alias("targetLanguage"), F.col("id").alias("topicId"), said.alias("instruction"), F.array(F.lit("held-out"), F.lit("L3-composite")).alias("tags"), criteria.alias("acceptanceCriteria"), (F.col("nth") - 1).alias("task_index"))


def topic_matrix(training: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training topics and then held-out ones, with what each may be used for."""

    def uses(seed: str, synthetic: str, held: str) -> list[Column]:
        return [F.lit(seed).alias("in_seed"), F.lit(synthetic).alias("in_synthetic"), F.lit(held).alias("in_held_out")]

    own = training.select(F.col("id").alias("topic_id"), "language", "difficulty", *uses("yes", "yes", "no"), "pattern")
    return own.unionByName(held_out.select(F.col("id").alias("topic_id"), "language", F.lit("L3").alias("difficulty"), *uses("no", "no", "yes"), "pattern"))


def shared_topics(training: DataFrame, held_out: DataFrame) -> DataFrame:
    """Topic ids in both; there should be none."""
    return training.select("id").intersect(held_out.select("id"))


def blocklist(held_out: DataFrame) -> DataFrame:
    """A line ``id [language]: pattern | keyword, keyword`` per topic, in order."""
    line = F.concat(F.col("id"), F.lit(" ["), F.col("language"), F.lit("]: "), F.col("pattern"), F.lit(" | "), F.array_join("keywords", ", "))
    return held_out.orderBy("ord").select(line.alias("value"))


def bullets(items: list[str]) -> str:
    return "\n".join(f"- {x}" for x in items)


def held_out_summary(scope: Scope, language: str, shown: int = 8) -> str:
    """The first held-out patterns as a list, with a note of how many more there are."""
    own = [t["pattern"] for t in scope.held_out if t["language"] == language]
    return bullets(own[:shown]) + f"\n- (and {max(len(own) - shown, 0)} more held-out patterns — see config/scope-boundary.yaml)"


def few_shots(seeds: DataFrame, key: str = "id", separator: str = "\n\n---\n\n") -> DataFrame:
    """One row with seeds as JSON texts, in the order of their keys; a handful by design."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("j"))))
    return seeds.agg(F.array_join(F.transform(packed, lambda s: s["j"]), separator).alias("few_shots"))


def user_prompt(template: str, values: dict[str, Column]) -> Column:
    return rendered(F.lit(template), values)


def out_of_scope_summary(scope: Scope, language: str) -> str:
    return bullets(list(scope.out_of_scope.get(language, ())))


def system_prompt(template: str, scope: Scope, language: str) -> str:
    """The system prompt of a language, with what is out of scope and held out."""
    return template.replace("{{OUT_OF_SCOPE}}", out_of_scope_summary(scope, language)).replace("{{HELD_OUT_SUMMARY}}", held_out_summary(scope, language))


def shot_pool(seeds: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """Seeds to draw few-shots from: those that are no reference seeds."""
    return seeds.join(references.select(key), key, "left_anti")


#: A teacher: system and user prompt in; text, input tokens, output tokens and model out.
Teacher = Callable[[str, str], tuple[str, int, int, str]]


def replies(prompts: DataFrame, teacher: Teacher, attempts: int = 3) -> DataFrame:
    """Rows of ``ord, system, user`` with a teacher's reply and the candidate in it as JSON.

    The teacher is any callable that executors can unpickle.  A reply without a
    JSON object is asked for again, ``attempts`` times at most; then ``candidate``
    is null and the row can be reported as rejected.  Tokens of all attempts count.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                spent = [0, 0]
                for _ in range(attempts):
                    text, i, o, model = teacher(row.system, row.user)
                    spent[0] += i
                    spent[1] += o
                    if "{" in text and "}" in text:
                        break
                rows.append((row.ord, text, spent[0], spent[1], model))
            yield pd.DataFrame(rows, columns=["ord", "text", "inputTokens", "outputTokens", "model"])

    said = prompts.select("ord", "system", "user").mapInPandas(run, "ord bigint, text string, inputTokens bigint, outputTokens bigint, model string")
    return said.withColumn("candidate", json_object(F.col("text")))


def parsed_replies(said: DataFrame, language: str, created: str) -> DataFrame:
    """Candidates of replies, defaults filled in; replies without one are left out."""
    got = said.where("candidate IS NOT NULL").select("ord", "inputTokens", "outputTokens", F.from_json("candidate", schemas.EXAMPLE).alias("r")).select("ord", "inputTokens", "outputTokens", "r.*")
    return with_defaults(got, language, created)
