"""Registered queries over plugged-in sources and streams.  Files lie in the shared folder, a new one for each call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .sources import replies, writers
from .storage import new_path
from .streaming import runs

# Fixed values of these queries: steps of the events' machine, the state that ends it, and an hour and a half of patience.
LEGAL = {("Pending", "signup"), ("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view")}
FINAL, PATIENCE = {"purchase"}, 90 * 60 * 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recorded_replies(spark, d):
    """Every answer of the conversations as a recorded reply, two of three with an object of JSON, through the data source."""
    path, said = new_path(spark, "replies"), table(spark, d, "conversations").where("role = 'assistant'")
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.lit("syn-js-"), F.col("conv_id").cast("string")).alias("id"), F.col("text").alias("instruction"))), F.lit("\n```"))
    made = said.select(F.concat_ws("-", "conv_id", "turn").alias("callId"), F.col("turn").alias("ord"), F.when(F.col("conv_id") % 3 > 0, fenced).otherwise(F.concat(F.lit("Sorry: "), F.col("text"))).alias("text"), (F.col("turn") + 100).alias("inputTokens"), F.length("text").cast("bigint").alias("outputTokens"), F.lit("recorded").alias("model"))
    writers.json_lines(made, path)
    got = replies.recorded(spark, path)
    told = F.from_json("candidate", schemas.EXAMPLE)
    return got.select("callId", "ord", "inputTokens", "outputTokens", "model", told["id"].alias("id"), F.sha2(told["instruction"], 256).alias("instruction_sha256"))


def run_follow(spark, d):
    """The events of all users as a stream: steps that their machine lacks, and silences of a user whose run isn't at its end."""
    log, out, at = (new_path(spark, n) for n in ("run-log", "followed", "follow-state"))
    lines = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("nth"))
    writers.json_lines(lines, log)
    found = runs.follow_log(spark, log, out, at, PATIENCE, LEGAL, FINAL)
    return found.groupBy("kind", "previous", "state").agg(F.count(F.lit(1)).alias("runs"), F.min("run").alias("first_run"))


QUERIES = {f.__name__: f for f in (recorded_replies, run_follow)}

STEPS = ", ".join(f"('{a}', '{b}')" for a, b in sorted(LEGAL))
ORACLE_SQL = {
    "recorded_replies": """SELECT conv_id || '-' || turn AS "callId", turn AS ord, turn + 100 AS "inputTokens", CAST(length(text) AS BIGINT) AS "outputTokens", 'recorded' AS model,
        CASE WHEN conv_id % 3 > 0 THEN 'syn-js-' || conv_id END AS id, CASE WHEN conv_id % 3 > 0 THEN sha256(text) END AS instruction_sha256 FROM conversations WHERE role = 'assistant'""",
    "run_follow": f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run, event_type AS state, epoch_ms(ts) AS ms, lag(event_type) OVER w AS before, lead(epoch_ms(ts)) OVER w AS after, max(epoch_ms(ts)) OVER () AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        x AS (SELECT 'illegal' AS kind, coalesce(before, 'Pending') AS previous, state, run FROM e WHERE (coalesce(before, 'Pending'), state) NOT IN ({STEPS})
              UNION ALL SELECT 'unfinished', NULL, state, run FROM e WHERE state NOT IN ({", ".join(f"'{s}'" for s in sorted(FINAL))}) AND coalesce(after, last) > ms + {PATIENCE})
        SELECT kind, previous, state, count(*) AS runs, min(run) AS first_run FROM x GROUP BY ALL""",
}
