"""Streaming queries, run over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.streaming import observations as s


def stream_observation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    x = s.log_stream(spark, d, "observations").select("id", "candidate_id", "kind", "outcome")
    return s.run_append(s.deduplicated(x))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    x = s.log_stream(spark, d, "observations").where("candidate_id IS NOT NULL")
    return s.run_complete(s.latest_by(x, "candidate_id", "id", "kind", "outcome"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = s.run_complete(s.sessions(s.log_stream(spark, d, "events"), "user_id", "ts", "30 minutes"))
    return x.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    x = s.run_complete(s.windows(s.log_stream(spark, d, "events"), "ts", "1 hour", "event_type"))
    return x.select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_observation_dedupe, stream_latest, stream_sessions, stream_windows)}
SQL = {
    "stream_observation_dedupe": "SELECT DISTINCT id, candidate_id, kind, outcome FROM observations",
    "stream_latest": "SELECT candidate_id, max(id) AS id, arg_max(kind, id) AS kind, arg_max(outcome, id) AS outcome FROM observations WHERE candidate_id IS NOT NULL GROUP BY 1",
    "stream_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM b GROUP BY user_id, k""",
    "stream_windows": "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
