"""Sessions and captures made of the test tables, by the same expressions that the comparison SQL uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import table

#: Session columns of ``conversations``, as SQL that Spark and DuckDB both read.
SESSION_SQL = """'conv-' || CAST(conv_id AS STRING) AS session_id,
CASE WHEN conv_id % 5 = 0 THEN '_global' ELSE 'team/repo ' || CAST(conv_id % 4 AS STRING) END AS repo,
CASE WHEN conv_id % 2 = 0 THEN 'tool-a' ELSE 'tool-b' END AS provider,
TIMESTAMP '2026-03-01 00:00:00' + conv_id * INTERVAL '37' MINUTE AS captured_at"""

MESSAGES = "m AS (SELECT conv_id, turn, role, text, " + SESSION_SQL.replace("STRING", "VARCHAR") + ", CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id FROM conversations)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each turn with its session's columns and a message id."""
    rows = table(spark, sf_dir, "conversations")
    extra = ["conv_id", "turn", "role", "text", *SESSION_SQL.split(",\n"), "CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id"]
    return rows.selectExpr(*extra)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session; messages in the order of their turns."""
    m = messages(spark, sf_dir)
    one = F.struct("turn", F.col("message_id").alias("id"), "role", F.col("text").alias("content"))
    return m.groupBy("conv_id", "session_id", "repo", "provider", "captured_at").agg(F.array_sort(F.collect_list(one)).alias("messages"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture requests: one for each event."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("trigger"), F.col("ts").cast("timestamp").alias("captured_at"), F.lit("tool-a").alias("provider"))
