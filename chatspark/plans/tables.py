"""The library's input shapes as projections of the driver tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream of messages: a user is a chat, purchases are own messages, errors are boundaries."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("chat_id"), pos.cast("long").alias("pos"), F.unix_timestamp("ts").alias("ts"), (F.col("event_type") == "purchase").alias("is_self"),
        (F.col("event_type") == "error").alias("boundary"), F.when(F.col("user_id") % 4 == 0, "private").otherwise("group").alias("chat_type"),
        F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("text"), F.col("event_id").alias("message_id"), F.col("event_type").alias("kind"), "value",
    )


#: CTE msg
MSG = """msg AS (
  SELECT user_id AS chat_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
    event_type = 'purchase' AS is_self, event_type = 'error' AS boundary, CASE WHEN user_id % 4 = 0 THEN 'private' ELSE 'group' END AS chat_type,
    event_type || ':' || CAST(event_id AS VARCHAR) AS text, event_id AS message_id, event_type AS kind, value
  FROM events)"""


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as messages with text; a turn takes a minute."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("pos"), (F.col("conv_id") * 100000 + F.col("turn") * 60).alias("ts"), (F.col("role") == "assistant").alias("is_self"),
        (F.col("role") == "system").alias("boundary"), F.when(F.col("conv_id") % 4 == 0, "private").otherwise("group").alias("chat_type"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role",
    )


#: CTE dlg
DLG = """dlg AS (
  SELECT conv_id AS chat_id, turn AS pos, conv_id * 100000 + turn * 60 AS ts, role = 'assistant' AS is_self, role = 'system' AS boundary,
    CASE WHEN conv_id % 4 = 0 THEN 'private' ELSE 'group' END AS chat_type, text, conv_id * 1000 + turn AS message_id, role
  FROM conversations)"""
