"""Readers and writers of chat exports, journals and role files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.sources.scratch import written

MESSAGE = "chat_id string, chat_type string, chat_name string, sender string, is_self boolean, timestamp long, text string, source_chat_id string, event string"
EXPORT = """session struct<type:string, wxid:string, displayName:string>, messages array<struct<localType:long, type:string, createTime:long, isSend:int, senderUsername:string, senderDisplayName:string,
content:string, platformMessageId:string, appMsgType:string, replyToMessageId:string, quotedContent:string, quotedSender:string, quotedType:long>>"""
REQUIRED = ["chat_id", "chat_type", "sender", "is_self", "timestamp", "text"]


def read_unified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, violations by field) of JSON lines: records end at a line feed only, blank lines are skipped, a malformed row fails."""
    rows = spark.read.schema(MESSAGE).option("lineSep", "\n").option("mode", "FAILFAST").json(path)
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED], F.when(~F.col("chat_type").isin("group", "private"), F.lit("chat_type_domain"))))
    return rows, rows.select(F.explode(bad).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of export files, one JSON document each: file, place, session and message fields."""
    files = spark.read.schema(EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())
    return files.select("file", F.col("session.type").alias("chat_type"), F.col("session.wxid").alias("peer"), F.col("session.displayName").alias("chat_name"), F.posexplode("messages").alias("file_pos", "m")).select("file", "chat_type", "peer", "chat_name", "file_pos", "m.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, line numbers from 1, read in byte ranges by any number of tasks.

    Spark's reader gives each range its lines in order; a task numbers them within the range, and the counts of the ranges before it, a row for each range, are
    added.
    """
    where = {"_file": "_metadata.file_path", "_block": "_metadata.file_block_start"}
    text = spark.read.option("lineSep", "\n").text(path).select(*[F.col(c).alias(n) for n, c in where.items()], "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = None, 0
        for batch in batches:
            keys = list(zip(batch["_file"].to_pylist(), batch["_block"].to_pylist()))
            places = []
            for key in keys:
                own, n = key, n + 1 if key == own else 1
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "_at"])

    lines = written(text.mapInArrow(run, "_file string, _block long, value string, _at long"))
    counts = lines.groupBy("_file", "_block").agg(F.max("_at").alias("n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_file", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    return lines.join(base, ["_file", "_block"]).select(F.col("_file").alias("file"), (F.col("_base") + F.col("_at")).alias("line_no"), F.col("value").alias("line"))


def read_journal(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with line_no, damage): the last line of a file may be unfinished and is left out; any other damaged line is reported."""
    lines = written(numbered_lines(spark, path).filter("trim(line) != ''"))
    parsed = lines.withColumn("row", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    last = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    marked = parsed.withColumn("_damaged", F.col("row._bad").isNotNull() | F.col("row").isNull())
    damage = marked.filter("_damaged").join(last, "file").filter(F.col("line_no") < F.col("_last")).select("file", "line_no")
    return marked.filter("not _damaged").select("file", "line_no", "row.*").drop("_bad"), damage


def write_roles(rows: DataFrame, path: str) -> DataFrame:
    """Write rows by role, and return the manifest: total, chats and groups of each."""
    rows.write.mode("overwrite").partitionBy("role").parquet(f"{path}/roles")
    manifest = rows.groupBy("role").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("chat_id").alias("chats"), F.sum((F.col("chat_type") == "group").cast("long")).alias("group_rows"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return rows.sparkSession.read.parquet(f"{path}/manifest")
