"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that a task exchanges with its Python worker, whatever the length of the texts.
BATCH_BYTES = 8 << 20
_own_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and Spark is one local process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="chatspark-"))
        base = _own_dir[0]
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of all operators so far, once their results are written elsewhere."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, so that long texts need no more memory of a worker than short ones."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that none of `columns` has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: Column) -> Column:
    """128 bits that tell rows with different values apart; a null is a value of its own."""
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit("-")) for c in columns])))


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the jobs inside go as soon as each job has written its table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str = "stage", by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder, in folders by a column's values if given, and read it back.

    Lineage ends here, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    small_batches(spark)
    with shuffle_cleanup(spark):
        df.write.partitionBy(*([by] if by else [])).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by_key(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """As written(), bucketed by `key`, so that later joins on it don't shuffle this side.

    A `df` that is already dealt by `key` isn't dealt again. The catalog entry that bucketing needs goes at once;
    what is returned reads the files.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    with shuffle_cleanup(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{label}").bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete intermediate tables that no later step reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            _delete(spark, file.rpartition("/")[0])


def text_key(column: str = "text"):
    """SHA-256 of the text, null as empty: equal keys mean equal texts."""
    return F.unhex(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per different text: first_id (the text's own), least_id (smallest doc_id), key, copies, n_bytes, text; bucketed by first_id.

    first_id is the smallest doc_id where no two texts share it; else all texts are numbered in the order of it and the key.

    Copies are grouped by their hash alone, combined before the shuffle; the texts themselves are dealt once,
    by doc_id, and only the row with a group's smallest doc_id stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    groups = written(rows.withColumn("key", text_key()).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "keys")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["first_id", "least_id", "key", "copies", F.octet_length("text").cast("long").alias("n_bytes"), "text"]
    if not groups.groupBy("first_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        ordered = groups.repartitionByRange(parts, "first_id", "key").sortWithinPartitions("first_id", "key")
        ranks = written(ordered.select(F.monotonically_increasing_id().alias("first_id"), F.col("first_id").alias("least_id"), "key", "copies"), "ranks")
        own = rows.groupBy(F.col("doc_id").alias("least_id"), text_key().alias("key")).agg(F.first("text").alias("text"))
        return written_by_key(own.join(ranks, ["least_id", "key"]).select(*columns).repartition(parts, "first_id"), "first_id", "texts")
    dealt = rows.withColumnRenamed("doc_id", "first_id").repartition(parts, "first_id")
    own = F.greatest(text_key(), F.col("_key")) == F.least(text_key(), F.col("_key"))  # not an equi-key: both sides stay dealt by first_id alone
    joined = dealt.join(groups.withColumnRenamed("key", "_key").repartition(parts, "first_id"), "first_id").filter(own)
    single = joined.groupBy("first_id", F.col("_key").alias("key"), "copies").agg(F.first("text").alias("text"))
    return written_by_key(single.withColumn("least_id", F.col("first_id")).select(*columns), "first_id", "texts")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"))
