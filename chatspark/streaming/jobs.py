"""Structured Streaming forms of the ingest, session and burst operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedupe_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Events without repeats of (user_id, event_id) within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def session_stream(events: DataFrame, gap: str = "2 hours", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a chat, closed by a gap: start, end and messages."""
    s = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def gap_counts_stream(events: DataFrame, size: str = "1 day", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Messages by window, chat type and kind."""
    chat = F.when(F.col("user_id") % 4 == 0, "private").otherwise("group").alias("chat_type")
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", lateness).groupBy(w.alias("w"), chat, F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start_ts"), "chat_type", "kind", "n")


class Bursts(StatefulProcessor):
    """Holds a chat's rows until the watermark has passed them, then takes them in order of time, whatever batches they came in.

    State is the list of rows that wait, and the open burst with the time of the one timer that is set: for the first row that waits, or for
    the end of the open burst, whichever is earlier.
    """

    def __init__(self, reply_gap: int):
        self.gap = reply_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, own boolean")
        self.open = handle.getValueState("open", "start long, last long, n long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            us = batch.ts.to_numpy().astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(us.tolist(), batch.event_id.tolist(), (batch.event_type == "purchase").tolist())))
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass

    def _advance(self, key, watermark: int, fired: bool) -> pd.DataFrame:
        start, last, n, timer = self.open.get() if self.open.exists() else (0, 0, 0, -1)
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] < watermark * 1000]
        out = []
        for us, _, own in ready:
            ts = us // 1_000_000
            if n and (not own or ts - last > self.gap):
                out.append((key[0], start, last, n))
                n = 0
            if own:
                start, last, n = (start, ts, n + 1) if n else (ts, ts, 1)
        if n and (last + self.gap) * 1000 < watermark:
            out.append((key[0], start, last, n))
            n = 0
        rest = rows[len(ready) :]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        due = min([r[0] // 1000 for r in rest[:1]] + [(last + self.gap) * 1000] * bool(n), default=-1)
        if due != timer or fired:
            if timer >= 0 and not fired:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        if due >= 0:
            self.open.update((start, last, n, due))
        elif self.open.exists():
            self.open.clear()
        return pd.DataFrame(out, columns=["user_id", "start_ts", "end_ts", "n"])


def burst_stream(events: DataFrame, reply_gap: int = 120, lateness: str = "10 minutes") -> DataFrame:
    """Finished bursts of own messages (purchases) of each chat: an event of another kind or a longer gap ends one.

    Rows may come late by `lateness`, in any order and any batches: bursts are those of the rows in order of time. The state needs
    RocksDB, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    grouped = events.withWatermark("ts", lateness).groupBy("user_id")
    return grouped.transformWithStateInPandas(Bursts(reply_gap), "user_id long, start_ts long, end_ts long, n long", "Append", "EventTime")


def final_records_sink(path: str, buckets: int = 32):
    """A foreachBatch function that keeps the last record (largest line_no) of each case.

    Cases are dealt to buckets. A batch reads the buckets that it touches, writes a new version of these, and then a manifest that says which
    epoch's folder each bucket is in. Folders that neither this manifest nor the one before names are deleted, so neither what
    a batch reads nor what is stored grows with the number of batches. A batch that is run again starts from the manifest before it.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")).persist()
        before = _manifest(spark, path, epoch)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        old = [_folder(path, before[b], b) for b in touched if b in before]
        held = spark.read.schema(batch.schema).parquet(*old) if old else spark.createDataFrame([], batch.schema)
        both = rows.unionByName(held.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")))
        last = F.row_number().over(Window.partitionBy("bucket", "case_id").orderBy(F.desc("line_no")))
        if touched:
            both.withColumn("_r", last).filter("_r = 1").drop("_r").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
        rows.unpersist()
        after = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(list(after.items()), "bucket int, epoch long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{epoch}")
        keep = {_folder(path, e, b) for m in (before, after) for b, e in m.items()}
        _clear(spark, path, keep, epoch)

    return merge


def _folder(path: str, epoch: int, bucket: int) -> str:
    return f"{path}/data/epoch={epoch}/bucket={bucket}"


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket to epoch, of the newest finished manifest, or of the newest before an epoch."""
    epochs = sorted((int(n) for n in _listed(spark, f"{path}/manifest") if n.isdigit() and (before is None or int(n) < before)), reverse=True)
    for e in epochs:
        if "_SUCCESS" in _listed(spark, f"{path}/manifest/{e}"):
            return {r.bucket: r.epoch for r in spark.read.schema("bucket int, epoch long").json(f"{path}/manifest/{e}").collect()}
    return {}


def _clear(spark: SparkSession, path: str, keep: set[str], epoch: int) -> None:
    """Deletes versions of buckets that aren't kept, and all manifests but the last two."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    gone = [f"{path}/data/{e}/{b}" for e in _listed(spark, f"{path}/data") for b in _listed(spark, f"{path}/data/{e}") if b.startswith("bucket=") and f"{path}/data/{e}/{b}" not in keep]
    past = sorted(int(n) for n in _listed(spark, f"{path}/manifest") if n.isdigit() and int(n) < epoch)
    for folder in gone + [f"{path}/manifest/{e}" for e in past[:-1]]:
        where = jvm.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def current_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What a final_records_sink has kept so far."""
    held = _manifest(spark, path)
    return spark.read.schema(schema).parquet(*[_folder(path, e, b) for b, e in held.items()]) if held else spark.createDataFrame([], schema)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet files, and read them."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
