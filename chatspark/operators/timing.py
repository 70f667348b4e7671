"""Latency, attempts, run windows and cache lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.quantiles import order_statistics
from chatspark.operators.scan import running
from chatspark.sources.scratch import written


def latency_dist(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Measured and missing counts, mean, true median and nearest-rank 95th percentile."""
    whole = rows.groupBy(*by).agg(F.count(value).alias("measured"), F.count(F.lit(1)).alias("_rows"), F.round(F.avg(value), 4).alias("mean"))
    ranks = {"_lower": lambda n: F.floor((n - 1) / 2), "_upper": lambda n: F.ceil((n - 1) / 2), "_p95": lambda n: F.ceil(n * F.lit(0.95)) - 1}
    placed = order_statistics(rows, by, value, ranks)
    joined = whole.alias("w").join(placed.alias("p"), [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by], "left")
    return joined.select(*[f"w.{c}" for c in by], "measured", "mean", F.round((F.col("_lower") + F.col("_upper")) / 2, 4).alias("p50"), F.round("_p95", 4).alias("p95"), (F.col("_rows") - F.col("measured")).alias("missing"))


def latency_index_pct(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The element at index int(n * p) of the sorted values."""
    return order_statistics(rows, by, value, {"value": lambda n: F.least(n - 1, F.floor(n * F.lit(p)))}).drop("n")


def attempt_totals(operations: DataFrame, by: list[str]) -> DataFrame:
    """Attempts of all operations, failed ones too, summed by case before the mean over cases. Operations have case_id, side, events."""
    events = operations.select("case_id", *by, F.explode_outer("events").alias("e"))
    cases = events.groupBy("case_id", *by).agg(F.sum(F.when(F.col("e.kind") == "attempt", 1).otherwise(0)).alias("attempts"), F.sum(F.when(F.col("e.kind") == "attempt", F.col("e.elapsed_ms"))).alias("elapsed_ms"))
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.sum("attempts").alias("attempts"), F.round(F.avg("attempts"), 6).alias("mean_attempts"), F.round(F.avg("elapsed_ms"), 4).alias("mean_elapsed_ms"))


def paired_speed(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Over cases with both sides measured: their number and the mean reduction in per cent."""
    wide = rows.filter(F.col("side").isin(baseline, candidate)).groupBy("case_id").pivot("side", [baseline, candidate]).agg(F.sum("elapsed_ms"))
    b, c = F.col(f"`{baseline}`"), F.col(f"`{candidate}`")
    return wide.filter(b.isNotNull() & c.isNotNull() & (b > 0)).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((1 - c / b) * 100), 4).alias("mean_reduction_pct"))


def window_assign(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds matches, the number of windows [start_ts, end_ts] that hold the event's ts, and window_id where there is exactly one.

    One sweep over starts, events and ends in order of time, whatever the windows' lengths and overlaps: the windows that
    hold a time are those begun less those ended, and so is the sum of their ids, which is the id itself where one is left.
    """
    number = F.col("window_id").cast("decimal(38,0)")
    marks = windows.select(F.col("start_ts").alias("ts"), F.lit(0).alias("_kind"), F.lit(1).alias("_n"), number.alias("_id"))
    marks = marks.unionByName(windows.select(F.col("end_ts").alias("ts"), F.lit(2).alias("_kind"), F.lit(-1).alias("_n"), (-number).alias("_id")))
    asked = events.filter("ts is not null").select("ts", F.lit(1).alias("_kind"), F.lit(0).alias("_n"), F.lit(0).cast("decimal(38,0)").alias("_id"), "event_id")
    swept = running(marks.unionByName(asked, allowMissingColumns=True), {"_open": (F.sum, "_n"), "_ids": (F.sum, "_id")}, ["ts", "_kind", "event_id"])
    found = swept.filter("_kind = 1").select("event_id", F.coalesce("_open", F.lit(0)).cast("long").alias("matches"), F.when(F.col("_open") == 1, F.col("_ids")).cast("long").alias("window_id"))
    return events.join(found, "event_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def stage_window_agg(assigned: DataFrame) -> DataFrame:
    """Operations, failures and durations by window and stage; operations that end after their window count as crossing."""
    return assigned.groupBy("window_id", "stage").agg(
        F.count(F.lit(1)).alias("operations"), F.sum((F.col("status") == "failed").cast("long")).alias("failed"), F.sum(F.col("cached").cast("long")).alias("cache_hits"),
        F.sum("elapsed").alias("elapsed"), F.sum((F.col("ts") + F.col("elapsed") > F.col("window_end")).cast("long")).alias("crossing"),
    )


def active_time(windows: DataFrame, by: list[str]) -> DataFrame:
    """Span, union, gap and overlap of windows [start_ts, end_ts) of each group, by islands of a running maximum.

    Windows are scanned in ranges of their starts: the latest end so far is carried from range to range, then the number of islands, and
    an island's sums are combined before they meet.
    """
    order = ["start_ts", "end_ts"]
    rows = running(windows.select(*by, *order), {"_seen": (F.max, "end_ts")}, order, by)
    fresh = (F.col("_seen").isNull() | (F.col("start_ts") > F.col("_seen"))).cast("int")
    rows = running(rows.withColumn("_new", fresh), {"_before": (F.sum, "_new")}, order, by).withColumn("_i", F.coalesce("_before", F.lit(0)) + F.col("_new"))
    islands = rows.groupBy(*by, "_i").agg(F.min("start_ts").alias("s"), F.max("end_ts").alias("e"), F.sum(F.col("end_ts") - F.col("start_ts")).alias("total"))
    out = islands.groupBy(*by).agg((F.max("e") - F.min("s")).alias("span"), F.sum(F.col("e") - F.col("s")).alias("active"), F.sum("total").alias("total"))
    return out.select(*by, "span", "active", (F.col("span") - F.col("active")).alias("uncovered"), (F.col("total") - F.col("active")).alias("overlapping"))


def failure_category(column: str):
    """http_429, read_timeout, tls_eof or other, by the error text."""
    c = F.lower(column)
    return F.when(c.rlike("429|too many requests"), "http_429").when(c.rlike("timed? ?out"), "read_timeout").when(c.rlike("ssl|tls|eof"), "tls_eof").otherwise("other")


def cache_lineage(calls: DataFrame, max_hops: int = 16) -> DataFrame:
    """(call_id, root_id, hops, state) of calls (call_id, origin_id): origins are followed to the measured call, doubling the step each round.

    State is measured, missing (an origin that isn't there), cycle or too_deep. Rounds are log2 of max_hops, each written, so a round
    reads the one before it and not all of them.
    """
    state = calls.select("call_id", F.coalesce("origin_id", "call_id").alias("root"), F.when(F.col("origin_id").isNull(), 0).otherwise(1).alias("hops"))
    reach = 1
    while reach < 2 * max_hops:
        step = state.select(F.col("call_id").alias("root"), F.col("root").alias("_next"), F.col("hops").alias("_more"))
        state = state.join(step, "root", "left").select("call_id", F.coalesce("_next", "root").alias("root"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))
        state = written(state)
        reach *= 2
    ends = calls.select(F.col("call_id").alias("root"), F.col("origin_id").isNull().alias("_end"))
    out = state.join(ends, "root", "left")
    label = F.when(F.col("_end").isNull(), "missing").when(~F.col("_end"), F.when(F.col("hops") >= 2 * max_hops, "cycle").otherwise("too_deep")).when(F.col("hops") > max_hops, "too_deep").otherwise("measured")
    return out.select("call_id", F.when(label == "measured", F.col("root")).alias("root_id"), F.when(label == "measured", F.col("hops")).alias("hops"), label.alias("state"))


def cache_usage(entries: DataFrame) -> DataFrame:
    """Entries, hits and writes by layer."""
    return entries.groupBy("layer").agg(F.count_distinct("entry_id").alias("entries"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("writes"))
