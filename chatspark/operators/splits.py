"""Whole-chat splits, time windows, quotas and batches. Random order is hash order: sha2(seed:id), id."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.scan import running
from chatspark.sources.scratch import written


def hash_order(seed: int, column: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")), 256)


def running_before(rows: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds before: the sum of `value` over the rows that come earlier in the order (of columns), within `by` if given.

    Rows are dealt by ranges of the order; sums within a range add to those of the ranges before it, so no task holds a whole kind.
    """
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    sums = dealt.groupBy("_part", *by).agg(F.sum(value).alias("_n"))  # a row per range and kind
    earlier = lambda *c: Window.partitionBy(*by).orderBy(*c).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", *by, F.coalesce(F.sum("_n").over(earlier("_part")), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(base), ["_part", *by]).withColumn("before", F.col("_base") + F.col("_own")).drop("_part", "_base", "_own")


def split_by_chat(messages: DataFrame, fixed: dict[str, int], dev: dict[str, int], seed: int = 42, per_chat: int = 18) -> DataFrame:
    """(chat_id, chat_type, role): chats are taken in hash order until their own messages, `per_chat` at most each, fill a kind's quota.

    A chat belongs when the chats before it haven't filled the quota. Dev chats come from what fixed left.
    """
    own = F.sum((F.col("is_self") & (F.trim("text") != "")).cast("long"))
    chats = messages.groupBy("chat_id", "chat_type").agg(F.least(F.coalesce(own, F.lit(0)), F.lit(per_chat)).alias("n"))
    quota = lambda q: F.coalesce(*[F.when(F.col("chat_type") == k, v) for k, v in q.items()], F.lit(0))

    def pick(rows, q, salt):
        placed = running_before(rows.withColumn("_h", hash_order(seed + salt, "chat_id")), "n", ["_h", "chat_id"], ["chat_type"])
        return placed.filter(F.col("before") < quota(q)).drop("_h", "before")

    first = pick(chats, fixed, 0).select("chat_id", F.lit("fixed_test").alias("role"))
    second = pick(chats.join(first, "chat_id", "left_anti"), dev, 1).select("chat_id", F.lit("development").alias("role"))
    roles = first.unionByName(second)
    return chats.join(roles, "chat_id", "left").select("chat_id", "chat_type", F.coalesce("role", F.lit("train")).alias("role"))


def order_statistic(rows: DataFrame, column: str, places: list[float]) -> list:
    """Values at floor(n * place) of the sorted column, by counts of distinct values (no global sort of the rows)."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    running = counts.repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    base = running.groupBy("_part").agg(F.sum("n").alias("size"))
    before = base.select("_part", (F.sum("size").over(Window.orderBy("_part")) - F.col("size")).alias("base"))  # a row per partition
    ranked = running.join(F.broadcast(before), "_part").withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("_part").orderBy(column)))
    out = ranked.agg(*[F.min(F.when(F.col("upto") > int(total * p), F.col(column))).alias(f"p{i}") for i, p in enumerate(places)]).first()
    return list(out)


def time_windows(examples: DataFrame, a: int | None = None, b: int | None = None) -> DataFrame:
    """Adds window: learning before a, development within [a, b), acceptance from b; others null."""
    if a is None or b is None:
        found = order_statistic(examples, "cutoff_ts", [0.25, 0.65])
        a, b = a if a is not None else found[0], b if b is not None else found[1]
    label = F.when(F.col("end_ts") < a, "learning").when((F.col("start_ts") >= a) & (F.col("end_ts") < b), "development").when(F.col("start_ts") >= b, "acceptance")
    return examples.withColumn("window", label)


def choose_quota(rows: DataFrame, total: int, group_ratio: float, cap: int, seed: int, occupied: DataFrame | None = None) -> DataFrame:
    """Rows (id, chat_id, chat_type, ids) in hash order: at most `cap` a chat, and the quota of each kind.

    Equal to the greedy loop, since a chat has one kind. The chat cap cuts the rows to chats * cap before the kinds are ranked,
    and each kind's ranking is cut per chat batch first, so no task sorts a kind's whole pool.
    """
    if occupied is not None:
        blocked = rows.select("id", F.explode("ids").alias("_m")).join(occupied.select(F.col("message_id").alias("_m")).distinct(), "_m", "left_semi").select("id").distinct()
        rows = rows.join(blocked, "id", "left_anti")
    group = round(total * group_ratio)
    quota = F.when(F.col("chat_type") == "group", group).otherwise(total - group)
    order = [hash_order(seed, "id"), F.col("id")]
    capped = rows.withColumn("_r", F.row_number().over(Window.partitionBy("chat_id").orderBy(*order))).filter(F.col("_r") <= cap).drop("_r")
    salted = capped.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    trimmed = salted.withColumn("_r", F.row_number().over(Window.partitionBy("chat_type", "_s").orderBy(*order))).filter(F.col("_r") <= quota)
    return trimmed.withColumn("rank", F.row_number().over(Window.partitionBy("chat_type").orderBy(*order))).filter(F.col("rank") <= quota).drop("_r", "_s")


def checked_quota(rows: DataFrame, total: int, group_ratio: float, cap: int, seed: int, occupied: DataFrame | None = None) -> DataFrame:
    """choose_quota(), written; an error where a kind has too few rows, which names the kind, what there is and what is due."""
    chosen = written(choose_quota(rows, total, group_ratio, cap, seed, occupied))
    have = {r.chat_type: r.n for r in chosen.groupBy("chat_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    group = round(total * group_ratio)
    short = [f"{kind}: {have.get(kind, 0)} of {need}" for kind, need in (("group", group), ("private", total - group)) if have.get(kind, 0) < need]
    if short:
        raise ValueError("not enough capacity: " + ", ".join(short))
    return chosen


def holdout_search(counts: DataFrame, needs: list[tuple[str, str, bool, int, int]], fraction: float, seed: int = 42, attempts: int = 1000) -> DataFrame:
    """The first attempt whose held-out chats leave enough capacity: attempt and its chats.

    `counts` has chat_id, chat_type, window, n; a need is (window, chat_type, held out?, cap, amount). Attempts are tried in
    rounds, each four times the one before, until one is enough; a round's attempts are broadcast to the chats' table.
    """
    chats = counts.select("chat_id", "chat_type").distinct()
    at, size = 0, 8
    while True:
        tries = range(at, min(attempts, at + size))
        held, best = _holdouts(chats, counts, needs, fraction, seed, tries)
        found = best.first().attempt
        if found is not None or tries.stop >= attempts:
            return held.filter("held").filter(F.col("attempt") == F.lit(found)).select("attempt", "chat_id")
        at, size = tries.stop, size * 4


def _holdouts(chats: DataFrame, counts: DataFrame, needs: list[tuple[str, str, bool, int, int]], fraction: float, seed: int, tries: range) -> tuple[DataFrame, DataFrame]:
    """(attempt, chat_id, held) of some attempts, and the first that is enough."""
    numbers = chats.sparkSession.range(tries.start, tries.stop).select(F.col("id").cast("int").alias("attempt"))
    sizes = chats.groupBy("chat_type").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction).cast("int")).alias("_size"))  # a row per kind
    hashed = chats.join(F.broadcast(numbers)).withColumns({"_h": F.sha2(F.concat(F.col("attempt") + seed, F.lit(":"), F.col("chat_id").cast("string")), 256), "_one": F.lit(1)})
    placed = running(hashed, {"_before": (F.sum, "_one")}, ["_h", "chat_id"], ["attempt", "chat_type"])  # no task ranks all chats of an attempt
    held = placed.join(F.broadcast(sizes), "chat_type").select("attempt", "chat_id", (F.coalesce("_before", F.lit(0)) < F.col("_size")).alias("held"))
    enough = [
        F.coalesce(F.sum(F.when((F.col("window") == w) & (F.col("chat_type") == k) & (F.col("held") == F.lit(h)), F.least("n", F.lit(cap)))), F.lit(0)) >= need
        for w, k, h, cap, need in needs
    ]
    ok = reduce(and_, enough)
    return held, held.join(counts, "chat_id").groupBy("attempt").agg(ok.alias("ok")).filter("ok").agg(F.min("attempt").alias("attempt"))


def seal_batches(rows: DataFrame, batches: int, stratum: list[str], seed: int = 42) -> DataFrame:
    """Adds batch: round robin in hash order within each stratum, strata shifted by the rows before them."""
    sizes = rows.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.withColumn("_base", F.sum("_n").over(Window.orderBy(*stratum)) - F.col("_n")).drop("_n")  # a row per stratum
    hashed = rows.withColumns({"_h": hash_order(seed, "id"), "_one": F.lit(1)})
    placed = running(hashed, {"_r": (F.sum, "_one")}, ["_h", "id"], stratum).withColumn("_r", F.coalesce("_r", F.lit(0)))  # no task ranks a whole stratum
    ranked = placed.join(F.broadcast(base), stratum)
    return ranked.withColumn("batch", ((F.col("_base") + F.col("_r")) % batches).cast("int")).drop("_r", "_base", "_h", "_one")


def stratified_candidates(rows: DataFrame, limit: int = 8, seed: int = 42) -> DataFrame:
    """Keeps baseline rows of each target, then takes strata (rank band, object match) in turn until `limit` rows.

    Rows have target_id, id, recall_rank (0-based), n, is_baseline, object_match.
    """
    band = F.least(F.lit(2), F.floor(3 * F.col("recall_rank") / F.col("n"))).cast("int")
    rows = rows.withColumn("band", band)
    strata = Window.partitionBy("target_id", "is_baseline", "band", "object_match").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("target_id").cast("string"), F.lit(":"), F.col("id").cast("string")), 256), "id")
    ranked = rows.withColumn("_r", F.when(F.col("is_baseline"), 0).otherwise(F.row_number().over(strata)))
    order = Window.partitionBy("target_id").orderBy(F.desc("is_baseline"), "_r", "band", F.desc("object_match"), "id")
    return ranked.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= limit) | F.col("is_baseline")).drop("_r")


def cap_observations(targets: DataFrame, limit: int) -> DataFrame:
    """Targets (target_id, priority, n) in order until `limit` observations; `take` cuts the last."""
    placed = running_before(targets, "n", ["priority", "target_id"])
    return placed.filter(F.col("before") < limit).withColumn("take", F.least(F.col("n"), limit - F.col("before"))).drop("before")


def temporal_split(targets: DataFrame, materials: DataFrame, fit_fraction: float = 0.8, until_stable: bool = False) -> DataFrame:
    """(target_id, split): by cutoff time, ties with the boundary to validation; fit targets whose material is as late as the boundary
    or shares a validation answer are purged. With `until_stable` purged targets' materials leave too, and the test repeats.

    `targets` has target_id, cutoff_ts, answer_ids; `materials` target_id, end_ts, message_ids.
    """
    boundary = order_statistic(targets, "cutoff_ts", [fit_fraction])[0]
    late = F.col("cutoff_ts") >= F.lit(boundary)
    fit, validation = targets.filter(~late), targets.filter(late).select("target_id", "answer_ids")
    answers = validation.select(F.explode("answer_ids").alias("m")).distinct()
    size = None
    while True:
        own = materials.join(fit.select("target_id"), "target_id", "left_semi")
        crossing = own.filter(F.col("end_ts") >= F.lit(boundary)).select("target_id")
        leaking = own.select("target_id", F.explode("message_ids").alias("m")).join(answers, "m", "left_semi").select("target_id")
        fit = fit.join(crossing.unionByName(leaking).distinct(), "target_id", "left_anti")
        n = fit.count() if until_stable else size
        if n == size:
            break
        size = n
    return fit.select("target_id", F.lit("fit").alias("split")).unionByName(validation.select("target_id", F.lit("validation").alias("split")))
