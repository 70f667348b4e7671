"""The plan of purpose roles, test sets and case cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.scan import running
from chatspark.operators.splits import choose_quota, hash_order


def plan_roles(examples: DataFrame, heldout: DataFrame, total: int, train_total: int, group: float = 0.75, train_group: float = 0.5, cap: int = 25, learning_cap: int = 125, seed: int = 42) -> DataFrame:
    """(role, id): learning outside held-out chats, optimisation and judge training chosen from it, development and fixed test from their windows.

    Examples have id, chat_id, chat_type, window, ids. Development messages are occupied for the fixed test. A role may get fewer rows
    than asked for; the caller compares the counts with the plan.
    """
    rows = examples.select("id", "chat_id", "chat_type", "window", "ids")
    learning = rows.filter("window = 'learning'").join(heldout.select("chat_id").distinct(), "chat_id", "left_anti")
    label = lambda df, role: df.select(F.lit(role).alias("role"), "id")
    dev = choose_quota(rows.filter("window = 'development'"), total, group, cap, seed)
    used = dev.select(F.explode("ids").alias("message_id"))
    fixed = choose_quota(rows.filter("window = 'acceptance'"), total, group, cap, seed, used)
    parts = [
        label(learning, "gen_learning"), label(choose_quota(learning, total, group, learning_cap, seed), "gen_optimization"), label(choose_quota(learning, train_total, train_group, learning_cap, seed + 1), "judge_training"),
        label(dev, "development"), label(dev, "judge_development"), label(fixed, "fixed_test"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def take_testset(rows: DataFrame, group: int, private: int, cap: int = 25, seed: int = 42) -> DataFrame:
    """Rows with place: at most `cap` a chat and the quota of each kind, kinds interleaved."""
    order = [hash_order(seed, "id"), F.col("id")]
    capped = rows.withColumn("_c", F.row_number().over(Window.partitionBy("chat_id").orderBy(*order))).filter(F.col("_c") <= cap)
    quota = F.when(F.col("chat_type") == "group", group).otherwise(private)
    hashed = capped.drop("_c").withColumns({"_h": hash_order(seed, "id"), "_one": F.lit(1)})
    placed = running(hashed, {"_before": (F.sum, "_one")}, ["_h", "id"], ["chat_type"])  # no task ranks a whole kind
    ranked = placed.withColumn("_r", F.coalesce("_before", F.lit(0)) + 1).filter(F.col("_r") <= quota).drop("_h", "_one", "_before")
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("_r", "chat_type"))).drop("_r")  # quota rows only


def refresh_fixed(rows: DataFrame, reserved: DataFrame, total: int, group: float, cap: int, seed: int) -> DataFrame:
    """A new fixed set among the rows whose ids earlier batches didn't reserve."""
    return choose_quota(rows.join(reserved.select("id").distinct(), "id", "left_anti"), total, group, cap, seed)


def clean_cases(cases: DataFrame, max_gap: int = 600) -> DataFrame:
    """(reason, n): cases that are exact consecutive slices with a reply gap of 0 to `max_gap`, and why others aren't. Cases have mismatches, cutoff_ts, reply_ts."""
    gap = F.col("reply_ts") - F.col("cutoff_ts")
    reason = F.when(F.size("mismatches") > 0, "source_mismatch").when(gap < 0, "reversed").when(gap > max_gap, "stale").otherwise("kept")
    return cases.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def contribution_decide(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds decision: a side that meets every need while the other misses one wins; blocked diagnostics and near ties keep the base. Rows have needs_a, needs_b (arrays of booleans), blocked, base."""
    all_a, all_b = F.forall("needs_a", lambda x: x), F.forall("needs_b", lambda x: x)
    return rows.withColumn("decision", F.when(F.col("blocked"), F.col("base")).when(all_a & ~all_b, 1.0).when(all_b & ~all_a, 0.0).otherwise(F.when(F.abs(F.col("base") - threshold) < 0.05, threshold).otherwise(F.col("base"))))
