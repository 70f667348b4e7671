"""Ingest, validation, coverage and audit of messages and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def message_identity(*parts: str) -> Column:
    """SHA-256 of the parts' canonical text: JSON strings in the given order, joined by commas."""
    return F.sha2(F.concat_ws(",", *[F.to_json(F.struct(F.col(p).cast("string").alias(p))) for p in parts]), 256)


def dedupe_events(rows: DataFrame, key: list[str], content: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, conflicts: keys with several contents)."""
    digest = F.xxhash64(*content)
    hashed = rows.withColumn("_digest", digest)
    conflicts = hashed.groupBy(*key).agg(F.count_distinct("_digest").alias("contents"), F.count(F.lit(1)).alias("copies")).filter("contents > 1")
    first = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r", "_digest")
    return first, conflicts


def dedupe_counts(rows: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Raw, retained and duplicate rows by kind."""
    per_key = rows.groupBy(*key, kind).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(kind).agg(F.sum("_n").alias("raw"), F.count(F.lit(1)).alias("retained")).withColumn("duplicates", F.col("raw") - F.col("retained"))


def fallback_occurrence(rows: DataFrame, file: str, base: str, order: str) -> DataFrame:
    """Adds occurrence: how many rows of the file with the same base came before."""
    return rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy(file, base).orderBy(order)) - 1).cast("long"))


def chat_key(rows: DataFrame, file: str, sender: str, own: str, order: str, kind: str, peer: str) -> DataFrame:
    """Adds chat_key = kind:account:peer, the account being the sender of the file's first own row."""
    account = rows.filter(F.col(own)).groupBy(file).agg(F.min_by(sender, order).alias("_account"))
    return rows.join(account, file, "left").withColumn("chat_key", F.concat_ws(":", kind, F.coalesce(F.col("_account").cast("string"), F.lit("unknown")), F.col(peer).cast("string"))).drop("_account")


GAP_LIMITS = (120, 300, 600, 1800, 7200, 86400)


def data_audit(examples: DataFrame, by: list[str]) -> DataFrame:
    """Totals, response gaps over fixed limits, the largest gap, and chat types. Examples have cutoff_ts, reply_ts, n_reply, chat_type."""
    gap = F.col("reply_ts") - F.col("cutoff_ts")
    return examples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[F.sum((gap > x).cast("long")).alias(f"over_{x}") for x in GAP_LIMITS], F.max(gap).alias("largest_gap"),
        F.sum((F.col("n_reply") > 1).cast("long")).alias("multi"), F.sum((F.col("chat_type") == "group").cast("long")).alias("group_rows"), F.count_distinct("chat_id").alias("chats"),
    )


def role_isolation(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Number of message ids that both roles of each pair have. Rows have role and ids."""
    ids = rows.select("role", F.explode("ids").alias("id")).distinct()
    roles = ids.groupBy("id").agg(F.collect_set("role").alias("roles"))
    counts = roles.agg(*[F.sum((F.array_contains("roles", a) & F.array_contains("roles", b)).cast("long")).alias(f"{a}_{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', coalesce({a}_{b}, 0)" for a, b in pairs)
    return counts.select(F.expr(f"stack({len(pairs)}, {stack}) as (role_a, role_b, shared)"))


def import_coverage(source: DataFrame, archive: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Multiset comparison by kind: retained, missing and extra copies."""
    count = lambda rows, name: rows.groupBy(*key, kind).agg(F.count(F.lit(1)).alias(name))
    both = count(source, "_s").join(count(archive, "_a"), [*key, kind], "full").na.fill(0, ["_s", "_a"])
    return both.groupBy(kind).agg(
        F.sum("_s").alias("source"), F.sum("_a").alias("archived"), F.sum(F.least("_s", "_a")).alias("retained"),
        F.sum(F.greatest(F.col("_s") - F.col("_a"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("_a") - F.col("_s"), F.lit(0))).alias("extra"),
    )


def capacity_report(rows: DataFrame, by: list[str], required: Column, cap: int, highest: int = 200) -> DataFrame:
    """Required, cases, chats, capacity under the cap, and the smallest cap that reaches the need (null if none up to `highest`)."""
    chats = rows.groupBy(*by, "chat_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = chats.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("m"))
    base = sizes.groupBy(*by).agg(F.sum(F.col("n") * F.col("m")).alias("cases"), F.sum("m").alias("chats"), F.sum(F.least("n", F.lit(cap)) * F.col("m")).alias("capacity")).withColumn("required", required)
    tries = sizes.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(highest)))).groupBy(*by, "c").agg(F.sum(F.least("n", "c") * F.col("m")).alias("_have"))
    least = tries.join(base.select(*by, "required"), by).filter(F.col("_have") >= F.col("required")).groupBy(*by).agg(F.min("c").alias("minimum_cap"))
    return base.join(least, by, "left")


def set_fingerprint(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """SHA-256 of the sorted ids of each (bounded) role, joined by line feeds."""
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), "\n"), 256).alias("fingerprint"), F.count_distinct(column).alias("n"))


def role_union(a: DataFrame, b: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(union by id, ids with different content)."""
    rows = a.unionByName(b).withColumn("_d", F.xxhash64(*content))
    bad = rows.groupBy("id").agg(F.count_distinct("_d").alias("contents")).filter("contents > 1").select("id")
    return rows.drop("_d").dropDuplicates(["id"]), bad


def journal_contract(planned: DataFrame, written: DataFrame, verdicts: list[str]) -> DataFrame:
    """(case_id, issue): what a journal lacks of its plan. Every planned case is to be there once, and no other.

    `planned` has case_id; `written` case_id, status, reason and the boolean columns `verdicts`. Issues: blank or repeated cases of
    the plan, missing, foreign and repeated rows, a status that is neither ok nor failed, a failure without its reason, and an
    ok row without all verdicts.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    plan = planned.select(F.col("case_id").cast("string").alias("case_id")).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    rows = written.withColumn("case_id", F.col("case_id").cast("string"))
    counts = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("found"))
    met = plan.withColumnRenamed("n", "planned").join(counts, "case_id", "full")
    of_plan = met.select("case_id", F.explode(F.array_compact(F.array(
        F.when((F.col("planned") > 0) & blank(F.col("case_id")), "plan_blank"), F.when(F.col("planned") > 1, "plan_repeated"),
        F.when((F.col("planned") > 0) & F.col("found").isNull(), "missing"), F.when(F.col("planned").isNull(), "foreign"), F.when(F.col("found") > 1, "repeated"),
    ))).alias("issue"))
    known = F.coalesce(F.col("status").isin("ok", "failed"), F.lit(False))
    whole = F.forall(F.array(*verdicts), lambda v: v.isNotNull())
    of_rows = rows.select("case_id", F.explode(F.array_compact(F.array(
        F.when(~known, "bad_status"), F.when((F.col("status") == "failed") & blank(F.col("reason")), "no_reason"), F.when((F.col("status") == "ok") & ~whole, "no_verdict"),
    ))).alias("issue"))
    return of_plan.unionByName(of_rows).distinct()
