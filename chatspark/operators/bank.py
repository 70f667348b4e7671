"""The measurement bank: verdicts by side and round, inserted once, audited against their source and replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["source_exp", "source_line", "side_fp", "round_fp"]


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def pair_fingerprint(a: Column, b: Column, *rest: Column) -> Column:
    """The same for either order of the two sides."""
    return fingerprint(F.least(a, b), F.greatest(a, b), *rest)


#: Fixed value: the URL namespace of RFC 4122.
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 identifier of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def bank_explode(records: DataFrame) -> DataFrame:
    """A row per side and vote: the initial verdict, then later votes. Failed rows, blank ids and equal sides are left out;
    votes whose first contradicts the initial verdict are not trusted.
    """
    rows = records.filter((F.col("status") == "ok") & (F.coalesce(F.col("case_id"), F.lit("")) != "") & (F.col("baseline_fp") != F.col("candidate_fp")))
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_fp").alias("side_fp"), F.col(f"identified_{s}").alias("initial"), F.col(f"{s}_votes").alias("votes"))
    sides = rows.select("source_exp", "source_line", "case_id", "judge_fp", "created_at", pair_fingerprint(F.col("baseline_fp"), F.col("candidate_fp"), F.col("judge_fp")).alias("pair_fp"), F.explode(F.array(side("baseline"), side("candidate"))).alias("s")).select("*", "s.*").drop("s").filter("initial is not null")
    trusted = F.coalesce(F.element_at("votes", 1) == F.col("initial"), F.lit(False))
    later = F.when(trusted & (F.size("votes") > 1), F.slice("votes", 2, F.size("votes") - 1)).otherwise(F.array().cast("array<boolean>"))
    out = sides.select("*", F.posexplode(F.concat(F.array("initial"), later)).alias("round_no", "vote")).filter("vote is not null")
    kind = F.when(F.col("round_no") == 0, "initial").otherwise("verify")
    nonce = uuid5(F.concat_ws(":", "source_exp", "case_id", F.col("round_no").cast("string")))
    return out.select("source_exp", "source_line", "case_id", "side", "side_fp", "judge_fp", "pair_fp", fingerprint(F.col("pair_fp"), kind, nonce).alias("round_fp"), kind.alias("round_kind"), "round_no", F.col("vote").cast("int").alias("verdict"), "created_at")


def bank_upsert(bank: DataFrame, new: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): a key that is there with equal values is ignored, with others (a null is a value of its own) a conflict; a round that any source already has for the case and side is skipped."""
    there = bank.select(*KEY, F.struct(*values).alias("_old"))
    met = new.withColumn("_new", F.struct(*values)).join(there, KEY, "left")
    conflicts = met.filter(F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).select(*KEY)
    rounds = bank.select("round_fp", "case_id", "side_fp").distinct()
    insert = met.filter("_old is null").join(rounds, ["round_fp", "case_id", "side_fp"], "left_anti")
    return insert.drop("_old", "_new"), conflicts


def bank_audit(bank: DataFrame, source: DataFrame, fields: list[str]) -> DataFrame:
    """Keys of rows that the bank has alone, lacks, or has with other values, and these fields."""
    a = bank.select(*KEY, F.struct(*fields).alias("_a"))
    b = source.select(*KEY, F.struct(*fields).alias("_b"))
    both = a.join(b, KEY, "full")
    state = F.when(F.col("_b").isNull(), "extra").when(F.col("_a").isNull(), "missing").otherwise("changed")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    return both.select(*KEY, state.alias("state"), F.when(state == "changed", differ).otherwise(F.array().cast("array<string>")).alias("fields")).filter("state != 'changed' or size(fields) > 0")


def bank_plan(bank: DataFrame, cases: DataFrame, extra_rounds: int) -> DataFrame:
    """(case_id, replay_from): the earliest finished source with both sides and, where the initial verdicts disagree, all verify rounds of both; null where the case must run."""
    by_side = bank.groupBy("case_id", "source_exp", "side").agg(
        F.max(F.when(F.col("round_no") == 0, F.col("verdict"))).alias("initial"), F.count_distinct(F.when(F.col("round_no") > 0, F.col("round_no"))).alias("rounds"), F.min("created_at").alias("created_at"), F.max("source_line").alias("line"),
    )
    sources = by_side.groupBy("case_id", "source_exp").agg(F.count("initial").alias("sides"), F.min("initial").alias("lo"), F.max("initial").alias("hi"), F.min("rounds").alias("rounds"), F.min("created_at").alias("created_at"), F.max("line").alias("line"))
    usable = sources.filter((F.col("sides") == 2) & ((F.col("lo") == F.col("hi")) | (F.col("rounds") >= extra_rounds)))
    first = usable.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy("created_at", "source_exp"))).filter("_r = 1")
    return cases.join(first.select("case_id", F.col("source_exp").alias("replay_from"), F.col("line").alias("replay_line")), "case_id", "left")
