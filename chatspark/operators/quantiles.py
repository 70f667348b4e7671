"""Exact order statistics of groups of any size: sketches bracket the rank, counts within the bracket select."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatspark.operators.scan import running
from chatspark.sources.scratch import written

#: Share of a group to either side of a rank that a bracket takes; a sketch's rank is off by less than half of it almost surely.
MARGIN = 0.04
#: Steps of the quantiles that are read off a sketch.
STEPS = 100


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """A row for each group with a value: by, n, and for each name the value at the rank (from 0) that the function makes of n.

    A mergeable KLL sketch of each group gives a value below and one above each rank. Counts of what lies below and within say whether the rank is
    there; where it isn't, the bracket is the whole group. The values within are counted, and the counts summed along ranges of values.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sketched = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v").alias("_k"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("rank")) for name, f in ranks.items()])).alias("_a")
    grid = F.kll_sketch_get_quantile_double("_k", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
    share = (F.col("rank") + 0.5) / F.col("n")
    below, above = F.floor((share - MARGIN) * STEPS).cast("int"), F.ceil((share + MARGIN) * STEPS).cast("int")
    lo = F.when(below <= 0, F.lit(float("-inf"))).otherwise(F.get("_g", below))
    hi = F.when(above >= STEPS, F.lit(float("inf"))).otherwise(F.get("_g", above))
    brackets = written(sketched.select(*by, "n", grid.alias("_g"), asked).select(*by, "n", "_g", "_a.*").select(*by, "n", "name", "rank", lo.alias("lo"), hi.alias("hi")))

    def counted(b: DataFrame) -> DataFrame:
        met = _met(known, b, by)
        return met.groupBy(*by, "name").agg(F.sum((F.col("_v") < F.col("lo")).cast("long")).alias("below"), F.sum(F.col("_v").between(F.col("lo"), F.col("hi")).cast("long")).alias("within"))

    found = _met(brackets, counted(brackets), [*by, "name"])
    holds = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("within"))
    sure = written(found.select(*by, "n", "name", "rank", *[F.when(holds, F.col(c)).otherwise(F.lit(other)).alias(c) for c, other in (("lo", float("-inf")), ("hi", float("inf")), ("below", 0))]))
    inside = _met(known, sure, by).filter(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*by, "name", "rank", "below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running(inside, {"_before": (F.sum, "_c")}, ["_v"], [*by, "name"]).withColumn("_from", F.col("below") + F.coalesce("_before", F.lit(0)))
    chosen = placed.filter((F.col("_from") <= F.col("rank")) & (F.col("rank") < F.col("_from") + F.col("_c")))
    values = chosen.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    return _met(sketched.select(*by, "n"), values, by)


def _met(rows: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the other's columns, by keys that may be null."""
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return rows.alias("a").join(other.alias("b"), on).select("a.*", *[F.col(f"b.{c}") for c in other.columns if c not in by and c not in rows.columns])
