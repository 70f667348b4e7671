"""How a score orders graded candidates: expected grades with ties, mean ranks, ordered pairs, histograms; and the choice of a penalty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.ranking import pairwise_lr
from chatspark.operators.splits import temporal_split
from chatspark.sources.scratch import written

#: Inverse penalties that are tried.
GRID = (0.01, 0.1, 1.0, 10.0)


def _measure(df: DataFrame, name: str, key: Column, n: Column, value: Column) -> DataFrame:
    return df.select(F.lit(name).alias("measure"), key.cast("string").alias("key"), n.cast("long").alias("n"), F.round(value, 6).alias("value"))


def graded_report(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(measure, key, n, value) of candidates (target_id, id, score, grade): n counts what the mean is over.

    mean_rank: by grade, ties share their mean place. ordered_pairs and positive_pairs: the mean over targets of the share of pairs of different grades
    (of positive ones only) that the score puts right, half for ties. grade_at: by K, the expected mean grade of the first K where equal scores come in any order.
    positives, candidates: how many targets have so many.
    """
    rows = written(rows.select("target_id", "id", "score", "grade"))
    own = Window.partitionBy("target_id")
    above = F.rank().over(own.orderBy(F.desc("score"))) - 1
    tied = F.count(F.lit(1)).over(Window.partitionBy("target_id", "score"))
    ranks = rows.select("grade", (1 + above + (tied - 1) / 2).alias("r")).groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("v"))
    out = _measure(ranks, "mean_rank", F.col("grade"), F.col("n"), F.col("v"))

    low = rows.select("target_id", F.col("grade").alias("_g"), F.col("score").alias("_s"))
    pairs = rows.join(low, "target_id").filter(F.col("grade") > F.col("_g"))
    won = F.when(F.col("score") > F.col("_s"), 1.0).when(F.col("score") == F.col("_s"), 0.5).otherwise(0.0)
    per = pairs.groupBy("target_id").agg(F.avg(won).alias("all"), F.avg(F.when(F.col("_g") > 0, won)).alias("positive"))
    both = per.agg(F.count("all").alias("na"), F.avg("all").alias("a"), F.count("positive").alias("np"), F.avg("positive").alias("p"))
    for name, n, v in (("ordered_pairs", "na", "a"), ("positive_pairs", "np", "p")):
        out = out.unionByName(_measure(both, name, F.lit(""), F.col(n), F.col(v)))

    groups = rows.groupBy("target_id", "score").agg(F.count(F.lit(1)).alias("m"), F.sum("grade").alias("g"))
    before = F.coalesce(F.sum("m").over(own.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = groups.withColumn("_a", before).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    taken = F.least(F.greatest(F.col("k") - F.col("_a"), F.lit(0)), F.col("m"))
    first = placed.groupBy("target_id", "k").agg((F.sum(F.col("g") * taken / F.col("m")) / F.sum(taken)).alias("v"))
    out = out.unionByName(_measure(first.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v")), "grade_at", F.col("k"), F.col("n"), F.col("v")))

    sizes = rows.groupBy("target_id").agg(F.count(F.lit(1)).alias("candidates"), F.sum((F.col("grade") > 0).cast("long")).alias("positives"))
    for name in ("positives", "candidates"):
        out = out.unionByName(_measure(sizes.groupBy(name).agg(F.count(F.lit(1)).alias("n")), name, F.col(name), F.col("n"), F.lit(None).cast("double")))
    return out


def feature_pairs(rows: DataFrame, features: list[str]) -> DataFrame:
    """(target_id, weight, differences of the features): every better and worse candidate of a target, which together weigh one."""
    side = lambda n: rows.select("target_id", F.col("grade").alias(f"_{n}"), *[F.col(f).alias(f"{n}_{f}") for f in features])
    pairs = side("a").join(side("b"), "target_id").filter("_a > _b")
    weighed = pairs.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("target_id")))
    return weighed.select("target_id", "weight", *[(F.col(f"a_{f}") - F.col(f"b_{f}")).cast("double").alias(f) for f in features])


def pair_loss(pairs: DataFrame, weights: dict[str, float]) -> float | None:
    """The mean over targets of the logistic loss of their pairs; None without pairs."""
    margin = sum((F.lit(w) * F.col(f) for f, w in weights.items()), F.lit(0.0))
    loss = F.when(margin > 0, F.log1p(F.exp(-margin))).otherwise(F.log1p(F.exp(margin)) - margin)
    row = pairs.agg((F.sum(F.col("weight") * loss) / F.sum("weight")).alias("loss")).first()
    return row.loss


def fitted(pairs: DataFrame, features: list[str], c: float) -> dict[str, float]:
    """Weights that minimise c * the weighted loss + half their square."""
    total = pairs.agg(F.sum("weight").alias("w")).first().w
    return pairwise_lr(pairs.select("weight", *features), features, 1.0 / (c * total))


def tuned_pairwise(targets: DataFrame, materials: DataFrame, rows: DataFrame, features: list[str], grid: tuple[float, ...] = GRID, fraction: float = 0.8) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """(weights, [(c, loss)]): the penalty with the least loss on later targets, then weights of all targets under it.

    Targets and materials are as temporal_split() takes them: the last fifth by time validates, earlier targets whose material reaches into it
    or holds one of its answers are purged. Each penalty is one distributed fit; equal losses go to the stronger penalty.
    """
    split = written(temporal_split(targets, materials, fraction))
    pairs = written(feature_pairs(rows.join(targets.select("target_id"), "target_id", "left_semi"), features))
    train, valid = (written(pairs.join(split.filter(F.col("split") == s).select("target_id"), "target_id", "left_semi")) for s in ("fit", "validation"))
    if train.isEmpty() or valid.isEmpty():
        raise ValueError("the split leaves no pairs to fit or to validate on")
    trials = [(c, pair_loss(valid, fitted(train, features, c))) for c in grid]
    best = min(trials, key=lambda t: (t[1], t[0]))[0]
    return fitted(pairs, features, best), trials
