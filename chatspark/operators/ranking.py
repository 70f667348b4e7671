"""Preference pairs, model scores and ranking metrics over observations (target_id, id, score, grade)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.splits import running_before
from chatspark.sources.scratch import written


def pref_pairs(rows: DataFrame) -> DataFrame:
    """(target_id, better, worse, weight): pairs of unequal grades inside a target of bounded size; a target's weights sum to one."""
    a, b = rows.select("target_id", F.col("id").alias("better"), F.col("grade").alias("_g")), rows.select("target_id", F.col("id").alias("worse"), F.col("grade").alias("_h"))
    pairs = a.join(b, "target_id").filter("_g > _h")
    return pairs.select("target_id", "better", "worse", F.round(1 / F.count(F.lit(1)).over(Window.partitionBy("target_id")), 9).alias("weight"))


def pair_differences(rows: DataFrame, features: list[str]) -> DataFrame:
    """(weight, features): better less worse of the pairs of unequal grades inside a target, whose weights sum to one as in pref_pairs(); pairs stay in their target's task."""
    rows = rows.select("target_id", F.struct("grade", *features).alias("_x")).filter("target_id is not null").groupBy("target_id").agg(F.collect_list("_x").alias("_all"))
    grades = F.transform("_all", lambda x: x["grade"])
    pairs = F.aggregate(grades, F.lit(0).cast("long"), lambda n, g: n + F.size(F.filter(grades, lambda h: g > h)))
    each = rows.withColumn("weight", F.round(1 / F.nullif(pairs, F.lit(0)), 9)).withColumn("_a", F.explode("_all")).withColumn("_b", F.explode("_all")).filter("_a.grade > _b.grade")
    return each.select("weight", *[(F.col(f"_a.{f}") - F.col(f"_b.{f}")).alias(f) for f in features])


def directed_pairs(rows: DataFrame) -> DataFrame:
    """(target_id, win, lose) of complete targets (no null z) that have both."""
    state = rows.groupBy("target_id").agg((F.count("z") == F.count(F.lit(1))).alias("_c"), F.min("z").alias("_lo"), F.max("z").alias("_hi")).filter("_c and _lo < _hi").select("target_id")
    good = rows.join(state, "target_id", "left_semi")
    return good.filter("z = 1").select("target_id", F.col("id").alias("win")).join(good.filter("z = 0").select("target_id", F.col("id").alias("lose")), "target_id")


def cat_encode(rows: DataFrame, fit: Column, field: str) -> DataFrame:
    """Adds code: the rank (from 1) of the field's value among the fit rows' values, 0 for others."""
    values = rows.filter(fit).select(field).filter(F.col(field).isNotNull()).distinct()
    coded = running_before(values.withColumn("_one", F.lit(1)), "_one", [field]).select(field, (F.col("before") + 1).cast("int").alias("code"))
    return rows.join(coded, field, "left").na.fill(0, ["code"])


def linear_score(rows: DataFrame, weights: DataFrame, fields: list[str]) -> DataFrame:
    """(id, score) of each row, ids may recur: sum of the weights of its fields' values; unknown values weigh nothing. Weights have field, value, weight and fit a task."""
    known = weights.groupBy("field", "value").agg(F.sum("weight").alias("weight"))
    for i, f in enumerate(fields):
        own = known.filter(F.col("field") == f).select(F.col("value").alias(f"_v{i}"), F.col("weight").alias(f"_w{i}"))
        rows = rows.join(F.broadcast(own), F.col(f).cast("string") == F.col(f"_v{i}"), "left")
    return rows.select("id", F.round(sum((F.coalesce(f"_w{i}", F.lit(0.0)) for i in range(len(fields))), F.lit(0.0)), 6).alias("score"))


def score_fusion(rows: DataFrame, train: Column, a: str, b: str, weight: float = 0.8) -> DataFrame:
    """Adds fused and probability: margins scaled by their root mean square over the training rows, weighted and squashed."""
    scale = rows.filter(train).agg(F.sqrt(F.avg(F.col(a) * F.col(a))).alias("_a"), F.sqrt(F.avg(F.col(b) * F.col(b))).alias("_b"))
    fused = weight * F.col(a) / F.col("_a") + (1 - weight) * F.col(b) / F.col("_b")
    return rows.join(F.broadcast(scale)).withColumn("fused", fused).withColumn("probability", 1 / (1 + F.exp(-F.col("fused")))).drop("_a", "_b")


def prob_metrics(rows: DataFrame, by: list[str], clip: float = 1e-6) -> DataFrame:
    """Correct, total and clipped log loss of probability against label (0 or 1)."""
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("probability")))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(((F.col("probability") >= 0.5).cast("int") == F.col("label")).cast("long")).alias("correct"), F.round(F.avg(loss), 6).alias("logloss"))


def topk_expectation(rows: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(target_id or other `by`, hit, positives): expectations at K when ties are broken uniformly (hypergeometric at the cut)."""
    by = by or ["target_id"]
    tied = rows.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("pos"))
    run = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    cut = tied.withColumn("above", F.coalesce(F.sum("n").over(run), F.lit(0)))
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - F.col("above")))
    cut = cut.withColumn("take", take.cast("int"))
    # probability of no positive among `take` of n with pos positives: product of (n - pos - i) / (n - i)
    miss = F.aggregate(F.sequence(F.lit(0), F.col("take")), F.lit(1.0), lambda acc, i: F.when(i < F.col("take"), acc * F.greatest(F.lit(0.0), (F.col("n") - F.col("pos") - i) / (F.col("n") - i))).otherwise(acc))
    return cut.withColumn("miss", miss).groupBy(*by).agg(F.round(1 - F.product("miss"), 6).alias("hit"), F.round(F.sum(F.when(F.col("n") > 0, F.col("take") * F.col("pos") / F.col("n"))), 6).alias("positives"))


def graded_comparison(rows: DataFrame, methods: list[str], ks: list[int], thresholds: list[int]) -> DataFrame:
    """(method, threshold, k, targets, available, hit_rate, hit_rate_given_available) of saved scores, one column for each method.

    A row counts as positive from the threshold grade on; `available` are the targets that have one. Targets without stay
    in the first rate's denominator, and leave the second's.
    """
    score = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("score")) for m in methods])).alias("s")
    stacked = rows.select("target_id", "grade", score).select("target_id", "grade", "s.*").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    stacked = stacked.withColumn("z", (F.col("grade") >= F.col("threshold")).cast("int"))
    by = ["method", "threshold", "target_id"]
    any_of = stacked.groupBy(*by).agg(F.max("z").alias("available"))
    out = None
    for k in ks:
        found = topk_expectation(stacked, k, by).join(any_of, by).groupBy("method", "threshold").agg(
            F.count(F.lit(1)).alias("targets"), F.sum("available").alias("available"), F.round(F.avg("hit"), 5).alias("hit_rate"),
            F.round(F.avg(F.when(F.col("available") == 1, F.col("hit"))), 5).alias("hit_rate_given_available"),
        ).withColumn("k", F.lit(k))
        out = found if out is None else out.unionByName(found)
    return out


def rank_metrics(rows: DataFrame) -> DataFrame:
    """One row: ROC-AUC and average precision over all rows, from counts of distinct scores; within-target AUC over its pairs."""
    sums = rows.groupBy("score").agg(F.sum("z").alias("p"), F.sum(1 - F.col("z")).alias("q"))
    parts = sums.repartitionByRange(F.desc("score")).withColumn("_part", F.spark_partition_id())
    base = parts.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = base.select("_part", F.coalesce(F.sum("_p").over(order), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_q").over(order), F.lit(0)).alias("_bq"))
    run = Window.partitionBy("_part").orderBy(F.desc("score"))
    cum = parts.join(F.broadcast(base), "_part").withColumn("cp", F.col("_bp") + F.sum("p").over(run)).withColumn("cq", F.col("_bq") + F.sum("q").over(run))
    both = F.sum("p") * F.sum("q")
    whole = cum.agg(
        F.round(F.sum(F.col("q") * (F.col("cp") - F.col("p") + F.col("p") / 2)) / both, 6).alias("roc_auc"),
        F.round(F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq"))) / F.sum("p"), 6).alias("average_precision"),
    )
    a, b = rows.filter("z = 1").select("target_id", F.col("score").alias("_s")), rows.filter("z = 0").select("target_id", F.col("score").alias("_t"))
    pair = a.join(b, "target_id").withColumn("_w", F.when(F.col("_s") > F.col("_t"), 1.0).when(F.col("_s") == F.col("_t"), 0.5).otherwise(0.0))
    within = pair.groupBy("target_id").agg(F.avg("_w").alias("_a"), F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n")).agg(F.round(F.avg("_a"), 6).alias("within_auc"), F.round(F.sum("_w") / F.sum("_n"), 6).alias("pair_accuracy"))
    best = rows.withColumn("_m", F.max("score").over(Window.partitionBy("target_id"))).filter("score = _m").groupBy("target_id").agg(F.avg("z").alias("_y")).agg(F.round(F.avg("_y"), 6).alias("top1_yield"))
    return whole.join(within).join(best)  # three single rows


def ndcg(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Mean NDCG at each K, linear gain, a tie group's gain averaged over its places; targets without a gain don't count."""
    places = Window.partitionBy("target_id")
    ranked = rows.withColumn("_r", F.row_number().over(places.orderBy(F.desc("score"), "id"))).withColumn("_i", F.row_number().over(places.orderBy(F.desc("grade"), "id")))
    tied = ranked.withColumn("_gain", F.avg("grade").over(Window.partitionBy("target_id", "score")))
    discount = lambda r, k: F.when(F.col(r) <= k, 1 / F.log2(F.col(r) + 1)).otherwise(0.0)
    per = tied.groupBy("target_id").agg(*[x for k in ks for x in (F.sum(F.col("_gain") * discount("_r", k)).alias(f"d{k}"), F.sum(F.col("grade") * discount("_i", k)).alias(f"i{k}"))])
    good = per.filter(F.col(f"i{ks[0]}") > 0)
    return good.agg(F.count(F.lit(1)).alias("targets"), *[F.round(F.avg(F.col(f"d{k}") / F.col(f"i{k}")), 6).alias(f"ndcg_{k}") for k in ks])


def graded_metrics(rows: DataFrame, k: int) -> DataFrame:
    """By threshold: positives, share of targets whose first K hold one; with mean grade at K."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("score"), "id")))
    stacked = ranked.withColumn("threshold", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    per = stacked.groupBy("threshold", "target_id").agg(F.sum((F.col("grade") >= F.col("threshold")).cast("long")).alias("p"), F.max(((F.col("grade") >= F.col("threshold")) & (F.col("_r") <= k)).cast("int")).alias("h"), F.avg(F.when(F.col("_r") <= k, F.col("grade"))).alias("m"))
    return per.groupBy("threshold").agg(F.sum("p").alias("positives"), F.round(F.avg("h"), 6).alias("hit_rate"), F.round(F.avg("m"), 6).alias("mean_grade"))


def selection_vs_baseline(rows: DataFrame, baseline: DataFrame, ties: tuple[str, ...] = ("z",)) -> DataFrame:
    """Model top-1 against the baseline id (one for a target) of the same targets: wins, losses, ties, exclusions. Rows that share an id go by `ties`, the first counts."""
    after = [F.asc_nulls_last(c) for c in ("id", *ties)]
    top = rows.withColumn("_r", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("score"), *after))).filter("_r = 1").select("target_id", F.col("z").alias("model"))
    met = baseline.select("target_id", F.col("id").alias("_id")).join(rows, "target_id").filter(F.col("id").eqNullSafe(F.col("_id")))
    base = met.groupBy("target_id").agg(F.min_by("z", F.struct(*[x for c in ties for x in (F.col(c).isNull(), F.col(c))])).alias("base"))
    both = top.join(base, "target_id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    m, b = F.col("model"), F.col("base")
    return both.agg(F.count(F.lit(1)).alias("targets"), n(b.isNull() | m.isNull()).alias("excluded"), n(m > b).alias("wins"), n(m < b).alias("losses"), n(m == b).alias("ties"))


def paired_bootstrap(deltas: DataFrame, by: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Mean and 95 % interval of per-target deltas by Poisson bootstrap: each draw weighs each target by a Poisson count of mean 1.

    Equal deltas of a group draw together (n of them have a Poisson count of mean n), seeded by group and value. Tasks send a draw's sums only.
    """
    values = deltas.select(F.col(by).cast("string").alias(by), F.col("delta").cast("double").alias("delta")).filter("delta is not null").groupBy(by, "delta").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        sums: dict[str | None, np.ndarray] = {}

        def rows():
            for group, (w, wd) in sums.items():
                yield pd.DataFrame({by: pd.Series([group] * draws, dtype=object), "draw": np.arange(draws), "w": w, "wd": wd})

        for table in batches:
            for group, delta, n, key in zip(table[by], table["delta"], table["n"], table["key"]):
                w = np.random.default_rng([seed, key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF]).poisson(n, draws)
                if group not in sums and len(sums) >= 256:
                    yield from rows()
                    sums.clear()
                sums.setdefault(group, np.zeros((2, draws)))
                sums[group] += (w, w * delta)
        yield from rows()

    parts = values.withColumn("key", F.xxhash64(by, "delta")).mapInPandas(run, f"`{by}` string, draw long, w double, wd double")
    means = parts.groupBy(by, "draw").agg((F.sum("wd") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ends = means.groupBy(F.col(by).alias("_by")).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = values.groupBy(by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("delta")) / F.sum("n")).alias("mean"))
    # Sums depend on the order of rows in their last digits.
    return whole.join(ends, F.col(by).eqNullSafe(F.col("_by"))).select(by, "n", *[F.round(c, 9).alias(x) for c, x in ((F.col("mean"), "mean"), (F.col("q")[0], "low"), (F.col("q")[1], "high"))])


def label_summary(rows: DataFrame) -> DataFrame:
    """Targets by class: mixed, all_one, all_zero, incomplete or none; with their labels."""
    per = rows.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("labelled"), F.coalesce(F.sum("z"), F.lit(0)).alias("ones"))
    kind = F.when(F.col("labelled") == 0, "none").when(F.col("labelled") < F.col("n"), "incomplete").when(F.col("ones") == 0, "all_zero").when(F.col("ones") == F.col("n"), "all_one").otherwise("mixed")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("targets"), F.sum("n").alias("candidates"), F.sum("ones").alias("ones"))


def graded_labels(rows: DataFrame, repeats: DataFrame, rounds: int) -> DataFrame:
    """(target_id, id, grade): z plus the repeats' labels; positives whose repeats are not complete stay out."""
    sums = repeats.groupBy("target_id", "id").agg(F.sum("label").alias("_s"), F.count("label").alias("_n"))
    joined = rows.join(sums, ["target_id", "id"], "left")
    return joined.filter(F.col("z").isNotNull() & ((F.col("z") == 0) | (F.coalesce("_n", F.lit(0)) == rounds))).select("target_id", "id", (F.col("z") + F.when(F.col("z") == 1, F.col("_s")).otherwise(0)).alias("grade"))


def stability_summary(repeats: DataFrame, rounds: int) -> DataFrame:
    """Histogram of the repeats' positives over complete identities, by split."""
    per = repeats.groupBy("split", "target_id", "id").agg(F.sum("label").alias("positives"), F.count("label").alias("n")).filter(F.col("n") == rounds)
    return per.groupBy("split", "positives").agg(F.count(F.lit(1)).alias("identities"))


def cross_coverage(rows: DataFrame, fit: Column, fields: list[str]) -> DataFrame:
    """Per field: values of the fit rows, singletons among them, validation rows and those with a value known in fit."""
    stacked = rows.withColumn("_fit", fit).select("_fit", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("_fit", "x.*")
    per = stacked.groupBy("field", "value").agg(F.sum(F.col("_fit").cast("long")).alias("f"), F.sum((~F.col("_fit")).cast("long")).alias("v"))
    return per.groupBy("field").agg(F.sum((F.col("f") > 0).cast("long")).alias("fit_values"), F.sum((F.col("f") == 1).cast("long")).alias("singletons"), F.sum("v").alias("validation_rows"), F.sum(F.when(F.col("f") > 0, F.col("v")).otherwise(0)).alias("known_rows"))


def field_profile(rows: DataFrame, context: str, fields: list[str], least: int = 10) -> DataFrame:
    """Per field: known rows, categories with `least` rows, contexts in which its value varies. `unknown` is a category, not null."""
    stacked = rows.select(context, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields])).alias("x")).select(context, "x.*")
    per = stacked.groupBy("field", "value", context).agg(F.count(F.lit(1)).alias("n"))
    values = per.groupBy("field", "value").agg(F.sum("n").alias("n")).groupBy("field").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value") != "unknown", F.col("n")).otherwise(0)).alias("known"), F.sum((F.col("n") >= least).cast("long")).alias("categories"))
    mixed = per.groupBy("field", context).agg(F.count(F.lit(1)).alias("k")).groupBy("field").agg(F.sum((F.col("k") > 1).cast("long")).alias("mixed_contexts"))
    return values.join(mixed, "field")


def pairwise_lr(pairs: DataFrame, features: list[str], reg: float = 0.01):
    """Weighted logistic model of feature differences (better minus worse), both ways round, without intercept; the coefficients by feature.

    Equal differences are one row with the sum of their weights, so what the fit keeps grows with distinct ones only.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    pairs = written(pairs.groupBy(*features).agg(F.sum("weight").alias("weight")))
    flip = pairs.select(*[(-F.col(f)).alias(f) for f in features], "weight", F.lit(0.0).alias("label"))
    both = pairs.select(*features, "weight", F.lit(1.0).alias("label")).unionByName(flip)
    ready = VectorAssembler(inputCols=features, outputCol="x").transform(both)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", fitIntercept=False, regParam=reg, standardization=False, maxIter=50).fit(ready)
    return dict(zip(features, model.coefficients.toArray().tolist()))
