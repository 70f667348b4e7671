"""Experiment records to verdicts, metrics, decisions and noise."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def final_records(journal: DataFrame, key: list[str]) -> DataFrame:
    """The row with the largest line_no of each key, with retries: the earlier rows."""
    last = Window.partitionBy(*key)
    rows = journal.withColumn("_n", F.row_number().over(last.orderBy(F.desc("line_no")))).withColumn("retries", F.count(F.lit(1)).over(last) - 1)
    return rows.filter("_n = 1").drop("_n")


def majority(votes: str) -> Column:
    """True where more than half of the boolean array is."""
    return F.aggregate(votes, F.lit(0), lambda a, v: a + v.cast("int")) * 2 > F.size(votes)


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


def _rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(n / of, 4)).otherwise(F.lit(0.0))


def ab_metrics(records: DataFrame, by: list[str]) -> DataFrame:
    """Identification, raw and confirmed wins, failures and retries of final records.

    Records have status, chat_type, retries, identified_baseline, identified_candidate and, where the two differ and were
    verified, baseline_votes and candidate_votes.
    """
    ok = F.col("status") != "failed"
    b, c = F.col("identified_baseline"), F.col("identified_candidate")
    verified = ok & F.col("baseline_votes").isNotNull()
    fb, fc = majority("baseline_votes"), majority("candidate_votes")
    group = ok & (F.col("chat_type") == "group")
    sums = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"), _n(~ok).alias("failures"), F.sum("retries").alias("retries"), _n(ok).alias("pairs"),
        _n(ok & b).alias("identified_baseline"), _n(ok & c).alias("identified_candidate"), _n(group).alias("_group"), _n(group & b).alias("_gb"), _n(group & c).alias("_gc"),
        _n(ok & b & ~c).alias("wins"), _n(ok & c & ~b).alias("losses"),
        _n(verified & fb & ~fc).alias("wins_confirmed"), _n(verified & fc & ~fb).alias("losses_confirmed"), _n(verified & (fb == fc)).alias("contested"),
    )
    denominator = F.when(F.col("_group") > 0, F.col("_group")).otherwise(F.col("pairs"))
    return sums.select(
        *by, "attempted", "failures", "retries", _rate(F.col("failures"), F.col("attempted")).alias("failure_rate"), "pairs", "identified_baseline", "identified_candidate",
        _rate(F.col("identified_baseline"), F.col("pairs")).alias("rate_baseline"), _rate(F.col("identified_candidate"), F.col("pairs")).alias("rate_candidate"),
        _rate(F.col("_gb"), denominator).alias("rate_baseline_group"), _rate(F.col("_gc"), denominator).alias("rate_candidate_group"),
        "wins", "losses", (F.col("pairs") - F.col("wins") - F.col("losses")).alias("ties"), (F.col("wins") - F.col("losses")).alias("net_win_raw"),
        "wins_confirmed", "losses_confirmed", "contested", (F.col("wins_confirmed") - F.col("losses_confirmed")).alias("net_win_confirmed"),
    )


def sign_test(wins: str, losses: str) -> Column:
    """Exact two-sided sign test; 1 without decisive pairs."""

    @F.pandas_udf("double")
    def test(w: pd.Series, x: pd.Series) -> pd.Series:
        def one(a: int, b: int) -> float:
            n, k = a + b, min(a, b)
            log2 = n * math.log(2)
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - log2) for i in range(k + 1))
            return min(1.0, 2 * tail) if n else 1.0

        return pd.Series([one(int(a), int(b)) for a, b in zip(w, x)])

    return test(wins, losses)


def decide(metrics: DataFrame, dataset: str, min_rate: float, max_failure: float = 0.01, higher_is_better: bool = False) -> DataFrame:
    """Adds verdict: incomplete beyond the failure ceiling; else by the net confirmed wins that `min_rate` of the pairs asks for."""
    net, need = F.col("net_win_confirmed"), F.greatest(F.lit(1), F.ceil(F.lit(min_rate) * F.col("pairs")))
    incomplete = F.when(F.col("failure_rate") >= max_failure, "experiment_incomplete")
    if dataset == "development":
        return metrics.withColumn("verdict", incomplete.when(net >= need, "merge_to_iteration_baseline").when(net < 0, "reject").otherwise("observe"))
    more = F.col("identified_candidate") > F.col("identified_baseline")
    improved = more if higher_is_better else F.col("identified_candidate") < F.col("identified_baseline")
    return metrics.withColumn("verdict", incomplete.when(improved & (net >= need), "adopt").otherwise("reject"))


def confirmed_metrics(records: DataFrame, expected: DataFrame, extra_rounds: int, max_failure: float, by: list[str]) -> DataFrame:
    """Recomputed wins with the violations that would void them: coverage, failures, vote counts, first votes, stored majorities."""
    ok = F.col("status") == "ok"
    differs = ok & (F.col("identified_baseline") != F.col("identified_candidate"))
    votes = lambda s: F.coalesce(F.size(f"{s}_votes"), F.lit(-1)) != extra_rounds + 1
    first = lambda s: F.coalesce(F.element_at(f"{s}_votes", 1) != F.col(f"identified_{s}"), F.lit(True))
    stored = lambda s: F.coalesce(majority(f"{s}_votes") != F.col(f"{s}_final"), F.lit(True))
    fb, fc = majority("baseline_votes"), majority("candidate_votes")
    joined = expected.withColumn("_expected", F.lit(1)).join(records.withColumn("_seen", F.lit(1)), [*by, "case_id"], "full")
    return joined.groupBy(*by).agg(
        _n(F.col("_seen").isNull()).alias("missing"), _n(F.col("_expected").isNull()).alias("unexpected"),
        (_n(F.col("status") == "failed") > F.count("_expected") * max_failure).alias("too_many_failures"),
        _n(differs & (votes("baseline") | votes("candidate"))).alias("vote_count_errors"), _n(differs & (first("baseline") | first("candidate"))).alias("first_vote_errors"),
        _n(differs & (stored("baseline") | stored("candidate"))).alias("majority_errors"),
        _n(differs & fb & ~fc).alias("wins"), _n(differs & fc & ~fb).alias("losses"),
    )


def cohort_metrics(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Attempted, pairs, failures and identifications by familiarity and chat type."""
    joined = cases.select("case_id", "familiarity", "chat_type").join(records.drop("chat_type", "familiarity"), "case_id", "left")
    ok = F.coalesce(F.col("status") != "failed", F.lit(False))
    return joined.groupBy("familiarity", "chat_type").agg(
        F.count(F.lit(1)).alias("attempted"), _n(ok).alias("pairs"), _n(F.col("status") == "failed").alias("failures"),
        _n(ok & F.col("identified_baseline")).alias("identified_baseline"), _n(ok & F.col("identified_candidate")).alias("identified_candidate"),
    )


def quality_cohorts(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Quality for all and for each chat type in one pass over the grouping sets, with expected, missing and coverage."""
    joined = cases.select("case_id", "chat_type").join(records.drop("chat_type"), "case_id", "left")
    ok = F.coalesce(F.col("status") != "failed", F.lit(False))
    rolled = joined.rollup("chat_type").agg(
        F.count(F.lit(1)).alias("expected"), _n(F.col("status").isNull()).alias("missing"), _n(ok).alias("measured"), _n(ok & F.col("identified_baseline")).alias("identified_baseline"),
        _n(ok & F.col("identified_candidate")).alias("identified_candidate"), F.grouping("chat_type").alias("_all"),
    )
    return rolled.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("chat_type")).alias("cohort"), "expected", "missing", "measured", F.round(F.col("measured") / F.col("expected"), 6).alias("coverage"), "identified_baseline", "identified_candidate")


def correction_report(rows: DataFrame) -> DataFrame:
    """Counts over paired options: flagged, triggered, correct before and after, helped, harmed; one row, or by feature."""
    h, g, base, new = (F.col(c) for c in ("human_flagged", "generated_flagged", "base_correct", "corrected_correct"))
    return rows.agg(
        F.count(F.lit(1)).alias("pairs"), _n(h).alias("human_flagged"), _n(g).alias("generated_flagged"), _n(h & g).alias("both_flagged"), _n(h != g).alias("triggered"),
        _n(base).alias("base_correct"), _n(new).alias("corrected_correct"), _n(~base & new).alias("helped"), _n(base & ~new).alias("harmed"),
    )


def noise_flip_rate(measurements: DataFrame) -> DataFrame:
    """Share of adjacent verify votes of a (experiment, case, side) that differ, by experiment."""
    order = Window.partitionBy("source_exp", "case_id", "side").orderBy("round_no")
    pairs = measurements.filter("round_kind = 'verify'").withColumn("_p", F.lag("verdict").over(order)).filter("_p is not null")
    return pairs.groupBy("source_exp").agg(F.count(F.lit(1)).alias("pairs"), _n(F.col("verdict") != F.col("_p")).alias("flips"))


def noise_phi(records: DataFrame, least: int = 30) -> DataFrame:
    """Phi of the two sides' verdicts by experiment (null below `least` cases or without variation) and their agreement."""
    a, b = F.col("baseline_final").cast("double"), F.col("candidate_final").cast("double")
    return records.groupBy("source_exp").agg(
        F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.round(F.corr(a, b), 6)).alias("phi"),
        F.round(F.avg((F.col("baseline_final") == F.col("candidate_final")).cast("double")), 6).alias("agreement"),
    )


def noise_inflation(records: DataFrame) -> DataFrame:
    """By pair_fp: variance of the net-win rate within experiments, and with sides re-paired across its experiments."""
    own = records.groupBy("pair_fp", "source_exp").agg(F.avg(F.col("baseline_final").cast("int") - F.col("candidate_final").cast("int")).alias("net"))
    left = records.select("pair_fp", "case_id", F.col("source_exp").alias("_x"), F.col("baseline_final").cast("int").alias("_b"))
    right = records.select("pair_fp", "case_id", F.col("source_exp").alias("_y"), F.col("candidate_final").cast("int").alias("_c"))
    crossed = left.join(right, ["pair_fp", "case_id"]).filter("_x != _y").groupBy("pair_fp", "_x", "_y").agg(F.avg(F.col("_b") - F.col("_c")).alias("net"))
    spread = lambda rows, name: rows.groupBy("pair_fp").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.round(F.var_samp("net"), 9).alias(f"var_{name}"))
    return spread(own, "within").join(spread(crossed, "repaired"), "pair_fp", "left")


def comparison_records(rows: DataFrame, extra_rounds: int) -> DataFrame:
    """By case: hits of both sides in round 0 and, where they disagree, over all rounds once all have come (else pending)."""
    cases = rows.groupBy("case_id").agg(
        F.max(F.when(F.col("round_no") == 0, F.col("baseline_hit").cast("int"))).alias("b0"), F.max(F.when(F.col("round_no") == 0, F.col("candidate_hit").cast("int"))).alias("c0"),
        F.count_distinct("round_no").alias("rounds"), F.sum(F.col("baseline_hit").cast("int")).alias("b"), F.sum(F.col("candidate_hit").cast("int")).alias("c"),
    )
    pending = (F.col("b0") != F.col("c0")) & (F.col("rounds") < extra_rounds + 1)
    side = lambda x: F.when(F.col("b0") == F.col("c0"), F.col(f"{x}0") == 1).otherwise(2 * F.col(x) > F.col("rounds"))
    return cases.select("case_id", F.when(pending, "pending").otherwise("complete").alias("state"), (F.col("b0") - F.col("c0")).alias("initial_net"), F.when(~pending, side("b")).alias("baseline_final"), F.when(~pending, side("c")).alias("candidate_final"))
