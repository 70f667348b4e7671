"""Eligible history against loops; its pairs are not shuffled."""

import random

import pytest

from chatspark.operators import eligibility as E


def made(spark, seed, n=120):
    rng = random.Random(seed)
    ids = lambda k: rng.choice([None, [], [rng.choice([None, *range(30)]) for _ in range(k)]])
    cases = [(i, rng.randrange(2), rng.randrange(100), rng.choice([[], [1, 2]]), ids(2)) for i in range(n)]
    pool = [(f"e{i}", rng.randrange(2), rng.randrange(4), rng.randrange(100), ids(4)) for i in range(n)]
    return cases, pool, spark.createDataFrame(cases, "case_id long, kin long, cutoff_ts long, excluded array<long>, reply_ids array<long>"), spark.createDataFrame(pool, "example_id string, kin long, chat_id long, end_ts long, ids array<long>")


@pytest.mark.parametrize("seed", [1, 2])
def test_eligible_history(spark, seed):
    cases, pool, c, p = made(spark, seed)
    want = {(i, e) for i, kin, cutoff, barred, r in cases for e, k, chat, end, ids in pool if k == kin and end < cutoff and chat not in barred and not {*(r or [])} & {*(ids or [])} - {None}}
    out = E.eligible_history(c, p, ["kin"]).collect()
    assert len(out) == len(want) > 100 and {(r.case_id, r.example_id) for r in out} == want


@pytest.mark.parametrize("make", [lambda pairs: pairs, E.history_age], ids=["pairs", "ages"])
def test_pairs_are_not_shuffled(spark, make):
    """One join alone makes pairs, and no exchange stands above it."""
    _, _, c, p = made(spark, 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = make(E.eligible_history(c, p, ["kin"]))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = [i for i, x in enumerate(plan) if "Join" in x]
    assert len(joins) == 2 and not any("Exchange" in x for x in plan[: joins[0]])
