"""Identities under either name of a claim, against sets."""

import random

import pytest

from chatspark.operators import eligibility as E


def made(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice([None, *"abcdefgh"])
    names = [(rng.choice([None, f"i{rng.randrange(9)}"]), name(), rng.choice([None, 0, 1])) for _ in range(40)]
    claims = [(i, name(), name(), rng.choice([None, 0, 1])) for i in range(150)] + [(999, "a", "a", 0)]
    return names, claims, spark.createDataFrame(names, "identity string, name string, chat_id long"), spark.createDataFrame(claims, "claim_id long, owner string, alias string, chat_id long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alias_identity_join(spark, seed):
    names, claims, n, c = made(spark, seed)
    want = {}
    for claim, owner, alias, chat in claims:
        found = {i for i, name, where in names if i and name and name in (owner, alias) and where is not None and where == chat}
        want[claim] = (len(found), min(found) if len(found) == 1 else None, ("none", "unique")[len(found)] if len(found) < 2 else "ambiguous")
    out = E.alias_identity_join(c, n).collect()
    assert len(out) == len(claims) and {r.claim_id: (r.identities, r.identity, r.state) for r in out} == want
    assert {s for _, _, s in want.values()} == {"none", "unique", "ambiguous"}


def test_claims_meet_no_identities(spark):
    """Two thousand claims on two common names: no operator makes a row for each claim and identity."""
    names = spark.range(2000).selectExpr("concat('i', id) AS identity", "if(id % 2 = 0, 'a', 'b') AS name", "0L AS chat_id")
    claims = spark.range(2000).selectExpr("id AS claim_id", "'a' AS owner", "'b' AS alias", "0L AS chat_id")
    out = E.alias_identity_join(claims, names)
    assert {(r.identities, r.identity, r.state) for r in out.collect()} == {(2000, None, "ambiguous")}
    rows, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []
        todo += [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
        metric = node.metrics().get("numOutputRows")
        rows += [metric.get().value()] if metric.isDefined() else []
    assert max(rows) <= 4000
