"""Feature differences of preference pairs against loops, and what the pairwise model keeps."""

import random
from collections import Counter

import pytest

from chatspark.operators import ranking as K


def test_pair_differences(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(8)]), rng.randrange(5), rng.choice([None, 0, 1, 2]), rng.randrange(4) / 2) for _ in range(60)] + [(99, 1, 1, 0.0)]
    want = Counter()
    for t in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == t and r[2] is not None]
        pairs = [a[3] - b[3] for a in own for b in own if a[2] > b[2]]
        want.update((round(1 / len(pairs), 9), x) for x in pairs)
    out = K.pair_differences(spark.createDataFrame(rows, "target_id long, id long, grade int, f double"), ["f"])
    assert Counter((r.weight, r.f) for r in out.collect()) == want


def test_fit_keeps_distinct_differences(spark, monkeypatch):
    """Equal differences reach the fit as one row each way, with the same coefficients as their copies."""
    from pyspark.ml.classification import LogisticRegression

    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    rows = [(0.25, 1.0 + i % 3, -0.5 * (i % 2)) for i in range(6000)]
    many = K.pairwise_lr(spark.createDataFrame(rows, "weight double, good double, bad double"), ["good", "bad"])
    few = K.pairwise_lr(spark.createDataFrame([(250.0, g, b) for _, g, b in rows[:6]], "weight double, good double, bad double"), ["good", "bad"])
    assert seen == [12, 12] and many == pytest.approx(few, abs=1e-9)
