"""Scans by ranges, the sweep over windows and the as-of join against loops."""

import random

import pytest
from pyspark.sql import functions as F

from chatspark.operators import eligibility, timing
from chatspark.operators.scan import running


def test_running(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i, rng.choice([None, rng.randrange(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t long, i long, v long")
    out = running(df, {"total": (F.sum, "v"), "most": (F.max, "v"), "least": (F.min, "v")}, ["t", "i"], ["g"]).collect()
    assert len(out) == len(rows)
    for r in out:
        before = [v for g, t, i, v in rows if g == r.g and (t, i) < (r.t, r.i) and v is not None]
        assert (r.total, r.most, r.least) == ((sum(before), max(before), min(before)) if before else (None,) * 3)


def test_window_assign(spark):
    """Overlapping, nested and touching windows; events on their edges, and without a time."""
    rng = random.Random(2)
    windows = [(i, s, s + rng.choice([0, 1, 5, 60])) for i in range(1, 40) for s in [rng.randrange(300)]]
    events = [(i, rng.randrange(-5, 400) if i % 17 else None, "x") for i in range(500)]
    out = timing.window_assign(spark.createDataFrame(events, "event_id long, ts long, stage string"), spark.createDataFrame(windows, "window_id long, start_ts long, end_ts long")).collect()
    for r in out:
        held = [i for i, s, e in windows if r.ts is not None and s <= r.ts <= e]
        assert (r.matches, r.window_id) == (len(held), held[0] if len(held) == 1 else None)
    assert len(out) == 500 and any(r.window_id for r in out)
    assert timing.window_assign(spark.createDataFrame([], "event_id long, ts long"), spark.createDataFrame([], "window_id long, start_ts long, end_ts long")).collect() == []


def test_active_time(spark):
    """One worker has nearly all windows; one long window covers many."""
    rng = random.Random(3)
    windows = [(0 if i % 10 else i % 3, s, s + rng.choice([1, 2, 30])) for i in range(300) for s in [rng.randrange(2000)]] + [(0, 500, 900)]
    out = {r.w: (r.span, r.active, r.uncovered, r.overlapping) for r in timing.active_time(spark.createDataFrame(windows, "w long, start_ts long, end_ts long"), ["w"]).collect()}
    for w in {w for w, _, _ in windows}:
        own = [(s, e) for x, s, e in windows if x == w]
        covered = len({t for s, e in own for t in range(s, e)})
        span = max(e for _, e in own) - min(s for s, _ in own)
        assert out[w] == (span, covered, span - covered, sum(e - s for s, e in own) - covered)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_latest_eligible(spark, k):
    """Most rows are barred for some cases, so ranks are widened over several rounds; equal seconds aren't earlier."""
    rng = random.Random(k)
    pool = [(i, rng.randrange(2), rng.randrange(6), rng.randrange(60), [i, 1000 + i]) for i in range(300)]
    cases = [(i, rng.randrange(2), rng.randrange(70), rng.sample(range(300), rng.choice([0, 40])), rng.choice([[], [1], [0, 1, 2, 3, 4], None])) for i in range(40)]
    p = spark.createDataFrame(pool, "example_id long, key int, chat_id int, end_ts long, ids array<long>")
    c = spark.createDataFrame(cases, "case_id long, key int, cutoff_ts long, reply_ids array<long>, excluded array<int>")
    out = eligibility.latest_eligible(c, p, ["key"], k, first=1).collect()
    want = []
    for case, key, cutoff, reply, excluded in cases:
        good = sorted(((t, i) for i, y, chat, t, ids in pool if y == key and t < cutoff and chat not in (excluded or []) and not set(ids) & set(reply)), reverse=True)
        want += [(case, i, t, cutoff, r) for r, (t, i) in enumerate(good[:k])]
    assert sorted((r.case_id, r.example_id, r.end_ts, r.cutoff_ts, r["rank"]) for r in out) == sorted(want)
