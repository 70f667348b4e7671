"""Streams whose rows come late or again, against the batch rules."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from chatspark.streaming import jobs as J

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
GAP = 120


def event(i, user, second, own):
    return (i, START + timedelta(seconds=second), user, "purchase" if own else "click", 1.0, "")


def streamed(spark, base, batches, lateness):
    """The stream's rows, each batch one file."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, J.EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/in")
    out = J.run_available(J.burst_stream(J.read_events(spark, f"{base}/in", 1), GAP, lateness), f"{base}/run")
    epoch = int(START.timestamp())
    return sorted((r.user_id, r.start_ts - epoch, r.end_ts - epoch, r.n) for r in out.collect())


def bursts(rows, until):
    """Bursts of the rows before `until` seconds, without those that could still go on."""
    out = []
    for user in {r[2] for r in rows}:
        own = sorted((int((r[1] - START).total_seconds()), r[0], r[3] == "purchase") for r in rows if r[2] == user)
        start = last = n = 0
        for ts, _, mine in own:
            if ts >= until:
                break
            if n and (not mine or ts - last > GAP):
                out.append((user, start, last, n))
                n = 0
            if mine:
                start, last, n = (start, ts, n + 1) if n else (ts, ts, 1)
        if n and last + GAP < until:
            out.append((user, start, last, n))
    return sorted(out)


def test_late_message_parts_a_burst(spark, tmp_path):
    """Own messages at 0 and 100 s, and another's at 50 s that comes a batch later, are two bursts."""
    rows = [[event(1, 7, 0, True), event(2, 7, 100, True)], [event(3, 7, 50, False)], [event(4, 8, 100_000, True)]]
    assert streamed(spark, tmp_path, rows, "10 minutes") == [(7, 0, 0, 1), (7, 100, 100, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches(spark, tmp_path, seed):
    """Rows up to an hour out of order, over four batches."""
    rng = random.Random(seed)
    rows = [event(i, rng.randrange(4), rng.randrange(20_000), rng.random() < 0.7) for i in range(400)]
    order = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(3600)))
    newest = max(int((r[1] - START).total_seconds()) for r in rows)
    got = streamed(spark, tmp_path, [order[i : i + 100] for i in range(0, 400, 100)], "1 hour")
    assert got == bursts(rows, newest - 3600) and len(got) > 40


def test_final_records(spark, tmp_path):
    """Versions are replaced, a repeated batch changes nothing, and files don't pile up with the batches."""
    rng, path = random.Random(3), str(tmp_path / "bank")
    schema = "case_id long, line_no long, status string"
    sink, want, sizes = J.final_records_sink(path, 4), {}, []
    for epoch in range(8):
        rows = [(rng.randrange(30), epoch * 100 + i, f"s{rng.randrange(9)}") for i in range(40 if epoch != 5 else 0)]
        want |= {c: (n, s) for c, n, s in rows}
        batch = spark.createDataFrame(rows, schema)
        for _ in range(2 if epoch in (3, 7) else 1):
            sink(batch, epoch)
        got = {r.case_id: (r.line_no, r.status) for r in J.current_records(spark, path, batch.schema).collect()}
        assert got == want
        sizes.append(sum(p.stat().st_size for p in (tmp_path / "bank" / "data").rglob("*.parquet")))
    assert max(sizes[4:]) <= 1.5 * max(sizes[:4]) and len(list((tmp_path / "bank" / "manifest").iterdir())) <= 2


def test_no_records(spark, tmp_path):
    empty = spark.createDataFrame([], "case_id long, line_no long, status string")
    assert J.current_records(spark, str(tmp_path / "none"), empty.schema).collect() == []
    J.final_records_sink(str(tmp_path / "none"))(empty, 0)
    assert J.current_records(spark, str(tmp_path / "none"), empty.schema).collect() == []


def test_conflicts_tell_nulls_apart(spark):
    """(null, 1) and (1, null) under one key are a conflict; equal rows with nulls aren't."""
    from chatspark.operators import bank

    columns = [*bank.KEY, "a", "b", "round_fp", "case_id", "side_fp"]
    columns = list(dict.fromkeys(columns))
    frame = lambda rows: spark.createDataFrame([tuple({**dict.fromkeys(columns, f"k{k}"), "a": a, "b": b}[c] for c in columns) for k, a, b in rows], ", ".join(f"{c} {'int' if c in 'ab' else 'string'}" for c in columns))
    insert, conflicts = bank.bank_upsert(frame([(1, None, 1), (2, None, None), (3, 4, None)]), frame([(1, 1, None), (2, None, None), (3, 4, None), (4, None, 2)]), ["a", "b"])
    assert [r[bank.KEY[0]] for r in conflicts.collect()] == ["k1"] and [r[bank.KEY[0]] for r in insert.collect()] == ["k4"]
