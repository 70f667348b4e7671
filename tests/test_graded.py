"""Graded report and penalty choice against plain Python; quotas that can't be filled; journals in byte ranges."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatspark.operators import graded, roles, splits
from chatspark.sources import io


def test_graded_report(spark):
    rng = random.Random(1)
    rows = [(t, i, float(rng.randrange(4)), rng.randrange(4)) for t in range(60) for i in range(rng.randrange(1, 7))]
    out = {(r.measure, r.key): (r.n, r.value) for r in graded.graded_report(spark.createDataFrame(rows, "target_id long, id long, score double, grade long")).collect()}
    groups = defaultdict(list)
    for t, _, s, g in rows:
        groups[t].append((s, g))
    ranks, every, positive, at = defaultdict(list), [], [], defaultdict(list)
    for own in groups.values():
        for s, g in own:
            ranks[g].append(1 + sum(x > s for x, _ in own) + (sum(x == s for x, _ in own) - 1) / 2)
        for low, into in ((-1, every), (0, positive)):
            won = [(s > x) + (s == x) / 2 for s, g in own for x, h in own if g > h > low]
            if won:
                into.append(sum(won) / len(won))
        for k in (1, 3, 5):
            orders = [0.0, 0.0]
            for s in sorted({s for s, _ in own}, reverse=True):
                tie = [g for x, g in own if x == s]
                take = min(len(tie), max(0, k - sum(x > s for x, _ in own)))
                orders = [orders[0] + take * sum(tie) / len(tie), orders[1] + take]
            at[k].append(orders[0] / orders[1])
    want = {("mean_rank", str(g)): (len(x), np.mean(x)) for g, x in ranks.items()} | {("ordered_pairs", ""): (len(every), np.mean(every)), ("positive_pairs", ""): (len(positive), np.mean(positive))}
    want |= {("grade_at", str(k)): (len(x), np.mean(x)) for k, x in at.items()}
    assert {k: v[0] for k, v in out.items() if k[0] == "candidates"} == {("candidates", str(n)): c for n, c in Counter(map(len, groups.values())).items()}
    assert {k: v[0] for k, v in out.items() if k[0] == "positives"} == {("positives", str(n)): c for n, c in Counter(sum(g > 0 for _, g in x) for x in groups.values()).items()}
    for key, (n, v) in want.items():
        assert out[key][0] == n and abs(out[key][1] - v) < 1e-5, key


def newton(x, w, c):
    """Weights that minimise c * sum(w * log(1 + exp(-x b))) + |b|^2 / 2."""
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(x @ b))
        b -= np.linalg.solve(c * (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(b)), b - c * x.T @ (w * p))
    return b


@pytest.mark.parametrize("noise", [0.2, 6.0])
def test_penalty_with_the_least_later_loss(spark, noise):
    rng = np.random.default_rng(int(noise))
    rows, targets, materials = [], [], []
    for t in range(120):
        targets.append((t, t * 10, [1000 + t]))
        materials.append((t, t * 10 + (200 if t in (90, 91) else 0), [5, 1000 + (118 if t == 7 else 500)]))
        for i in range(3):
            x = rng.normal(size=2)
            rows.append((t, i, int(np.clip(round(1.5 + x[0] - 0.5 * x[1] + noise * rng.normal()), 0, 3)), float(x[0]), float(x[1])))
    frames = spark.createDataFrame(targets, "target_id long, cutoff_ts long, answer_ids array<long>"), spark.createDataFrame(materials, "target_id long, end_ts long, message_ids array<long>"), spark.createDataFrame(rows, "target_id long, id long, grade int, f1 double, f2 double")
    weights, trials = graded.tuned_pairwise(*frames, ["f1", "f2"])
    boundary = sorted(c for _, c, _ in targets)[96]
    late = {t for t, c, _ in targets if c >= boundary}
    fit = {t for t, c, _ in targets} - late - {90, 91, 7}

    def pairs(which):
        x, w = [], []
        for t in which:
            own = [r for r in rows if r[0] == t]
            mine = [(a[3] - b[3], a[4] - b[4]) for a in own for b in own if a[2] > b[2]]
            x += mine
            w += [1 / max(1, len(mine))] * len(mine)
        return np.array(x), np.array(w)

    (x, w), (y, v) = pairs(sorted(fit)), pairs(sorted(late))
    losses = [(c, float(np.sum(v * np.logaddexp(0, -(y @ newton(x, w, c)))) / v.sum())) for c in graded.GRID]
    for (c, a), (d, b) in zip(trials, losses):
        assert c == d and abs(a - b) < 1e-4
    best = min(losses, key=lambda t: (t[1], t[0]))[0]
    assert np.allclose(list(weights.values()), newton(*pairs(range(120)), best), atol=1e-3)


def test_quota_shortage_is_an_error(spark):
    rows = spark.createDataFrame([(f"e{i}", i // 2, "group" if i % 8 else "private", [i]) for i in range(40)], "id string, chat_id long, chat_type string, ids array<long>")
    assert splits.checked_quota(rows, 8, 0.75, 2, 1).count() == 8
    with pytest.raises(ValueError, match="private: 5 of 10"):
        splits.checked_quota(rows, 20, 0.5, 2, 1)


def test_ranks_by_ranges(spark):
    """Test sets and batches are those of one ranking of each kind."""
    import hashlib

    h = lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest()
    rows = [(i, i % 30, "group" if i % 30 < 20 else "private") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, chat_id long, chat_type string")
    capped = [r for c in range(30) for r in sorted((r for r in rows if r[1] == c), key=lambda r: (h(r[0]), r[0]))[:4]]
    kinds = {k: sorted((r for r in capped if r[2] == k), key=lambda r: (h(r[0]), r[0]))[:q] for k, q in (("group", 25), ("private", 12))}
    want = sorted((at, k, r[0]) for k, x in kinds.items() for at, r in enumerate(x))
    assert [r.id for r in roles.take_testset(df, 25, 12, 4).orderBy("place").collect()] == [i for _, _, i in want]
    base, batches = 0, {}
    for k in ("group", "private"):
        own = sorted((r for r in rows if r[2] == k), key=lambda r: (h(r[0]), r[0]))
        batches |= {r[0]: (base + at) % 7 for at, r in enumerate(own)}
        base += len(own)
    assert {r.id: r.batch for r in splits.seal_batches(df, 7, ["chat_type"]).collect()} == batches


def test_journal_in_byte_ranges(spark, tmp_path):
    """A journal that many tasks read: line numbers as in the whole file, damage in the middle reported, an unfinished tail left out."""
    lines = [json.dumps({"case_id": f"c{i}", "pad": "é" * (i % 50)}, ensure_ascii=False) if i % 7 else "" for i in range(4000)]
    lines[1234] = '{"case_id": "bro'
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + '\n{"case_id": "tail', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"case_id": "whole"}\n', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        text = io.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r.file.rpartition("/")[2], r.line_no): r.line for r in text.collect()}
        rows, damage = io.read_journal(spark, str(tmp_path), "case_id string")
        read = sorted((r.line_no, r.case_id) for r in rows.collect() if r.case_id != "whole")
        bad = [r.line_no for r in damage.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {("a.jsonl", i + 1): x for i, x in enumerate([*lines, '{"case_id": "tail'])} | {("b.jsonl", 1): '{"case_id": "whole"}'}
    assert read == [(i + 1, f"c{i}") for i in range(4000) if i % 7 and i != 1234] and bad == [1235]
