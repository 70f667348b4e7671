"""Memory search against loops over all messages."""

import random
import re

import numpy as np
import pytest

from chatspark.operators import memory

MESSAGE = "id long, chat_id long, pos long, ts long, account long, sender string, text string, vector array<float>"
CASE = "case_id long, account long, cutoff long, excluded array<long>, blocked array<long>, query string, vector array<float>"


def made(rng, n=400):
    words = ["rain", "Sun", "wind", "sea", "stone", "sunny", "é", "x1"]
    vector = lambda: [round(rng.gauss(0, 1), 3) for _ in range(6)] if rng.random() < 0.9 else rng.choice([None, [0.0] * 6, [1.0]])
    rows = []
    for chat in range(8):
        ts = 0
        for pos in range(n // 8):
            ts += rng.choice([0, 30, 200, 700])
            rows.append((chat * 1000 + pos, chat, pos, ts, chat % 2, rng.choice(["Ann", "Bob", "stone"]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4))), vector()))
    cases = [(i, rng.randrange(2), rng.randrange(12000), rng.choice([None, [], [2, 3]]), rng.choice([None, rng.sample([r[0] for r in rows], min(30, len(rows)))]), rng.choice(["", "the Sun and rain", "stone, ann?", "nothing"]), vector()) for i in range(30)]
    return rows, cases


def unit(v):
    v = np.array(v if v is not None and len(v) == 6 else [0.0] * 6, np.float32).astype(float)
    return v / max(np.linalg.norm(v), 1e-12)


def routes(rows, case, k):
    case_id, account, cutoff, excluded, blocked, query, vector = case
    free = [r for r in rows if r[3] < cutoff and r[4] == account and r[1] not in (excluded or []) and r[0] not in (blocked or [])]
    terms = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    cosine = {r[0]: round(float(unit(r[7]) @ unit(vector)), 9) for r in free}
    hits = {r[0]: sum(t in f"{r[5]} {r[6]}".lower() for t in terms) for r in free}
    limit = max(20, 5 * k)
    dense = sorted((r for r in free if cosine[r[0]] >= 0.01), key=lambda r: (-cosine[r[0]], r[1], r[2]))[:limit]
    words = sorted((r for r in free if hits[r[0]]), key=lambda r: (-hits[r[0]], -r[3], r[1], r[2]))[:limit]
    return {r[0]: cosine[r[0]] for r in dense}, {r[0]: hits[r[0]] for r in words}


def expected(rows, cases, k):
    out, by_id = [], {r[0]: r for r in rows}
    place = {(r[1], r[2]): r for r in rows}
    for case in cases:
        dense, words = routes(rows, case, k)
        most = max(words.values(), default=1)
        score = {i: round((0.6 * dense.get(i, 0) + 0.4 * words.get(i, 0) / most) * (1.15 if i in dense and i in words else 1), 7) for i in {*dense, *words}}
        seen, n = set(), 0
        for i in sorted(score, key=lambda i: (-score[i], by_id[i][1], by_id[i][2])):
            chat, pos, ts = by_id[i][1:4]
            window = [r for p in range(pos - 2, pos + 3) if (r := place.get((chat, p))) and r[3] < case[2] and r[0] not in (case[4] or []) and abs(r[3] - ts) <= 600]
            ids = [r[0] for r in window]
            if n < k and not seen & set(ids):
                out.append((case[0], n, i, ids))
                seen |= set(ids)
                n += 1
    return out


@pytest.mark.parametrize("k,block", [(2, 7), (6, 4096)])
def test_exact(spark, monkeypatch, k, block):
    """Probing all cells: the rows of the loops, in blocks of any size."""
    monkeypatch.setattr(memory, "BLOCK_ROWS", block)
    rows, cases = made(random.Random(k))
    m, c = spark.createDataFrame(rows, MESSAGE), spark.createDataFrame(cases, CASE)
    out = memory.memory_search(c, m, k, cells=5, recall=1).collect()
    assert sorted((r.case_id, r.n, r.hit_id, r.messages) for r in out) == sorted(expected(rows, cases, k))


def test_probes(spark):
    """Fewer cells than all, nine tenths of the true neighbours; every row is in one block."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 8)) * 3
    pool = [(i, [float(x) for x in centre[i % 30] + rng.normal(size=8)]) for i in range(3000)]
    asked = [(i, pool[i * 7][1]) for i in range(200)]
    p, q = spark.createDataFrame(pool, "id long, vector array<float>"), spark.createDataFrame(asked, "case_id long, vector array<float>")
    exact = {(r.case_id, r.id) for r in memory.dense_route(q, p, 10).collect()}
    near = {(r.case_id, r.id) for r in memory.dense_route(q, p, 10, cells=30, recall=0.95).collect()}
    assert len(exact) == 2000 and len(exact & near) >= 0.9 * len(exact)
    x = np.stack([unit_any(v) for _, v in pool])
    for case, v in asked[:20]:
        score = np.round(x @ unit_any(v), 9)
        assert {i for c, i in exact if c == case} == set(np.lexsort((np.arange(len(x)), -score))[:10].tolist())
    cells = memory.Cells.fit(p, 30)
    from pyspark.sql import functions as F

    held, blocks = memory.inverted_file(p.withColumn("chat_id", F.lit(1).cast("long")), cells)
    tried = memory.calibrated_probes(q.select("case_id", F.lit(0).cast("long").alias("account"), F.lit(1).cast("long").alias("cutoff"), F.lit(None).cast("array<long>").alias("excluded"), F.lit(None).cast("array<long>").alias("blocked"), "vector"),
                                     held.withColumns({"pos": F.col("id"), "ts": F.lit(0).cast("long"), "account": F.lit(0).cast("long"), "hay": F.lit("")}), cells, blocks, 10, 0.95)
    assert held.count() == 3000 and 1 <= tried < cells.n


def unit_any(v):
    v = np.array(v, np.float32).astype(float)
    return v / np.linalg.norm(v)


def test_nothing(spark):
    empty = spark.createDataFrame([], MESSAGE), spark.createDataFrame([], CASE)
    assert memory.memory_search(empty[1], empty[0], 3).collect() == []
    rows, cases = made(random.Random(1), 16)
    assert memory.memory_search(spark.createDataFrame(cases, CASE), empty[0], 3).collect() == []
