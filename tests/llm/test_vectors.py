"""Nearest neighbours against brute force."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest import DATA  # noqa: E402

from chatspark.llm import vector_tree  # noqa: E402
from chatspark.llm.queries import QUERIES  # noqa: E402


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def expected(rows, k=20, every=20):
    """[(query_id, rank, vec_id, score)] by brute force; sums in doubles."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and usable(v)]
    if not rows:
        return []
    sizes = [len(v) for _, v in rows]
    usual = max(sorted(set(sizes)), key=sizes.count)
    rows = [(i, v) for i, v in rows if len(v) == usual]
    x = np.stack([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = []
    for a, (i, v) in enumerate(rows):
        if i % every == 0:
            score = np.round(x @ v, 9)
            order = [b for b in np.lexsort((ids, -score)) if b != a][:k]
            out += [(i, r + 1, int(ids[b]), float(score[b])) for r, b in enumerate(order)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def table():
    rng = random.Random(8)
    rows = [(0, None), (20, [0.0, 0.0, 0.0]), (40, [1.0, None, 2.0]), (60, [float("nan"), 1.0, 1.0]), (80, [float("inf"), 1.0, 1.0]), (100, []), (120, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(i, [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(3)]) for i in range(130, 700)]
    rows += [(i, [0.5, -0.0, 1.5]) for i in range(700, 1000)] + [(740, [0.5, 0.0, 1.5]), (760, [9.0, 9.0, 9.0]), (760, [9.0, 9.0, 9.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", None) for i, v in rows], "vec_id long, embedding array<float>, row long, key string, score double")


def test_exact(spark, monkeypatch):
    """All leaves: the rows of brute force, with ties, copies, norms of all sizes and vectors that take no part."""
    monkeypatch.setattr(vector_tree, "CELL_ROWS", 30)
    monkeypatch.setattr(vector_tree, "QUERY_ROWS", 4)
    monkeypatch.setattr(vector_tree, "LEAF", 8)
    rows = table()
    assert got(vector_tree.vector_search(frame(spark, rows), recall=1)) == expected(rows)


def test_few_and_none(spark):
    rows = [(20, [1.0, 2.0]), (21, [2.0, 1.0]), (40, [3.0, 3.0])]
    assert got(vector_tree.vector_search(frame(spark, rows))) == expected(rows)
    assert got(vector_tree.vector_search(frame(spark, [(20, [1.0])]))) == []
    assert got(vector_tree.vector_search(frame(spark, [(1, [1.0]), (2, [3.0])]))) == []
    assert got(vector_tree.vector_search(frame(spark, []))) == []


def test_recall(spark):
    """The query's rows: right scores, gapless ranks, and nine tenths of the true neighbours at least."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    out, want = got(QUERIES["op12_nearest_neighbours"](spark, DATA)), expected(rows)
    assert [(q, r) for q, r, _, _ in out] == [(q, r) for q, r, _, _ in want]
    vector = {i: np.array(v, float) for i, v in rows}
    assert all(abs(float(vector[q] @ vector[i]) - s) < 1e-9 for q, _, i, s in out)
    assert len({(q, i) for q, _, i, _ in out} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


@pytest.mark.parametrize("most", [1, 5, 10**6])
def test_walk(most):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6))
    tree = vector_tree.Tree(x)
    leaf = tree.descend(x)
    assert leaf.max() < tree.leaves and len(np.unique(leaf)) > 20
    walk = tree.visits(x[5], most)
    assert len(walk) == min(most, tree.leaves) == len(set(walk))
