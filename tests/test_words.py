"""Words contained in texts against Python's `in`, and first places against a whole sort."""

import random
import time

import numpy as np
import pytest

from chatspark.operators import memory as M


@pytest.mark.parametrize("remembered", [2, 4096])
def test_words_are_found_inside_others(monkeypatch, remembered):
    monkeypatch.setattr(M, "REMEMBERED", remembered)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ab_é天1", k=rng.randrange(1, 9)))
    texts = ["".join(word() + rng.choice([" ", "-", ", ", "　", "’", "\n", "^"]) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + ["", "x" * 50000]
    held = M._Words(texts)
    for term in [word() for _ in range(300)] * 2 + ["x", "xxxx", "x" * 50001, "q"]:
        assert held.holding(term).tolist() == [term in t for t in texts]


def test_first_places():
    rng = np.random.default_rng(3)
    for k in (1, 5, 25):
        keys = [rng.integers(0, n, 300) for n in (2, 4, 1000)]
        good = np.nonzero(rng.random(300) < 0.7)[0]
        order = lambda at: at[np.lexsort([x[at] for x in reversed(keys)])][:k].tolist()
        some = M._narrowed(good, keys, k)
        assert order(some) == order(good) and len(some) <= k + 2


def test_terms_do_not_scan_texts():
    """Three thousand different words over 8,192 texts of fifty words take seconds; scans of the texts took a minute."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randrange(4, 12))) for _ in range(20000)]
    held = M._Words([" ".join(rng.choices(vocabulary, k=50)) for _ in range(8192)])
    began = time.process_time()
    for term in vocabulary[:3000]:
        held.holding(term)
    assert time.process_time() - began < 10


def test_words_meet_full_blocks(spark, monkeypatch):
    """With sixteen cells a query meets one block for its words, not one for each cell."""
    met, asks = [], M._asks

    def counted(cases, cells, blocks, probes, keywords):
        out = asks(cases, cells, blocks, probes, keywords)
        met.extend([out.count()] if keywords else [])
        return out

    monkeypatch.setattr(M, "_asks", counted)
    rng = random.Random(5)
    rows = [(i, 0, i, i, 0, "a", f"word{i % 7}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    cases = [(i, 0, 500, [], [], f"word{i}", [1.0, 0.0, 0.0, 0.0]) for i in range(5)]
    out = M.search_routes(spark.createDataFrame(cases, "case_id long, account long, cutoff long, excluded array<long>, blocked array<long>, query string, vector array<float>"), spark.createDataFrame(rows, "id long, chat_id long, pos long, ts long, account long, sender string, text string, vector array<float>"), 1, cells=16, recall=0.9)
    words = [r for r in out.collect() if r.route == "keyword"]
    assert met == [5] and all(r.id % 7 == r.case_id and r.value == 1 for r in words) and len(words) == 100
