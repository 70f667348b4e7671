"""Sentences with a match: the quick rule against difflib, and blocks against all pairs."""

import random

import pytest
from test_patterns import mixed

from chatspark.operators import patterns as P


def test_pair_match_equals_difflib():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd天😀") for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    text = lambda: mixed(rng, base) if rng.random() < 0.7 else "".join(rng.choices("ab", k=rng.randrange(0, 18)))
    seen = set()
    for _ in range(6000):
        x, y = text(), text()
        want = P.block_match(x, y)
        assert P.pair_match([x[i : i + 2] for i in range(len(x) - 1)], len(x), P._places(y), len(y)) == want
        seen.add(want)
    assert seen == {True, False}


@pytest.mark.parametrize("rows,asks", [(4, 3), (1024, 512)])
def test_matched(spark, monkeypatch, rows, asks):
    """Chats of one block and of many rounds of blocks."""
    monkeypatch.setattr(P, "BLOCK_ROWS", rows)
    monkeypatch.setattr(P, "ASKS", asks)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh天😀") for _ in range(rng.randrange(6, 25))) for _ in range(25)]
    left, right = ([(rng.choice([None, "a", "a|b", "c"]), mixed(rng, base)) for _ in range(n)] for n in (80, 70))
    right = [r for r in right if r[0] != "c"] + [("c", "abcdefghijkl"), ("c", "short")]
    want = {(c, s) for c, s in left if c and any(c == d and P.block_match(s, t) for d, t in right)}
    out = P.matched(spark.createDataFrame(left, "chat_id string, s string"), spark.createDataFrame(right, "chat_id string, t string")).collect()
    assert len(out) == len(want) > 5 and {(r.chat_id, r.s) for r in out} == want


def test_few_are_compared(monkeypatch):
    """A sentence leaves with its first match, of a thousand that match."""
    calls, rule = [], P.pair_match
    monkeypatch.setattr(P, "pair_match", lambda *a: calls.append(1) or rule(*a))
    rng = random.Random(9)
    block = P._Block(["over the hills " + "".join(rng.choices("xyz", k=6)) + " and far away" for _ in range(1000)])
    assert block.matches("over the hills and far away") and len(calls) == 1
