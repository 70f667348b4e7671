"""Spelling variants against brute force."""

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from brute import UPPER  # noqa: E402
from conftest import DATA  # noqa: E402

from chatspark.llm import spelling  # noqa: E402
from chatspark.llm.queries import QUERIES  # noqa: E402

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(word, words):
    """Words of the set at one edit, by making every edit."""
    letters = sorted(set("".join(words)))
    made = {word[:i] + word[i + 1 :] for i in range(len(word))}
    made |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    made |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (made & words) - {word}


def expected(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    met = {w: near(w, set(n)) for w in n}
    best = {w: min(m, key=lambda x: (-n[x], x)) for w, m in met.items() if m}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, len(met[w]), n.get(form.get(w))) for w, c in n.items())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def order(rows):
    return sorted(rows, key=str)


def texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgéßÿ") for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 300, "x" * 301, "Überfall", "überfall", "l×÷end"]
    for w in base[:60]:
        i = rng.randrange(len(w))
        base += [w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :]]
    out = [None, "", " ,;", "one"]
    for _ in range(150):
        out.append(rng.choice([" ", "-", "7", "\n"]).join(rng.choice(base) if rng.random() < 0.7 else base[int(rng.random() ** 3 * 40)] for _ in range(60)))
    out += [" ".join(["chainone"] * 3 + ["chainonex"] * 8 + ["chainonexy"] * 20 + ["chainonexyz"] * 60)]
    return [(None if i == 9 else i % 140, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return texts()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1, "k") for d, t in rows], "doc_id long, text string, word string, n long, key string")


def test_brute_force(spark, rows):
    out = got(spelling.spelling_groups(frame(spark, rows)).na.fill("", ["form"]).na.fill(0, ["form_n"]))
    want = sorted((w, f or "", r, c, m, k or 0) for w, f, r, c, m, k in expected(rows))
    assert out == want and sum(bool(x[1]) for x in want) > 30 and any(x[2] != x[1] for x in want if x[1])


def test_tiles(spark, rows, monkeypatch):
    """Blocks that are larger than a tile meet in pairs of tiles."""
    monkeypatch.setattr(spelling, "TILE", 4)
    test_brute_force(spark, rows)


def test_empty(spark):
    assert got(spelling.spelling_groups(frame(spark, []))) == []
    assert got(spelling.spelling_groups(frame(spark, [(1, None), (2, "short words once")]))) == []


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    out = QUERIES["op13_spelling_variants"](spark, DATA)
    assert order(tuple(r[c] for c in COLUMNS) for r in out.collect()) == order(expected(docs))
