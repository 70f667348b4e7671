"""Recall in full against loops over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chatspark.operators import pruned, recall

WORDS = [f"w{i}" for i in range(40)]


def bag(rows):
    return {key: {t: terms.count(t) for t in terms} for key, terms in rows}


@pytest.mark.parametrize("descending,block_rows", [(False, 8), (True, 3), (False, 512)])
def test_pruned_topk(spark, monkeypatch, descending, block_rows):
    """Random postings with many ties: the rows of a full ranking, whatever is pruned."""
    monkeypatch.setattr(pruned, "BLOCK_ROWS", block_rows)
    rng = random.Random(block_rows)
    pool = [(i, [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 20, 60]))]) for i in range(400)]
    asked = [(c, [rng.choice(WORDS + ["unknown"]) for _ in range(rng.randrange(1, 15))]) for c in range(25)] + [(99, ["unknown"])]
    static = {i: rng.choice([0.0, 0.5, 1.0]) for i, _ in pool}
    frame = lambda rows, key: spark.createDataFrame([(k, t, n) for k, b in bag(rows).items() for t, n in b.items()], f"{key} long, term string, n long")
    out = pruned.pruned_topk(frame(asked, "case_id"), frame(pool, "id"), spark.createDataFrame(list(static.items()), "id long, static double"), 5, 2.0, descending)
    want, bags = [], bag(pool)
    for case, own in bag(asked).items():
        both = {i: sum(min(n, b.get(t, 0)) for t, n in own.items()) for i, b in bags.items()}
        order = sorted((-(2.0 * o + static[i]), -i if descending else i, i, o) for i, o in both.items() if o)
        want += [(case, i, o, -s, r) for r, (s, _, i, o) in enumerate(order[:5])]
    assert sorted((r.case_id, r.id, r.overlap, r.score, r["rank"]) for r in out.collect()) == sorted(want)


def test_pruning_reads_less(spark, monkeypatch):
    """Blocks of short rows can't reach a long row's score: their bound keeps them out."""
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 16)
    pool = [(i, WORDS[:3] if i < 900 else WORDS) for i in range(1000)]
    rows = [(k, t, n) for k, b in bag(pool).items() for t, n in b.items()]
    queries = spark.createDataFrame([(1, t, 1) for t in WORDS], "case_id long, term string, n long")
    asked, bags = pruned.term_ids(queries, spark.createDataFrame(rows, "id long, term string, n long"))
    held = pruned.size_blocks(bags.withColumn("static", F.lit(0.0)))
    bounds = pruned.block_bounds(asked, held, 1.0).collect()
    assert sum(r.bound >= len(WORDS) for r in bounds) <= 100 // 16 + 2 and len(bounds) >= 1000 // 16


def said(lines):
    return [x.strip() for x in lines or [] if x.strip()]


def concrete(context):
    text = "".join(said(context))
    return len(said(context)) > 1 or len(re.sub(r"\s+", "", text)) > 10 or bool(re.search(r"\d|[a-zA-Z]{2,}", text))


def bound(reply):
    return any(len(re.sub("[^0-9a-z一-鿿]+", "", r.lower())) > 5 or bool(re.search(r"\d|[a-zA-Z]{2,}", r)) for r in said(reply))


def fits(reply):
    return bool(said(reply)) and all(re.fullmatch(f"(?:{recall.PORTABLE})", re.sub(r"[\s，,。.!！?？~～…]+", "", r.lower())) for r in said(reply))


def test_sparse_rules(spark):
    rng = random.Random(2)
    parts = ["怎么了　", "　", "在 呢", "٣", "真的假的", "哈哈哈哈哈哈哈", "你 呢？", "在", "可怕!!", "", " ", "ab", "x", "7", "很长的一句话没有什么意义", "hhhh", "好吧～", "惨", "没问题啊"]
    rows = [(i, [rng.choice(parts) for _ in range(rng.randrange(0, 3))] if i else None, [rng.choice(parts) for _ in range(rng.randrange(0, 3))] if i != 1 else None) for i in range(300)]
    out = recall.sparse_marks(spark.createDataFrame(rows, "id long, context array<string>, reply array<string>")).collect()
    want = {i: (not concrete(c), not concrete(c) and not bound(r) and fits(r)) for i, c, r in rows}
    assert {r.id: (r.bare, r.portable) for r in out} == want and sum(p for _, p in want.values()) > 10
    texts = ["在吗", "", "啊", "为什么", "abcde", "a1 b2", "？", "嗯嗯嗯嗯嗯", "什么啊", "好 的!"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", recall.sparse_turn(F.col("t")).alias("s")).collect()
    size = lambda t: len(re.sub("[^0-9a-z一-鿿]+", "", t.lower()))
    assert {r.t: r.s for r in got} == {t: 0 < size(t) <= 4 and not re.search(recall.ASKING, t) for t in texts}


def made(rng, ids, case):
    pick = lambda *x: rng.choice(x)
    out = []
    for i in ids:
        row = {
            "is_group": pick(True, False), "chat_id": rng.randrange(6), "relationship": pick("friend", "kin", None, ""), "situations": rng.sample(["a", "b", "c", "d"], pick(0, 0, 1, 2)), "precise": pick("p", "q", None, None, None, ""),
            "praise_target": pick("x", "y", None), "speaker_posture": pick("x", None, ""), "expected_move": pick("m", "n", None), "form": pick("f", "g", None, ""), "participants": pick([True, False, True, True, False], [rng.random() < 0.5 for _ in range(5)], None),
            "chars": rng.randrange(200), "several": pick(True, False), "terms": [rng.choice(WORDS[:15]) for _ in range(pick(0, 3, 8))],
        }
        if case:
            row |= {"case_id": i, "cutoff": rng.randrange(1200), "sparse": pick(True, False, False), "brief": pick(True, False), "excluded_chats": pick(None, [1], [2, 3], [0, 1, 2, 3, 4, 5]), "excluded_ids": pick(None, [], rng.sample(range(300), 20))}
        else:
            row |= {"id": i, "ended": pick(rng.randrange(1000), 500), "bare": pick(True, False)}
            row["portable"] = row["bare"] and pick(True, False, False)
        out.append(row)
    return out


def decide(case, pool, limit):
    """(tier, topped, candidates) of a case."""
    free = [r for r in pool if r["is_group"] == case["is_group"] and r["ended"] < case["cutoff"] and r["chat_id"] not in (case["excluded_chats"] or []) and r["id"] not in (case["excluded_ids"] or [])]
    if not free:
        return None
    precise = [r for r in free if case["precise"] and r["precise"] == case["precise"]]
    shared = [r for r in free if set(r["situations"]) & set(case["situations"])]
    tier, rows = ("precise", precise) if precise else ("situation", shared) if shared else ("all", free)
    topped = False
    if case["sparse"]:
        fit = "bare" if case["brief"] else "portable"
        rows = [r for r in rows if r[fit]]
        if not case["brief"] and len(rows) < limit and tier != "all":
            topped, rows = True, rows + [r for r in free if r["portable"] and r not in rows]
    return tier, topped, rows


def compatible(case, row):
    return sum((w if case[n] == row[n] else -w) for n, w in recall.PROFILE.items() if case[n] and row[n])


def points(case, row, p):
    overlap = sum(min(case["terms"].count(t), row["terms"].count(t)) for t in set(case["terms"]))
    lexical, length = overlap / max(1, len(case["terms"])), 1 / (1 + abs(case["chars"] - row["chars"]) / 20)
    shared = set(case["situations"]) & set(row["situations"])
    chat, kin = row["chat_id"] == case["chat_id"], bool(case["relationship"]) and row["relationship"] == case["relationship"]
    if not p.situations:
        return 8 * lexical + length + 1.5 * chat + 2 * kin
    s = 1.5 * lexical + 0.5 * length + compatible(case, row) + (7 if shared else -3 if case["situations"] and row["situations"] else 0)
    if p.turn_form and not case["is_group"] and case["form"] and row["form"]:
        s += 4 if case["form"] == row["form"] else -1
    if p.participants and case["is_group"] and case["participants"] and row["participants"]:
        s += sum(1.5 if a == b else -1.5 for a, b in zip(case["participants"], row["participants"]))
    return s + (2.5 if shared else 0.5) * chat + 0.5 * kin + (p.several_messages and case["several"] and row["several"])


def expected(cases, pool, limit, p):
    out = []
    for case in cases:
        found = decide(case, pool, limit)
        if not found:
            continue
        tier, topped, rows = found
        best = max([compatible(case, r) for r in rows], default=0)
        keyed = []
        for r in rows:
            move = 1 if not case["expected_move"] or not r["expected_move"] else 0 if case["expected_move"] == r["expected_move"] else 2
            near = r["chat_id"] == case["chat_id"] and (set(case["situations"]) & set(r["situations"]) or case["precise"] and case["precise"] == r["precise"])
            ahead = bool(near) and ((p.same_chat_after_situation and compatible(case, r) >= best) or (p.same_chat_after_move and bool(case["expected_move"]) and move == 0))
            keyed.append((move if p.move_first else 0, not ahead, -round(points(case, r, p), 6), r["id"]))
        out += [(case["case_id"], i, tier, topped, -s, at) for at, (_, _, s, i) in enumerate(sorted(keyed)[:limit])]
    return sorted(out)


CASE = "case_id long, is_group boolean, cutoff long, chat_id long, relationship string, situations array<string>, precise string, praise_target string, speaker_posture string, expected_move string, form string, participants array<boolean>, chars long, several boolean, sparse boolean, brief boolean, excluded_chats array<long>, excluded_ids array<long>, terms array<string>"
ROW = "id long, is_group boolean, ended long, chat_id long, relationship string, situations array<string>, precise string, praise_target string, speaker_posture string, expected_move string, form string, participants array<boolean>, chars long, several boolean, bare boolean, portable boolean, terms array<string>"
ALL = recall.Policy(move_first=True, same_chat_after_situation=True, same_chat_after_move=True)


@pytest.mark.parametrize("policy,limit", [(recall.Policy(), 6), (ALL, 12), (recall.Policy(situations=False, same_chat_after_move=True), 5), (recall.Policy(False, False, False, False, True), 40)])
def test_recall(spark, monkeypatch, policy, limit):
    monkeypatch.setattr(recall, "BLOCK_ROWS", 40)
    rng = random.Random(limit)
    pool, cases = made(rng, range(300), False), made(rng, range(60), True)
    frames = [spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in s.split(", ")) for r in rows], s) for rows, s in ((cases, CASE), (pool, ROW))]
    out = recall.recall(*frames, limit, policy).collect()
    got = sorted((r.case_id, r.id, r.tier, r.topped, round(r.score, 6), r["rank"]) for r in out)
    want = expected(cases, pool, limit, policy)
    assert [x[:4] + x[5:] for x in got] == [x[:4] + x[5:] for x in want]
    assert all(abs(a[4] - b[4]) < 1e-5 for a, b in zip(got, want))
    counts = {r.case_id: (r.tier, r.topped, r.n) for r in recall.bucket_counts(*frames, limit).collect()}
    assert counts == {c["case_id"]: (f[0], f[1], len(f[2])) for c in cases for f in [decide(c, pool, limit) or ("all", False, [])]}
    assert {t for t, _, _ in counts.values()} == set(recall.TIERS) and any(t for _, t, _ in counts.values())


def test_empty(spark):
    empty = [spark.createDataFrame([], s) for s in (CASE, ROW)]
    assert recall.recall(*empty, 5).collect() == []
