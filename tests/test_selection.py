"""The queries that choose step by step, against loops in plain Python over the same candidates."""

import math
from collections import defaultdict

from conftest import DATA
from pyspark.sql import functions as F

from chatspark.functions import situations as S
from chatspark.plans import QUERIES, features
from chatspark.plans import retrieval as P


def by_case(rows, *order):
    out = defaultdict(list)
    for r in rows:
        out[r.case_id].append(r)
    return {c: sorted(x, key=lambda r: [f(r) for f in order]) for c, x in out.items()}


def facts(spark):
    return P._with_facts(spark, DATA).collect()


def select(rows, k, budget):
    seen, used, taken, out = set(), 0, 0, []
    for r in rows:
        if r.content in seen:
            out.append((r.case_id, r.id, "duplicate"))
        elif taken >= k:
            out.append((r.case_id, r.id, "over_count"))
        elif used + r.chars > budget:
            out.append((r.case_id, r.id, "over_budget"))
        else:
            seen.add(r.content)
            used, taken = used + r.chars, taken + 1
            out.append((r.case_id, r.id, "selected"))
    return out


def test_learned_choose_sweep_and_card(spark):
    rows = by_case(facts(spark), lambda r: -r.score, lambda r: r.id)
    got = lambda name, *c: sorted(tuple(r[x] for x in c) for r in QUERIES[name](spark, DATA).collect())
    assert got("learned_choose", "case_id", "id", "decision") == sorted(x for r in rows.values() for x in select(r, 6, 6000))
    want = []
    for budget in (2000, 6000, 20000):
        every = [x for r in rows.values() for x in select(r, 6, budget)]
        want.append((budget, sum(x[2] == "selected" for x in every), sum(x[2] == "over_budget" for x in every), len({x[0] for x in every if x[2] == "over_budget"})))
    assert got("budget_sweep", "budget", "selected", "over_budget", "cases_rejecting") == sorted(want)
    cards = by_case(facts(spark), lambda r: -(1e6 * (r.lang == "en") + r.id), lambda r: r.id)
    assert got("knowledge_card", "case_id", "id", "decision") == sorted(x for r in cards.values() for x in select(r, 12, 10000))


def test_diversity_cap(spark):
    want = []
    for rows in by_case(facts(spark), lambda r: r["rank"]).values():
        counts, taken = defaultdict(int), 0
        for r in rows:
            if taken < 6 and counts["lang", r.lang] < 3 and counts["source", r.source] < 2:
                counts["lang", r.lang] += 1
                counts["source", r.source] += 1
                taken += 1
                want.append((r.case_id, r.id, r["rank"]))
    assert sorted((r.case_id, r.id, r["rank"]) for r in QUERIES["diversity_cap"](spark, DATA).collect()) == sorted(want)


def test_mmr_select(spark):
    vectors = {r.id: list(map(float, r.vector)) for r in P._vectors(spark, DATA).collect()}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in vectors.items()}
    same = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b]))
    want = []
    for case, rows in by_case(P._dense(spark, DATA).collect(), lambda r: -r.cosine, lambda r: r.id).items():
        left, chosen = [(r.id, r.cosine) for r in rows], []
        while left and len(chosen) < 8:
            best = max(left, key=lambda x: (round(0.8 * x[1] - 0.2 * max([same(x[0], c) for c in chosen] + [0.0]), 12), -left.index(x)))  # noqa: B023
            left.remove(best)
            want.append((case, best[0], len(chosen)))
            chosen.append(best[0])
    assert sorted((r.case_id, r.id, r.place) for r in QUERIES["mmr_select"](spark, DATA).collect()) == sorted(want)


def test_hit_windows(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").collect()
    cases = defaultdict(list)
    for r in e:
        cases[r.event_id % 40].append((-r.value, r.event_id, r.user_id % 3))
    want = []
    for case, rows in cases.items():
        kept = []
        for rank, (_, i, chat) in enumerate(sorted(rows), 1):
            a, b = i // 40 - 2, i // 40 + 2
            if all(c != chat or b < x or a > y for c, x, y in kept):
                kept.append((chat, a, b))
                want.append((case, chat, rank, a, b))
    assert sorted(tuple(r) for r in QUERIES["hit_windows"](spark, DATA).select("case_id", "chat_id", "rank", "start", "end").collect()) == sorted(want)


def test_char_batches(spark):
    chats = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        chats[r.conv_id].append((r.turn, len(r.text)))
    want = []
    for chat, rows in chats.items():
        batch, held = 0, []
        for pos, n in sorted(rows):
            if held and sum(x for _, x in held) + n > 4000:
                want += [(chat, p, batch) for p, _ in held]
                batch, held = batch + 1, held[-2:]
                while held and sum(x for _, x in held) + n > 4000:
                    held = held[1:]
            held.append((pos, n))
        want += [(chat, p, batch) for p, _ in held]
    assert sorted((r.chat_id, r.pos, r.batch) for r in QUERIES["char_batches"](spark, DATA).collect()) == sorted(want)


def test_situations_by_hand(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(features.PHRASES)], "i int, text string")
    t = F.col("text")
    out = df.select("i", S.turn_form(t).alias("form"), F.array_join(S.situation_tags(t), ",").alias("tags"), S.precise_situation(t).alias("setup"), S.situation_profile(t).alias("p")).collect()
    assert {r.i: (r.form, r.tags, r.setup, *r.p) for r in out} == {i: p[1:] for i, p in enumerate(features.PHRASES)}


def test_skills_and_information_gaps(spark):
    rows = [("好的", "handling_vent, receiving_share", "complaint,share", False), ("听朋友说他要走", None, "", True), ("他技术很好", "", "", True), ("a12", None, "", True), ("好的\nx9", None, "", True), ("卧槽", "handling_praise", "brief_exclamation", False)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, text string, context string")
    t = F.col("text")
    out = {r.i: r for r in df.select("i", F.array_join(S.situation_tags(t, F.col("context")), ",").alias("tags"), S.information_gap(t).alias("gap"), S.situation_profile(t, F.col("context"), True).alias("p")).collect()}
    for i, (_, _, tags, gap) in enumerate(rows):
        assert (out[i].tags, out[i].gap) == (tags, gap)
    assert out[1].p.expected_move == "verify_or_request_detail" and out[0].p.expected_move == "acknowledge_or_share_feeling" and out[5].p.expected_move == "instant_reaction"


def test_prefix_sums_by_ranges(spark):
    import random

    from chatspark.operators.splits import cap_observations, running_before

    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.randrange(5), rng.randrange(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "target_id long, kind string, priority long, n long")
    got = {r.target_id: r.before for r in running_before(df, "n", ["priority", "target_id"], ["kind"]).collect()}
    assert got == {i: sum(m for j, k2, q, m in rows if k2 == k and (q, j) < (p, i)) for i, k, p, _ in rows}
    taken = sum(r.take for r in cap_observations(df, 500).collect())
    assert taken == 500


def test_record_sink_rewrites_touched_buckets_only(spark, tmp_path):
    from pathlib import Path

    from chatspark.streaming.jobs import current_records, final_records_sink

    schema = "case_id long, line_no long, status string"
    path = f"{tmp_path}/records"
    merge = final_records_sink(path, 4)
    assert current_records(spark, path, spark.createDataFrame([], schema).schema).count() == 0
    merge(spark.createDataFrame([(i, 1, "a") for i in range(40)], schema), 0)
    merge(spark.createDataFrame([(3, 5, "b"), (3, 2, "x")], schema), 1)
    merge(spark.createDataFrame([(3, 5, "b"), (3, 2, "x")], schema), 1)  # run again
    merge(spark.createDataFrame([(7, 0, "old"), (99, 1, "new")], schema), 2)
    rows = {r.case_id: r.status for r in current_records(spark, path, spark.createDataFrame([], schema).schema).collect()}
    assert rows == {**{i: "a" for i in range(40)}, 3: "b", 99: "new"}
    assert len(list(Path(path, "data", "epoch=1").glob("bucket=*"))) == 1
