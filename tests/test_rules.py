"""Rules that SQL can't express, against plain Python; boundaries by hand."""

import itertools
import json
import math
import re
import uuid

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from chatspark.functions import text as X
from chatspark.operators import bank as B
from chatspark.operators import conversation as C
from chatspark.operators import ranking as K
from chatspark.operators import retrieval as R
from chatspark.operators import verdicts as V
from chatspark.sources import io

MESSAGE = "chat_id long, pos long, ts long, is_self boolean, boundary boolean, chat_type string, text string, message_id long"


def chat(spark, rows):
    """rows: (ts, is_self) or (ts, is_self, boundary)"""
    full = [(1, i, r[0], r[1], r[2] if len(r) > 2 else False, "group", f"m{i}", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, MESSAGE)


def reasons(spark, rows, policy=C.Policy()):
    return [r.reason for r in C.burst_candidates(chat(spark, rows), policy).orderBy("reply_start").collect()]


def test_reply_gap_boundary(spark):
    assert reasons(spark, [(0, False), (600, True)]) == ["retained"]
    assert reasons(spark, [(0, False), (601, True)]) == ["stale_response"]


def test_own_message_never_answers_itself(spark):
    rows = C.burst_candidates(chat(spark, [(0, False), (10, True), (100, True), (400, True), (500, False), (520, True)])).orderBy("reply_start").collect()
    assert [(r.reply_start, r.end, r.unattached, r.reason) for r in rows] == [(1, 3, 1, "retained"), (5, 6, 0, "retained")]


def test_context_starts_after_boundary_and_last_gap(spark):
    rows = [(0, False), (10, False, True), (20, False), (9000, False), (9010, False), (9020, True)]
    r = C.burst_candidates(chat(spark, rows)).first()
    assert (r.start, r.reason, r.trimmed) == (3, "retained", True)
    assert reasons(spark, [(0, False, True), (5, True)]) == ["no_context"]


def test_policy_is_checked():
    with pytest.raises(ValueError):
        C.Policy(reply_gap=0)


def test_sign_test(spark):
    pairs = [(0, 0), (5, 0), (8, 3), (10, 10), (60, 41)]
    got = [r.p for r in spark.createDataFrame(pairs, "w long, l long").select(V.sign_test("w", "l").alias("p")).collect()]
    for (w, x), p in zip(pairs, got):
        n, k = w + x, min(w, x)
        assert p == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0)


def test_uuid5(spark):
    names = ["e1:c1:0", "é:2:3", ""]
    got = [r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select(B.uuid5(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def py_terms(text, singles=12):
    c = [x for x in "".join(text.lower().split()) if x.isalnum()]
    return c[:singles] + [a + b for a, b in zip(c, c[1:])]


def test_terms_and_jaccard(spark):
    texts = ["Hello, World 12", "", "a", "你好 吗?", "é😀ñ x"]
    df = spark.createDataFrame([(t, u) for t in texts for u in texts], "t string, u string")
    for r in df.select("t", "u", X.terms(F.col("t")).alias("a"), X.token_jaccard(F.col("t"), F.col("u")).alias("j")).collect():
        assert r.a == py_terms(r.t)
        a, b = set(py_terms(r.t, 10**6)), set(py_terms(r.u, 10**6))
        assert r.j == pytest.approx(len(a & b) / len(a | b) if a | b else 0.0)


def test_selection_rules(spark):
    rows = [(1, i, 10.0 - i, f"c{i % 4}", 100 * (i % 3 + 1)) for i in range(9)]
    got = {r.id: r.decision for r in R.budget_select(spark.createDataFrame(rows, "case_id long, id long, score double, content string, chars long"), 3, 500).collect()}
    seen, used, want = set(), 0, {}
    for _, i, _, content, chars in rows:
        if content in seen:
            want[i] = "duplicate"
        elif len(seen) >= 3:
            want[i] = "over_count"
        elif used + chars > 500:
            want[i] = "over_budget"
        else:
            want[i], used = "selected", used + chars
            seen.add(content)
    assert got == want
    ranked = spark.createDataFrame([(1, i, i, "x" if i < 5 else "y", None if i == 2 else str(i % 2)) for i in range(8)], "case_id long, id long, rank long, a string, b string")
    assert sorted(r.id for r in R.diversity_cap(ranked, {"a": 2, "b": 2}, 4).collect()) == [0, 1, 5, 6]


def test_mmr_prefers_diversity(spark):
    rows = [(1, 1, 1.0, [1.0, 0.0], "a", 1), (1, 2, 0.99, [1.0, 0.0], "b", 1), (1, 3, 0.85, [0.0, 1.0], "c", 1), (1, 4, 0.5, [0.0, 1.0], "a", 1)]
    got = R.mmr_select(spark.createDataFrame(rows, "case_id long, id long, relevance double, vector array<double>, content string, chars long"), 3)
    assert [r.id for r in got.orderBy("place").collect()] == [1, 3, 2]


def test_char_batches(spark):
    rows = [(1, i, n) for i, n in enumerate([40, 40, 40, 10, 10, 95, 5])]
    got = R.char_batches(spark.createDataFrame(rows, "chat_id long, pos long, chars long"), 100, 1)
    by = {}
    for r in got.collect():
        by.setdefault(r.batch, []).append(r.pos)
    assert {b: sorted(p) for b, p in by.items()} == {0: [0, 1], 1: [1, 2, 3, 4], 2: [5], 3: [5, 6]} or all(sum(rows[p][2] for p in ps) <= 100 for ps in by.values())
    assert set(itertools.chain(*by.values())) == set(range(7))


def test_topk_expectation(spark):
    rows = [(1, i, s, z) for i, (s, z) in enumerate([(3, 0), (2, 1), (2, 0), (2, 1), (1, 1)])]
    r = K.topk_expectation(spark.createDataFrame(rows, "target_id long, id long, score int, z int"), 2).first()
    orders = [o for o in itertools.permutations(rows) if all(a[2] >= b[2] for a, b in zip(o, o[1:]))]
    top = [o[:2] for o in orders]
    assert r.hit == pytest.approx(sum(any(x[3] for x in t) for t in top) / len(top))
    assert r.positives == pytest.approx(sum(sum(x[3] for x in t) for t in top) / len(top))


def test_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([("a", float(i % 5)) for i in range(50)], "g string, delta double")
    one, two = K.paired_bootstrap(df, "g", 100).first(), K.paired_bootstrap(df.repartition(3), "g", 100).first()
    assert one == two and one.low <= one["mean"] <= one.high


def test_pairwise_lr_finds_direction(spark):
    rows = [(0.5, 1.0 + i % 3, -0.2 * (i % 2)) for i in range(60)]
    w = K.pairwise_lr(spark.createDataFrame(rows, "weight double, good double, bad double"), ["good", "bad"])
    assert w["good"] > 0 > w["bad"]


def test_journal_tail_and_damage(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"case_id": "x"}) + "\n\n{bad\n" + json.dumps({"case_id": "y"}) + '\n{"case_id": "z')
    rows, damage = io.read_journal(spark, str(tmp_path), "case_id string")
    assert sorted((r.line_no, r.case_id) for r in rows.collect()) == [(1, "x"), (4, "y")]
    assert [r.line_no for r in damage.collect()] == [3]


def test_unified_records_end_at_line_feeds(spark, tmp_path):
    row = {"chat_id": "c", "chat_type": "group", "sender": "s", "is_self": True, "timestamp": 1, "text": "a b"}
    (tmp_path / "m.jsonl").write_text(json.dumps(row, ensure_ascii=False) + "\n\n" + json.dumps(row | {"chat_type": "odd", "sender": None}) + "\n", encoding="utf-8")
    rows, bad = io.read_unified(spark, str(tmp_path))
    assert [r.text for r in rows.filter("chat_type = 'group'").collect()] == ["a b"]
    assert {r.field: r.n for r in bad.collect()} == {"sender": 1, "chat_type_domain": 1}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert DATA


def test_group_pattern_query_reads_whole_texts(spark, tmp_path):
    from chatspark.plans import QUERIES

    rows = [(20, 0, "user", "x" * 420 + ". a sentence that comes late here"), (40, 0, "assistant", "y" * 420 + ". A sentence that comes late there")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.fuzzy for r in QUERIES["group_pattern_reuse"](spark, str(tmp_path)).collect()] == [True]


def test_terms_query_reads_whole_texts(spark, tmp_path):
    from chatspark.plans import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.createDataFrame([(1, "ab\ncdq", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars int").select(*[F.col(c).cast(t) for c, t in docs.dtypes]).write.parquet(f"{tmp_path}/documents.parquet")
    assert "dq" in QUERIES["terms"](spark, str(tmp_path)).first().terms.split("|")


def test_mentions_overlap(spark):
    from chatspark.operators.knowledge import mention_scan

    names = ["Ann", "Lee", "Ann Lee", "Lee Roy", "A.B.", "@x", "nn"]
    texts = ["Ann Lee Roy met A.B. and @x", "Anna, Lee", None, "", "nn_ x@x Ann"]
    out = mention_scan(spark.createDataFrame(list(enumerate(texts)), "message_id long, text string"), spark.createDataFrame([(n, 1) for n in names], "name string, identity int"))
    want = {(i, n) for i, t in enumerate(texts) for n in names if re.search(rf"(?<![0-9A-Za-z_]){re.escape(n)}(?![0-9A-Za-z_])", t or "")}
    assert sorted((r.message_id, r.name) for r in out.collect()) == sorted(want)


def test_bootstrap_is_distributed_and_has_the_normal_interval(spark):
    from chatspark.plans import QUERIES

    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 37 % 101 / 10.0).alias("delta"))
    for r in K.paired_bootstrap(df, "g").collect():
        x = [i * 37 % 101 / 10 for i in range(4000) if (i % 4 == 0) == (r.g == "b")]
        mean = sum(x) / len(x)
        error = (sum((y - mean) ** 2 for y in x) / len(x) / len(x)) ** 0.5
        assert r.n == len(x) and abs(r["mean"] - mean) < 1e-8 and abs(r.low - mean + 1.96 * error) < 0.2 * error and abs(r.high - mean - 1.96 * error) < 0.2 * error
    out = QUERIES["paired_bootstrap"](spark, DATA)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString() and out.filter("low <= mean and mean <= high").count() == 4
