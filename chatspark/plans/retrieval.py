"""Queries: recall and ranking, over `benchmark` (cases), `documents` (pool) and `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.functions import text as X
from chatspark.operators import memory as M
from chatspark.operators import recall as C
from chatspark.operators import retrieval as R
from chatspark.operators.pruned import pruned_topk
from chatspark.plans.registry import query
from chatspark.plans.tables import table
from chatspark.sources.scratch import written

#: Words of five letters and more stand for situations; terms are words, so that SQL can count them too.
_WORDS = "list_filter(string_split(lower({}), ' '), lambda w: length(w) >= 5)"


def _words(c):
    return F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) >= 5)


def _pool(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def _cases(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")


_BAG = f"""pt AS (SELECT id, term, count(*) AS n FROM (SELECT doc_id AS id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY ALL), qt AS (SELECT case_id, term, count(*) AS n FROM (SELECT item_id AS case_id, unnest({_WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
ov AS (SELECT case_id, id, CAST(sum(least(pt.n, qt.n)) AS BIGINT) AS overlap FROM qt JOIN pt USING (term) GROUP BY ALL)"""


def _overlap(spark, d):
    q = R.term_postings(_cases(spark, d).withColumnRenamed("case_id", "id"), _words("text")).withColumnRenamed("id", "case_id")
    return R.term_overlap(q, R.term_postings(_pool(spark, d), _words("text")))


_CHARS = "list_filter(string_split(regexp_replace(lower({}), '\\s+', '', 'g'), ''), lambda x: regexp_matches(x, '^[\\p{{L}}\\p{{N}}]$'))"
_PAIRS = "list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])"


@query(f"WITH t AS (SELECT doc_id AS id, {_CHARS.format('text')} AS c FROM documents) SELECT id, array_to_string(list_concat(c[1:12], {_PAIRS}), '|') AS terms FROM t")
def terms(spark, d):
    """Characters and bigrams of each document's whole text."""
    return _pool(spark, d).select("id", F.array_join(X.terms("text"), "|").alias("terms"))


@query(f"WITH {_BAG} SELECT id, term, n FROM pt")
def term_postings(spark, d):
    return R.term_postings(_pool(spark, d), _words("text"))


@query(f"WITH {_BAG} SELECT * FROM ov")
def term_overlap(spark, d):
    return _overlap(spark, d)


#: Cases and pool of the full recall. A pool row's context and reply are short phrases after the length and digits of its text.
_RECALL = f"""p AS (SELECT doc_id AS id, doc_id % 2 = 0 AS is_group, doc_id * 10 AS ended, doc_id % 37 AS chat_id, lang AS relationship,
  list_filter([CASE WHEN contains(text, '!') THEN 'cheer' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END, CASE WHEN n_chars > 4000 THEN 'long' END], lambda x: x IS NOT NULL) AS situations,
  CASE WHEN doc_id % 11 = 0 THEN source END AS precise, lang AS praise_target, CASE WHEN doc_id % 3 > 0 THEN source END AS speaker_posture, CASE WHEN contains(text, '!') THEN 'cheer' WHEN doc_id % 4 = 0 THEN 'ask' END AS expected_move,
  CASE WHEN n_chars < 500 THEN 'brief' WHEN n_chars < 3000 THEN 'statement' END AS form, CASE WHEN doc_id % 13 > 0 THEN [doc_id % 2 = 0, doc_id % 3 = 0, doc_id % 5 = 0, n_chars > 500, lang = 'en'] END AS participants,
  n_chars AS chars, doc_id % 4 = 0 AS several, n_chars % 14 < 10 AND NOT regexp_matches(substr(text, 1, 50), '[0-9]') AS bare, n_chars % 14 < 10 AND NOT regexp_matches(substr(text, 1, 50), '[0-9]') AND n_chars % 3 < 2 AS portable FROM documents),
c AS (SELECT item_id AS case_id, item_id % 2 = 0 AS is_group, item_id * 300 + 500 AS cutoff, item_id % 37 AS chat_id, CASE WHEN item_id % 3 = 0 THEN 'en' ELSE 'fr' END AS relationship,
  CASE WHEN item_id % 5 = 0 THEN [] WHEN item_id % 5 = 1 THEN ['number', 'long'] WHEN item_id % 5 = 2 THEN ['absent'] ELSE ['cheer', 'number'] END AS situations, CASE WHEN item_id % 7 = 0 THEN 'src' || CAST(item_id % 20 AS VARCHAR) END AS precise,
  CASE WHEN item_id % 2 = 0 THEN 'en' END AS praise_target, CASE WHEN item_id % 4 > 0 THEN 'src1' END AS speaker_posture, CASE item_id % 3 WHEN 0 THEN 'ask' WHEN 1 THEN 'cheer' END AS expected_move, CASE WHEN item_id % 4 = 1 THEN 'brief' ELSE 'statement' END AS form,
  CASE WHEN item_id % 6 > 0 THEN [true, item_id % 3 = 0, false, true, item_id % 4 = 0] END AS participants, length(text) AS chars, item_id % 3 = 0 AS several, item_id % 6 = 1 AS sparse, item_id % 12 = 1 AS brief, len({_WORDS.format('text')}) AS n_terms FROM benchmark),
free AS (SELECT c.case_id, p.*, coalesce(p.precise = c.precise, false) AS same_precise, list_has_any(p.situations, c.situations) AS shared FROM c JOIN p ON p.is_group = c.is_group AND p.ended < c.cutoff AND p.chat_id <> 5 AND p.id <> c.case_id * 3),
tier AS (SELECT case_id, CASE WHEN sum(CAST(same_precise AS INT)) > 0 THEN 'precise' WHEN sum(CAST(shared AS INT)) > 0 THEN 'situation' ELSE 'all' END AS tier FROM free GROUP BY case_id),
cand AS (SELECT free.* FROM free JOIN tier USING (case_id) JOIN c USING (case_id) WHERE (tier = 'all' OR tier = 'precise' AND same_precise OR tier = 'situation' AND shared) AND (NOT sparse OR CASE WHEN brief THEN bare ELSE portable END)),
top AS (SELECT c.case_id, coalesce(tier, 'all') AS tier, coalesce(sparse AND NOT brief AND tier <> 'all' AND (SELECT count(*) FROM cand WHERE cand.case_id = c.case_id) < 12, false) AS topped FROM c LEFT JOIN tier USING (case_id)),
use AS (SELECT * FROM cand UNION SELECT free.* FROM free JOIN top USING (case_id) WHERE topped AND portable)"""

#: Phrases of a pool row's reply.
_REPLIES = ["真的假的?", "哈哈哈哈"]


def _recall_pool(spark, d):
    t, n, i = F.col("text"), F.col("n_chars"), F.col("doc_id")
    head = F.regexp_replace(F.substring("text", 1, 50), "[^0-9]+", "")
    rows = table(spark, d, "documents").select(
        i.alias("id"), (i % 2 == 0).alias("is_group"), (i * 10).alias("ended"), (i % 37).alias("chat_id"), F.col("lang").alias("relationship"),
        F.array_compact(F.array(F.when(t.contains("!"), "cheer"), F.when(t.rlike("[0-9]"), "number"), F.when(n > 4000, "long"))).alias("situations"), F.when(i % 11 == 0, F.col("source")).alias("precise"),
        F.col("lang").alias("praise_target"), F.when(i % 3 > 0, F.col("source")).alias("speaker_posture"), F.when(t.contains("!"), "cheer").when(i % 4 == 0, "ask").alias("expected_move"),
        F.when(n < 500, "brief").when(n < 3000, "statement").alias("form"), F.when(i % 13 > 0, F.array(i % 2 == 0, i % 3 == 0, i % 5 == 0, n > 500, F.col("lang") == "en")).alias("participants"),
        n.alias("chars"), (i % 4 == 0).alias("several"), _words("text").alias("terms"),
        F.array(F.concat(F.repeat(F.lit("在"), (1 + n % 14).cast("int")), head)).alias("context"), F.array(F.when(n % 3 == 0, _REPLIES[0]).when(n % 3 == 1, _REPLIES[1]).otherwise(F.substring("text", 1, 12))).alias("reply"),
    )
    return C.sparse_marks(rows)


def _recall_cases(spark, d):
    i = F.col("item_id")
    of = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return table(spark, d, "benchmark").select(
        i.alias("case_id"), (i % 2 == 0).alias("is_group"), (i * 300 + 500).alias("cutoff"), (i % 37).alias("chat_id"), F.when(i % 3 == 0, "en").otherwise("fr").alias("relationship"),
        F.when(i % 5 == 0, of()).when(i % 5 == 1, of("number", "long")).when(i % 5 == 2, of("absent")).otherwise(of("cheer", "number")).alias("situations"), F.when(i % 7 == 0, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("precise"),
        F.when(i % 2 == 0, "en").alias("praise_target"), F.when(i % 4 > 0, "src1").alias("speaker_posture"), F.when(i % 3 == 0, "ask").when(i % 3 == 1, "cheer").alias("expected_move"), F.when(i % 4 == 1, "brief").otherwise("statement").alias("form"),
        F.when(i % 6 > 0, F.array(F.lit(True), i % 3 == 0, F.lit(False), F.lit(True), i % 4 == 0)).alias("participants"), F.char_length("text").cast("long").alias("chars"), (i % 3 == 0).alias("several"), (i % 6 == 1).alias("sparse"), (i % 12 == 1).alias("brief"),
        F.array(F.lit(5).cast("long")).alias("excluded_chats"), F.array(i * 3).alias("excluded_ids"), _words("text").alias("terms"),
    )


@query(f"WITH {_RECALL} SELECT case_id, tier, topped, (SELECT count(*) FROM use WHERE use.case_id = top.case_id) AS n FROM top")
def candidate_bucket(spark, d):
    """Where each case chooses from: its precise situation, a shared one, or its whole flag where these have nothing."""
    return C.bucket_counts(_recall_cases(spark, d), _recall_pool(spark, d), 12).select("case_id", "tier", "topped", "n")


@query(f"WITH {_RECALL} SELECT id, bare, portable FROM p")
def sparse_filter(spark, d):
    """Rows for sparse turns: nothing concrete in the context; a reply that fits anywhere."""
    return _recall_pool(spark, d).select("id", "bare", "portable")


def _points(policy_first: bool) -> str:
    """SQL of the score and the order of recall rows, with priority of the move and of the own chat or without."""
    same = lambda a: f"CASE WHEN c.{a} IS NULL OR u.{a} IS NULL THEN 0 WHEN c.{a} = u.{a} THEN {C.PROFILE[a]} ELSE -{C.PROFILE[a]} END"
    compatible = " + ".join(map(same, C.PROFILE))
    order = "CASE WHEN c_move IS NULL OR u_move IS NULL THEN 1 WHEN c_move = u_move THEN 0 ELSE 2 END, CASE WHEN near AND (compatible >= best OR c_move IS NOT NULL AND c_move = u_move) THEN 0 ELSE 1 END, " if policy_first else ""
    return f"""{_RECALL}, {_BAG}, sc AS (SELECT u.case_id, u.id, c.expected_move AS c_move, u.expected_move AS u_move, u.chat_id = c.chat_id AND (u.shared OR u.same_precise) AS near, {compatible} AS compatible,
  round(1.5 * coalesce(overlap, 0) / greatest(1, n_terms) + 0.5 / (1 + abs(c.chars - u.chars) / 20.0) + {compatible} + CASE WHEN u.shared THEN 7 WHEN len(c.situations) > 0 AND len(u.situations) > 0 THEN -3 ELSE 0 END
    + CASE WHEN c.is_group OR u.form IS NULL THEN 0 WHEN c.form = u.form THEN 4 ELSE -1 END
    + CASE WHEN c.is_group AND c.participants IS NOT NULL AND u.participants IS NOT NULL THEN list_sum(list_transform(range(1, 6), lambda i: CASE WHEN c.participants[i] = u.participants[i] THEN 1.5 ELSE -1.5 END)) ELSE 0 END
    + CASE WHEN u.chat_id <> c.chat_id THEN 0 WHEN u.shared THEN 2.5 ELSE 0.5 END + CASE WHEN u.relationship = c.relationship THEN 0.5 ELSE 0 END + CASE WHEN c.several AND u.several THEN 1 ELSE 0 END, 6) AS score
  FROM use u JOIN c USING (case_id) LEFT JOIN ov USING (case_id, id)),
bs AS (SELECT *, max(compatible) OVER (PARTITION BY case_id) AS best FROM sc)
SELECT case_id, id, tier, topped, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY {order}score DESC, id) - 1 AS INTEGER) AS rank FROM bs) JOIN top USING (case_id) WHERE rank < 12"""


@query(f"WITH {_points(False)}")
def recall_rows(spark, d):
    """The twelve best examples of each case under every rule of the score."""
    return _recalled(spark, d, C.Policy())


@query(f"WITH {_points(True)}")
def recall_order(spark, d):
    """The same where the expected move, then the own chat, come before the score."""
    return _recalled(spark, d, C.Policy(move_first=True, same_chat_after_situation=True, same_chat_after_move=True))


def _recalled(spark, d, policy):
    return C.recall(_recall_cases(spark, d), _recall_pool(spark, d), 12, policy).select("case_id", "id", "tier", "topped", "score", "rank")


_SCORE = f"""{_BAG}, sc AS (SELECT case_id, id, round(2.0 * overlap + 1.5 * CAST(doc.lang = 'en' AS INT) + 0.5 * least(1.0, 200.0 / greatest(1, doc.n_chars)), 6) AS score FROM ov JOIN documents doc ON doc.doc_id = ov.id),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) - 1 AS rank FROM sc) WHERE rank < 12)"""


def _scored(spark, d):
    facts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").cast("int").alias("english"), F.least(F.lit(1.0), 200.0 / F.greatest(F.lit(1), F.col("n_chars"))).alias("brevity"))
    return R.rule_score(_overlap(spark, d).join(facts, "id"), {"overlap": 2.0, "english": 1.5, "brevity": 0.5})


@query(f"WITH {_SCORE} SELECT case_id, id, score FROM sc")
def rule_score(spark, d):
    return _scored(spark, d).select("case_id", "id", "score")


def _pruned(spark, d, weight, static, descending=False):
    q = R.term_postings(_cases(spark, d).withColumnRenamed("case_id", "id"), _words("text")).withColumnRenamed("id", "case_id")
    facts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), static.alias("static"))
    return pruned_topk(q, R.term_postings(_pool(spark, d), _words("text")), facts, 12, weight, descending)


def _ranked(spark, d):
    english, brevity = (F.col("lang") == "en").cast("int"), F.least(F.lit(1.0), 200.0 / F.greatest(F.lit(1), F.col("n_chars")))
    return _pruned(spark, d, 2.0, 1.5 * english + 0.5 * brevity)


@query(f"WITH {_SCORE} SELECT case_id, id, score, rank FROM rk")
def topk_rank(spark, d):
    """Recall: the twelve best documents of each case, from the blocks whose bounds reach them."""
    return _ranked(spark, d).select("case_id", "id", "score", "rank")


_ROUTES = f"""{_SCORE}, lr AS (SELECT * FROM (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY overlap DESC, id DESC) - 1 AS rank FROM ov) WHERE rank < 12), rt AS (SELECT 'context' AS route, case_id, id, rank FROM rk UNION ALL SELECT 'latest', case_id, id, rank FROM lr)"""


def _routes(spark, d):
    a = _ranked(spark, d).select("case_id", "id", "rank", F.lit("context").alias("route"))
    b = _pruned(spark, d, 1.0, F.lit(0.0), descending=True).select("case_id", "id", "rank", F.lit("latest").alias("route"))
    return a.unionByName(b)


@query(f"WITH {_ROUTES} SELECT case_id, id, round(sum(CASE route WHEN 'context' THEN 0.35 ELSE 0.65 END * 11 / (11 + rank)), 9) AS score FROM rt GROUP BY ALL")
def rrf_fusion(spark, d):
    return R.rrf_fusion(_routes(spark, d), {"context": 0.35, "latest": 0.65})


@query(f"WITH {_ROUTES}, b AS (SELECT case_id, id, min(rank) AS best FROM rt GROUP BY ALL) SELECT case_id, id, best, CAST(row_number() OVER (PARTITION BY case_id ORDER BY best, id) AS INTEGER) AS place FROM b")
def route_union(spark, d):
    return R.route_union(_routes(spark, d))


def _with_facts(spark, d):
    facts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content"), F.col("n_chars").alias("chars"), "lang", "source")
    return _ranked(spark, d).join(facts, "id")


@query()
def diversity_cap(spark, d):
    """At most three of a language and two of a source among a case's twelve; tested against a Python loop."""
    return R.diversity_cap(_with_facts(spark, d).select("case_id", "id", F.col("rank").cast("long").alias("rank"), "lang", "source"), {"lang": 3, "source": 2}, 6)


@query()
def learned_choose(spark, d):
    """Selection under a count and a character budget; tested against a Python loop."""
    return R.budget_select(_with_facts(spark, d).select("case_id", "id", "score", "content", "chars"), 6, 6000)


@query()
def budget_sweep(spark, d):
    """Selected and rejected documents at three budgets; tested against a Python loop."""
    return R.budget_sweep(_with_facts(spark, d).select("case_id", "id", "score", "content", "chars"), [2000, 6000, 20000], 6)


@query()
def knowledge_card(spark, d):
    """Documents of a case's language first, then the newest, while the characters hold; tested against a Python loop."""
    rows = _with_facts(spark, d).select("case_id", "id", (F.when(F.col("lang") == "en", 1000000.0).otherwise(0.0) + F.col("id")).alias("score"), "content", "chars")
    return R.budget_select(rows, 12, 10000)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_DENSE = """dn AS (SELECT q.vec_id AS case_id, p.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS cosine FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0),
dr AS (SELECT case_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(cosine, 9) DESC, id) - 1 AS rank FROM dn WHERE cosine >= 0.01) WHERE rank < 20)"""


def _dense(spark, d, recall=1.0):
    v = _vectors(spark, d)
    return M.dense_route(v.filter("id % 50 = 0").select(F.col("id").alias("case_id"), "vector"), v, 20, recall=recall)


@query(f"WITH {_DENSE} SELECT case_id, id, round(cosine, 5) AS cosine, rank FROM dr")
def dense_route(spark, d):
    """Every fiftieth vector against all."""
    return _dense(spark, d).select("case_id", "id", F.round("cosine", 5).alias("cosine"), "rank")


@query()
def probed_route(spark, d):
    """The same from the cells that hold nine tenths of the neighbours and more; tested against the exact rows."""
    return _dense(spark, d, 0.95).select("case_id", "id", F.round("cosine", 5).alias("cosine"), "rank")


#: Turns as messages of their conversation's account; each has one of the vectors. The first user turn of every conversation asks before its answer.
_MEMORY = """n AS (SELECT count(*) AS n FROM embeddings),
m AS (SELECT conv_id * 100 + turn AS id, conv_id AS chat_id, CAST(turn AS BIGINT) AS pos, conv_id * 200 + turn * 250 AS ts, conv_id % 3 AS account, role AS sender, text, CAST(embedding AS DOUBLE[]) AS v FROM conversations, n JOIN embeddings ON vec_id = (conv_id * 100 + turn) * 7 % n),
q AS (SELECT id AS case_id, account, ts AS cutoff, [chat_id, chat_id - 9] AS excluded, [id - 100] AS blocked, list_distinct(regexp_extract_all(lower(substr(text, 1, 60)), '[\\p{L}\\p{M}\\p{N}_]+')) AS terms, v FROM m WHERE sender = 'user' AND pos <= 1),
e AS (SELECT q.case_id, m.id, m.chat_id, m.pos, m.ts, round(list_cosine_similarity(m.v, q.v), 9) AS cosine, len(list_filter(q.terms, lambda t: contains(lower(m.sender || ' ' || m.text), t))) AS hits FROM q JOIN m ON m.ts < q.cutoff AND m.account = q.account AND NOT list_contains(q.excluded, m.chat_id) AND NOT list_contains(q.blocked, m.id)),
r1 AS (SELECT * FROM e WHERE cosine >= 0.01 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY cosine DESC, chat_id, pos) <= 25), r2 AS (SELECT * FROM e WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY hits DESC, ts DESC, chat_id, pos) <= 25),
f AS (SELECT coalesce(r1.case_id, r2.case_id) AS case_id, coalesce(r1.id, r2.id) AS id, coalesce(r1.chat_id, r2.chat_id) AS chat_id, coalesce(r1.pos, r2.pos) AS pos, r1.cosine, r2.hits FROM r1 FULL JOIN r2 ON r1.case_id = r2.case_id AND r1.id = r2.id),
s AS (SELECT *, round((0.6 * coalesce(cosine, 0) + 0.4 * coalesce(hits / max(hits) OVER (PARTITION BY case_id), 0)) * CASE WHEN cosine IS NOT NULL AND hits IS NOT NULL THEN 1.15 ELSE 1 END, 7) AS score FROM f)"""


def _memory(spark, d):
    c, v = table(spark, d, "conversations"), table(spark, d, "embeddings")
    number = F.col("conv_id") * 100 + F.col("turn")
    own = c.crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("n")))).withColumn("vec_id", number * 7 % F.col("n")).join(v, "vec_id")
    messages = written(own.select(number.alias("id"), F.col("conv_id").alias("chat_id"), F.col("turn").cast("long").alias("pos"), (F.col("conv_id") * 200 + F.col("turn") * 250).alias("ts"), (F.col("conv_id") % 3).alias("account"), F.col("role").alias("sender"), "text", F.col("embedding").alias("vector")))
    asking = messages.filter("sender = 'user' and pos <= 1")
    cases = asking.select(F.col("id").alias("case_id"), "account", F.col("ts").alias("cutoff"), F.array("chat_id", F.col("chat_id") - 9).alias("excluded"), F.array(F.col("id") - 100).alias("blocked"), F.substring("text", 1, 60).alias("query"), "vector")
    return cases, messages


@query(f"WITH {_MEMORY} SELECT case_id, id, round(score, 4) AS score, CASE WHEN cosine IS NULL THEN 'keyword' WHEN hits IS NULL THEN 'dense' ELSE 'dense,keyword' END AS routes FROM s")
def hybrid_search(spark, d):
    """Messages before each first question, by vector and by words contained, fused; all cells are probed, so rows are exact."""
    return M.fused(M.search_routes(*_memory(spark, d), 5, recall=1)).select("case_id", "id", F.round("score", 4).alias("score"), "routes")


@query()
def memory_search(spark, d):
    """The five best of these with the messages around them, from calibrated cells; tested against loops."""
    return M.memory_search(*_memory(spark, d), 5).select("case_id", "n", "hit_id", F.array_join(F.transform("messages", lambda x: x.cast("string")), ",").alias("messages"))


@query()
def mmr_select(spark, d):
    """Eight of the twenty dense neighbours, diverse ones first; tested against a Python loop."""
    v = _vectors(spark, d)
    rows = _dense(spark, d).join(v.select("id", "vector", F.col("id").alias("content"), F.lit(1).alias("chars")), "id")
    return R.mmr_select(rows.select("case_id", "id", F.col("cosine").alias("relevance"), "vector", "content", "chars"), 8)


@query()
def hit_windows(spark, d):
    """Windows of five places around events, in order of value; those that overlap an earlier one of the case leave; tested against a Python loop."""
    e = table(spark, d, "events")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("value"), "event_id"))
    hits = e.select((F.col("event_id") % 40).alias("case_id"), F.col("user_id").alias("chat_id"), "event_id", "value").withColumn("rank", rank.cast("long"))
    return R.hit_windows(hits.select("case_id", (F.col("chat_id") % 3).alias("chat_id"), "rank", (F.floor(F.col("event_id") / 40) - 2).alias("start"), (F.floor(F.col("event_id") / 40) + 2).alias("end")))


@query("WITH v AS (SELECT DISTINCT trim(text) AS t FROM documents WHERE doc_id % 2 = 0) SELECT count(*) AS total, count(v.t) AS covered, count(*) - count(v.t) AS keyword_only FROM documents LEFT JOIN v ON trim(text) = v.t")
def dense_coverage(spark, d):
    p = _pool(spark, d)
    return R.dense_coverage(p, p.filter("id % 2 = 0"))


@query(f"WITH {_SCORE}, b AS (SELECT case_id, id, CASE WHEN id % 5 = 0 THEN score + 1 ELSE score END AS score, rank FROM rk WHERE id % 7 <> 3) SELECT case_id, id, CASE WHEN id % 7 = 3 THEN 'score,rank' ELSE 'score' END AS fields FROM rk WHERE id % 7 = 3 OR id % 5 = 0")
def retrieval_diff(spark, d):
    a = _ranked(spark, d).select("case_id", "id", "score", "rank")
    b = a.filter("id % 7 != 3").withColumn("score", F.when(F.col("id") % 5 == 0, F.col("score") + 1).otherwise(F.col("score")))
    return R.retrieval_diff(a, b, ["case_id", "id"], ["score", "rank"]).select("case_id", "id", F.array_join("fields", ",").alias("fields"))


@query()
def char_batches(spark, d):
    """Turns of a conversation packed into batches of four thousand characters; tested against a Python loop."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("pos"), F.length("text").cast("long").alias("chars"))
    return R.char_batches(c, 4000, 2)


@query("WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) % 3 AS case_group FROM events) SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_type = 'click' AND case_group = 1) WHERE r <= 50")
def history_page(spark, d):
    """The newest fifty rows of a filtered history."""
    e = table(spark, d, "events").filter((F.col("event_type") == "click") & (F.floor("value") % 3 == 1))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("user_id", "event_id", "ts")
