"""Queries: from messages to examples, splits and roles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators import conversation as C
from chatspark.operators import splits as S
from chatspark.plans.registry import query
from chatspark.plans.tables import DLG, MSG, dialogue, messages, table

#: The default policy keeps few runs of the event stream, whose messages lie hours apart; the wide one keeps half.
WIDE = C.Policy(context_gap=172800, response_gap=43200, reply_gap=21600)


def _runs_sql(p: C.Policy) -> str:
    return f"""{MSG},
m1 AS (SELECT *, is_self AND trim(text) <> '' AS own, ts - lag(ts) OVER w AS gap, lag(is_self) OVER w AS prev_self, lag(ts) OVER w AS prev_ts FROM msg WINDOW w AS (PARTITION BY chat_id ORDER BY pos)),
m2 AS (SELECT *, own AND NOT coalesce(lag(own) OVER w, false) AS run_begin,
  greatest(0, pos - {p.max_context}, max(CASE WHEN boundary THEN pos + 1 END) OVER b, max(CASE WHEN gap > {p.context_gap} THEN pos END) OVER b) AS context_start
  FROM m1 WINDOW w AS (PARTITION BY chat_id ORDER BY pos), b AS (PARTITION BY chat_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m3 AS (SELECT *, CASE WHEN own THEN sum(CAST(run_begin AS INT)) OVER (PARTITION BY chat_id ORDER BY pos) END AS run FROM m2),
m4 AS (SELECT *, own AND sum(CASE WHEN NOT run_begin AND gap > {p.reply_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id, run ORDER BY pos) = 0 AS in_burst FROM m3),
cand AS (SELECT *, CASE WHEN start >= reply_start THEN 'no_context' WHEN prev_self THEN 'reply_to_self' WHEN reply_ts - cutoff_ts > {p.response_gap} THEN 'stale_response' ELSE 'retained' END AS reason,
  start > greatest(0, reply_start - {p.max_context}) AS trimmed
  FROM (SELECT chat_id, chat_type, run, min(pos) AS reply_start, max(CASE WHEN in_burst THEN pos END) + 1 AS "end", max(pos) - max(CASE WHEN in_burst THEN pos END) AS unattached,
    arg_min(context_start, pos) AS start, arg_min(prev_self, pos) AS prev_self, arg_min(prev_ts, pos) AS cutoff_ts, min(ts) AS reply_ts, max(CASE WHEN in_burst THEN ts END) AS end_ts
    FROM m4 WHERE run IS NOT NULL GROUP BY chat_id, chat_type, run))"""


_EX = f"""{_runs_sql(WIDE)},
ex AS (SELECT c.chat_id, c.chat_type, c.start, c.reply_start, c."end", c.cutoff_ts, c.end_ts, string_agg(CASE WHEN m.pos < c.reply_start THEN CAST(m.message_id AS VARCHAR) END, ',' ORDER BY m.pos) AS context_ids,
  string_agg(CASE WHEN m.pos >= c.reply_start THEN CAST(m.message_id AS VARCHAR) END, ',' ORDER BY m.pos) AS reply_ids, min(m.ts) AS start_ts
  FROM cand c JOIN msg m ON m.chat_id = c.chat_id AND m.pos >= c.start AND m.pos < c."end" WHERE c.reason = 'retained' GROUP BY ALL),
exs AS (SELECT *, substr(sha256(context_ids || '|' || reply_ids), 1, 24) AS example_id, row_number() OVER (PARTITION BY chat_id ORDER BY reply_start) - 1 AS prior_interactions, "end" - reply_start AS n_reply FROM ex)"""


def examples(spark, d):
    """Examples of the event stream under the wide policy, with the first timestamp of each."""
    m = messages(spark, d)
    rows = C.examples(m, WIDE)
    return rows.join(m.select("chat_id", F.col("pos").alias("start"), F.col("ts").alias("start_ts")), ["chat_id", "start"])


@query(f"WITH {_runs_sql(C.Policy())} SELECT chat_id, chat_type, start, reply_start, \"end\" AS end_pos, unattached, trimmed, reason FROM cand")
def extract_examples(spark, d):
    """Self runs, bursts, contexts and what became of each, under the default policy."""
    return C.burst_candidates(messages(spark, d)).select("chat_id", "chat_type", "start", "reply_start", F.col("end").alias("end_pos"), "unattached", "trimmed", "reason")


@query(f"WITH {_runs_sql(WIDE)}, marks AS (SELECT unnest([ 'self_runs', CASE WHEN unattached > 0 THEN 'split_self_runs' END, CASE WHEN trimmed THEN 'trimmed_contexts' END, reason]) AS reason FROM cand) SELECT reason, count(*) AS n FROM marks WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'unattached_self_messages', CAST(coalesce(sum(unattached), 0) AS BIGINT) FROM cand")
def extract_counts(spark, d):
    return C.extraction_counts(C.burst_candidates(messages(spark, d), WIDE))


@query(f"WITH {_runs_sql(C.Policy())} SELECT chat_id, run, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM m3 WHERE run IS NOT NULL GROUP BY chat_id, run")
def self_runs(spark, d):
    return C.self_runs(messages(spark, d)).filter("run is not null").groupBy("chat_id", "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_runs_sql(WIDE)} SELECT chat_id, run, pos, in_burst FROM m4 WHERE run IS NOT NULL")
def reply_burst(spark, d):
    return C.reply_bursts(C.self_runs(messages(spark, d)), WIDE).filter("run is not null").select("chat_id", "run", "pos", "in_burst")


@query(f"WITH {_runs_sql(WIDE)} SELECT chat_id, pos, CAST(context_start AS BIGINT) AS context_start FROM m2")
def context_window(spark, d):
    return C.context_starts(messages(spark, d), WIDE).select("chat_id", "pos", "context_start")


@query(f"WITH {_EX} SELECT example_id, chat_id, chat_type, start, reply_start, \"end\" AS end_pos, cutoff_ts, context_ids, reply_ids, prior_interactions, CASE WHEN n_reply > 1 THEN 'multi' ELSE 'single' END AS reply_shape, CASE WHEN prior_interactions > 0 THEN 'familiar' ELSE 'observed_first' END AS familiarity FROM exs")
def example_ids(spark, d):
    """Examples with ids from their messages, running number in the chat and familiarity."""
    e = examples(spark, d)
    return e.select("example_id", "chat_id", "chat_type", "start", "reply_start", F.col("end").alias("end_pos"), "cutoff_ts", F.array_join("context_ids", ",").alias("context_ids"), F.array_join("reply_ids", ",").alias("reply_ids"), "prior_interactions", "reply_shape", "familiarity")


@query(f"""WITH {_runs_sql(WIDE)}, near AS (SELECT DISTINCT chat_id, pos + g.d AS pos FROM msg, (SELECT unnest(range(-3, 4)) AS d) g WHERE message_id % 97 = 0)
SELECT chat_id, reply_start, reason FROM cand c WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.chat_id = c.chat_id AND n.pos >= c.reply_start AND n.pos < c."end")""")
def protect_margin(spark, d):
    m = messages(spark, d)
    return C.protect_margin(C.burst_candidates(m, WIDE), m.filter("message_id % 97 = 0").select("chat_id", "pos"), 3).select("chat_id", "reply_start", "reason")


@query(f"""WITH {MSG}, r AS (SELECT chat_id, pos, ts, is_self, boundary, kind <> 'view' AS eligible FROM msg),
f AS (SELECT a.chat_id, a.pos, count(b.pos) FILTER (b.pos < a.pos) AS n_context, bool_or(b.ts < p.ts) AS reversed_time, bool_or(b.boundary) FILTER (b.pos < a.pos) AS bound,
  bool_or(b.is_self) FILTER (b.pos = a.pos - 1) AS to_self, bool_or(NOT b.eligible) FILTER (b.pos >= a.pos) AS non_text, max(a.ts - b.ts) FILTER (b.pos = a.pos - 1) AS response,
  max(b.ts - p.ts) FILTER (b.pos < a.pos AND b.pos > a.pos - 3) AS cgap, max(b.ts - p.ts) FILTER (b.pos > a.pos) AS rgap
  FROM r a JOIN r b ON b.chat_id = a.chat_id AND b.pos BETWEEN a.pos - 3 AND a.pos + 1 LEFT JOIN r p ON p.chat_id = b.chat_id AND p.pos = b.pos - 1 WHERE a.is_self GROUP BY a.chat_id, a.pos)
SELECT chat_id, pos, CASE WHEN n_context = 0 THEN 'empty_fragment' ELSE array_to_string(list_sort(list_filter([CASE WHEN to_self THEN 'reply_to_self' END, CASE WHEN non_text THEN 'non_text_reply' END, CASE WHEN bound THEN 'context_contains_boundary' END,
  CASE WHEN response > 43200 THEN 'stale_response' END, CASE WHEN cgap > 172800 THEN 'context_crosses_session' END, CASE WHEN rgap > 21600 THEN 'reply_crosses_burst' END], lambda x: x IS NOT NULL)), ',') END AS issues FROM f""")
def fragment_issues(spark, d):
    """Fragments of three messages before each own message and it with its successor."""
    m = messages(spark, d).withColumn("item", F.struct("ts", "is_self", "boundary", (F.col("kind") != "view").alias("eligible")))
    chat = Window.partitionBy("chat_id").orderBy("pos")
    rows = m.withColumn("context", F.collect_list("item").over(chat.rowsBetween(-3, -1))).withColumn("reply", F.collect_list("item").over(chat.rowsBetween(0, 1))).filter("is_self")
    return C.fragment_issues(rows, WIDE).select("chat_id", "pos", F.array_join("issues", ",").alias("issues"))


@query(f"WITH {_EX} SELECT example_id, CASE WHEN prior_interactions % 5 = 0 THEN 'context_ids' ELSE '' END AS mismatches FROM exs")
def source_reconstruct(spark, d):
    """Every fifth example of a chat has its context ids damaged; only that is found."""
    e = examples(spark, d)
    damaged = e.withColumn("context_ids", F.when(F.col("prior_interactions") % 5 == 0, F.transform("context_ids", lambda x: x + 1)).otherwise(F.col("context_ids")))
    return C.source_reconstruct(damaged, messages(spark, d)).select("example_id", F.array_join("mismatches", ",").alias("mismatches"))


@query(f"""WITH {MSG}, a AS (SELECT chat_id, pos, ts FROM msg WHERE message_id % 211 = 0)
SELECT DISTINCT m.chat_id, m.pos FROM msg m JOIN a ON a.chat_id = m.chat_id AND abs(m.pos - a.pos) <= 8 AND abs(m.ts - a.ts) <= 86400""")
def neighbour_windows(spark, d):
    m = messages(spark, d)
    return C.neighbour_windows(m, m.filter("message_id % 211 = 0"), seconds=86400)


@query(f"""WITH {MSG}, a AS (SELECT chat_id, pos, ts FROM msg WHERE message_id % 211 = 0 AND chat_type = 'group')
SELECT chat_id, pos FROM msg m WHERE chat_type = 'private' AND EXISTS (SELECT 1 FROM msg s WHERE s.chat_id = m.chat_id AND s.message_id % 211 = 0)
UNION SELECT m.chat_id, m.pos FROM msg m JOIN a ON a.chat_id = m.chat_id AND abs(m.pos - a.pos) <= 8 AND abs(m.ts - a.ts) <= 86400""")
def history_select(spark, d):
    return C.history_select(messages(spark, d), F.col("message_id") % 211 == 0, seconds=86400)


@query(f"""WITH {DLG}, h AS (SELECT chat_id, pos, contains(text, 'the ') AS hit, list(message_id) OVER (PARTITION BY chat_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b FROM dlg)
SELECT chat_id, pos, rank, coalesce(array_to_string(b, ','), '') AS before_ids FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY pos) AS rank FROM h WHERE hit) WHERE rank <= 12""")
def focus_context(spark, d):
    return C.focus_context(dialogue(spark, d), F.col("text").contains("the ")).select("chat_id", "pos", "rank", F.array_join("before_ids", ",").alias("before_ids"))


_SPLIT = {"group": 400, "private": 100}


@query(f"""WITH {MSG}, chats AS (SELECT chat_id, chat_type, least(sum(CASE WHEN is_self AND trim(text) <> '' THEN 1 ELSE 0 END), 18) AS n FROM msg GROUP BY ALL),
f AS (SELECT chat_id FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY chat_type ORDER BY sha256('42:' || chat_id), chat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM chats) WHERE b < CASE chat_type WHEN 'group' THEN 400 ELSE 100 END),
g AS (SELECT chat_id FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY chat_type ORDER BY sha256('43:' || chat_id), chat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM chats WHERE chat_id NOT IN (SELECT chat_id FROM f)) WHERE b < CASE chat_type WHEN 'group' THEN 400 ELSE 100 END)
SELECT chat_id, chat_type, CASE WHEN chat_id IN (SELECT chat_id FROM f) THEN 'fixed_test' WHEN chat_id IN (SELECT chat_id FROM g) THEN 'development' ELSE 'train' END AS role FROM chats""")
def split_by_chat(spark, d):
    return S.split_by_chat(messages(spark, d), _SPLIT, _SPLIT)


_WIN = f"""{_EX}, t AS (SELECT list(cutoff_ts ORDER BY cutoff_ts) AS l FROM exs), ab AS (SELECT l[len(l) // 4 + 1] AS a, l[65 * len(l) // 100 + 1] AS b FROM t),
win AS (SELECT exs.*, CASE WHEN end_ts < a THEN 'learning' WHEN start_ts >= a AND end_ts < b THEN 'development' WHEN start_ts >= b THEN 'acceptance' END AS "window" FROM exs, ab)"""


@query(f'WITH {_WIN} SELECT example_id, "window" FROM win')
def time_windows(spark, d):
    return S.time_windows(examples(spark, d)).select("example_id", "window")


@query(f"""WITH {_EX}, c AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY sha256('42:' || example_id), example_id) AS r FROM exs WHERE chat_id % 10 <> 3),
k AS (SELECT *, row_number() OVER (PARTITION BY chat_type ORDER BY sha256('42:' || example_id), example_id) AS rank FROM c WHERE r <= 2)
SELECT example_id AS id, chat_id, chat_type, rank FROM k WHERE rank <= CASE chat_type WHEN 'group' THEN 60 ELSE 20 END""")
def choose_quota(spark, d):
    """Eighty examples, three quarters from groups, at most two a chat, none that touches an occupied chat's messages."""
    e = examples(spark, d).withColumn("ids", F.concat("context_ids", "reply_ids"))
    occupied = messages(spark, d).filter("chat_id % 10 = 3").select("message_id")
    return S.choose_quota(e.select(F.col("example_id").alias("id"), "chat_id", "chat_type", "ids"), 80, 0.75, 2, 42, occupied).select("id", "chat_id", "chat_type", "rank")


@query(f"""WITH {_WIN}, n AS (SELECT chat_id, chat_type, "window", count(*) AS n FROM win WHERE "window" IS NOT NULL GROUP BY ALL), chats AS (SELECT DISTINCT chat_id, chat_type FROM n),
h AS (SELECT attempt, chat_id, chat_type, row_number() OVER (PARTITION BY attempt, chat_type ORDER BY sha256((attempt + 42) || ':' || chat_id), chat_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY attempt, chat_type) * 0.2, 0)) AS held FROM chats, (SELECT unnest(range(0, 200)) AS attempt)),
ok AS (SELECT attempt FROM h JOIN n USING (chat_id, chat_type) GROUP BY attempt HAVING
 coalesce(sum(CASE WHEN "window" = 'learning' AND chat_type = 'group' AND NOT held THEN least(n, 125) END), 0) >= (SELECT sum(least(n, 125)) * 80 // 100 FROM n WHERE "window" = 'learning' AND chat_type = 'group')
 AND coalesce(sum(CASE WHEN "window" = 'acceptance' AND chat_type = 'group' AND held THEN least(n, 25) END), 0) >= (SELECT sum(least(n, 25)) * 20 // 100 FROM n WHERE "window" = 'acceptance' AND chat_type = 'group'))
SELECT CAST(attempt AS INTEGER) AS attempt, chat_id FROM h WHERE held AND attempt = (SELECT min(attempt) FROM ok)""")
def holdout_search(spark, d):
    """The first of 200 holdouts that leaves 80 % of the groups' learning capacity and holds 20 % of their acceptance capacity."""
    w = S.time_windows(examples(spark, d)).filter("window is not null")
    n = w.groupBy("chat_id", "chat_type", "window").agg(F.count(F.lit(1)).alias("n"))
    cap = lambda w, c: F.sum(F.when((F.col("window") == w) & (F.col("chat_type") == "group"), F.least("n", F.lit(c))))
    total = n.agg(cap("learning", 125).alias("l"), cap("acceptance", 25).alias("a")).first()
    needs = [("learning", "group", False, 125, (total.l or 0) * 80 // 100), ("acceptance", "group", True, 25, (total.a or 0) * 20 // 100)]
    return S.holdout_search(n, needs, 0.2, attempts=200)


@query(f"""WITH {_EX}, b AS (SELECT chat_type, familiarity, count(*) AS n FROM (SELECT *, CASE WHEN prior_interactions > 0 THEN 'familiar' ELSE 'observed_first' END AS familiarity FROM exs) GROUP BY ALL),
o AS (SELECT chat_type, familiarity, sum(n) OVER (ORDER BY chat_type, familiarity) - n AS base FROM b)
SELECT example_id AS id, CAST((base + row_number() OVER (PARTITION BY chat_type, familiarity ORDER BY sha256('42:' || example_id), example_id) - 1) % 4 AS INTEGER) AS batch
FROM (SELECT *, CASE WHEN prior_interactions > 0 THEN 'familiar' ELSE 'observed_first' END AS familiarity FROM exs) JOIN o USING (chat_type, familiarity)""")
def seal_batches(spark, d):
    return S.seal_batches(examples(spark, d).withColumnRenamed("example_id", "id"), 4, ["chat_type", "familiarity"]).select("id", "batch")


@query("""WITH r AS (SELECT l_orderkey AS target_id, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) - 1 AS recall_rank, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linestatus = 'O' AS object_match, l_partkey FROM lineitem),
s AS (SELECT *, recall_rank < 1 AS is_baseline, CAST(least(2, floor(3 * recall_rank / n)) AS INTEGER) AS band FROM r),
k AS (SELECT *, CASE WHEN is_baseline THEN 0 ELSE row_number() OVER (PARTITION BY target_id, is_baseline, band, object_match ORDER BY sha256('42:' || target_id || ':' || id), id, recall_rank) END AS rr FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY is_baseline DESC, rr, band, object_match DESC, id, recall_rank) AS place FROM k) SELECT target_id, recall_rank, band, place FROM p WHERE place <= 3 OR is_baseline""")
def stratified_candidates(spark, d):
    """Lines of an order as candidates: the dearest is the baseline, three are taken."""
    o = Window.partitionBy("l_orderkey")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.row_number().over(o.orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")) - 1).cast("long").alias("recall_rank"),
        F.count(F.lit(1)).over(o).alias("n"), (F.col("l_linestatus") == "O").alias("object_match"),
    ).withColumn("is_baseline", F.col("recall_rank") < 1)
    return S.stratified_candidates(rows, 3).select("target_id", "recall_rank", "band", "place")


@query("""WITH t AS (SELECT o_custkey AS target_id, min(o_orderpriority) AS priority, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY priority, target_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t)
SELECT target_id, priority, n, CAST(least(n, 5000 - b) AS BIGINT) AS take FROM b WHERE b < 5000""")
def cap_observations(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("target_id")).agg(F.min("o_orderpriority").alias("priority"), F.count(F.lit(1)).alias("n"))
    return S.cap_observations(t, 5000)


_TS = f"""{_EX}, t AS (SELECT list(cutoff_ts ORDER BY cutoff_ts) AS l FROM exs), bd AS (SELECT l[CAST(floor(len(l) * 0.8) AS INT) + 1] AS x FROM t),
mat AS (SELECT e.example_id AS target_id, f.end_ts, f.reply_ids FROM exs e JOIN exs f ON f.chat_id = e.chat_id AND f.prior_interactions = e.prior_interactions + 1),
val AS (SELECT example_id AS target_id, reply_ids FROM exs, bd WHERE cutoff_ts >= x), fit AS (SELECT example_id AS target_id FROM exs, bd WHERE cutoff_ts < x)"""


@query(f"""WITH {_TS}, bad AS (SELECT target_id FROM mat, bd WHERE end_ts >= x UNION SELECT m.target_id FROM (SELECT target_id, unnest(string_split(reply_ids, ',')) AS i FROM mat) m JOIN (SELECT unnest(string_split(reply_ids, ',')) AS i FROM val) v USING (i))
SELECT target_id, 'fit' AS split FROM fit WHERE target_id NOT IN (SELECT target_id FROM bad) UNION ALL SELECT target_id, 'validation' FROM val""")
def temporal_split(spark, d):
    """A target's material is the next example of its chat."""
    e = examples(spark, d)
    nxt = e.select("chat_id", (F.col("prior_interactions") - 1).alias("prior_interactions"), "end_ts", F.col("reply_ids").alias("message_ids"))
    material = e.select("chat_id", "prior_interactions", F.col("example_id").alias("target_id")).join(nxt, ["chat_id", "prior_interactions"]).select("target_id", "end_ts", "message_ids")
    return S.temporal_split(e.select(F.col("example_id").alias("target_id"), "cutoff_ts", F.col("reply_ids").alias("answer_ids")), material)


@query(f"WITH {_EX} SELECT chat_id, reply_start, prior_interactions FROM exs")
def prior_interactions(spark, d):
    """Earlier retained examples of the chat."""
    return examples(spark, d).select("chat_id", "reply_start", "prior_interactions")
