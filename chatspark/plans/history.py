"""Queries: ingest, audits and eligibility joins, over `events`, `conversations`, `orders` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatspark.operators import audit as A
from chatspark.operators import eligibility as E
from chatspark.operators import splits as S
from chatspark.plans.corpus import _EX, _WIN, examples
from chatspark.plans.registry import query
from chatspark.plans.tables import DLG, MSG, dialogue, messages, table

#: CTE raw: events with a seventh repeated and, of these, those divisible by 21 changed
RAW = """raw AS (SELECT user_id AS chat_id, event_id, event_type AS kind, value, 0 AS copy FROM events UNION ALL SELECT user_id, event_id, event_type, CASE WHEN event_id % 21 = 0 THEN value + 1 ELSE value END, 1 FROM events WHERE event_id % 7 = 0)"""


def raw(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("chat_id"), "event_id", F.col("event_type").alias("kind"), "value")
    again = e.filter("event_id % 7 = 0").withColumn("value", F.when(F.col("event_id") % 21 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return e.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))


@query(f"WITH {RAW} SELECT chat_id, event_id, count(DISTINCT kind || '|' || value) AS contents, count(*) AS copies FROM raw GROUP BY ALL HAVING contents > 1")
def ev_dedupe_conflicts(spark, d):
    return A.dedupe_events(raw(spark, d), ["chat_id", "event_id"], ["kind", "value"], ["copy"])[1]


@query(f"WITH {RAW} SELECT chat_id, event_id, kind, value FROM raw WHERE copy = 0")
def ev_dedupe(spark, d):
    return A.dedupe_events(raw(spark, d), ["chat_id", "event_id"], ["kind", "value"], ["copy"])[0].select("chat_id", "event_id", "kind", "value")


@query(f"WITH {RAW} SELECT kind, count(*) AS raw, count(DISTINCT (chat_id, event_id)) AS retained, count(*) - count(DISTINCT (chat_id, event_id)) AS duplicates FROM raw GROUP BY kind")
def ev_dedupe_counts(spark, d):
    return A.dedupe_counts(raw(spark, d), ["chat_id", "event_id"], "kind")


@query("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS occurrence FROM events")
def ev_fallback_occurrence(spark, d):
    return A.fallback_occurrence(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("WITH a AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS account FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT o_orderkey, 'group:' || coalesce(account, 'unknown') || ':' || o_custkey AS chat_key FROM orders LEFT JOIN a USING (o_custkey)")
def ev_chat_key(spark, d):
    o = table(spark, d, "orders").withColumn("kind", F.lit("group")).withColumn("own", F.col("o_orderstatus") == "F")
    return A.chat_key(o, "o_custkey", "o_orderpriority", "own", "o_orderkey", "kind", "o_custkey").select("o_orderkey", "chat_key")


@query(f"""WITH {MSG} SELECT message_id, sha256('{{"chat_id":"' || chat_id || '"}},{{"ts":"' || ts || '"}},{{"text":"' || text || '"}}') AS identity FROM msg""")
def msg_identity(spark, d):
    return messages(spark, d).select("message_id", A.message_identity("chat_id", "ts", "text").alias("identity"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3', 'src7') AND text IS NOT NULL AND n_chars > 0")
def trusted_filter(spark, d):
    return table(spark, d, "documents").filter(F.col("source").isin("src0", "src3", "src7") & F.col("text").isNotNull() & (F.col("n_chars") > 0)).select("doc_id", "source")


_AUD = f"""{_WIN}, au AS (SELECT w.*, m.ts AS reply_ts FROM win w JOIN msg m ON m.chat_id = w.chat_id AND m.pos = w.reply_start)"""


def _audited(spark, d):
    e = S.time_windows(examples(spark, d)).filter("window is not null").withColumn("n_reply", F.size("reply"))
    first = messages(spark, d).select("chat_id", F.col("pos").alias("reply_start"), F.col("ts").alias("reply_ts"))
    return e.join(first, ["chat_id", "reply_start"]).withColumnRenamed("window", "role")


@query(f"""WITH {_AUD} SELECT "window" AS role, count(*) AS total, {', '.join(f"CAST(sum(CAST(reply_ts - cutoff_ts > {x} AS BIGINT)) AS BIGINT) AS over_{x}" for x in A.GAP_LIMITS)}, max(reply_ts - cutoff_ts) AS largest_gap, CAST(sum(CAST(n_reply > 1 AS BIGINT)) AS BIGINT) AS multi, CAST(sum(CAST(chat_type = 'group' AS BIGINT)) AS BIGINT) AS group_rows, count(DISTINCT chat_id) AS chats FROM au WHERE "window" IS NOT NULL GROUP BY ALL""")
def data_audit(spark, d):
    return A.data_audit(_audited(spark, d), ["role"])


@query(f"""WITH {_WIN}, i AS (SELECT DISTINCT "window" AS role, unnest(string_split(context_ids || ',' || reply_ids, ',')) AS id FROM win WHERE "window" IS NOT NULL), p AS (SELECT * FROM (VALUES ('learning', 'development'), ('learning', 'acceptance'), ('development', 'acceptance')) t(role_a, role_b))
SELECT role_a, role_b, (SELECT count(*) FROM i a JOIN i b ON a.id = b.id AND a.role = role_a AND b.role = role_b) AS shared FROM p""")
def role_isolation(spark, d):
    e = S.time_windows(examples(spark, d)).filter("window is not null").select(F.col("window").alias("role"), F.concat("context_ids", "reply_ids").alias("ids"))
    return A.role_isolation(e, [("learning", "development"), ("learning", "acceptance"), ("development", "acceptance")])


@query(f"""WITH {RAW}, a AS (SELECT * FROM raw WHERE event_id % 10 <> 3 UNION ALL SELECT * FROM raw WHERE event_id % 50 = 1), s AS (SELECT chat_id, event_id, kind, count(*) AS s FROM raw GROUP BY ALL), b AS (SELECT chat_id, event_id, kind, count(*) AS a FROM a GROUP BY ALL)
SELECT kind, CAST(sum(coalesce(s, 0)) AS BIGINT) AS source, CAST(sum(coalesce(a, 0)) AS BIGINT) AS archived, CAST(sum(least(coalesce(s, 0), coalesce(a, 0))) AS BIGINT) AS retained, CAST(sum(greatest(coalesce(s, 0) - coalesce(a, 0), 0)) AS BIGINT) AS missing, CAST(sum(greatest(coalesce(a, 0) - coalesce(s, 0), 0)) AS BIGINT) AS extra FROM s FULL JOIN b USING (chat_id, event_id, kind) GROUP BY kind""")
def import_coverage(spark, d):
    source = raw(spark, d)
    archive = source.filter("event_id % 10 != 3").unionByName(source.filter("event_id % 50 = 1"))
    return A.import_coverage(source, archive, ["chat_id", "event_id"], "kind")


@query(f"""WITH {_EX}, c AS (SELECT chat_type, chat_id, count(*) AS n FROM exs GROUP BY ALL), b AS (SELECT chat_type, CAST(sum(n) AS BIGINT) AS cases, count(*) AS chats, CAST(sum(least(n, 5)) AS BIGINT) AS capacity, CAST(sum(n) // 2 AS BIGINT) AS required FROM c GROUP BY chat_type),
t AS (SELECT chat_type, k, sum(least(n, k)) AS have FROM c, (SELECT unnest(range(1, 201)) AS k) GROUP BY ALL) SELECT b.*, CAST((SELECT min(k) FROM t WHERE t.chat_type = b.chat_type AND have >= required) AS INTEGER) AS minimum_cap FROM b""")
def capacity_report(spark, d):
    return A.capacity_report(examples(spark, d), ["chat_type"], F.floor(F.col("cases") / 2), 5)


@query(f"""WITH {_WIN} SELECT "window" AS role, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS fingerprint, count(*) AS n FROM win WHERE "window" IS NOT NULL GROUP BY ALL""")
def io_fingerprint(spark, d):
    return A.set_fingerprint(S.time_windows(examples(spark, d)).filter("window is not null").withColumnRenamed("window", "role"), ["role"], "example_id")


@query("WITH a AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 4 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0) SELECT id, count(DISTINCT text) > 1 AS conflict FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def role_union(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    b = docs.filter("id % 2 = 0").withColumn("text", F.when(F.col("id") % 10 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    union, bad = A.role_union(docs.filter("id % 3 != 0"), b, ["text"])
    return union.select("id").join(bad.withColumn("conflict", F.lit(True)), "id", "left").na.fill(False, ["conflict"])


_ELIG = f"""{_EX}, cases AS (SELECT example_id AS case_id, chat_type, chat_id, cutoff_ts, string_split(reply_ids, ',') AS r FROM exs WHERE reply_start % 9 = 4),
pool AS (SELECT example_id, chat_type, chat_id, end_ts, string_split(context_ids || ',' || reply_ids, ',') AS ids FROM exs),
elig AS (SELECT case_id, example_id, c.cutoff_ts, p.end_ts FROM cases c JOIN pool p ON p.chat_type = c.chat_type AND p.chat_id % 10 = c.chat_id % 10 WHERE p.end_ts < c.cutoff_ts AND p.chat_id % 7 <> 2 AND NOT list_has_any(p.ids, c.r))"""


def _eligible_sides(spark, d):
    """All examples as cases, and as their pool."""
    e = examples(spark, d).withColumn("kin", F.col("chat_id") % 10)
    barred = F.transform(F.sequence(F.lit(2), F.lit(149), F.lit(7)), lambda x: x.cast("long"))
    cases = e.select(F.col("example_id").alias("case_id"), "chat_type", "kin", "cutoff_ts", "reply_ids", F.filter(barred, lambda x: x % 10 == F.col("kin")).alias("excluded"), "reply_start")
    pool = e.filter("chat_id % 7 != 2 or chat_id < 150").select("example_id", "chat_type", "kin", "chat_id", "end_ts", F.concat("context_ids", "reply_ids").alias("ids"))
    return cases, pool


def _eligible(spark, d):
    cases, pool = _eligible_sides(spark, d)
    return E.eligible_history(cases.filter("reply_start % 9 = 4"), pool, ["chat_type", "kin"])


@query(f"WITH {_ELIG} SELECT case_id, example_id FROM elig")
def eligible_history(spark, d):
    """History of like chats that a case may see; chats of one remainder are held out."""
    return _eligible(spark, d).select("case_id", "example_id")


@query(f"WITH {_ELIG} SELECT case_id, example_id, cutoff_ts - end_ts AS age, CAST({' + '.join(f'CAST(cutoff_ts - end_ts > {86400 * x} AS INT)' for x in (1, 7, 30, 90, 365))} AS INTEGER) AS age_bin FROM elig")
def history_age(spark, d):
    return E.history_age(_eligible(spark, d)).select("case_id", "example_id", "age", "age_bin")


_NEWEST = _ELIG.replace(" WHERE reply_start % 9 = 4", "")


@query(f"WITH {_NEWEST}, l AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY end_ts DESC, example_id DESC) - 1 AS INTEGER) AS rank FROM elig) SELECT case_id, example_id, rank, cutoff_ts - end_ts AS age, CAST({' + '.join(f'CAST(cutoff_ts - end_ts > {86400 * x} AS INT)' for x in (1, 7, 30, 90, 365))} AS INTEGER) AS age_bin FROM l WHERE rank < 12")
def eligible_latest(spark, d):
    """The twelve newest examples that each example, taken as a case, may see, with their ages."""
    newest = E.latest_eligible(*_eligible_sides(spark, d), ["chat_type", "kin"], 12)
    return E.history_age(newest).select("case_id", "example_id", "rank", "age", "age_bin")


@query(f"WITH {_EX} SELECT example_id FROM exs WHERE chat_id % 7 <> 2")
def heldout_exclusion(spark, d):
    e = examples(spark, d)
    held = e.filter("chat_id % 7 = 2").select("chat_id").distinct()
    return e.join(held, "chat_id", "left_anti").select("example_id")


@query(f"WITH {_EX}, a AS (SELECT DISTINCT unnest(string_split(reply_ids, ',')) AS i FROM exs WHERE prior_interactions % 6 = 5) SELECT DISTINCT example_id FROM (SELECT example_id, unnest(string_split(context_ids, ',')) AS i FROM exs) JOIN a USING (i)")
def answer_overlap(spark, d):
    """Examples whose context holds an answer of some target."""
    e = examples(spark, d)
    answers = e.filter("prior_interactions % 6 = 5").select(F.explode("reply_ids").alias("i")).distinct()
    return e.select("example_id", F.explode("context_ids").alias("i")).join(answers, "i", "left_semi").select("example_id").distinct()


@query(f"WITH {_ELIG}, v AS (SELECT c.example_id AS case_id, p.example_id FROM exs c JOIN exs p ON p.chat_id = c.chat_id AND p.prior_interactions < c.prior_interactions WHERE list_has_any(string_split(p.reply_ids, ','), string_split(c.context_ids, ','))) SELECT c.example_id AS case_id, p.example_id FROM exs c JOIN exs p ON p.chat_id = c.chat_id AND p.prior_interactions < c.prior_interactions WHERE (c.example_id, p.example_id) NOT IN (SELECT case_id, example_id FROM v)")
def visible_reply_exclusion(spark, d):
    """Earlier examples of the chat whose reply isn't in the case's context already."""
    e = examples(spark, d)
    old = e.select("chat_id", F.col("example_id").alias("old_id"), F.col("prior_interactions").alias("p"), "reply_ids")
    pairs = e.select("chat_id", F.col("example_id").alias("case_id"), "prior_interactions").join(old.drop("reply_ids"), "chat_id").filter("p < prior_interactions").select("case_id", F.col("old_id").alias("example_id"))
    seen = e.select("chat_id", F.col("example_id").alias("case_id"), F.explode("context_ids").alias("i")).join(old.select("chat_id", F.col("old_id").alias("example_id"), F.explode("reply_ids").alias("i")), ["chat_id", "i"]).select("case_id", "example_id").distinct()
    return pairs.join(seen, ["case_id", "example_id"], "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 100 = 3)")
def reserved_exclusion(spark, d):
    o = table(spark, d, "orders")
    return o.join(o.filter("o_orderkey % 100 = 3").select("o_custkey").distinct(), "o_custkey", "left_anti").select("o_orderkey")


@query(f"""WITH {DLG}, q AS (SELECT chat_id, message_id, message_id - 1 AS quoted_id, pos FROM dlg WHERE pos % 2 = 1), t AS (SELECT q.*, p.text AS orig FROM q LEFT JOIN dlg p ON p.message_id = q.quoted_id)
SELECT message_id, CASE WHEN message_id % 5 = 0 THEN 'missing' WHEN orig IS NULL THEN 'missing' WHEN message_id % 3 = 0 THEN 'text_mismatch' ELSE 'resolved' END AS state FROM t""")
def quote_resolution(spark, d):
    """Odd turns quote the turn before; some quotes name no message, some a changed text."""
    m = dialogue(spark, d)
    before = m.select("chat_id", (F.col("message_id") + 1).alias("message_id"), F.col("text").alias("orig"))
    q = m.filter("pos % 2 = 1").select("chat_id", "message_id").join(before, ["chat_id", "message_id"], "left")
    quotes = q.select("chat_id", "message_id", F.when(F.col("message_id") % 5 == 0, -1).otherwise(F.col("message_id") - 1).alias("quoted_id"), F.when(F.col("message_id") % 3 == 0, F.concat("orig", F.lit("?"))).otherwise(F.col("orig")).alias("quoted_text"))
    return E.quote_resolution(quotes, m).select("message_id", "state")


@query(f"""WITH {DLG}, m AS (SELECT *, ts // 86400 AS day, role AS sender FROM dlg), a AS (SELECT message_id AS anchor_id, day, sender, chat_id, CASE WHEN message_id % 2 = 0 THEN substr(text, 1, 20) ELSE text END AS text FROM m),
g AS (SELECT a.anchor_id, count(*) AS n, min(m.message_id) AS id FROM a JOIN m ON m.day = a.day AND m.sender = a.sender AND m.chat_id = a.chat_id WHERE a.text = m.text OR (length(a.text) >= 16 AND starts_with(m.text, a.text)) GROUP BY 1)
SELECT anchor_id, CASE WHEN n = 1 THEN id END AS message_id, coalesce(n, 0) AS matches FROM a LEFT JOIN g USING (anchor_id)""")
def anchor_match(spark, d):
    m = dialogue(spark, d).withColumn("day", F.floor(F.col("ts") / 86400)).withColumn("sender", F.col("role"))
    anchors = m.select(F.col("message_id").alias("anchor_id"), "day", "sender", "chat_id", F.when(F.col("message_id") % 2 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("text"))
    return E.anchor_match(anchors, m)


@query("""WITH r AS (SELECT o_custkey AS record_id, o_custkey % 10 AS account, o_orderkey AS message_id FROM orders), m AS (SELECT o_orderkey AS message_id, o_custkey % 10 AS account, o_orderdate, o_orderkey FROM orders WHERE o_orderkey % 200 <> 1)
SELECT record_id, bool_and(coalesce(m.account = r.account AND m.o_orderdate < TIMESTAMP '2001-06-01' AND m.message_id % 150 <> 2 AND m.message_id % 170 <> 3, false)) AS admitted FROM r LEFT JOIN m USING (message_id) GROUP BY record_id""")
def evidence_prior(spark, d):
    """A customer is a record, its orders the evidence."""
    o = table(spark, d, "orders")
    records = o.groupBy(F.col("o_custkey").alias("record_id")).agg((F.first("o_custkey") % 10).alias("account"), F.collect_list("o_orderkey").alias("evidence"))
    m = o.filter("o_orderkey % 200 != 1").select(F.col("o_orderkey").alias("message_id"), (F.col("o_custkey") % 10).alias("account"), "o_orderdate")
    answers = o.filter("o_orderkey % 170 = 3").select(F.col("o_orderkey").alias("message_id"))
    return E.evidence_prior(records, m, F.col("o_orderdate") < F.lit("2001-06-01").cast("timestamp"), F.col("message_id") % 150 == 2, answers)


@query(f"""WITH {_EX}, mt AS (SELECT chat_id % 12 AS material_id, chat_id, unnest(string_split(context_ids || ',' || reply_ids, ',')) AS i, end_ts FROM exs WHERE prior_interactions % 2 = 0),
c AS (SELECT min(cutoff_ts) AS f FROM exs WHERE prior_interactions % 4 = 2), a AS (SELECT DISTINCT unnest(string_split(reply_ids, ',')) AS i FROM exs WHERE prior_interactions % 4 = 2)
SELECT material_id, count(DISTINCT i) FILTER (chat_id % 5 = 0) AS unseen_messages, count(DISTINCT i) FILTER (i IN (SELECT i FROM a)) AS answer_messages, max(end_ts) >= (SELECT f FROM c) AS future FROM mt GROUP BY material_id""")
def material_conflicts(spark, d):
    e = examples(spark, d)
    item = F.transform(F.concat("context_ids", "reply_ids"), lambda x: F.struct(F.col("chat_id").alias("chat_id"), x.alias("message_id")))
    materials = e.filter("prior_interactions % 2 = 0").groupBy((F.col("chat_id") % 12).alias("material_id")).agg(F.max("end_ts").alias("end_ts"), F.flatten(F.collect_list(item)).alias("messages"))
    return E.material_conflicts(materials, e.filter("prior_interactions % 4 = 2"), e.filter("chat_id % 5 = 0").select("chat_id"))


@query(f"""WITH {_EX}, t AS (SELECT * FROM exs WHERE prior_interactions % 5 = 1), i AS (SELECT DISTINCT unnest(string_split(context_ids || ',' || reply_ids, ',')) AS i FROM t), f AS (SELECT example_id AS case_id, cutoff_ts, reply_ids, 1705276800 > cutoff_ts AS trained_after, example_id IN (SELECT example_id FROM t) AS same_case FROM exs),
g AS (SELECT *, EXISTS (SELECT 1 FROM i WHERE list_contains(string_split(f.reply_ids, ','), i.i)) AS answer_overlap FROM f) SELECT case_id, trained_after, same_case, answer_overlap, NOT trained_after AND NOT same_case AND NOT answer_overlap AS eligible FROM g""")
def teacher_overlap(spark, d):
    e = examples(spark, d).withColumnRenamed("example_id", "case_id")
    return E.teacher_overlap(e, e.filter("prior_interactions % 5 = 1").select("case_id", F.concat("context_ids", "reply_ids").alias("ids")), 1705276800)


_NAMES = """names AS (SELECT DISTINCT 'i' || o_custkey AS identity, 'n' || (o_custkey % 700) AS name, o_orderkey % 3 AS chat_id FROM orders)"""


def _names(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("identity"), F.concat(F.lit("n"), (F.col("o_custkey") % 700).cast("string")).alias("name"), (F.col("o_orderkey") % 3).alias("chat_id")).distinct()


@query(f"""WITH {_NAMES}, cl AS (SELECT c_custkey AS claim_id, 'n' || (c_custkey * 3 % 900) AS owner, 'n' || (c_custkey * 7 % 1100) AS alias, c_custkey % 3 AS chat_id FROM customer),
f AS (SELECT claim_id, count(DISTINCT identity) AS n, min(identity) AS i FROM cl JOIN names nm ON nm.chat_id = cl.chat_id AND (nm.name = cl.owner OR nm.name = cl.alias) GROUP BY 1)
SELECT claim_id, coalesce(n, 0) AS identities, CASE WHEN n = 1 THEN i END AS identity, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM cl LEFT JOIN f USING (claim_id)""")
def alias_identity_join(spark, d):
    k = F.col("c_custkey")
    claims = table(spark, d, "customer").select(k.alias("claim_id"), F.concat(F.lit("n"), (k * 3 % 900).cast("string")).alias("owner"), F.concat(F.lit("n"), (k * 7 % 1100).cast("string")).alias("alias"), (k % 3).alias("chat_id"))
    return E.alias_identity_join(claims, _names(spark, d))


@query(f"""WITH {_NAMES}, pg AS (SELECT p_partkey AS page_id, 'i' || (p_partkey * 2) AS file_name, 'n' || p_partkey AS title FROM part), t AS (SELECT page_id, count(DISTINCT identity) AS n, min(identity) AS i FROM pg JOIN names ON name = title GROUP BY 1)
SELECT page_id, CASE WHEN file_name IN (SELECT identity FROM names) THEN file_name WHEN n = 1 THEN i END AS identity, CASE WHEN file_name IN (SELECT identity FROM names) THEN 'file_name' WHEN n = 1 THEN 'title' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS route FROM pg LEFT JOIN t USING (page_id)""")
def identity_candidates(spark, d):
    p = table(spark, d, "part")
    pages = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("i"), (F.col("p_partkey") * 2).cast("string")).alias("file_name"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("title"))
    return E.identity_candidates(pages, _names(spark, d))


@query("""WITH r AS (SELECT l_orderkey AS record_id, l_orderkey % 3 AS account, l_orderkey % 2 = 0 AS self_report, l_suppkey % 3 = l_orderkey % 3 AS own, l_returnflag = 'R' AS forwarded FROM lineitem), g AS (SELECT record_id, self_report, bool_or(own) AS any_own, bool_or(own AND NOT forwarded) AS direct FROM r GROUP BY ALL)
SELECT record_id, CASE WHEN NOT any_own THEN 'account_without_source' ELSE 'self_report_without_author' END AS issue FROM g WHERE NOT any_own OR (self_report AND NOT direct)""")
def attribution_issues(spark, d):
    """An order is a record, its lines the evidence, the supplier's remainder the sender."""
    l = table(spark, d, "lineitem").withColumn("message_id", F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")]))  # noqa: E741
    records = l.groupBy(F.col("l_orderkey").alias("record_id")).agg((F.first("l_orderkey") % 3).alias("account"), (F.first("l_orderkey") % 2 == 0).alias("self_report"), F.collect_set("message_id").alias("evidence"))
    sources = l.select("message_id", (F.col("l_suppkey") % 3).alias("sender"), (F.col("l_returnflag") == "R").alias("forwarded")).distinct()
    return E.attribution_issues(records, sources)


@query("WITH t AS (SELECT DISTINCT sha256('v1:' || text) AS task, length(text) AS chars FROM documents) SELECT task, chars FROM t WHERE task NOT IN (SELECT sha256('v1:' || text) FROM documents WHERE doc_id % 4 = 0)")
def feature_tasks(spark, d):
    docs = table(spark, d, "documents")
    return E.feature_tasks(docs, docs.filter("doc_id % 4 = 0").select(F.sha2(F.concat(F.lit("v1:"), "text"), 256).alias("task")), "v1")


@query("""WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id FROM customer WHERE c_custkey % 7 <> 3 UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 50 = 1), w AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'failed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 9 > 0 THEN 'timeout' WHEN o_orderkey % 2 = 0 THEN '' END AS reason, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 2 = 0 END AS a, o_orderkey % 3 = 0 AS b FROM orders),
pc AS (SELECT case_id, count(*) AS n FROM p GROUP BY 1), wc AS (SELECT case_id, count(*) AS n FROM w GROUP BY 1)
SELECT case_id, 'plan_repeated' AS issue FROM pc WHERE n > 1 UNION SELECT case_id, 'missing' FROM pc WHERE case_id NOT IN (SELECT case_id FROM wc) UNION SELECT case_id, 'foreign' FROM wc WHERE case_id NOT IN (SELECT case_id FROM pc) UNION SELECT case_id, 'repeated' FROM wc WHERE n > 1
UNION SELECT case_id, 'bad_status' FROM w WHERE status = 'open' UNION SELECT case_id, 'no_reason' FROM w WHERE status = 'failed' AND coalesce(reason, '') = '' UNION SELECT case_id, 'no_verdict' FROM w WHERE status = 'ok' AND (a IS NULL OR b IS NULL)""")
def journal_contract(spark, d):
    """Customers are the plan, some of them twice; their orders the journal's rows."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    planned = c.filter("c_custkey % 7 != 3").unionByName(c.filter("c_custkey % 50 = 1")).select(F.col("c_custkey").alias("case_id"))
    k = F.col("o_orderkey")
    written = o.select(
        F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "failed").otherwise("open").alias("status"),
        F.when(k % 9 > 0, "timeout").when(k % 2 == 0, "").alias("reason"), F.when(k % 11 > 0, k % 2 == 0).alias("a"), (k % 3 == 0).alias("b"),
    )
    return A.journal_contract(planned, written, ["a", "b"])
