"""Queries: roles, event normalisation, sources and sinks, streams. Streams read the event table's files; batch twins are in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatspark.functions import events as E
from chatspark.operators import conversation as C
from chatspark.operators import patterns as P
from chatspark.operators import roles as L
from chatspark.operators import splits as S
from chatspark.plans.corpus import _EX, _WIN, WIDE, examples
from chatspark.plans.registry import query
from chatspark.plans.tables import messages, table
from chatspark.sources import io
from chatspark.sources.scratch import folder
from chatspark.streaming import jobs as J


def _pool(spark, d):
    return S.time_windows(examples(spark, d)).select(F.col("example_id").alias("id"), "chat_id", "chat_type", "window", F.concat("context_ids", "reply_ids").alias("ids"))


def _ranked(rel: str, seed: int, cap: int, group: int, private: int) -> str:
    return f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY chat_type ORDER BY sha256('{seed}:' || id), id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY sha256('{seed}:' || id), id) AS c FROM {rel}) WHERE c <= {cap}) WHERE k <= CASE chat_type WHEN 'group' THEN {group} ELSE {private} END"


@query(f"""WITH {_WIN}, p AS (SELECT example_id AS id, chat_id, chat_type, "window" AS w, string_split(context_ids || ',' || reply_ids, ',') AS ids FROM win), learn AS (SELECT * FROM p WHERE w = 'learning' AND chat_id % 6 <> 1), dv AS (SELECT * FROM p WHERE w = 'development'), dev AS ({_ranked('dv', 42, 3, 30, 10)}),
occ AS (SELECT list(DISTINCT i) AS l FROM (SELECT unnest(ids) AS i FROM p WHERE id IN (SELECT id FROM dev))), ac AS (SELECT p.* FROM p, occ WHERE w = 'acceptance' AND NOT list_has_any(ids, coalesce(l, [])))
SELECT 'gen_learning' AS role, id FROM learn UNION ALL SELECT 'gen_optimization', id FROM ({_ranked('learn', 42, 5, 30, 10)}) UNION ALL SELECT 'judge_training', id FROM ({_ranked('learn', 43, 5, 12, 12)}) UNION ALL SELECT 'development', id FROM dev UNION ALL SELECT 'judge_development', id FROM dev UNION ALL SELECT 'fixed_test', id FROM ({_ranked('ac', 42, 3, 30, 10)})""")
def plan_roles(spark, d):
    path = folder(spark)
    _pool(spark, d).write.parquet(path)  # six roles are drawn from it
    p = spark.read.parquet(path)
    held = p.filter("chat_id % 6 = 1").select("chat_id")
    return L.plan_roles(p, held, 40, 24, cap=3, learning_cap=5)


@query(f"""WITH {_EX}, p AS (SELECT example_id AS id, chat_id, chat_type FROM exs), r AS (SELECT *, row_number() OVER (PARTITION BY chat_type ORDER BY sha256('42:' || id), id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY sha256('42:' || id), id) AS c FROM p) WHERE c <= 2)
SELECT id, chat_type, CAST(row_number() OVER (ORDER BY k, chat_type) AS INTEGER) AS place FROM r WHERE k <= CASE chat_type WHEN 'group' THEN 40 ELSE 15 END""")
def take_testset(spark, d):
    return L.take_testset(_pool(spark, d).select("id", "chat_id", "chat_type"), 40, 15, 2).select("id", "chat_type", "place")


@query(f"WITH {_EX}, p AS (SELECT example_id AS id, chat_id, chat_type FROM exs WHERE chat_id % 4 <> 2), q AS ({_ranked('p', 7, 2, 30, 10)}) SELECT id FROM q")
def refresh_fixed(spark, d):
    p = _pool(spark, d)
    return L.refresh_fixed(p, p.filter("chat_id % 4 = 2"), 40, 0.75, 2, 7).select("id")


@query(f"""WITH {_EX}, t AS (SELECT list(end_ts ORDER BY end_ts) AS l FROM exs), b AS (SELECT l[CAST(floor(len(l) * 0.8) AS INT) + 1] AS x FROM t) SELECT example_id, CASE WHEN end_ts >= x THEN 'tune' ELSE 'fit' END AS part FROM exs, b""")
def inner_split(spark, d):
    """The last fifth by end time is for tuning."""
    e = examples(spark, d)
    x = S.order_statistic(e, "end_ts", [0.8])[0]
    return e.select("example_id", F.when(F.col("end_ts") >= F.lit(x), "tune").otherwise("fit").alias("part"))


@query(f"""WITH {_EX}, f AS (SELECT e.*, m.ts AS reply_ts FROM exs e JOIN msg m ON m.chat_id = e.chat_id AND m.pos = e.reply_start) SELECT CASE WHEN prior_interactions % 5 = 0 THEN 'source_mismatch' WHEN reply_ts - cutoff_ts > 14400 THEN 'stale' ELSE 'kept' END AS reason, count(*) AS n FROM f GROUP BY 1""")
def clean_cases(spark, d):
    e = examples(spark, d)
    damaged = e.withColumn("context_ids", F.when(F.col("prior_interactions") % 5 == 0, F.transform("context_ids", lambda x: x + 1)).otherwise(F.col("context_ids")))
    m = messages(spark, d)
    reply = m.select("chat_id", F.col("pos").alias("reply_start"), F.col("ts").alias("reply_ts"))
    checked = C.source_reconstruct(damaged, m)
    return L.clean_cases(e.join(checked, "example_id").join(reply, ["chat_id", "reply_start"]), 14400)


@query()
def group_pattern_reuse(spark, d):
    """Replies of assistants that repeat sentences of their conversation; tested against Python's difflib."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), (F.col("conv_id") % 20).alias("chat_id"), "role", "text")
    return P.group_pattern_reuse(c.filter("role = 'assistant'").select(F.col("message_id").alias("id"), "chat_id", "text"), c.filter("role != 'assistant'"), P.ENDS.replace("[", "[."))


@query("WITH r AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS a, bool_and(l_linestatus = 'O') AS b, l_orderkey % 9 = 0 AS blocked, l_orderkey % 100 / 100 AS base FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN blocked THEN base WHEN a AND NOT b THEN 1.0 WHEN b AND NOT a THEN 0.0 WHEN abs(base - 0.5) < 0.05 THEN 0.5 ELSE base END AS decision FROM r")
def contribution_decide(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_returnflag") != "R").alias("needs_a"), F.collect_list(F.col("l_linestatus") == "O").alias("needs_b"))
    k = F.col("l_orderkey")
    return L.contribution_decide(r.withColumn("blocked", k % 9 == 0).withColumn("base", (k % 100) / 100)).select("l_orderkey", "decision")


_TYPES = [1, 3, 34, 49, 49 + (57 << 32), 49 + (6 << 32), 77, 10000]
_KINDS = ["text", "image", "voice", "link", "quote", "file", "video", "system"]


@query("SELECT event_id, CASE WHEN event_id % 50 = 3 THEN 'quote' ELSE (['text', 'image', 'voice', 'link', 'quote', 'file', 'video', 'system'])[event_id % 8 + 1] END AS kind FROM events")
def ev_kind(spark, d):
    """Kinds of events that get a type by their id."""
    return _typed(spark, d).select("event_id", "kind")


def _typed(spark, d):
    e = table(spark, d, "events")
    i = (F.col("event_id") % 8 + 1).cast("int")
    kind = E.message_kind(F.element_at(F.array(*[F.lit(x).cast("long") for x in _TYPES]), i), F.when(i == 4, 5), F.when(i == 7, "short VIDEO").otherwise("other"), F.col("event_id") % 50 == 3)
    return e.withColumn("kind", kind)


@query("WITH k AS (SELECT *, CASE WHEN event_id % 50 = 3 THEN 'quote' ELSE (['text', 'image', 'voice', 'link', 'quote', 'file', 'video', 'system'])[event_id % 8 + 1] END AS kind FROM events) SELECT event_id, CASE WHEN kind IN ('text', 'quote') THEN trim(event_type) ELSE '[' || kind || ']' END AS text, kind IN ('text', 'quote') AS reply_eligible, kind = 'system' AS context_boundary, CASE WHEN event_id % 3 = 0 THEN 'fallback:' || sha256(user_id || '|' || event_type || '|' || props) ELSE 'platform:' || event_id END AS identity FROM k")
def ev_normalize(spark, d):
    t = _typed(spark, d)
    k = F.col("kind")
    platform = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string"))
    return t.select("event_id", E.normalized_text(F.col("event_type"), k).alias("text"), k.isin("text", "quote").alias("reply_eligible"), (k == "system").alias("context_boundary"), E.event_identity(platform, F.col("user_id"), F.col("event_type"), F.col("props")).alias("identity"))


@query("SELECT CAST(user_id AS VARCHAR) AS chat_id, event_id AS timestamp, event_type AS text FROM events")
def io_read_unified(spark, d):
    """Messages written as JSON lines and read back with the checked schema."""
    path = folder(spark)
    e = table(spark, d, "events")
    e.select(F.col("user_id").cast("string").alias("chat_id"), F.lit("group").alias("chat_type"), F.lit("s").alias("sender"), F.lit(False).alias("is_self"), F.col("event_id").alias("timestamp"), F.col("event_type").alias("text")).write.json(path)
    rows, bad = io.read_unified(spark, path)
    if not bad.isEmpty():
        raise ValueError("required fields are missing")
    return rows.select("chat_id", "timestamp", "text")


@query("SELECT conv_id AS peer, turn AS file_pos, role AS sender, length(text) AS n FROM conversations")
def io_read_export(spark, d):
    """Conversations written as one export document each and read back."""
    path = folder(spark)
    c = table(spark, d, "conversations")
    m = F.struct("turn", F.struct(F.col("text").alias("content"), F.col("role").alias("senderUsername")).alias("m"))
    doc = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("messages"))
    out = doc.select(F.to_json(F.struct(F.struct(F.lit("group").alias("type"), F.col("conv_id").cast("string").alias("wxid")).alias("session"), "messages")).alias("value"), F.col("conv_id").alias("part"))
    out.write.partitionBy("part").text(path)
    return io.read_export(spark, path).select(F.col("peer").cast("long").alias("peer"), F.col("file_pos").cast("long").alias("file_pos"), F.col("senderUsername").alias("sender"), F.length("content").alias("n"))


@query("SELECT conv_id AS case_id, turn AS line FROM conversations")
def io_read_journal(spark, d):
    """Turns written as the rows of a few journals, and read back in byte ranges."""
    path = folder(spark)
    table(spark, d, "conversations").select(F.to_json(F.struct(F.col("conv_id").alias("case_id"), F.col("turn").alias("line"))).alias("value")).write.text(path)
    rows, damage = io.read_journal(spark, path, "case_id long, line long")
    if not damage.isEmpty():
        raise ValueError("a journal is damaged")
    return rows.select("case_id", "line")


@query(f'WITH {_WIN} SELECT "window" AS role, count(*) AS total, count(DISTINCT chat_id) AS chats, CAST(sum(CAST(chat_type = \'group\' AS BIGINT)) AS BIGINT) AS group_rows FROM win WHERE "window" IS NOT NULL GROUP BY ALL')
def io_write_roles(spark, d):
    e = S.time_windows(examples(spark, d)).filter("window is not null").withColumnRenamed("window", "role")
    return io.write_roles(e.select("role", "example_id", "chat_id", "chat_type"), folder(spark))


def _stream(spark, d, files=100):
    path = folder(spark)
    e = table(spark, d, "events")
    e.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(path)
    return J.read_events(spark, path, files)


@query("SELECT event_id, user_id FROM events")
def st_dedupe(spark, d):
    """Every event twice: each stays once."""
    s = _stream(spark, d)
    return J.run_available(J.dedupe_stream(s.union(s), "40 days"), folder(spark)).select("event_id", "user_id")


@query("WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR, true) AS new FROM events), i AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), s AS (SELECT user_id, k, min(ts) AS start_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, start_ts, end_ts, n FROM s WHERE end_ts < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def st_sessions(spark, d):
    """Sessions that the watermark has closed."""
    return J.run_available(J.session_stream(_stream(spark, d)), folder(spark))


@query("SELECT date_trunc('day', ts) AS start_ts, CASE WHEN user_id % 4 = 0 THEN 'private' ELSE 'group' END AS chat_type, event_type AS kind, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL")
def st_gap_counts(spark, d):
    """Counts of the days that the watermark has closed."""
    return J.run_available(J.gap_counts_stream(_stream(spark, d)), folder(spark))


@query("""WITH w AS (SELECT epoch_ms(max(ts)) - 25200000 AS w FROM events), m AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type = 'purchase' AS own, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events, w WHERE epoch_us(ts) < w * 1000),
p AS (SELECT *, coalesce(NOT lag(own) OVER w OR ts - lag(ts) OVER w > 21600, true) AS new, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS back FROM m WINDOW w AS (PARTITION BY user_id ORDER BY r)),
b AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY r) AS k FROM p WHERE own), g AS (SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, min(back) AS back FROM b GROUP BY user_id, k)
SELECT user_id, start_ts, end_ts, n FROM g, w WHERE back > 1 OR (end_ts + 21600) * 1000 < w""")
def st_bursts(spark, d):
    """Bursts of own messages with gaps of up to six hours, of the rows that the watermark has passed; rows come in three batches, up to six hours out of order."""
    path = folder(spark)
    late = table(spark, d, "events").withColumn("_s", F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(21600)))
    a, b = late.approxQuantile("_s", [0.33, 0.67], 0.01)
    for part in ("_s < {a}", "_s >= {a} and _s < {b}", "_s >= {b}"):
        late.filter(part.format(a=a, b=b)).drop("_s").repartition(2).write.mode("append").parquet(path)
    return J.run_available(J.burst_stream(J.read_events(spark, path, 2), 21600, "7 hours"), folder(spark))


@query("SELECT user_id AS case_id, max(event_id) AS line_no, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def st_final_records(spark, d):
    """The last event of each user, kept up to date batch by batch."""
    out = folder(spark)
    s = _stream(spark, d, 2).select(F.col("user_id").alias("case_id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("status"))
    s.writeStream.foreachBatch(J.final_records_sink(out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return J.current_records(spark, out, s.schema)
