"""Queries: functions of texts, times and categories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.functions import situations as S
from chatspark.functions import text as X
from chatspark.operators.eligibility import bins as exceeded
from chatspark.plans.registry import query
from chatspark.plans.tables import DLG, MSG, dialogue, messages, table

_SURF = {k: v for k, v in X.SURFACE.items()}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{v.replace(chr(10), chr(92) + 'n')}') AS {k}" for k, v in _SURF.items()) + " FROM documents")
def surface_flags(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", *[c for c in X.surface_flags(F.col("text"))[:-1]])


@query("WITH t AS (SELECT doc_id, string_split(text, '') AS c FROM documents) SELECT doc_id, len(list_filter(range(1, len(c) - 1), lambda i: c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] NOT IN (chr(10), chr(13)))) > 0 AS repeated_character FROM t")
def repeated_character(spark, d):
    """The flag of a character that is there three times in a row."""
    return table(spark, d, "documents").select("doc_id", X.surface_flags(F.col("text"))[-1])


#: Turns and what each is, found by hand: text, form, tags, setup, target of praise, posture, expected answer.
PHRASES = [
    ("卧槽！！", "brief_exclamation", "brief_exclamation", "", None, None, "instant_reaction"),
    ("吃饭还是看电影？", "choice_question", "question", "", None, None, "direct_answer"),
    ("为什么这么晚", "wh_question", "question", "", None, None, "direct_answer"),
    ("你到家了吗", "yes_no_question", "arrival_status", "", None, None, None),
    ("行了？", "other_question", "question", "", None, None, "direct_answer"),
    ("好的", "brief_statement", "", "", None, None, None),
    ("今天的会议改到下午三点开始", "statement", "", "", None, None, None),
    ("帮我拿一下快递", "statement", "invitation_request", "task_request", None, None, "accept_decline_or_clarify"),
    ("能不能替我看看", "statement", "invitation_request", "task_request", None, None, "accept_decline_or_clarify"),
    ("晚上一起吃饭", "brief_statement", "invitation_request", "invitation", None, None, "accept_decline_or_clarify"),
    ("一起来帮忙搬家", "statement", "invitation_request", "", None, None, "accept_decline_or_clarify"),
    ("在吗", "yes_no_question", "calling_presence", "", None, None, "brief_presence"),
    ("昨天说好的那个方案我已经整理完了并且发到了群里面，大家都看过了没有意见\n 在吗", "yes_no_question", "", "", None, None, None),
    ("我太菜了，羡慕你们", "statement", "self_deprecation", "", "listener_group", "self_lowering", "downplay_or_counter_praise"),
    ("我不行了要去睡了", "statement", "", "", None, None, None),
    ("你真厉害", "brief_statement", "praise", "", "listener", None, "deflect_or_playfully_accept"),
    ("你厉害吗", "yes_no_question", "", "", None, None, None),
    ("他也太强了", "brief_statement", "praise", "", "third_party", None, "agree_or_comment"),
    ("烦死了", "brief_statement", "complaint", "emotion_vent", None, None, "acknowledge_or_share_feeling"),
    ("我下班了，在路上", "statement", "arrival_status", "", None, None, None),
    ("看这个 https://x.org", "statement", "share", "", None, None, "acknowledge_share"),
    ("就这？少装", "brief_statement", "question,teasing", "playful_teasing", None, None, "playful_counter"),
    ("有些词不知道怎么翻", "wh_question", "needs_clarification,question", "", None, None, "clarify_detail"),
    ("太坑了", "brief_statement", "needs_clarification", "", None, None, "clarify_detail"),
    ("你昨天说的那个后来怎么样", "wh_question", "question", "thread_followup", None, None, "direct_answer"),
    ("你在哪里", "wh_question", "question", "location_followup", None, None, "direct_answer"),
    ("是3号楼吗", "yes_no_question", "", "address_confirmation", None, None, None),
    ("我到了，这里是正门吗", "yes_no_question", "arrival_status", "address_confirmation", None, None, None),
    ("出来玩", "brief_statement", "calling_presence", "invitation", None, None, "brief_presence"),
    ("羡慕各位大佬", "brief_statement", "self_deprecation", "", "listener_group", "self_lowering", "downplay_or_counter_praise"),
    ("恭喜你", "brief_statement", "praise", "", "listener", None, "deflect_or_playfully_accept"),
    ("又亏了", "brief_statement", "self_deprecation", "", None, "self_lowering", "acknowledge_or_reassure"),
    (" \n", "", "", "", None, None, None),
]


def _phrase_sql(columns: dict[int, str]) -> str:
    """Each turn with the listed facts of the phrase that it gets by its place."""
    value = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ", ".join(f"({i}, {', '.join(value(p[c]) for c in columns)})" for i, p in enumerate(PHRASES))
    names = ", ".join(columns.values())
    return f"SELECT conv_id AS chat_id, turn AS pos, {names} FROM conversations JOIN (VALUES {rows}) v(k, {names}) ON (conv_id * 7 + turn) % {len(PHRASES)} = k"


def _phrases(spark, d):
    place = (F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES) + 1
    text = F.element_at(F.array(*[F.lit(p[0]) for p in PHRASES]), place.cast("int"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("pos"), text.alias("text"))


@query(_phrase_sql({2: "tags"}))
def situation_tags(spark, d):
    """Tags of turns that get a phrase by their place."""
    return _phrases(spark, d).select("chat_id", "pos", F.array_join(S.situation_tags(F.col("text")), ",").alias("tags"))


@query(_phrase_sql({4: "praise_target", 5: "speaker_posture", 6: "expected_move"}))
def situation_profile(spark, d):
    """Target of praise, posture and expected answer of turns that get a phrase by their place."""
    return _phrases(spark, d).select("chat_id", "pos", S.situation_profile(F.col("text")).alias("p")).select("chat_id", "pos", "p.*")


@query(_phrase_sql({1: "form"}))
def turn_form(spark, d):
    """Forms of turns that get a phrase by their place."""
    return _phrases(spark, d).select("chat_id", "pos", S.turn_form(F.col("text")).alias("form"))


@query(_phrase_sql({3: "setup"}))
def precise_situation(spark, d):
    """Setups of turns that get a phrase by their place."""
    return _phrases(spark, d).select("chat_id", "pos", S.precise_situation(F.col("text")).alias("setup"))


@query("SELECT a.item_id AS a, b.item_id AS b, CASE WHEN length(a.text) // 100 = length(b.text) // 100 THEN 2.5 ELSE -2.5 END + CASE WHEN a.item_id % 5 = 0 OR b.item_id % 5 = 0 THEN 0.0 WHEN a.item_id % 3 = b.item_id % 3 THEN 2.0 ELSE -2.0 END AS compat FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def profile_compat(spark, d):
    b = table(spark, d, "benchmark").withColumn("len", F.floor(F.length("text") / 100)).withColumn("kind", F.when(F.col("item_id") % 5 != 0, F.col("item_id") % 3))
    x, y = b.alias("x"), b.alias("y")
    both = x.join(y, F.col("y.item_id") == F.col("x.item_id") + 1)
    return both.select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), (X.profile_compat(F.col("x.len"), F.col("y.len"), 2.5) + X.profile_compat(F.col("x.kind"), F.col("y.kind"), 2.0)).alias("compat"))


@query(f"WITH {MSG} SELECT message_id, CAST(CAST(value > 5 AS INT) + CAST(value > 10 AS INT) + CAST(value > 20 AS INT) + CAST(value > 40 AS INT) AS INTEGER) AS bin FROM msg")
def bins(spark, d):
    return messages(spark, d).select("message_id", exceeded(F.col("value"), [5, 10, 20, 40]).alias("bin"))


@query("SELECT event_id, CAST(hour(ts + INTERVAL 8 HOUR) // 4 AS BIGINT) AS band, isodow(ts + INTERVAL 8 HOUR) >= 6 AS weekend, CAST(strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS VARCHAR) AS day FROM events")
def time_bands(spark, d):
    """Band, weekend and day in the fixed local zone."""
    local = F.from_utc_timestamp("ts", "Asia/Shanghai")
    return table(spark, d, "events").select("event_id", F.floor(F.hour(local) / 4).alias("band"), F.dayofweek(local).isin(1, 7).alias("weekend"), F.date_format(local, "yyyy-MM-dd").alias("day"))


@query(f"""WITH {MSG}, w AS (SELECT chat_id, pos, ts, is_self, length(text) AS n, ts - lag(ts) OVER c AS gap, coalesce(is_self <> lag(is_self) OVER c, false) AS switch FROM msg WINDOW c AS (PARTITION BY chat_id ORDER BY pos))
SELECT chat_id, pos, max(gap) OVER r AS largest_gap, CAST(sum(CAST(switch AS INT)) OVER r AS BIGINT) AS switches, max(CASE WHEN is_self THEN pos END) OVER p AS last_self, CAST(sum(CASE WHEN gap <= 3600 THEN 1 ELSE 0 END) OVER r AS BIGINT) AS quick, CAST(sum(n) OVER r AS BIGINT) AS chars FROM w
WINDOW r AS (PARTITION BY chat_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), p AS (PARTITION BY chat_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def turn_features(spark, d):
    """Gaps, switches, last own message and lengths of the recent turns."""
    chat = Window.partitionBy("chat_id").orderBy("pos")
    recent, before = chat.rowsBetween(-4, 0), chat.rowsBetween(Window.unboundedPreceding, -1)
    m = messages(spark, d).withColumn("gap", F.col("ts") - F.lag("ts").over(chat)).withColumn("switch", F.coalesce(F.col("is_self") != F.lag("is_self").over(chat), F.lit(False)))
    return m.select(
        "chat_id", "pos", F.max("gap").over(recent).alias("largest_gap"), F.sum(F.col("switch").cast("long")).over(recent).alias("switches"), F.max(F.when(F.col("is_self"), F.col("pos"))).over(before).alias("last_self"),
        F.sum(F.when(F.col("gap") <= 3600, 1).otherwise(0)).over(recent).alias("quick"), F.sum(F.length("text")).over(recent).alias("chars"),
    )


@query(f"""WITH {DLG}, l AS (SELECT chat_id, list(role ORDER BY pos) AS r, list(length(text) ORDER BY pos) AS n FROM dlg GROUP BY chat_id)
SELECT chat_id, r[-1] = 'user' AND r[-2] = 'assistant' AS answers_self, coalesce(r[-2] <> r[-1], false) AS speaker_changed, list_contains(r[1:-2], 'assistant') AS self_before, len(list_distinct(list_filter(r, lambda x: x <> 'assistant'))) >= 2 AS many_others FROM l""")
def participant_profile(spark, d):
    m = dialogue(spark, d).groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]).alias("r"))
    last, prev = F.element_at("r", -1), F.when(F.size("r") > 1, F.get("r", F.size("r") - 2))
    return m.select(
        "chat_id", ((last == "user") & (prev == "assistant")).alias("answers_self"), F.coalesce(prev != last, F.lit(False)).alias("speaker_changed"),
        F.array_contains(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0))), "assistant").alias("self_before"), (F.size(F.array_distinct(F.filter("r", lambda x: x != "assistant"))) >= 2).alias("many_others"),
    )


@query(f"WITH {DLG} SELECT chat_id, CASE WHEN count(DISTINCT role) FILTER (role <> 'assistant') = 1 THEN substr(sha256(chat_id || ':' || min(role) FILTER (role <> 'assistant')), 1, 12) END AS mention FROM dlg GROUP BY chat_id")
def mention_id(spark, d):
    """The only other participant of a chat, as a scoped hash."""
    other = F.when(F.col("role") != "assistant", F.col("role"))
    g = dialogue(spark, d).groupBy("chat_id").agg(F.count_distinct(other).alias("n"), F.min(other).alias("o"))
    return g.select("chat_id", F.when(F.col("n") == 1, F.substring(F.sha2(F.concat_ws(":", F.col("chat_id").cast("string"), "o"), 256), 1, 12)).alias("mention"))


@query(f"WITH {DLG} SELECT message_id, len(string_split(text, '\n')) AS bubbles, CAST(length(text) > 100 AS INT) + CAST(length(text) > 400 AS INT) + CAST(length(text) > 1600 AS INT) AS length_bin, strpos(text, '?') AS question_at, regexp_matches(string_split(text, '\n')[-1], '[.]$') AS ends_with_stop FROM dlg WHERE is_self")
def reply_local(spark, d):
    lines = F.split("text", "\n")
    return dialogue(spark, d).filter("is_self").select("message_id", F.size(lines).alias("bubbles"), exceeded(F.length("text"), [100, 400, 1600]).alias("length_bin"), F.instr("text", "?").alias("question_at"), F.element_at(lines, -1).rlike("[.]$").alias("ends_with_stop"))


_TERMS = "list_filter(string_split(regexp_replace(lower(text), '\\s+', '', 'g'), ''), lambda x: regexp_matches(x, '^[\\p{L}\\p{N}]$'))"


@query(f"WITH c AS (SELECT item_id, {_TERMS} AS c FROM benchmark), t AS (SELECT item_id, list_distinct(list_concat(c, list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]))) AS t FROM c) SELECT a.item_id, round(coalesce(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0), 6) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def token_jaccard(spark, d):
    """Neighbouring benchmark items by their characters and bigrams."""
    b = table(spark, d, "benchmark")
    x, y = b.alias("x"), b.alias("y")
    return x.join(y, F.col("y.item_id") == F.col("x.item_id") + 1).select(F.col("x.item_id").alias("item_id"), F.round(X.token_jaccard(F.col("x.text"), F.col("y.text")), 6).alias("jaccard"))


@query("SELECT o_orderkey, o_orderstatus = o_orderpriority AS equal, '[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]' AS status_priority, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - CAST(o_custkey % 5 AS INTEGER) AS ordinal FROM orders")
def category_crosses(spark, d):
    """Declared crosses of low-cardinality fields as JSON pairs, equality and ordinal difference."""
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == F.col("o_orderpriority")).alias("equal"), F.to_json(F.array("o_orderstatus", "o_orderpriority")).alias("status_priority"), (F.substring("o_orderpriority", 1, 1).cast("int") - (F.col("o_custkey") % 5).cast("int")).alias("ordinal"))


@query("SELECT a.l_orderkey AS a, a.flags = b.flags AS same, round(len(list_intersect(a.flags, b.flags)) / len(list_distinct(list_concat(a.flags, b.flags))), 6) AS jaccard FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1) b ON b.l_orderkey = a.l_orderkey + 1")
def combine_features(spark, d):
    """Equality and Jaccard of two rows' needs; neighbouring orders and their return flags."""
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    x, y = f.alias("x"), f.alias("y")
    both = x.join(y, F.col("y.l_orderkey") == F.col("x.l_orderkey") + 1)
    u = F.size(F.array_union("x.flags", "y.flags"))
    return both.select(F.col("x.l_orderkey").alias("a"), (F.col("x.flags") == F.col("y.flags")).alias("same"), F.round(F.size(F.array_intersect("x.flags", "y.flags")) / u, 6).alias("jaccard"))


@query("SELECT c_custkey, CAST(c_acctbal > 5000 AS INTEGER) || ',' || CAST(c_nationkey < 10 AS INTEGER) || ',' || CAST(c_mktsegment = 'BUILDING' AS INTEGER) || ',' || CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS options FROM customer")
def option_booleans(spark, d):
    """Threshold, boolean and one-hot options of a row as a vector."""
    flags = [F.col("c_acctbal") > 5000, F.col("c_nationkey") < 10, F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment") == "MACHINERY"]
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array(*[c.cast("int").cast("string") for c in flags]), ",").alias("options"))


@query(f"WITH {DLG} SELECT message_id, contains(text, '?') AS asks, contains(text, '!') AS exclaims, regexp_matches(text, '[0-9]') AS number, length(text) <= 80 AS short, contains(text, chr(10)) AS several_lines, contains(text, '\"') AS quotes, chat_type = 'group' AS in_group FROM dlg WHERE is_self")
def observable_booleans(spark, d):
    t = F.col("text")
    return dialogue(spark, d).filter("is_self").select("message_id", t.contains("?").alias("asks"), t.contains("!").alias("exclaims"), t.rlike("[0-9]").alias("number"), (F.length(t) <= 80).alias("short"), t.contains("\n").alias("several_lines"), t.contains('"').alias("quotes"), (F.col("chat_type") == "group").alias("in_group"))


@query(f"WITH {MSG}, b AS (SELECT message_id, chat_type = 'group' AS g, chat_id < 20 AS known, coalesce(kind = lag(kind) OVER (PARTITION BY chat_id ORDER BY pos), false) AS same FROM msg) SELECT message_id, g, known, same, g AND same AS g_same, known AND same AS known_same FROM b")
def context_crosses(spark, d):
    """Context booleans and their declared products."""
    same = F.coalesce(F.col("kind") == F.lag("kind").over(Window.partitionBy("chat_id").orderBy("pos")), F.lit(False))
    m = messages(spark, d).select("message_id", (F.col("chat_type") == "group").alias("g"), (F.col("chat_id") < 20).alias("known"), same.alias("same"))
    return m.select("*", (F.col("g") & F.col("same")).alias("g_same"), (F.col("known") & F.col("same")).alias("known_same"))


@query(f"""WITH {MSG}, f AS (SELECT chat_id, kind, min(pos) AS p FROM msg WHERE NOT is_self GROUP BY ALL) SELECT chat_id, kind, 'P' || (1 + row_number() OVER (PARTITION BY chat_id ORDER BY p)) AS speaker FROM f UNION ALL SELECT DISTINCT chat_id, 'purchase', 'P1' FROM msg WHERE is_self""")
def speaker_roster(spark, d):
    """Numbers of speakers (kinds of events) in order of first appearance, own messages being P1."""
    m = messages(spark, d)
    first = m.filter("not is_self").groupBy("chat_id", "kind").agg(F.min("pos").alias("p"))
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy("p"))
    others = first.select("chat_id", "kind", F.concat(F.lit("P"), (rank + 1).cast("string")).alias("speaker"))
    return others.unionByName(m.filter("is_self").select("chat_id", "kind", F.lit("P1").alias("speaker")).distinct())


@query("SELECT doc_id, CASE WHEN substr(sha256('pair:' || doc_id), 1, 1) < '8' THEN 'human' ELSE 'generated' END AS option_a FROM documents")
def blind_pairs(spark, d):
    """Human reply as option A by the parity of a hash; the mapping is all that is returned."""
    return table(spark, d, "documents").select("doc_id", F.when(F.substring(F.sha2(F.concat(F.lit("pair:"), F.col("doc_id").cast("string")), 256), 1, 1) < "8", "human").otherwise("generated").alias("option_a"))


@query("SELECT doc_id, CASE WHEN toxic <> quality AND doc_id % 10 >= 6 THEN toxic ELSE quality END AS verdict, CASE WHEN quality = 1 AND toxic = 0 THEN 0.0 WHEN toxic = 1 AND quality = 0 THEN 1.0 ELSE doc_id % 10 / 10 END AS shifted FROM labels")
def threshold_correct(spark, d):
    """Corrected verdicts, and base probabilities that a one-sided flag overrides."""
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, d, "labels").select("doc_id", X.threshold_correct(q, t, (F.col("doc_id") % 10) / 10, 0.6).alias("verdict"), X.owner_shift(q == 1, t == 1, (F.col("doc_id") % 10) / 10).alias("shifted"))


@query("SELECT c_custkey, regexp_matches(n, '[?？]|可能|疑似|maybe|perhaps') AS uncertain, regexp_matches(n, '[<>{}|]') AS unclean, array_to_string(list_filter(regexp_split_to_array(trim(n), '\\s*[/、,;]\\s*'), lambda x: x <> ''), '|') AS aliases FROM (SELECT c_custkey, c_name || CASE WHEN c_custkey % 5 = 0 THEN '?' WHEN c_custkey % 7 = 0 THEN ' / ' || c_mktsegment ELSE '' END AS n FROM customer)")
def alias_flags(spark, d):
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 5 == 0, "?").when(k % 7 == 0, F.concat(F.lit(" / "), "c_mktsegment")).otherwise(""))
    flags = X.alias_flags(name)
    return table(spark, d, "customer").select("c_custkey", *flags[:2], F.array_join(F.filter(F.split(F.trim(name), r"\s*[/、,;]\s*"), lambda x: x != ""), "|").alias("aliases"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '')[1:16] END AS name FROM customer")
def self_names(spark, d):
    """Naming statements outside quotations: every other customer states its name, the rest quote one."""
    said = F.regexp_replace("c_name", "#", "")
    t = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Hello. My name is "), said, F.lit("."))).otherwise(F.concat(F.lit('He wrote "my name is '), said, F.lit('" to me')))
    return table(spark, d, "customer").select("c_custkey", F.get(X.naming_statements(t), F.lit(0)).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'timeless' WHEN o_orderkey % 4 = 0 THEN 'open' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'expired' ELSE 'current' END AS state FROM orders")
def validity_state(spark, d):
    kind = F.when(F.col("o_orderstatus") == "P", "timeless").otherwise("state")
    until = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", X.validity_state(kind, until, F.lit("1998-01-01").cast("date")).alias("state"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 0.0 WHEN toxic = 1 AND quality = 0 THEN 1.0 ELSE doc_id % 10 / 10 END AS probability FROM labels")
def owner_shift_decide(spark, d):
    """A flag on one side alone overrides the base probability."""
    return table(spark, d, "labels").select("doc_id", X.owner_shift(F.col("quality") == 1, F.col("toxic") == 1, (F.col("doc_id") % 10) / 10).alias("probability"))


@query(f"WITH {MSG} SELECT message_id, chat_type = 'group' AS in_group, chat_id IN (4, 8, 15, 16, 23, 42) AS known_chat, coalesce(kind = lag(kind) OVER (PARTITION BY chat_id ORDER BY pos), false) AS same_speaker FROM msg")
def context_booleans(spark, d):
    """Chat type, known chats and recent-speaker equality."""
    same = F.coalesce(F.col("kind") == F.lag("kind").over(Window.partitionBy("chat_id").orderBy("pos")), F.lit(False))
    return messages(spark, d).select("message_id", (F.col("chat_type") == "group").alias("in_group"), F.col("chat_id").isin(4, 8, 15, 16, 23, 42).alias("known_chat"), same.alias("same_speaker"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE '' END AS names FROM customer")
def vocatives(spark, d):
    """Names that begin a line before a comma."""
    k, n = F.col("c_custkey"), F.lower("c_mktsegment")
    t = F.when(k % 3 == 0, F.concat(F.lit("well\n"), n, F.lit(", come here"))).otherwise(F.concat(F.lit("the "), n, F.lit(", it is")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(X.vocatives(t), ",").alias("names"))
