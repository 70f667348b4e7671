"""Reply bursts and their context, per chat, as window functions.

Messages have chat_id, pos (0-based place in the chat), ts (epoch seconds), is_self, boundary, chat_type,
text and message_id. Every operator is partitioned by chat_id and ordered by pos, so one shuffle serves all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Policy:
    """Gaps in seconds and the longest context, in messages."""

    context_gap: int = 7200
    response_gap: int = 600
    reply_gap: int = 120
    max_context: int = 8

    def __post_init__(self):
        if any(type(v) is not int or v <= 0 for v in (self.context_gap, self.response_gap, self.reply_gap, self.max_context)):
            raise ValueError("policy values must be positive integers")


def _chat():
    return Window.partitionBy("chat_id").orderBy("pos")


def _before():
    return _chat().rowsBetween(Window.unboundedPreceding, -1)


def own_message() -> Column:
    return F.col("is_self") & (F.trim("text") != "")


def self_runs(messages: DataFrame) -> DataFrame:
    """Adds own, gap (seconds since the previous message) and run: the number of the maximal run of own messages, null outside."""
    own = own_message()
    rows = messages.withColumn("own", own).withColumn("gap", F.col("ts") - F.lag("ts").over(_chat()))
    begins = F.col("own") & ~F.coalesce(F.lag("own").over(_chat()), F.lit(False))
    rows = rows.withColumn("run_begin", begins)
    return rows.withColumn("run", F.when(F.col("own"), F.sum(F.col("run_begin").cast("int")).over(_chat())))


def reply_bursts(runs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds in_burst: in the first part of a run without a gap over reply_gap."""
    in_run = Window.partitionBy("chat_id", "run").orderBy("pos")
    late = (~F.col("run_begin")) & (F.col("gap") > policy.reply_gap)
    return runs.withColumn("in_burst", F.col("own") & (F.sum(late.cast("int")).over(in_run) == 0))


def context_starts(messages: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds context_start of the context that would precede each message, and what comes just before it."""
    gap = F.col("ts") - F.lag("ts").over(_chat())
    rows = messages.withColumn("_gap_at", F.when(gap > policy.context_gap, F.col("pos"))).withColumn("_boundary_at", F.when(F.col("boundary"), F.col("pos") + 1))
    start = F.greatest(F.lit(0), F.col("pos") - policy.max_context, F.max("_boundary_at").over(_before()), F.max("_gap_at").over(_before()))
    rows = rows.withColumn("context_start", start.cast("long"))
    return rows.withColumn("prev_self", F.lag("is_self").over(_chat())).withColumn("prev_ts", F.lag("ts").over(_chat())).drop("_gap_at", "_boundary_at")


def burst_candidates(messages: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row per self run: its burst, context start, what is left over, and the reason (retained or why not)."""
    rows = context_starts(reply_bursts(self_runs(messages), policy), policy).filter("run is not null")
    first = lambda c: F.min_by(c, "pos")
    runs = rows.groupBy("chat_id", "chat_type", "run").agg(
        F.min("pos").alias("reply_start"), (F.max(F.when(F.col("in_burst"), F.col("pos"))) + 1).alias("end"), (F.max("pos") + 1).alias("run_end"),
        first("context_start").alias("start"), first("prev_self").alias("prev_self"), first("prev_ts").alias("cutoff_ts"), first("ts").alias("reply_ts"),
        F.max(F.when(F.col("in_burst"), F.col("ts"))).alias("end_ts"),
    )
    empty = F.col("start") >= F.col("reply_start")
    reason = F.when(empty, "no_context").when(F.col("prev_self"), "reply_to_self").when(F.col("reply_ts") - F.col("cutoff_ts") > policy.response_gap, "stale_response").otherwise("retained")
    trimmed = F.col("start") > F.greatest(F.lit(0), F.col("reply_start") - policy.max_context)
    return runs.select("chat_id", "chat_type", "start", "reply_start", "end", (F.col("run_end") - F.col("end")).alias("unattached"), "cutoff_ts", "reply_ts", "end_ts", trimmed.alias("trimmed"), reason.alias("reason"))


def extraction_counts(candidates: DataFrame) -> DataFrame:
    """(reason, n): what became of the self runs."""
    marks = F.array_compact(F.array(
        F.lit("self_runs"), F.when(F.col("unattached") > 0, "split_self_runs"), F.when(F.col("trimmed"), "trimmed_contexts"), F.col("reason"),
    ))
    counts = candidates.select(F.explode(marks).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    rest = candidates.agg(F.lit("unattached_self_messages").alias("reason"), F.coalesce(F.sum("unattached"), F.lit(0)).cast("long").alias("n"))
    return counts.unionByName(rest)


def examples(messages: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Retained bursts with their messages: ids, texts, familiarity and a content-based id."""
    kept = burst_candidates(messages, policy).filter("reason = 'retained'")
    spans = kept.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    joined = spans.join(messages.select("chat_id", "pos", "message_id", "text"), ["chat_id", "pos"])
    item = F.struct("pos", "message_id", "text")
    side = lambda cond, f: F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda x: x[f])
    before, after = F.col("pos") < F.col("reply_start"), F.col("pos") >= F.col("reply_start")
    rows = joined.groupBy("chat_id", "chat_type", "start", "reply_start", "end", "cutoff_ts", "end_ts").agg(
        side(before, "text").alias("context"), side(after, "text").alias("reply"), side(before, "message_id").alias("context_ids"), side(after, "message_id").alias("reply_ids"),
    )
    order = Window.partitionBy("chat_id").orderBy("reply_start")
    rows = rows.withColumn("prior_interactions", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(
        example_id("context_ids", "reply_ids").alias("example_id"), "*",
        F.when(F.size("reply") > 1, "multi").otherwise("single").alias("reply_shape"), F.when(F.col("prior_interactions") > 0, "familiar").otherwise("observed_first").alias("familiarity"),
    )


def example_id(context_ids: str, reply_ids: str) -> Column:
    """24 hex digits of the hash of the context's and the reply's message ids."""
    return F.substring(F.sha2(F.concat_ws("|", F.array_join(context_ids, ","), F.array_join(reply_ids, ",")), 256), 1, 24)


def protect_margin(candidates: DataFrame, protected: DataFrame, margin: int) -> DataFrame:
    """Candidates without a protected (chat_id, pos) within `margin` places of their burst: an equi anti-join on the places near one."""
    near = protected.select("chat_id", F.explode(F.sequence(F.col("pos") - margin, F.col("pos") + margin)).alias("_near")).distinct()
    hit = candidates.select("chat_id", "reply_start", F.explode(F.sequence("reply_start", F.col("end") - 1)).alias("_near")).join(near, ["chat_id", "_near"], "left_semi").select("chat_id", "reply_start").distinct()
    return candidates.join(hit, ["chat_id", "reply_start"], "left_anti")


def fragment_issues(fragments: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds issues: reason codes of (context, reply) arrays of structs with ts, is_self, boundary, eligible."""
    gaps = lambda a: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: y["ts"] - x["ts"])
    whole = F.concat("context", "reply")
    last = F.element_at("context", -1)
    empty = (F.size("context") == 0) | (F.size("reply") == 0)
    found = F.array_sort(F.array_compact(F.array(
        F.when(F.exists(gaps(whole), lambda g: g < 0), "reversed_time"),
        F.when(last["is_self"], "reply_to_self"),
        F.when(F.exists("reply", lambda m: ~m["eligible"]), "non_text_reply"),
        F.when(F.exists("context", lambda m: m["boundary"]), "context_contains_boundary"),
        F.when(F.element_at("reply", 1)["ts"] - last["ts"] > policy.response_gap, "stale_response"),
        F.when(F.exists(gaps(F.col("context")), lambda g: g > policy.context_gap), "context_crosses_session"),
        F.when(F.exists(gaps(F.col("reply")), lambda g: g > policy.reply_gap), "reply_crosses_burst"),
    )))
    return fragments.withColumn("issues", F.when(empty, F.array(F.lit("empty_fragment"))).otherwise(found))


def source_reconstruct(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """example_id and the fields of an example that its source span doesn't bear out."""
    spans = rows.select("example_id", "chat_id", "reply_start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    joined = spans.join(messages.select("chat_id", "pos", "message_id", "text", "ts"), ["chat_id", "pos"])
    item = F.struct("pos", "message_id", "text", "ts")
    side = lambda cond: F.array_sort(F.collect_list(F.when(cond, item)))
    seen = joined.groupBy("example_id").agg(side(F.col("pos") < F.col("reply_start")).alias("c"), side(F.col("pos") >= F.col("reply_start")).alias("r"))
    both = rows.join(seen, "example_id", "left")
    differs = lambda name, ok: F.when(~F.coalesce(ok, F.lit(False)), name)
    get = lambda a, f: F.transform(a, lambda x: x[f])
    shape = F.when(F.size("r") > 1, "multi").otherwise("single")
    return both.select("example_id", F.array_sort(F.array_compact(F.array(
        differs("context_ids", get("c", "message_id") == F.col("context_ids")), differs("reply_ids", get("r", "message_id") == F.col("reply_ids")),
        differs("context", get("c", "text") == F.col("context")), differs("reply", get("r", "text") == F.col("reply")),
        differs("cutoff_ts", F.element_at("c", -1)["ts"] == F.col("cutoff_ts")), differs("reply_shape", shape == F.col("reply_shape")),
    ))).alias("mismatches"))


def neighbour_windows(messages: DataFrame, anchors: DataFrame, radius: int = 8, seconds: int = 600) -> DataFrame:
    """Distinct (chat_id, pos) within `radius` places and `seconds` of an anchor (chat_id, pos, ts)."""
    near = anchors.select("chat_id", F.col("ts").alias("anchor_ts"), F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("pos"))
    return messages.join(near, ["chat_id", "pos"]).filter(F.abs(F.col("ts") - F.col("anchor_ts")) <= seconds).select("chat_id", "pos").distinct()


def history_select(messages: DataFrame, sender: Column, radius: int = 8, seconds: int = 600) -> DataFrame:
    """All private rows of chats with the sender, and the group windows around its messages."""
    private = messages.filter("chat_type = 'private'").join(messages.filter(sender).select("chat_id").distinct(), "chat_id", "left_semi").select("chat_id", "pos")
    around = neighbour_windows(messages.filter("chat_type = 'group'"), messages.filter(sender & (F.col("chat_type") == "group")).select("chat_id", "pos", "ts"), radius, seconds)
    return private.unionByName(around).distinct()


def focus_context(messages: DataFrame, hit: Column, hits: int = 12, before: int = 10) -> DataFrame:
    """The first `hits` hits of each chat with the ids of up to `before` messages before each."""
    around = _chat().rowsBetween(-before, -1)
    rows = messages.withColumn("hit", hit).withColumn("before_ids", F.collect_list("message_id").over(around)).filter("hit")
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy("pos"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= hits).select("chat_id", "pos", "rank", "before_ids")
