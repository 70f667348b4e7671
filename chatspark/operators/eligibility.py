"""Which history a case may see, and the joins that keep answers out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.scan import running
from chatspark.sources.scratch import written


def eligible_history(cases: DataFrame, pool: DataFrame, key: list[str], salts: int = 16) -> DataFrame:
    """(case_id, example_id) of pool rows that ended before the case's cutoff, in a chat that isn't excluded, sharing no message with its answer.

    Cases have cutoff_ts, reply_ids, excluded; pool rows end_ts, chat_id, ids. `key` is the equi-key that bounds the join. Rows that end in
    the cutoff's own second are not earlier. The latest cutoff prunes the pool first; a key's pool is dealt to `salts` tasks, to each of
    which its cases go. All that tells a pair's worth goes with its sides, so pairs, whose number is the square of a key's rows, are
    neither shuffled nor kept: they leave the join as they are made.
    """
    last = cases.groupBy(*key).agg(F.max("cutoff_ts").alias("_last"))
    live = pool.join(last, key).filter(F.col("end_ts") < F.col("_last")).select(*key, "example_id", "chat_id", "end_ts", "ids", F.pmod(F.xxhash64("example_id"), F.lit(salts)).alias("_salt"))
    asked = cases.select("case_id", *key, "cutoff_ts", "excluded", "reply_ids").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    conflict = F.coalesce(F.arrays_overlap("ids", "reply_ids"), F.lit(False))
    met = asked.join(live, [*key, "_salt"]).filter((F.col("end_ts") < F.col("cutoff_ts")) & ~F.array_contains("excluded", F.col("chat_id")))
    return met.filter(~conflict).select("case_id", "example_id", "cutoff_ts", "end_ts")


def latest_eligible(cases: DataFrame, pool: DataFrame, key: list[str], k: int, first: int = 4) -> DataFrame:
    """(case_id, example_id, end_ts, cutoff_ts, rank): the k newest rows that eligible_history() would give each case.

    An as-of join by rank. Rows and cases are numbered together in order of time, range by range, so a case knows how many rows of its key
    ended before it; its newest rows are the ranks just below that, which an equi-join fetches. Cases that exclusions leave short
    go on to the ranks below, `first` times k at first and twice as many each round, so no case meets more than a few times k rows.
    """
    order = ["_ts", "_row", "_id"]
    rows = pool.select(*key, F.col("end_ts").alias("_ts"), F.lit(1).alias("_row"), F.col("example_id").alias("_id"), "chat_id")
    asks = cases.select(*key, F.col("cutoff_ts").alias("_ts"), F.lit(0).alias("_row"), F.col("case_id").alias("_id"), "excluded")
    placed = written(running(rows.unionByName(asks, allowMissingColumns=True), {"_before": (F.sum, "_row")}, order, key).withColumn("_before", F.coalesce("_before", F.lit(0)).cast("long")))
    ranked = placed.filter("_row = 1").select(*key, F.col("_before").alias("_rank"), F.col("_id").alias("example_id"), "chat_id", F.col("_ts").alias("end_ts"))
    asked = placed.filter("_row = 0 and _before > 0").select(*key, F.col("_id").alias("case_id"), F.col("_ts").alias("cutoff_ts"), "excluded", F.col("_before").alias("_upto"), F.lit(0).cast("long").alias("_have"))
    barred, width, found = written(conflicts(cases, pool)), first * k, None
    while True:
        spread = asked.withColumn("_rank", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("_upto") - width), F.col("_upto") - 1)))
        met = spread.join(ranked, [*key, "_rank"]).filter(~F.coalesce(F.array_contains("excluded", F.col("chat_id")), F.lit(False)))
        good = written(met.join(barred, ["case_id", "example_id"], "left_anti").select("case_id", "example_id", "end_ts", "cutoff_ts", "_rank"))
        found = good if found is None else found.unionByName(good)
        more = good.groupBy("case_id").agg(F.count(F.lit(1)).alias("_more"))
        left = asked.join(more, "case_id", "left").withColumns({"_have": F.col("_have") + F.coalesce("_more", F.lit(0)), "_upto": F.col("_upto") - width}).drop("_more")
        asked = written(left.filter((F.col("_have") < k) & (F.col("_upto") > 0)).select(*asked.columns))
        if asked.isEmpty():
            break
        width *= 2
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("_rank")))
    return found.withColumn("rank", place - 1).filter(F.col("rank") < k).drop("_rank")


def conflicts(cases: DataFrame, pool: DataFrame) -> DataFrame:
    """(case_id, example_id) of pool rows that hold a message of the case's answer."""
    answers = cases.select("case_id", F.explode("reply_ids").alias("m")).distinct()
    held = pool.select("example_id", F.explode("ids").alias("m")).distinct()
    return answers.join(held, "m").select("case_id", "example_id").distinct()


def history_age(pairs: DataFrame) -> DataFrame:
    """Adds age (seconds, positive only) and its bin over 1, 7, 30, 90 and 365 days."""
    age = F.col("cutoff_ts") - F.col("end_ts")
    return pairs.filter(age > 0).withColumn("age", age).withColumn("age_bin", bins(age, [86400 * x for x in (1, 7, 30, 90, 365)]))


def bins(value: Column, bounds: list) -> Column:
    """Number of bounds that the value exceeds."""
    return sum((F.coalesce(value > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))


def quote_resolution(quotes: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds state of a quote of (chat_id, quoted_id, quoted_text): resolved, text_mismatch or missing."""
    known = messages.select("chat_id", F.col("message_id").alias("quoted_id"), F.col("text").alias("_text"))
    joined = quotes.join(known, ["chat_id", "quoted_id"], "left")
    return joined.withColumn("state", F.when(F.col("_text").isNull(), "missing").when(F.col("_text") == F.col("quoted_text"), "resolved").otherwise("text_mismatch")).drop("_text")


def anchor_match(anchors: DataFrame, messages: DataFrame, prefix: int = 16) -> DataFrame:
    """(anchor_id, message_id, matches): raw messages of the same day, sender and chat with equal text, or one that begins with the anchor's `prefix` characters or more; only unique ones have an id."""
    met = anchors.join(messages.select("day", "sender", "chat_id", "message_id", F.col("text").alias("_t")), ["day", "sender", "chat_id"])
    good = met.filter((F.col("text") == F.col("_t")) | ((F.length("text") >= prefix) & F.startswith("_t", "text")))
    one = good.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("matches"), F.min("message_id").alias("message_id"))
    return anchors.select("anchor_id").join(one, "anchor_id", "left").select("anchor_id", F.when(F.col("matches") == 1, F.col("message_id")).alias("message_id"), F.coalesce("matches", F.lit(0)).alias("matches"))


def evidence_prior(records: DataFrame, messages: DataFrame, case: Column, held_out: Column, answers: DataFrame) -> DataFrame:
    """(record_id, admitted): all its evidence messages exist, pass `case` (account and cutoff), aren't held out nor in an answer."""
    ev = records.select("record_id", "account", F.explode("evidence").alias("message_id"))
    met = ev.join(messages.withColumnRenamed("account", "_account"), "message_id", "left").join(answers.select("message_id", F.lit(True).alias("_answer")).distinct(), "message_id", "left")
    ok = F.coalesce(F.col("_account").isNotNull() & (F.col("_account") == F.col("account")) & case & ~held_out & F.col("_answer").isNull(), F.lit(False))
    return met.groupBy("record_id").agg(F.bool_and(ok).alias("admitted"))


def material_conflicts(materials: DataFrame, cases: DataFrame, unseen: DataFrame) -> DataFrame:
    """Per material: messages from unseen chats, answers it holds, and whether it ends after the first case's cutoff."""
    ids = materials.select("material_id", F.explode("messages").alias("m")).select("material_id", "m.*")
    chats = ids.join(unseen.select("chat_id").distinct(), "chat_id", "left_semi").groupBy("material_id").agg(F.count_distinct("message_id").alias("unseen_messages"))
    answers = ids.join(cases.select(F.explode("reply_ids").alias("message_id")).distinct(), "message_id", "left_semi").groupBy("material_id").agg(F.count_distinct("message_id").alias("answer_messages"))
    first = cases.agg(F.min("cutoff_ts").alias("_first"))
    out = materials.join(chats, "material_id", "left").join(answers, "material_id", "left").join(F.broadcast(first))
    return out.select("material_id", F.coalesce("unseen_messages", F.lit(0)).alias("unseen_messages"), F.coalesce("answer_messages", F.lit(0)).alias("answer_messages"), (F.col("end_ts") >= F.col("_first")).alias("future"))


def teacher_overlap(targets: DataFrame, teacher: DataFrame, trained_at: int) -> DataFrame:
    """Per target: teacher trained after its input, same training case, answers in the teacher's training; eligible if none."""
    cases = teacher.select("case_id").distinct().withColumn("_case", F.lit(True))
    ids = teacher.select(F.explode("ids").alias("m")).distinct()
    leaks = targets.select("case_id", F.explode("reply_ids").alias("m")).join(ids, "m", "left_semi").select("case_id").distinct().withColumn("_leak", F.lit(True))
    out = targets.join(cases, "case_id", "left").join(leaks, "case_id", "left")
    after, same, leak = F.lit(trained_at) > F.col("cutoff_ts"), F.col("_case").isNotNull(), F.col("_leak").isNotNull()
    return out.select("case_id", after.alias("trained_after"), same.alias("same_case"), leak.alias("answer_overlap"), (~after & ~same & ~leak).alias("eligible"))


def alias_identity_join(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Per claim (claim_id, owner, alias, chat_id): identities observed under either name in the chat, and whether there is one, several or none.

    A name's identities are counted once for a chat. Those under both names count once: pairs of names that one identity has in a chat are
    counted apart, so no claim meets identities, and what grows is the square of an identity's own names in a chat alone.
    """
    known = names.select("identity", "name", "chat_id").filter("identity is not null").distinct()
    sizes = known.groupBy("name", "chat_id").agg(F.count(F.lit(1)).alias("n"), F.min("identity").alias("i"))
    of = lambda c, x: sizes.select(F.col("name").alias(c), "chat_id", F.col("n").alias(f"_n{x}"), F.col("i").alias(f"_i{x}"))
    other = known.select("identity", "chat_id", F.col("name").alias("_high"))
    shared = known.withColumnRenamed("name", "_low").join(other, ["identity", "chat_id"]).filter("_low < _high").groupBy("_low", "_high", "chat_id").agg(F.count(F.lit(1)).alias("_both"))
    asked = claims.select("claim_id", "owner", "alias", "chat_id", F.least("owner", "alias").alias("_low"), F.greatest("owner", "alias").alias("_high"))
    met = asked.join(of("owner", "a"), ["owner", "chat_id"], "left").join(of("alias", "b"), ["alias", "chat_id"], "left").join(shared, ["_low", "_high", "chat_id"], "left")
    own, second = (F.coalesce(c, F.lit(0)) for c in ("_na", "_nb"))
    n = F.when(F.col("owner") == F.col("alias"), own).otherwise(own + second - F.coalesce("_both", F.lit(0)))
    return met.select("claim_id", n.alias("identities"), F.when(n == 1, F.least("_ia", "_ib")).alias("identity"), F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous").alias("state"))


def identity_candidates(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Page to account by its file name, else by its title among the observed names; ambiguous titles stay open."""
    accounts = names.select("identity").distinct()
    direct = pages.join(accounts, pages["file_name"] == accounts["identity"], "left_semi").select("page_id", F.col("file_name").alias("identity"), F.lit("file_name").alias("route"))
    titled = pages.join(names.select("identity", F.col("name").alias("title")).distinct(), "title").groupBy("page_id").agg(F.count_distinct("identity").alias("_n"), F.min("identity").alias("_i"))
    title = titled.select("page_id", F.when(F.col("_n") == 1, F.col("_i")).alias("identity"), F.when(F.col("_n") == 1, "title").otherwise("ambiguous").alias("route"))
    best = direct.unionByName(title).withColumn("_o", F.when(F.col("route") == "file_name", 0).otherwise(1))
    first = best.withColumn("_r", F.row_number().over(Window.partitionBy("page_id").orderBy("_o"))).filter("_r = 1").select("page_id", "identity", "route")
    return pages.select("page_id").join(first, "page_id", "left").withColumn("route", F.coalesce("route", F.lit("unmatched")))


def attribution_issues(records: DataFrame, messages: DataFrame) -> DataFrame:
    """(record_id, issue): the account wrote none of the evidence, or none of a self-report's direct sources."""
    ev = records.select("record_id", "account", "self_report", F.explode("evidence").alias("message_id")).join(messages.select("message_id", "sender", "forwarded"), "message_id", "left")
    own = F.coalesce(F.col("sender") == F.col("account"), F.lit(False))
    seen = ev.groupBy("record_id", "self_report").agg(F.max(own).alias("_any"), F.max(own & ~F.coalesce("forwarded", F.lit(True))).alias("_direct"))
    issue = F.when(~F.col("_any"), "account_without_source").when(F.col("self_report") & ~F.col("_direct"), "self_report_without_author")
    return seen.withColumn("issue", issue).filter("issue is not null").select("record_id", "issue")


def feature_tasks(texts: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """Distinct content-addressed requests that the cache lacks."""
    tasks = texts.select(F.sha2(F.concat(F.lit(f"{version}:"), "text"), 256).alias("task"), F.length("text").alias("chars")).distinct()
    return tasks.join(cached.select("task"), "task", "left_anti")
