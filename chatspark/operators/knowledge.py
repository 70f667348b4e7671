"""Inventories of people, groups, names and addresses, compiled from messages and materials."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.sources.scratch import written

#: Bits of the filter of names, 8 MB when broadcast.
MAX_BITS = 1 << 26


def _evidence(k: int) -> Column:
    """The k smallest (ts, message_id), as message ids: a bounded buffer by merging sorted slices."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("_rank") <= k, F.struct("ts", "message_id")))), 1, k), lambda x: x["message_id"])


def identity_inventory(messages: DataFrame, evidence: int = 2) -> DataFrame:
    """Per sender and name: messages, own ones, first and last time, chats, and the first messages as evidence."""
    ranked = messages.withColumn("_rank", F.row_number().over(Window.partitionBy("sender", "name").orderBy("ts", "message_id")))
    return ranked.groupBy("sender", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_self").cast("long")).alias("own"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("chat_id").alias("chats"), _evidence(evidence).alias("evidence"))


def group_inventory(messages: DataFrame) -> DataFrame:
    """Per group chat: messages and sorted participants (a chat's members are bounded)."""
    return messages.filter("chat_type = 'group'").groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("sender")).alias("participants"))


def alias_conflicts(claims: DataFrame) -> DataFrame:
    """(kind, name, n): aliases of several owners, and names of several identities."""
    owners = claims.groupBy(F.col("alias").alias("name")).agg(F.count_distinct("owner").alias("n")).filter("n > 1").withColumn("kind", F.lit("alias_with_owners"))
    ids = claims.groupBy(F.col("owner").alias("name")).agg(F.count_distinct("identity").alias("n")).filter("n > 1").withColumn("kind", F.lit("name_with_identities"))
    return owners.unionByName(ids).select("kind", "name", "n")


def address_records(uses: DataFrame, evidence: int = 3) -> DataFrame:
    """Directed address records by source, target, alias, chat and usage: count, first, last and evidence."""
    key = ["source", "target", "alias", "chat_id", "usage"]
    ranked = uses.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("ts", "message_id")))
    return ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), _evidence(evidence).alias("evidence"))


def knowledge_compose(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged records by hashed entity, type conflicts): union of labels, evidence and origins of many materials."""
    keyed = records.withColumn("entity_id", F.substring(F.sha2(F.lower(F.trim("entity")), 256), 1, 24))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    merged = keyed.groupBy("entity_id").agg(F.min("type").alias("type"), union("labels").alias("labels"), union("evidence").alias("evidence"), F.array_sort(F.collect_set("material")).alias("origins"))
    bad = keyed.groupBy("entity_id").agg(F.count_distinct("type").alias("types")).filter("types > 1")
    return merged, bad


def attribute_groups(records: DataFrame) -> DataFrame:
    """(subject, field, n, evidence) of fields with several records, for review."""
    return records.groupBy("subject", "field").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")).filter("n > 1")


def alias_refine(claims: DataFrame, uncertain: str = "[?？]") -> DataFrame:
    """(owner, alias, n, flags, sources): normalised names, without excluded ones (blank, or the owner's own)."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    rows = claims.withColumn("owner", norm("owner")).withColumn("alias", norm("alias"))
    excluded = F.when(F.col("alias") == "", "blank").when(F.col("alias") == F.col("owner"), "own_name")
    kept = rows.withColumn("_x", excluded).filter("_x is null").withColumn("_flag", F.when(F.col("alias").rlike(uncertain), "uncertain"))
    return kept.groupBy("owner", "alias").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("_flag")).alias("flags"), F.array_sort(F.collect_set("source")).alias("sources"))


def vocative_claims(vocatives: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """(target, alias, n, strength): in chats of two, a vocative names the other member; single evidence is weak."""
    two = members.groupBy("chat_id").agg(F.count(F.lit(1)).alias("_n"), F.min("sender").alias("_a"), F.max("sender").alias("_b")).filter("_n = 2")
    named = vocatives.join(two, "chat_id").withColumn("target", F.when(F.col("sender") == F.col("_a"), F.col("_b")).otherwise(F.col("_a")))
    return named.groupBy("target", "alias").agg(F.count(F.lit(1)).alias("n")).withColumn("strength", F.when(F.col("n") >= least, "kept").otherwise("weak"))


def mention_scan(messages: DataFrame, names: DataFrame) -> DataFrame:
    """(message_id, name, identities): names found with word bounds, also within or across longer ones; several identities make a mention ambiguous.

    Of each message the pieces between word bounds that have the length of some name are tested against a filter of the names' hashes, of
    MAX_BITS at most whatever the names' number; only those that pass are joined with the names.
    """
    owned = written(names.groupBy("name").agg(F.count_distinct("identity").alias("identities")))
    lengths = sorted(r.n for r in owned.select(F.length("name").alias("n")).filter("n > 0").distinct().collect())
    bits = min(MAX_BITS, 1 << max(10, (16 * owned.count()).bit_length()))
    slot = F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(bits))
    words = owned.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    known = messages.sparkSession.sparkContext.broadcast(table.tobytes())
    word = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")

    def passes(piece: str) -> bool:
        h = zlib.crc32(piece.encode()) & (bits - 1)
        return bool(known.value[h >> 3] >> (h & 7) & 1)

    def pieces(batches):
        for table in batches:
            hits = []
            for i, t in zip(table.message_id, table.text):
                t = t or ""
                ends = [j == len(t) or t[j] not in word for j in range(len(t) + 1)]
                found = {t[a : a + n] for a in range(len(t)) if a == 0 or t[a - 1] not in word for n in lengths if a + n <= len(t) and ends[a + n]}
                hits += [(i, x) for x in found if passes(x)]
            yield pd.DataFrame(hits, columns=["message_id", "name"])

    found = messages.select("message_id", "text").mapInPandas(pieces, "message_id long, name string")
    return found.join(owned, "name").select("message_id", "name", "identities").distinct()


def inventory_summary(candidates: DataFrame) -> DataFrame:
    """(measure, value, n): candidates per target, object match, and selection reasons."""
    per = candidates.groupBy("target_id").agg(F.count(F.lit(1)).alias("k")).groupBy(F.lit("candidates_per_target").alias("measure"), F.col("k").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    count = lambda name, c: candidates.groupBy(F.lit(name).alias("measure"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return per.unionByName(count("object_match", "object_match")).unionByName(count("reason", "reason"))


def composition_check(rows: DataFrame, total: int, group: int, least_pool: int) -> DataFrame:
    """Actual total and group count against the plan, and whether the pool is large enough."""
    n, g = F.count(F.lit(1)), F.sum((F.col("chat_type") == "group").cast("long"))
    return rows.agg(n.alias("total"), g.alias("group_rows"), (n == total).alias("total_ok"), (g == group).alias("group_ok"), (n >= least_pool).alias("pool_ok"))
