"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 adds every row's text hash to a counting Bloom filter and keeps the slots
that were hit twice or more, packed into 64-bit words; what it exchanges are slot numbers, two of
8 bytes for a row, combined by task. Pass 2 tests each row against the words: a row with a slot
that was hit once is unique and passes straight through; only the others (repeats and a few false
positives) shuffle and are grouped exactly, combined by task first, so that a group of a third of
all rows doesn't meet in one task.

Null text counts as empty; empty texts are equal to each other. Repeated rows with one
doc_id and text form a group like any other, of which a single row stays. An empty table
gives an empty result. Extra columns, whatever their names, are ignored by `exact_groups`
and kept by `exact_dedup`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatspark.llm.stage import written

SLOTS_PER_ROW = 16
#: Slots of a filter for each probe that is broadcast: PROBES * MAX_SLOTS / 64 words, two million. With more rows than
#: MAX_SLOTS / SLOTS_PER_ROW (four million) thin rows of 48 bytes and words meet by shuffle.
MAX_SLOTS = 1 << 26
PROBES = 2
#: Groups of possible repeats up to this many (about 100 MB) are broadcast to their rows; more are joined by shuffle.
MAX_BROADCAST_GROUPS = 1_000_000


def _slot(probe: int, slots: int) -> Column:
    return F.pmod(F.xxhash64("_h", F.lit(probe)), F.lit(slots))


def repeated_slots(hashes: DataFrame, slots: int) -> DataFrame:
    """(word, bits) of the slots that at least two rows hit, for each probe in its own range of slots."""
    hits = hashes.select(F.explode(F.array(*[_slot(p, slots) + F.lit(p * slots) for p in range(PROBES)])).alias("slot"))
    twice = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))


def with_maybe_repeated(rows: DataFrame, words: DataFrame, slots: int) -> DataFrame:
    """Adds _maybe: false for rows that are certainly unique. `rows` has _h.

    The words of up to MAX_SLOTS slots are broadcast; those of a larger filter meet the rows by shuffle, once for each probe.
    """
    out, maybe = rows, F.lit(True)
    words = F.broadcast(words) if slots <= MAX_SLOTS else words
    for p in range(PROBES):
        slot = _slot(p, slots) + F.lit(p * slots)
        side = words.select(F.col("word").alias(f"_w{p}"), F.col("bits").alias(f"_b{p}"))
        out = out.withColumn(f"_s{p}", slot).join(side, F.shiftright(f"_s{p}", 6) == F.col(f"_w{p}"), "left")
        maybe = maybe & F.expr(f"coalesce(shiftright(_b{p}, cast(_s{p} & 63 as int)) & 1, 0) = 1")
    out = out.withColumn("_maybe", maybe)
    return out.drop(*[f"_{c}{p}" for p in range(PROBES) for c in "swb"])


def _slots(rows: int) -> int:
    return 1 << max(10, math.ceil(math.log2(max(1, rows) * SLOTS_PER_ROW)))


def _tested(thin: DataFrame) -> DataFrame:
    """`thin`, a table of _h and other columns, with _maybe. The filter grows with the rows, so the share of unique rows that test as possible repeats doesn't."""
    slots = _slots(thin.count())
    return with_maybe_repeated(thin, written(repeated_slots(thin, slots), "bloom"), slots)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Of equal texts the row with the largest doc_id stays (null ids count as smallest;
    of rows that also share the doc_id, the last in row order).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row")).withColumn("_h", F.xxhash64("_sha")), "hashes")
    tested = _tested(thin)
    unique = tested.filter(~F.col("_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")
    maybe = tested.filter("_maybe").drop("_maybe")
    groups = written(maybe.groupBy("_sha").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    if groups.count() <= MAX_BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    repeated = maybe.join(groups, "_sha").select("doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), "_sha")
    return unique.unionByName(repeated).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64(F.unhex(F.sha2("_text", 256))))
    hashes = written(rows.select("_h"), "hashes")
    slots = _slots(hashes.count())
    if slots <= MAX_SLOTS:
        tested = with_maybe_repeated(rows, written(repeated_slots(hashes, slots), "bloom"), slots)
    else:  # the filters leave a list of the hashes that really occur again
        again = written(_tested(hashes).filter("_maybe").groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"), "again")
        if again.count() <= MAX_BROADCAST_GROUPS:
            again = F.broadcast(again)
        tested = rows.join(again.withColumn("_maybe", F.lit(True)), "_h", "left").withColumn("_maybe", F.coalesce("_maybe", F.lit(False)))
    unique = tested.filter(~F.col("_maybe")).select("_row")
    order = F.struct(F.col("_row.doc_id").cast("long"), *[F.col(f"_row.`{c}`").cast("string") for c in columns if c not in ("doc_id", "text")])
    best = tested.filter("_maybe").withColumn("_sha", F.unhex(F.sha2("_text", 256))).groupBy("_sha").agg(F.max_by("_row", order).alias("_row")).select("_row")
    return unique.unionByName(best).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
