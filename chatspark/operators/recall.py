"""Recall of examples for cases: which rows a case may choose from, how they score, and in which order they come.

A case's pool are the rows of its group flag that ended before it, of chats that it doesn't exclude. Of these it chooses among the first
that aren't empty: rows of its precise situation, rows that share a situation, all. A sparse turn takes only rows that carry nothing
concrete; where the limit isn't reached, portable rows of the whole flag fill up. All this is decided from counts of blocks, in a first pass;
the second ranks, and a block returns no more than the limit for a case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.blocks import Postings, flat_terms, meet
from chatspark.operators.pruned import term_ids
from chatspark.sources.scratch import written

#: Rows of a block; blocks hold rows of one flag that ended at about the same time.
BLOCK_ROWS = 2048
#: A range of the pool's order has up to 2 ** RANGE_BITS blocks.
RANGE_BITS = 24

# Replies that fit any short turn, the marks that don't count in them, the question words of a turn, and the bounds.
PORTABLE = (
    "怎么了|咋了|咋啦|咋回事|什么情况|真的假的|为啥|为什么|比如|然后呢|后来呢|你呢|"
    "惨|太惨了|难受|确实|唉|哎|哎呀|抱抱|没事吧|还好吗|辛苦了|"
    "卧槽|我操|我擦|我靠|笑死|哈哈+|hhh+|牛逼|牛|离谱|绝了|"
    "可怕|这么可怕|少来|哪有|别闹|可还行|行吧|好吧|可以|羡慕|我也羡慕|"
    "问问|问下|确认下|看看|试试|在|在呢|来了"
)
PORTABLE_MARKS = r"(?U)[\s，,。.!！?？~～…]+"
ASKING = "[?？]|为什么|为啥|怎么|咋|什么|啥|谁|哪|多少"
NEITHER_LETTER_NOR_DIGIT = "[^0-9a-z一-鿿]+"
CONCRETE = r"(?U)\d|[a-zA-Z]{2,}"
SPARSE_CHARS, CONTEXT_CHARS, REPLY_CHARS = 4, 10, 5
# End of the fixed values.


def sparse_turn(text: Column) -> Column:
    """One to four letters or digits, and no question."""
    size = F.char_length(F.regexp_replace(F.lower(text), NEITHER_LETTER_NOR_DIGIT, ""))
    return (size > 0) & (size <= SPARSE_CHARS) & ~text.rlike(ASKING)


def _said(lines: Column) -> Column:
    """Lines without the white space around them; empty ones are left out."""
    return F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def strong_payload(context: Column) -> Column:
    """Several lines, a long one, or a number or Latin word: too concrete for a sparse turn."""
    text = F.array_join(_said(context), "")
    return (F.size(_said(context)) > 1) | (F.char_length(F.regexp_replace(text, r"(?U)\s+", "")) > CONTEXT_CHARS) | text.rlike(CONCRETE)


def context_bound(reply: Column) -> Column:
    """A reply with more letters than a phrase has, or with a number or Latin word."""
    return F.exists(_said(reply), lambda r: (F.char_length(F.regexp_replace(F.lower(r), NEITHER_LETTER_NOR_DIGIT, "")) > REPLY_CHARS) | r.rlike(CONCRETE))


def portable_reply(reply: Column) -> Column:
    """Some reply, and all of it phrases that fit anywhere."""
    return (F.size(_said(reply)) > 0) & F.forall(_said(reply), lambda r: F.regexp_replace(F.lower(r), PORTABLE_MARKS, "").rlike(f"^(?:{PORTABLE})$"))


def sparse_marks(rows: DataFrame) -> DataFrame:
    """Adds bare (carries nothing concrete) and portable (and its reply fits anywhere), from arrays context and reply."""
    bare = ~strong_payload(F.col("context"))
    return rows.withColumns({"bare": bare, "portable": bare & ~context_bound(F.col("reply")) & portable_reply(F.col("reply"))})


@dataclass(frozen=True)
class Policy:
    """What a recall weighs besides terms, length, situations and profile."""

    turn_form: bool = True
    participants: bool = True
    several_messages: bool = True
    move_first: bool = False
    same_chat_after_situation: bool = False
    same_chat_after_move: bool = False
    situations: bool = True


PROFILE = {"praise_target": 2.5, "speaker_posture": 2.0, "expected_move": 3.0}
_CASE = ["case_id", "is_group", "cutoff", "chat_id", "relationship", "situations", "precise", *PROFILE, "form", "participants", "chars", "several", "sparse", "brief", "excluded_chats", "excluded_ids"]
_ROW = ["id", "is_group", "ended", "chat_id", "relationship", "situations", "precise", *PROFILE, "form", "participants", "chars", "several", "bare", "portable"]
TIERS = ["precise", "situation", "all"]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False)


class Block:
    """Rows of a block as arrays; texts as objects, so that a comparison is one NumPy call."""

    def __init__(self, table: pa.Table):
        self.row = {c: _column(table, c) for c in ("id", "ended", "chat_id", "relationship", "precise", *PROFILE, "form", "chars", "several", "bare", "portable")}
        self.n = table.num_rows
        lists = table["situations"].combine_chunks()
        parent, values = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        self.with_situation = {s: parent[values == s] for s in set(values.tolist())}
        self.any_situation = np.bincount(parent, minlength=self.n) > 0
        five = table["participants"].to_pylist()
        self.known_participants = np.array([p is not None for p in five])
        self.participants = np.array([p or [False] * 5 for p in five], bool).reshape(self.n, -1)
        self.postings = Postings(table["terms"])
        self.known = {c: np.array([x not in (None, "") for x in self.row[c]], bool) for c in (*PROFILE, "form")}

    def same(self, name: str, value) -> np.ndarray:
        """Rows that have the value; none where the case has none."""
        return self.row[name] == value if value not in (None, "") else np.zeros(self.n, bool)

    def shared(self, situations: list[str] | None) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for s in situations or ():
            out[self.with_situation.get(s, [])] = True
        return out

    def open(self, case: dict) -> np.ndarray:
        """Rows that ended before the case, and that it doesn't exclude."""
        out = (self.row["ended"] < case["cutoff"]) & ~np.isin(self.row["id"], case["excluded_ids"] or [])
        for chat in case["excluded_chats"] or ():
            out &= self.row["chat_id"] != chat
        return out

    def tiers(self, case: dict) -> list[np.ndarray]:
        free = self.open(case)
        return [free & self.same("precise", case["precise"]), free & self.shared(case["situations"]), free]

    def fit(self, case: dict) -> np.ndarray:
        """Rows that a sparse turn may take."""
        return (self.row["bare"] if case["brief"] else self.row["portable"]) if case["sparse"] else np.ones(self.n, bool)

    def compatibility(self, case: dict) -> np.ndarray:
        out = np.zeros(self.n)
        for name, weight in PROFILE.items():
            if case[name] not in (None, ""):
                out += np.where(self.known[name], np.where(self.same(name, case[name]), weight, -weight), 0)
        return out

    def score(self, case: dict, policy: Policy, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(score, rank of the move, same chat and situation, compatibility) of every row."""
        overlap = self.postings.overlap(terms, counts) if len(terms) else np.zeros(self.n)
        lexical = overlap / max(1, case["n_terms"])
        length = 1 / (1 + np.abs(case["chars"] - self.row["chars"]) / 20)
        shared, compatible = self.shared(case["situations"]), self.compatibility(case)
        chat, kin = self.same("chat_id", case["chat_id"]), self.same("relationship", case["relationship"])
        if policy.situations:
            score = lexical * 1.5 + length * 0.5 + compatible + np.where(shared, 7.0, np.where(self.any_situation & bool(case["situations"]), -3.0, 0.0))
            if policy.turn_form and not case["is_group"] and case["form"]:
                score = score + np.where(self.known["form"], np.where(self.same("form", case["form"]), 4.0, -1.0), 0.0)
            if policy.participants and case["is_group"] and case["participants"] is not None:
                score = score + np.where(self.known_participants, np.where(self.participants == np.array(case["participants"], bool), 1.5, -1.5).sum(axis=1), 0.0)
            score = score + np.where(chat, np.where(shared, 2.5, 0.5), 0.0) + 0.5 * kin
            if policy.several_messages and case["several"]:
                score = score + self.row["several"]
        else:
            score = lexical * 8 + length + 1.5 * chat + 2.0 * kin
        move = case["expected_move"]
        rank = np.where(self.same("expected_move", move), 0, np.where(self.known["expected_move"], 2, 1)) if move not in (None, "") else np.ones(self.n, np.int64)
        return score, rank, chat & (shared | self.same("precise", case["precise"])), compatible


def time_blocks(pool: DataFrame) -> DataFrame:
    """Adds block: each BLOCK_ROWS rows in order of flag, time and id; written, so that numbers hold.

    Ranges of that order are sorted by one task each, and cut there: a block's number is its range's, its place in the range, and its flag.
    """
    order = ["is_group", "ended", "id"]
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pool.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    place = F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / BLOCK_ROWS)
    number = (F.shiftright("_at", 33) * (1 << RANGE_BITS) + place) * 2 + F.col("is_group").cast("int")
    return written(dealt.withColumn("block", number.cast("long")).drop("_at"))


def _asked(cases: DataFrame, held: DataFrame) -> DataFrame:
    """Each case for each block of its flag in the ranges that began before it. The broadcast has two rows for each range, however many rows there are."""
    spans = held.groupBy(F.shiftright("block", RANGE_BITS + 1).alias("_range"), "is_group").agg(F.min("block").alias("_first"), F.max("block").alias("_last"), F.min("ended").alias("_began"))
    met = cases.join(F.broadcast(spans), "is_group").filter(F.col("_began") < F.col("cutoff"))
    return met.withColumn("block", F.explode(F.sequence("_first", "_last", F.lit(2).cast("long")))).drop("_range", "_first", "_last", "_began")


def _cases(table: pa.Table) -> list[dict]:
    row, term, count = flat_terms(table["asked"].combine_chunks())
    bounds = np.searchsorted(row, np.arange(table.num_rows + 1))
    out = table.select([c for c in table.column_names if c in {*_CASE, "n_terms", "tier", "best", "topped"}]).to_pylist()
    for i, case in enumerate(out):
        case["asked"] = term[bounds[i] : bounds[i + 1]], count[bounds[i] : bounds[i + 1]]
    return out


def case_tiers(cases: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """(case_id, tier, topped, n, best): where each case chooses from, whether portable rows fill up, how many rows it has and their best compatibility."""
    names = ["case_id", *[f"{kind}{i}" for i in range(3) for kind in ("n", "f", "c")]]

    def answer(block: Block, table: pa.Table):
        out = []
        for case in _cases(table):
            fit, compatible = block.fit(case), block.compatibility(case)
            row = [case["case_id"]]
            for tier in block.tiers(case):
                mine = tier & fit
                row += [int(tier.sum()), int(mine.sum()), float(compatible[mine].max()) if mine.any() else None]
            out.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64() if name[0] == "c" and name != "case_id" else pa.int64()) for name, c in zip(names, zip(*out))], names=names)

    met = meet(held, _asked(cases, held), Block, answer, ", ".join(f"{c} {'double' if c[0] == 'c' and c != 'case_id' else 'long'}" for c in names))
    sums = met.groupBy("case_id").agg(*[(F.max(c) if c[0] == "c" else F.sum(c)).alias(c) for c in names[1:]])
    at = F.when(F.col("n0") > 0, 0).when(F.col("n1") > 0, 1).otherwise(2)
    pick = lambda kind, i: F.when(i == 0, F.col(f"{kind}0")).when(i == 1, F.col(f"{kind}1")).otherwise(F.col(f"{kind}2"))
    joined = cases.select("case_id", "sparse", "brief").join(sums, "case_id", "left").na.fill(0, [c for c in names[1:] if c[0] != "c"]).withColumn("_at", at)
    joined = joined.withColumn("topped", F.col("sparse") & ~F.col("brief") & (pick("f", F.col("_at")) < limit) & (F.col("_at") < 2))
    used = F.when(F.col("topped"), 2).otherwise(F.col("_at"))
    return joined.select("case_id", F.element_at(F.array(*map(F.lit, TIERS)), F.col("_at") + 1).alias("tier"), "topped", pick("f", used).alias("n"), F.coalesce(pick("c", used), F.lit(0.0)).alias("best"))


def _prepared(cases: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with the numbers of their terms (asked), rows in blocks with theirs (terms)."""
    asked, bags = term_ids(cases.select("case_id", F.explode("terms").alias("term")).groupBy("case_id", "term").agg(F.count(F.lit(1)).alias("n")), pool.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n")))
    none = F.array().cast("array<struct<t: bigint, n: bigint>>")
    own = cases.select(*_CASE, F.size("terms").alias("n_terms")).join(asked.withColumnRenamed("terms", "asked"), "case_id", "left").withColumn("asked", F.coalesce("asked", none))
    rows = pool.select(*_ROW).join(bags.drop("total"), "id", "left").withColumn("terms", F.coalesce("terms", none))
    return written(own), time_blocks(rows)


def bucket_counts(cases: DataFrame, pool: DataFrame, limit: int) -> DataFrame:
    """case_tiers() of cases and pool as recall() takes them."""
    own, held = _prepared(cases, pool)
    return case_tiers(own, held, limit)


def recall(cases: DataFrame, pool: DataFrame, limit: int, policy: Policy | None = None) -> DataFrame:
    """(case_id, id, tier, topped, score, rank): the first `limit` rows of each case.

    Rows come by the rank of the expected move (if the policy says so), then those of the case's own chat where it has priority, then by score and
    id. Cases have the columns _CASE and terms (an array), rows _ROW and terms. A row without terms in common still scores.
    """
    policy = policy or Policy()
    own, held = _prepared(cases, pool)
    tiers = written(case_tiers(own, held, limit))

    def answer(block: Block, table: pa.Table):
        for case in _cases(table):
            mine = block.tiers(case)[2 if case["topped"] else TIERS.index(case["tier"])] & block.fit(case)
            at = np.nonzero(mine)[0]
            if not len(at):
                continue
            score, move, near, compatible = (x[at] for x in block.score(case, policy, *case["asked"]))
            first = np.zeros(len(at), bool)
            if policy.same_chat_after_situation:
                first |= compatible >= case["best"]
            if policy.same_chat_after_move and case["expected_move"]:
                first |= move == 0
            score = np.floor(score * 1e6 + 0.5) / 1e6
            ahead = np.where(first & near, 0, 1)
            move = move if policy.move_first else np.zeros(len(at), np.int64)
            ids = block.row["id"][at]
            best = np.lexsort((ids, -score, ahead, move))[:limit]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(best), case["case_id"]), ids[best], move[best].astype(np.int64), ahead[best].astype(np.int64), score[best])], names=["case_id", "id", "move", "ahead", "score"])

    met = meet(held, _asked(own.join(tiers.select("case_id", "tier", "topped", "best"), "case_id"), held), Block, answer, "case_id long, id long, move long, ahead long, score double")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("move", "ahead", F.desc("score"), "id"))
    first = met.withColumn("rank", rank - 1).filter(F.col("rank") < limit)
    return first.join(tiers.select("case_id", "tier", "topped"), "case_id").select("case_id", "id", "tier", "topped", "score", "rank")
