"""Replies that reuse a group's sentences, exactly or in blocks, by an inverted index of numbered character pairs.

Two sentences match in blocks if both have EIGHT characters and more, and their matching blocks of two characters and more are at
least two, one of three or more, together six or more, and cover 65 % of the shorter. Blocks of S characters in B pieces share S - B
pairs of characters, so sentences that match share a number of pairs that follows from the shorter's length. Of the shorter sentence only as many of
its rarest pairs are looked up as leave no match without one of them; pairs of sentences that share too few leave before the texts are compared.
Whether a sentence has a match at all takes fewer comparisons: it meets its chat's sentences block by block, the likeliest of a block first, and
leaves with its first match.
"""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.blocks import meet
from chatspark.sources.scratch import written

#: Sentences of a chat in a block, and sentences that one copy of a block answers for.
BLOCK_ROWS, ASKS = 1024, 512

# What precedes a message, a quotation and what follows it, where sentences end, the marks that don't count, and the bounds.
SPEAKER = r"(?s)^(.*?)[（(]\d{4}-\d{2}-\d{2}[^）)]*[）)][:：]"
QUOTATION = r"(?s)\[引用.*$"
ENDS = r"[。！？!?；;\n]+"
MARKS = r"(?U)[\s，,、…~～—\-：:。！？!?；;\"'“”‘’（）()\[\]【】]+"
MENTION = r"(?sU)^(?:@[^\u2005]*\u2005\s*)+"
LEADING = r"(?U)^同(?=\s)"
LEAST_SENTENCE, EIGHT, LEAST_BLOCK, LEAST_LARGEST, LEAST_SUM, LEAST_SHARE = 2, 8, 2, 3, 6, 0.65
# End of the fixed values.


def sentences(text: Column, ends: str = ENDS) -> Column:
    """The sentences of a message without speaker, quotation, mentions and marks; two characters at least."""
    body = F.regexp_replace(F.regexp_replace(text, SPEAKER, ""), QUOTATION, "")
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    body = trim(F.regexp_replace(trim(F.regexp_replace(trim(body), MENTION, "")), LEADING, ""))
    return F.filter(F.transform(F.split(body, ends), lambda s: F.regexp_replace(s, MARKS, "")), lambda s: F.char_length(s) >= LEAST_SENTENCE)


def block_match(left: str, right: str) -> bool:
    """The rule of matching blocks."""
    shorter = min(len(left), len(right))
    if shorter < EIGHT:
        return False
    blocks = [b.size for b in SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks() if b.size >= LEAST_BLOCK]
    return len(blocks) >= 2 and max(blocks) >= LEAST_LARGEST and sum(blocks) >= LEAST_SUM and sum(blocks) / shorter >= LEAST_SHARE


def least_shared(length: Column) -> Column:
    """The fewest pairs of characters that sentences share which match, by the length of the shorter."""
    covered = F.greatest(F.lit(LEAST_SUM), F.ceil(length * LEAST_SHARE - 1e-9).cast("int"))
    return (covered - 1 - F.floor((covered - LEAST_LARGEST) / LEAST_BLOCK)).cast("int")


def _places(text: str) -> dict[str, list[int]]:
    out = defaultdict(list)
    for j in range(len(text) - 1):
        out[text[j : j + 2]].append(j)
    return dict(out)


def pair_match(pairs: list[str], n: int, places: dict[str, list[int]], m: int) -> bool:
    """block_match() of a text of n characters, given by its pairs, and one of m, given by the places of its pairs.

    Runs of pairs on a diagonal are found once; the longest within a window of both texts is the block that difflib finds there. Blocks of
    one character count for nothing, nor does anything beside them. Stops when enough is covered, or no longer can be.
    """
    shorter, runs, open_at = min(n, m), [], {}
    for i, p in enumerate(pairs):
        now = {j: open_at.get(j - 1, i) for j in places.get(p, ())}
        runs += [(i + 1 - at, at, j - i + 1 + at) for j, at in open_at.items() if j + 1 not in now]
        open_at = now
    i = len(pairs)
    runs += [(i + 1 - at, at, j - i + 1 + at) for j, at in open_at.items()]
    if shorter < EIGHT or max((r[0] for r in runs), default=0) < LEAST_LARGEST:
        return False
    covered = blocks = 0
    bound, todo = shorter, [(0, n, 0, m, runs)]
    while todo:
        left, right, low, high, own = todo.pop()
        best, at, there, inside = 1, 0, 0, []
        for run in own:
            size, i, j = run
            cut = max(left - i, low - j, 0)
            i, j = i + cut, j + cut
            size = min(size - cut, right - i, high - j)
            if size >= LEAST_BLOCK:
                inside.append(run)
                if size > best or (size == best and (i, j) < (at, there)):
                    best, at, there = size, i, j
        bound -= min(right - left, high - low)
        if best >= LEAST_BLOCK:
            covered, blocks, bound = covered + best, blocks + 1, bound + best
            if blocks >= 2 and covered >= LEAST_SUM and covered / shorter >= LEAST_SHARE:
                return True
            for window in ((left, at, low, there), (at + best, right, there + best, high)):
                room = min(window[1] - window[0], window[3] - window[2])
                if room >= LEAST_BLOCK:
                    bound += room
                    todo.append((*window, inside))
        if bound < LEAST_SUM or bound / shorter < LEAST_SHARE:
            return False
    return False


def _grams(text: str, n: int) -> list[tuple[str, int]]:
    """The runs of n characters, the k-th of a kind with its number."""
    seen: dict[str, int] = defaultdict(int)
    out = []
    for i in range(len(text) - n + 1):
        x = text[i : i + n]
        out.append((x, seen[x]))
        seen[x] += 1
    return out


class _Block:
    """Sentences with inverted lists of their pairs and threes of characters."""

    def __init__(self, texts: list[str]):
        self.texts, self.sizes = texts, np.array([len(x) for x in texts])
        self.lists: dict[int, dict] = {}
        for n in (2, 3):
            rows = defaultdict(list)
            for i, x in enumerate(texts):
                for g in _grams(x, n):
                    rows[g].append(i)
            self.lists[n] = {g: np.array(x) for g, x in rows.items()}
        self.places: list[dict | None] = [None] * len(texts)

    def shared(self, text: str, n: int) -> np.ndarray:
        found = [x for g in _grams(text, n) if (x := self.lists[n].get(g)) is not None]
        return np.bincount(np.concatenate(found), minlength=len(self.texts)) if found else np.zeros(len(self.texts), np.int64)

    def matches(self, text: str) -> bool:
        """Whether one of the sentences matches; those that share most for their length, and short ones, are tried first."""
        size = np.minimum(self.sizes, len(text))
        pairs = self.shared(text, 2)
        covered = np.maximum(LEAST_SUM, np.ceil(size * LEAST_SHARE - 1e-9).astype(int))
        at = np.nonzero(pairs >= covered - 1 - (covered - LEAST_LARGEST) // LEAST_BLOCK)[0]
        if not len(at):
            return False
        likely = pairs[at] / (size[at] - 1) + self.shared(text, 3)[at] / (size[at] - 2) - 0.004 * self.sizes[at]
        own = [text[i : i + 2] for i in range(len(text) - 1)]
        for i in at[np.argsort(-likely, kind="stable")].tolist():
            if self.places[i] is None:
                self.places[i] = _places(self.texts[i])
            if pair_match(own, len(text), self.places[i], len(self.texts[i])):
                return True
        return False


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """The different sentences (chat_id, s) of `left` that one of (chat_id, t) matches in blocks.

    A chat's sentences t lie in blocks of about BLOCK_ROWS. Sentences s meet the first block, those without a match the next two, then the next
    four and so on, so only those that nothing matches are compared with all; copies of a block deal a chat's sentences to many tasks.
    """
    number = lambda n, by: F.ceil(n / F.lit(by)).cast("long")
    known = right.select("chat_id", "t").filter((F.char_length("t") >= EIGHT) & F.col("chat_id").isNotNull()).distinct()
    known = written(known)
    sizes = written(known.groupBy("chat_id").agg(number(F.count(F.lit(1)), BLOCK_ROWS).alias("_blocks")))
    held = written(known.join(sizes, "chat_id").withColumn("_b", F.pmod(F.xxhash64("t"), "_blocks")).drop("_blocks"))
    asks = left.select("chat_id", "s").filter(F.char_length("s") >= EIGHT).distinct().join(sizes, "chat_id")
    asks = written(asks.withColumn("sid", F.monotonically_increasing_id()))

    def answer(block: _Block, table: pa.Table):
        good = [i for i, s in zip(table["sid"].to_pylist(), table["s"].to_pylist()) if block.matches(s)]
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], names=["sid"])

    todo, found, first, width = asks, [], 0, 1
    while not todo.isEmpty():
        copies = todo.groupBy("chat_id").agg(number(F.count(F.lit(1)), ASKS).alias("_copies"))
        block = F.concat_ws("|", "_copy", "_b", "chat_id").alias("block")
        mine = todo.join(copies, "chat_id").withColumn("_copy", F.pmod(F.xxhash64("s"), "_copies"))
        asked = mine.withColumn("_b", F.explode(F.sequence(F.lit(first).cast("long"), F.least(F.lit(first + width), F.col("_blocks")) - 1)))
        dealt = held.filter(F.col("_b").between(first, first + width - 1)).join(copies, "chat_id").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        found.append(written(meet(dealt.select(block, "t"), asked.select(block, "sid", "s"), lambda t: _Block(t["t"].to_pylist()), answer, "sid long").distinct()))
        first, width = first + width, 2 * width
        todo = written(todo.filter(F.col("_blocks") > first).join(found[-1], "sid", "left_anti"))
    out = asks.select("sid").limit(0)
    for x in found:
        out = out.unionByName(x)
    return asks.join(out, "sid", "left_semi").select("chat_id", "s")


def _numbered(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(sentences with an id, their pairs): different sentences of EIGHT characters and more, and the pairs of neighbouring characters in each, the k-th of a kind with its number."""
    known = rows.select("chat_id", F.col(column).alias("x")).distinct().filter(F.char_length("x") >= EIGHT)
    known = written(known.select(F.monotonically_increasing_id().alias("sid"), "chat_id", "x", F.char_length("x").alias("size")))
    chars = F.split("x", "")
    pairs = F.transform(F.sequence(F.lit(0), F.col("size") - 2), lambda i: F.concat(F.get(F.col("_c"), i), F.get(F.col("_c"), i + 1)))
    counts = known.withColumn("_c", chars).select("sid", "chat_id", "size", F.explode(pairs).alias("p")).groupBy("sid", "chat_id", "size", "p").agg(F.count(F.lit(1)).alias("n"))
    return known, written(counts.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("sid", "chat_id", "size", F.concat("p", F.col("k").cast("string")).alias("p")))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (chat_id, s, t) of different sentences of (chat_id, s) and (chat_id, t) that share enough pairs of characters to match."""
    (s, of_s), (t, of_t) = _numbered(left, "s"), _numbered(right, "t")
    rarity = of_s.unionByName(of_t).groupBy("chat_id", "p").agg(F.count(F.lit(1)).alias("n"))

    def rarest(pairs: DataFrame) -> DataFrame:
        """As many of each sentence's rarest pairs as leave no match without one of them."""
        place = F.row_number().over(Window.partitionBy("sid").orderBy("n", "p"))
        kept = F.greatest(F.lit(1), F.col("size") - 1 - least_shared(F.col("size")) + 1)
        return pairs.join(rarity, ["chat_id", "p"]).withColumn("_r", place).filter(F.col("_r") <= kept).select("sid", "chat_id", "size", "p")

    def met(shorter: DataFrame, longer: DataFrame, names: list[str]) -> DataFrame:
        other = longer.select(F.col("sid").alias("other"), "chat_id", F.col("size").alias("_size"), "p")
        return rarest(shorter).join(other, ["chat_id", "p"]).filter(F.col("size") <= F.col("_size")).select(F.col("sid").alias(names[0]), F.col("other").alias(names[1]))

    found = met(of_s, of_t, ["s_id", "t_id"]).unionByName(met(of_t, of_s, ["t_id", "s_id"])).distinct()
    bags = lambda known, pairs, n: known.join(pairs.groupBy("sid").agg(F.collect_list("p").alias(f"{n}_pairs")), "sid").select(F.col("sid").alias(f"{n}_id"), F.col("x").alias(n), F.col("size").alias(f"{n}_size"), f"{n}_pairs", *["chat_id"] * (n == "s"))
    full = found.join(bags(s, of_s, "s"), "s_id").join(bags(t, of_t, "t"), "t_id").filter("s != t")
    shared = F.size(F.array_intersect("s_pairs", "t_pairs"))
    return full.filter(shared >= least_shared(F.least("s_size", "t_size"))).select("chat_id", "s", "t")


def group_pattern_reuse(replies: DataFrame, history: DataFrame, ends: str = ENDS) -> DataFrame:
    """(id, exact, fuzzy) of replies (id, chat_id, text): a sentence is in two or more of the chat's messages; one matches another in blocks, or itself.

    History has chat_id, message_id, text; `ends` is the pattern of what ends a sentence.
    """
    r = written(replies.select("id", "chat_id", F.explode(sentences(F.col("text"), ends)).alias("s")))
    h = written(history.select("chat_id", "message_id", F.explode(sentences(F.col("text"), ends)).alias("t")).distinct())
    often = h.groupBy("chat_id", F.col("t").alias("s")).agg(F.count_distinct("message_id").alias("n"))
    exact = r.join(often.filter("n >= 2"), ["chat_id", "s"]).select("id").distinct().withColumn("exact", F.lit(True))

    alike = matched(r, h)
    fuzzy = r.join(alike, ["chat_id", "s"]).select("id").distinct().withColumn("fuzzy", F.lit(True))
    return replies.select("id").join(exact, "id", "left").join(fuzzy, "id", "left").na.fill(False, ["exact", "fuzzy"])
