"""Spelling variants of the corpus' words by blocked Gram matrices of letter counts.

Words are counted over all texts by Spark's own functions. One inserted or deleted letter changes one entry of a word's
letter counts by one, a replaced one two: near words lie at a squared distance of at most two, in the same or in adjacent
length blocks. The letters are dealt into four parts of about equal weight, so near words of one length agree in the
counts of two parts, and near words of adjacent lengths in three. Blocks of words that agree so are multiplied in NumPy
(|a|^2 + |b|^2 - 2 a.b), pairs within the distance are emitted from the first of their common blocks alone, and
edits are verified on the words. A block of more than TILE words is dealt in tiles, whose pairs meet in tasks of their own.

Null texts have no words, a null doc_id counts as the empty string; repeated rows count again; an empty table, or one without
a word that is frequent enough, gives no rows; other columns are ignored. Words of any length take part. Of near words that occur
equally often the smallest in code-point order is the form.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.stage import drop_written, written

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a tile, and of a product of several small blocks.
TILE, TOGETHER = 512, 128
PARTS = 4
#: Parts that near words of one length, and of adjacent lengths, have in common.
_SAME = list(combinations(range(PARTS), PARTS - 2))
_NEXT = list(combinations(range(PARTS), PARTS - 1))
_EQUAL, _SHORT, _LONG = 0, 1, 2
_KEYED = "key long, role int, combo int, word string, n long"


def counted_words(docs: DataFrame, rate: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case; of one in `rate`, by its document and spelling, a letter is deleted."""
    lower = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.split(lower, "[^A-Za-zÀ-ÿ]+")).alias("run"))
    size = F.char_length("run")
    hashed = runs.filter(size >= least_length).select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"), size.cast("long").alias("size"))
    at = F.pmod("h", "size").cast("int")
    word = F.when(F.col("h") % rate == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size").cast("int")))).otherwise(F.col("run"))
    found = hashed.select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def letter_parts(words: DataFrame) -> np.ndarray:
    """The part of each Latin-1 code: letters by their number in all words, each to the part that has least so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    part, weight = np.zeros(256, np.int64), [0] * PARTS
    for row in sorted(letters, key=lambda r: (-r.n, r.c)):
        lightest = weight.index(min(weight))
        part[ord(row.c)] = lightest
        weight[lightest] += row.n
    return part


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, Latin-1 code) of each letter of the words, all of which Latin-1 has."""
    data = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    return np.repeat(np.arange(len(data)), sizes), np.frombuffer(b"".join(data), np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def block_keys(words: DataFrame, part: np.ndarray) -> DataFrame:
    """A row for each block of a word: key (of length, common parts and their letters), role, combo (the parts), word, n."""
    values = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code = _letters(batch["word"])
            n = batch.num_rows
            size = np.bincount(row, minlength=n).astype(np.uint64)
            sums = np.zeros((PARTS, n), np.uint64)  # a sum of random values tells multisets of letters apart
            np.add.at(sums, (part[code], row), values[code])
            every = np.arange(n)
            for combos, roles in ((_SAME, (_EQUAL,)), (_NEXT, (_SHORT, _LONG))):
                for role in roles:
                    length = size - np.uint64(role == _LONG)
                    for i, combo in enumerate(combos):
                        key = _mixed(length * np.uint64(64) + np.uint64(32 * (role != _EQUAL) + i))
                        for p in combo:
                            key = _mixed(key + sums[p])
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(n, role, np.int32)), pa.array(np.full(n, i, np.int32)), batch["word"].take(pa.array(every)), batch["n"]], names=["key", "role", "combo", "word", "n"])

    return words.select("word", "n").mapInArrow(run, _KEYED)


def _changes(table: pa.Table) -> np.ndarray:
    """Whether each row but the first is of another block, or pair of tiles, than the one before."""
    group = np.stack([table[c].to_numpy() for c in ("key", "lo", "hi")])
    return (group[:, 1:] != group[:, :-1]).any(axis=0)


def _pairs(table: pa.Table, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of whole blocks (or pairs of tiles) within the squared distance."""
    row, code = _letters(table["word"].combine_chunks())
    present, column = np.unique(code, return_inverse=True)
    n = table.num_rows
    counts = np.bincount(row * len(present) + column, minlength=n * len(present)).reshape(n, len(present)).astype(np.float64)
    role, combo, tile, across = (table[c].to_numpy() for c in ("role", "combo", "tile", "across"))
    block = np.cumsum(np.append(0, _changes(table)))
    squared = (counts * counts).sum(axis=1)
    size = counts.sum(axis=1)
    distance = squared[:, None] + squared[None, :] - 2 * (counts @ counts.T)
    met = (block[:, None] == block[None, :]) & (combo[:, None] == combo[None, :]) & ((tile[:, None] != tile[None, :]) | ~across[:, None])
    equal = (role[:, None] == _EQUAL) & (role[None, :] == _EQUAL) & (size[:, None] == size[None, :]) & np.tri(n, k=-1, dtype=bool)
    longer = (role[:, None] == _SHORT) & (role[None, :] == _LONG) & (size[:, None] + 1 == size[None, :])
    a, b = np.nonzero(met & (equal & (distance <= 2) | longer & (distance <= 1)))
    if not len(a):
        return
    own = part[present]
    differs = np.stack([(counts[a][:, own == p] != counts[b][:, own == p]).any(axis=1) for p in range(PARTS)], axis=1)
    first = np.zeros(len(a), bool)
    for combos, mine in ((_SAME, role[a] == _EQUAL), (_NEXT, role[a] == _SHORT)):
        agrees = np.stack([~differs[:, list(c)].any(axis=1) for c in combos], axis=1)
        first |= mine & agrees.any(axis=1) & (agrees.argmax(axis=1) == combo[a])
    a, b = pa.array(a[first]), pa.array(b[first])
    word, times = table["word"].combine_chunks(), table["n"].combine_chunks()
    yield pa.RecordBatch.from_arrays([word.take(a), times.take(a), word.take(b), times.take(b)], names=["word", "n", "near", "near_n"])


def _blocks(part: np.ndarray):
    """Cuts sorted rows where a block ends: small blocks share a product, a pair of tiles has one of its own."""

    def whole(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
        starts = np.concatenate([[0], np.nonzero(_changes(table))[0] + 1])
        ends = np.append(starts[1:], table.num_rows)
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        out, at = [], 0
        for i, end in enumerate(ends):
            if end - at > TOGETHER and starts[i] > at:
                out.append(table.slice(at, starts[i] - at))
                at = starts[i]
        done = int(ends[-1]) if len(ends) else 0
        if done > at:
            out.append(table.slice(at, done - at))
        return out, table.slice(done) if done < table.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            tables, held = whole(pa.concat_tables([held, table]).combine_chunks() if held is not None else table, False)
            for t in tables:
                yield from _pairs(t, part)
        if held is not None:
            for t in whole(held, True)[0]:
                yield from _pairs(t, part)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), one row for each pair of words that differ by one inserted, deleted or replaced letter."""
    part = letter_parts(words)
    keyed = written(block_keys(words, part), "blocks")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    dealt = keyed.join(sizes, "key").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = other.select("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "role", "combo", "tile", (F.col("tile") != F.col("other")).alias("across"), "word", "n")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = ordered.mapInArrow(_blocks(part), "word string, n long, near string, near_n long")
    out = written(pairs.filter(F.levenshtein("word", "near", 1) == 1), "near")
    drop_written(words.sparkSession, keyed)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: forms are followed to the last, twice as far each round, each written."""
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = written(state.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        state = after.select("word", "root")
        if after.filter("_moved").isEmpty():
            return state


def spelling_groups(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of five letters or more that occurs three times or more.

    The form is the near word that occurs most, if at least twice as often as the word; the root is the last of the forms.
    """
    words = written(counted_words(docs), "words")
    pairs = near_words(words)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_order"), "near")).alias("_best"))
    near = words.join(best, "word", "left").withColumn("_n", -F.col("_best._order"))
    led = F.col("_n") >= 2 * F.col("n")
    formed = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("_best.near")).alias("form"), F.when(led, F.col("_n")).cast("long").alias("form_n")), "forms")
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
