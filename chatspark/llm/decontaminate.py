"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item (an item of fewer words is one
window). The fingerprint of a window is the smallest hash of its 5-word grams. Since it
depends on the window's words alone, every shared window has one fingerprint on both
sides. Document windows whose fingerprint is one of the benchmark's are extended: the
whole window's hash must be that of an item's window. Items of fewer than 13 words have
no 13-word window to winnow; the full gram is their fingerprint.

Null or empty texts have no words and are never hit. Repeated rows each get their row.
Ties between equal gram hashes don't matter (the fingerprint is a value, not a place).
An empty benchmark hits nothing; empty documents give an empty result. Other columns are
ignored (`contaminated_words`) or kept (`clean_documents`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.seqhash import NON_WORD, Words, covered, distinct_hashes, grams, lower_ascii, sliding_min, text_blocks, valid_starts
from chatspark.llm.stage import fresh, row_key, small_batches, written

WINDOW = 13
GRAM = 5
#: A benchmark of up to this much text is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20


class ItemWindows:
    """Windows of a block of benchmark items: fingerprints, and items by window hash and length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.ids = window, gram, []
        full: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for at, data, offsets in text_blocks(pa.array([t for _, t in items], pa.string())):
            words = Words(lower_ascii(data), offsets, NON_WORD)
            for i in range(len(offsets) - 1):
                own = words.hash[words.doc_start[i] : words.doc_start[i + 1]]
                self.ids.append(items[at + i][0])
                if not len(own):
                    continue
                n = min(len(own), window)
                hashes = grams(own, n)
                by_length.setdefault(n, []).append((hashes, np.full(len(hashes), at + i)))
                if n == window:
                    full.append(hashes)
                    marks.append(sliding_min(grams(own, gram), window - gram + 1))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        self.by_length = {}
        for n, parts in by_length.items():
            hashes, item = np.concatenate([h for h, _ in parts]), np.concatenate([i for _, i in parts])
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = (hashes[order], item[order])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mask of values that are in the sorted array `known`."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def scan(texts: pa.Array, items: ItemWindows) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(words, mask of the hit words, items found) of each text."""
    for _, data, offsets in text_blocks(texts):
        words = Words(lower_ascii(data), offsets, NON_WORD)
        n = len(words)
        hit = np.zeros(n, bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for length, (known, item) in items.by_length.items():
            if n < length:
                continue
            if length == items.window:
                marks = sliding_min(grams(words.hash, items.gram), items.window - items.gram + 1)
                at = np.flatnonzero(_among(marks, items.marks) & valid_starts(words, length))
                index = at[:, None] + np.arange(length)
                hashes = grams(words.hash[index].ravel(), length)[::length] if len(at) else np.zeros(0, np.uint64)
            else:
                hashes = grams(words.hash, length)
                at = np.flatnonzero(_among(hashes, known) & valid_starts(words, length))
                hashes = hashes[at]
            good = _among(hashes, known)
            at, hashes = at[good], hashes[good]
            if not len(at):
                continue
            hit |= covered(at, length, n)
            low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            doc = np.searchsorted(words.doc_start, at, "right") - 1
            reps = high - low
            flat = np.repeat(low - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
            found.append((np.repeat(doc, reps), item[flat]))
        doc = np.concatenate([d for d, _ in found]) if found else np.zeros(0, np.int64)
        item = np.concatenate([i for _, i in found]) if found else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([doc, item], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        edges = np.searchsorted(pairs[:, 0], np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            a, b = words.doc_start[i], words.doc_start[i + 1]
            yield int(b - a), hit[a:b], [items.ids[k] for k in pairs[edges[i] : edges[i + 1], 1]]


def _summary(n: int, hit: int, items: list[str]) -> tuple:
    items = sorted(set(items))
    return n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n


_OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _broadcast(benchmark: DataFrame, limit: int):
    """The items' windows for every task, or None where the items' texts and ids are over `limit` bytes."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if size > limit:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(ItemWindows([tuple(r) for r in items.collect()]))


def _marks(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, fingerprints, hashes) of the windows of n words."""
    at = np.flatnonzero(valid_starts(words, n))
    hashes = grams(words.hash, n)
    return at, (sliding_min(grams(words.hash, GRAM), n - GRAM + 1) if n == WINDOW else hashes)[at], hashes[at]


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """(n, mark, hash, item) of the items' windows."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in text_blocks(batch["text"]):
                words = Words(lower_ascii(data), offsets, NON_WORD)
                size = np.minimum(words.counts, WINDOW)
                for n in np.unique(size[size > 0]).tolist():
                    start, mark, hashes = _marks(words, n)
                    doc = words.doc[start]
                    mine = size[doc] == n
                    out = [pa.array(np.full(int(mine.sum()), n, np.int32)), *[pa.array(x[mine].view(np.int64)) for x in (mark, hashes)], batch["item"].take(pa.array(at + doc[mine]))]
                    yield pa.RecordBatch.from_arrays(out, names=["n", "mark", "hash", "item"])

    return _items(benchmark).mapInArrow(run, "n int, mark long, hash long, item string").distinct()


def _doc_marks(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, n, mark): the distinct fingerprints of each document."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in text_blocks(batch["text"]):
                words = Words(lower_ascii(data), offsets, NON_WORD)
                for n in lengths:
                    start, mark, _ = _marks(words, n) if len(words) >= n else (np.zeros(0, np.int64), np.zeros(0, np.uint64), None)
                    doc, mark, _ = distinct_hashes(words.doc[start], mark)
                    yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(at + doc)), pa.array(np.full(len(doc), n, np.int32)), pa.array(mark.view(np.int64))], names=["row", "n", "mark"])

    return rows.select("row", "text").mapInArrow(run, "row binary, n int, mark long")


def _doc_windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, n, hash, start) of the windows whose fingerprint is among the row's `marks`."""

    def run(batches):
        for batch in batches:
            asked = batch["marks"].to_pylist()
            for at, data, offsets in text_blocks(batch["text"]):
                words = Words(lower_ascii(data), offsets, NON_WORD)
                for n in lengths:
                    if len(words) < n:
                        continue
                    start, mark, hashes = _marks(words, n)
                    edges = np.searchsorted(start, words.doc_start)
                    for i in range(len(offsets) - 1):
                        a, b = edges[i], edges[i + 1]
                        mine = np.flatnonzero(np.isin(mark[a:b].view(np.int64), [m["mark"] for m in asked[at + i] if m["n"] == n])) + a
                        if len(mine):
                            columns = [batch["row"].take(pa.array(np.full(len(mine), at + i))), pa.array(np.full(len(mine), n, np.int32)), pa.array(hashes[mine].view(np.int64)), pa.array(start[mine] - words.doc_start[i])]
                            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "hash", "start"])

    return rows.select("row", "text", "marks").mapInArrow(run, "row binary, n int, hash long, start long")


def _joined_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As contaminated_words(), for a benchmark of any size: fingerprints and then windows are joined by shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    rows = written(rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "rows")
    items = written(_item_windows(benchmark), "item_windows")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())
    marks = _doc_marks(rows, lengths).join(items.select("n", "mark").distinct(), ["n", "mark"], "left_semi")
    asked = rows.join(marks.groupBy("row").agg(F.collect_list(F.struct("n", "mark")).alias("marks")), "row")
    found = written(_doc_windows(asked, lengths), "windows")
    hits = found.join(items.select("n", "hash").distinct(), ["n", "hash"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("n", "start")).alias("hits"))
    names = found.select("row", "n", "hash").distinct().join(items.select("n", "hash", "item").distinct(), ["n", "hash"]).select("row", "item").distinct().groupBy("row").agg(F.collect_list("item").alias("items"))

    def run(batches):
        for batch in batches:
            out, hits, items = [], batch["hits"].to_pylist(), batch["items"].to_pylist()
            for at, data, offsets in text_blocks(batch["text"]):
                for i, n in enumerate(Words(lower_ascii(data), offsets, NON_WORD).counts.tolist(), at):
                    gone = np.zeros(n, bool)
                    for x in hits[i] or []:
                        gone[x["start"] : x["start"] + x["n"]] = True
                    out.append(_summary(n, int(gone.sum()), items[i] or []))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), _KINDS)] if out else [pa.array([], k) for k in _KINDS]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["copies"], *columns], names=["row", "doc_id", "copies", *[x.split()[0] for x in _OUT.split(", ")]])

    whole = rows.join(hits, "row", "left").join(names, "row", "left").select("row", "doc_id", "copies", "text", "hits", "items")
    return whole.mapInArrow(run, f"row binary, doc_id long, copies long, {_OUT}")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs`.

    A benchmark of up to `broadcast_bytes` goes to every task and needs no shuffle; a larger one is joined.
    """
    small_batches(docs.sparkSession)
    shared = _broadcast(benchmark, broadcast_bytes)
    if shared is None:
        found = _joined_words(docs, benchmark)
        return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies", "row")

    def run(batches):
        for batch in batches:
            out = [_summary(n, int(h.sum()), found) for n, h, found in scan(batch["text"], shared.value)]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), _KINDS)] if out else [pa.array([], k) for k in _KINDS]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *[x.split()[0] for x in _OUT.split(", ")]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {_OUT}")


def clean_documents(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `docs` that aren't contaminated, with all their columns; only the texts go to the workers, and a mask comes back."""
    small_batches(docs.sparkSession)
    shared = _broadcast(benchmark, broadcast_bytes)
    if shared is not None:

        @F.arrow_udf("boolean")
        def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for some in texts:
                yield pa.array([not _summary(n, int(h.sum()), [])[4] for n, h, _ in scan(some, shared.value)], pa.bool_())

        return docs.filter(clean(docs["text"].cast("string")))
    gone = fresh(docs.columns, "gone")
    bad = _joined_words(docs.select("doc_id", "text"), benchmark).filter("contaminated").select(F.col("row").alias(gone))
    own = row_key(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, own == F.col(gone), "left_anti")
