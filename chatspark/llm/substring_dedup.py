"""Substring deduplication by seed and extend over words.

Seeds are winnowed anchors: the smallest 5-word gram of each window of 13 words, so that every
window holds a seed that depends on its own words alone. Documents are joined on their seeds;
only seeds of several documents go on. Each is extended both ways, to every window that it anchors,
and the extensions meet by their words (two 64-bit hashes) instead of by pairs of documents, of
which a common passage has a quadratic number. A window that also starts in a document with a
smaller doc_id is a repeat, and overlapping repeats chain to maximal ones, whose words are removed.

Equal texts are processed once, for their smallest doc_id; in copies with a larger one every window is a
repeat. Null or empty text has no words and keeps the empty text; a document of fewer than 13 words
loses nothing. A null doc_id counts as smallest. Rows that share a doc_id, or have none, take nothing
from each other, since neither has the smaller one; equal rows get equal results. Empty tables give
empty results, other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.repeats import by_document, later_hashes, minimizers, shared_hashes
from chatspark.llm.seqhash import OTHER, WHITE, Words, covered, distinct_hashes, grams, sliding_min, text_blocks, valid_starts
from chatspark.llm.stage import distinct_texts, keyed_rows, written

WINDOW = 13
SEED = 5
_LEAST = -(1 << 63)


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hashes, the smallest of each window, and the mask of the seeds that are one."""
    seeds = grams(words.hash, SEED)
    least, chosen = minimizers(seeds, WINDOW - SEED + 1, valid_starts(words, WINDOW))
    return seeds, least, chosen


def hash_batch(ids: np.ndarray, doc: np.ndarray, hashes: np.ndarray, copied: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct hashes of each document; `often` where a document repeats one or is itself copied."""
    doc, hashes, often = distinct_hashes(doc, hashes)
    if copied is not None:
        often = often | copied[doc]
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[doc]), pa.array(often)], names=["hash", "doc", "often"])


HASH_ROWS = "hash long, doc long, often boolean"


def _seed_rows(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch["first_id"].to_numpy()
            for at, data, offsets in text_blocks(batch["text"]):
                words = Words(data, offsets, WHITE)
                if len(words) >= WINDOW:
                    seeds, _, chosen = _anchors(words)
                    yield hash_batch(ids[at:], words.doc[: len(seeds)][chosen], seeds[chosen])

    return texts.select("first_id", "text").mapInArrow(run, HASH_ROWS)


def answers(batch: pa.RecordBatch, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document in the block, hash) of what was answered to the n documents from `at`, sorted by hash within each."""
    lists = batch["hashes"].slice(at, n)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy().view(np.uint64) if sizes.sum() else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    order = np.lexsort((flat, doc))
    return doc[order], flat[order]


def among_answers(doc: np.ndarray, hashes: np.ndarray, known_doc: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mask of the (doc, hash) that were answered."""
    if not len(known):
        return np.zeros(len(doc), bool)
    out = np.zeros(len(doc), bool)
    every, index = np.unique(known, return_inverse=True)
    place = np.minimum(np.searchsorted(every, hashes), len(every) - 1)
    hit = np.flatnonzero(every[place] == hashes)
    pairs = np.sort(known_doc.astype(np.int64) * len(every) + index)
    asked = doc[hit].astype(np.int64) * len(every) + place[hit]
    found = pairs[np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)] == asked
    out[hit[found]] = True
    return out


def _window_rows(joined: DataFrame) -> DataFrame:
    """The extensions of shared seeds: from each seed to the left and right as far as the windows that it anchors reach."""

    def run(batches):
        for batch in batches:
            ids, least_id = batch["first_id"].to_numpy(), batch["least_id"].to_numpy()
            for at, data, offsets in text_blocks(batch["text"]):
                words = Words(data, offsets, WHITE)
                seeds, least, _ = _anchors(words)
                shared = among_answers(words.doc[: len(seeds)], seeds, *answers(batch, at, len(offsets) - 1))
                best = sliding_min(np.where(shared, seeds, ~np.uint64(0)), WINDOW - SEED + 1)
                start = np.flatnonzero((best == least) & valid_starts(words, WINDOW))
                windows, other = grams(words.hash, WINDOW), grams(words.hash, WINDOW, OTHER)
                doc, hashes, _, place = distinct_hashes(words.doc[start], windows[start], places=True)
                columns = [hashes.view(np.int64), other[start][place].view(np.int64), ids[at:][doc], least_id[at:][doc]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "other", "doc", "least"])

    return joined.select("first_id", "least_id", "text", "hashes").mapInArrow(run, "hash long, other long, doc long, least long")


def _removed(joined: DataFrame) -> DataFrame:
    """n_words, n_removed, n_spans and the kept words' digest of each text, for its smallest doc_id."""
    schema = "key binary, least_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            rows = []
            for at, data, offsets in text_blocks(batch["text"]):
                words = Words(data, offsets, WHITE)
                n = len(words)
                gone = np.zeros(n, bool)
                if n >= WINDOW:
                    known = answers(batch, at, len(offsets) - 1)
                    if len(known[1]):
                        windows = grams(words.hash, WINDOW)
                        start = np.flatnonzero(among_answers(words.doc[: len(windows)], windows, *known) & valid_starts(words, WINDOW))
                        gone = covered(start, WINDOW, n)
                first = gone.copy()
                if n:
                    first[1:] &= ~gone[:-1]
                for i in range(len(offsets) - 1):
                    a, b = words.doc_start[i], words.doc_start[i + 1]
                    own = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    out = gone[a:b]
                    lost = int(out.sum())
                    kept = own if not lost else [w for w, x in zip(own, out.tolist()) if not x]
                    spans = int(first[a:b].sum()) + int(b > a and out[0] and not first[a])
                    rows.append((int(b - a), lost, spans, hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch["key"], batch["least_id"], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["key", "least_id", "n_words", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("key", "least_id", "text", "hashes").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans (maximal repeats) for each row of `docs`."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), "text")
    texts = distinct_texts(docs)
    joined = lambda rows, how: texts.join(by_document(rows).withColumnRenamed("doc", "first_id"), "first_id", how)
    seeds = written(shared_hashes(_seed_rows(texts)), "seeds")
    repeats = written(later_hashes(_window_rows(joined(seeds, "inner"))), "repeats")
    own = written(_removed(joined(repeats, "left")), "removed")
    rows = keyed_rows(docs).join(own, "key")
    copy = F.col("doc_id") > F.col("least_id")
    full = copy & (F.col("n_words") >= WINDOW)
    return rows.select(
        F.nullif("doc_id", F.lit(_LEAST)).alias("doc_id"), "n_words",
        F.when(full, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(full, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(full, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
    )
