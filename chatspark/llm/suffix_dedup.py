"""Removal of repeated byte strings, by merged Burrows-Wheeler transforms.

A string of LENGTH bytes that occurs twice has the same smallest 16-byte gram (minimizer) at both
places. Documents first exchange their minimizers; only windows whose minimizer occurs again go on, as
segments of consecutive windows with one minimizer. Equal segments are combined, with their number as
weight. All segments of a minimizer meet in one bucket, where shards of them are sorted, their transforms
merged by interleave refinement, and the intervals of common prefixes of LENGTH bytes read off: the places of
an interval of weight two or more are repeats. Overlapping repeats chain to maximal runs, which are removed.

Buckets are read as a stream of about BUCKET_BYTES. The different segments of a minimizer that fill more than
GROUP_BYTES are cut, by the place of the minimizer in their windows, into pieces that are dealt by the bytes which all
windows of a piece share, and merged in the same way: a passage that very many documents have doesn't meet in one
task, since its inner pieces are equal and combine, and its outer ones differ and part.

Equal texts are processed once with their number as weight. Null or empty text has no bytes; texts of fewer
than LENGTH bytes lose nothing. Matches never cross documents. Repeated rows are copies of each other. Texts that
share a doc_id, or have none, are told apart by their keys. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.bwt import repeated_starts
from chatspark.llm.repeats import by_document, minimizers, shared_hashes
from chatspark.llm.seqhash import byte_grams, inside, text_blocks
from chatspark.llm.stage import distinct_texts, keyed_rows, written
from chatspark.llm.substring_dedup import HASH_ROWS, among_answers, answers, hash_batch

LENGTH = 200
GRAM = 16
BUCKET_BYTES = 64 << 10
#: Different segments of one minimizer beyond this size are cut into PIECES ranges and dealt to several tasks.
GROUP_BYTES = 128 << 10
PIECES = 8
#: Repeats of pieces up to this many (about 20 MB) are broadcast to the pieces; more are joined by shuffle.
MAX_BROADCAST_PIECES = 200_000
_LEAST = -(1 << 63)
_SEGMENTS = "hash long, segment binary, doc long, start long, weight long"


def _minimizers(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, the smallest of each window, the mask of grams that are one, and the mask of whole windows."""
    valid = inside(offsets, length)
    seeds = byte_grams(data, GRAM)
    if not len(valid):
        return seeds, valid.astype(np.uint64), np.zeros(len(seeds), bool), valid
    least, chosen = minimizers(seeds, length - GRAM + 1, valid)
    return seeds, least, chosen, valid


def _seed_rows(texts: DataFrame, length: int) -> DataFrame:
    """The minimizers of each text; those of a text with copies occur more than once."""

    def run(batches):
        for batch in batches:
            ids, copied = batch["first_id"].to_numpy(), batch["copies"].to_numpy() > 1
            for at, data, offsets in text_blocks(batch["text"]):
                seeds, _, chosen, _ = _minimizers(data, offsets, length)
                place = np.flatnonzero(chosen)
                yield hash_batch(ids[at:], np.searchsorted(offsets, place, "right") - 1, seeds[place], copied[at:])

    return texts.select("first_id", "copies", "text").mapInArrow(run, HASH_ROWS)


def _segments(joined: DataFrame, length: int) -> DataFrame:
    """The segments of each document whose minimizer occurs again."""

    def run(batches):
        for batch in batches:
            ids, copies = batch["first_id"].to_numpy(), batch["copies"].to_numpy()
            for at, data, offsets in text_blocks(batch["text"]):
                seeds, least, _, valid = _minimizers(data, offsets, length)
                window = np.flatnonzero(valid)
                if not len(window):
                    continue
                doc = np.searchsorted(offsets, window, "right") - 1
                value = least[window]
                new = np.ones(len(window), bool)
                new[1:] = (window[1:] != window[:-1] + 1) | (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(window)) - 1
                keep = among_answers(doc[first], value[first], *answers(batch, at, len(offsets) - 1))
                first, last = first[keep], last[keep]
                begin, end, doc = window[first], window[last] + length, doc[first]
                pieces = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[first].view(np.int64)), pa.array(pieces, pa.binary()), pa.array(ids[at:][doc]), pa.array(begin - offsets[doc]), pa.array(copies[at:][doc])],
                    names=["hash", "segment", "doc", "start", "weight"],
                )

    return joined.select("first_id", "copies", "text", "hashes").mapInArrow(run, _SEGMENTS)


def _runs(start: np.ndarray, whole: bool = False) -> bytes:
    """Sorted window starts as (first, last) pairs of 4-byte numbers; `whole`: the first and last of one run."""
    if whole:
        return start.astype("<u4").tobytes()
    if not len(start):
        return b""
    cut = np.flatnonzero(np.diff(start) > 1)
    pairs = np.stack([start[np.append(0, cut + 1)], start[np.append(cut, len(start) - 1)]], 1)
    return pairs.astype("<u4").tobytes()


def _merged(distinct: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """(segment_id, runs): the repeats of each distinct segment, bucket by bucket of complete minimizer groups.

    A group of one segment has nothing to merge: it is all repeats when it occurs more than once.
    """

    def run(batches):
        strings: list[bytes] = []
        weights: list[int] = []
        group: list[tuple[bytes, int]] = []
        out: list[tuple[bytes, bytes]] = []
        size, before = 0, None

        def close():
            nonlocal size
            if len(group) == 1 and group[0][1] > 1:
                out.append((hashlib.md5(group[0][0]).digest(), _runs(np.array([0, len(group[0][0]) - length]), whole=True)))
            else:
                for s, w in group:
                    strings.append(s)
                    weights.append(w)
                    size += len(s)
            group.clear()

        def flush():
            nonlocal size
            if strings:
                out.extend((hashlib.md5(s).digest(), _runs(start)) for s, start in zip(strings, repeated_starts(strings, weights, length)) if len(start))
            strings.clear()
            weights.clear()
            size = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["segment_id", "runs"])
            out.clear()

        for batch in batches:
            for key, segment, weight in zip(batch["hash"].to_pylist(), batch["segment"].to_pylist(), batch["weight"].to_pylist()):
                if key != before:
                    close()
                    before = key
                    if size >= bucket_bytes or len(out) >= 10_000:
                        yield from flush()
                group.append((segment, weight))
        close()
        yield from flush()

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("hash", "segment", "weight").repartition(parts, "hash").sortWithinPartitions("hash")
    return dealt.mapInArrow(run, "segment_id binary, runs binary")


def _pieces(distinct: DataFrame, length: int, parts: int) -> DataFrame:
    """(hash, segment, gram, weight, parent, offsets): the segments cut by the place of the minimizer in their windows.

    Equal windows have their first minimizer at the same place j. The places fall into `parts` ranges; the windows of
    a range share the bytes from the least to the greatest j on, and these bytes' hash is the piece's key: equal windows
    meet again, and segments that differ there no longer do. A piece that a segment holds several times is one row.
    """
    places = length - GRAM + 1

    def run(batches):
        for batch in batches:
            out = []
            for gram, segment, weight in zip(*[batch[c].to_pylist() for c in ("gram", "segment", "weight")]):
                at = np.flatnonzero(byte_grams(np.frombuffer(segment, np.uint8), GRAM).view(np.int64) == gram)
                start = np.arange(len(segment) - length + 1)
                first = at[np.searchsorted(at, start)]
                part = (first - start) * parts // places
                cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(first) != 0)) + 1
                parent = hashlib.md5(segment).digest()
                runs: list[tuple[int, int, int]] = []  # key, first and last window; runs of a repetitive text share their key
                for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(start)).tolist()):
                    r, p = int(part[a]), int(first[a])
                    low, high = -(-r * places // parts), -(-(r + 1) * places // parts) - 1
                    common = hashlib.blake2b(segment[p - low : p - high + length], digest_size=8, salt=r.to_bytes(4, "little"))
                    key = int.from_bytes(common.digest(), "little", signed=True)
                    if runs and runs[-1][0] == key:
                        a = runs.pop()[1]
                    runs.append((key, a, b - 1))
                places_of: dict[tuple[int, bytes], list[int]] = {}  # a repetitive text has few different pieces
                for key, a, b in runs:
                    places_of.setdefault((key, segment[a : b + length]), []).append(a)
                out += [(key, piece, gram, weight * len(at), parent, np.array(at, "<u4").tobytes()) for (key, piece), at in places_of.items()]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 10_000]), kinds)], names=["hash", "segment", "gram", "weight", "parent", "offsets"])

    return distinct.mapInArrow(run, "hash long, segment binary, gram long, weight long, parent binary, offsets binary")


def _in_parents(found: DataFrame) -> DataFrame:
    """(segment_id, runs) of the segments that pieces (parent, offsets, runs) were cut from."""

    def run(batches):
        for batch in batches:
            out = []
            for offsets, runs in zip(batch["offsets"].to_pylist(), batch["runs"].to_pylist()):
                own = np.concatenate([np.arange(a, b + 1) for a, b in np.frombuffer(runs, "<u4").reshape(-1, 2).tolist()])
                out.append(_runs(np.unique(np.frombuffer(offsets, "<u4").astype(np.int64)[:, None] + own)))
            yield pa.RecordBatch.from_arrays([batch["parent"], pa.array(out, pa.binary())], names=["segment_id", "runs"])

    return found.select("parent", "offsets", "runs").mapInArrow(run, "segment_id binary, runs binary")


def _repeats(segments: DataFrame, length: int, bucket_bytes: int, group_bytes: int, cuts: list[int]) -> DataFrame:
    """(segment_id, runs): the repeats of each distinct segment (hash, segment, gram, weight). Groups beyond `group_bytes` are cut and dealt anew."""
    distinct = segments.groupBy("hash", "segment").agg(F.sum("weight").alias("weight"), F.first("gram").alias("gram"))
    thin = segments.select("hash", F.xxhash64("segment").alias("of"), F.length("segment").cast("long").alias("n")).distinct()
    large = written(thin.groupBy("hash").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("several")).filter((F.col("size") > group_bytes) & (F.col("several") > 1)).select("hash"), "large") if cuts else None
    if large is None or large.isEmpty():
        return _merged(distinct, length, bucket_bytes)
    pieces = written(_pieces(distinct.join(large, "hash", "left_semi"), length, cuts[0]), "pieces")
    found = written(_repeats(pieces.select("hash", "segment", "gram", "weight"), length, bucket_bytes, group_bytes, cuts[1:]), "repeats")
    if found.count() <= MAX_BROADCAST_PIECES:
        found = F.broadcast(found)
    of = pieces.select(F.unhex(F.md5("segment")).alias("segment_id"), "parent", "offsets")
    return _merged(distinct.join(large, "hash", "left_anti"), length, bucket_bytes).unionByName(_in_parents(of.join(found, "segment_id")))


def _removed(joined: DataFrame, length: int) -> DataFrame:
    schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            rows, found = [], batch["found"].to_pylist()
            for at, data, offsets in text_blocks(batch["text"]):
                for i in range(len(offsets) - 1):
                    own = data[offsets[i] : offsets[i + 1]]
                    gone = np.zeros(len(own), bool)
                    for x in found[at + i] or []:
                        for a, b in np.frombuffer(x["runs"], "<u4").reshape(-1, 2).tolist():
                            gone[x["start"] + a : x["start"] + b + length] = True
                    lost = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if lost else 0
                    rows.append((len(own), lost, spans, hashlib.sha256((own[~gone] if lost else own).tobytes()).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("key", "text", "found").mapInArrow(run, schema)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row: bytes that a repeat of `length` bytes covers go.

    `length` is a multiple of 40.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), "text")
    texts = distinct_texts(docs)
    seeds = written(shared_hashes(_seed_rows(texts, length)), "seeds")
    asked = texts.join(by_document(seeds).withColumnRenamed("doc", "first_id"), "first_id")
    segments = written(_segments(asked, length), "segments")
    repeats = written(_repeats(segments.withColumn("gram", F.col("hash")), length, bucket_bytes, group_bytes, [PIECES, length - GRAM + 1]), "repeats")
    places = segments.select(F.unhex(F.md5("segment")).alias("segment_id"), F.col("doc").alias("first_id"), "start").join(repeats, "segment_id")
    found = places.groupBy("first_id").agg(F.collect_list(F.struct("start", "runs")).alias("found"))
    own = written(_removed(texts.join(found, "first_id", "left"), length), "removed")
    return keyed_rows(docs).join(own, "key").select(F.nullif("doc_id", F.lit(_LEAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
