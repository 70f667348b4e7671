"""Vectorised hashing of the word and byte sequences of an Arrow text column.

All helpers work on one block of whole documents at a time (a few MB of UTF-8),
so the memory of a task does not depend on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Separator bytes of the two word definitions that the operators use.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 1)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE_INV)]), dtype=np.uint64)
    return _powers, _inverse


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | np.uint8(0x20), data)


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, offsets) for runs of whole documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a block: byte spans, 64-bit hashes and the word range of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        inside = ~separators[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = offsets[1:] > offsets[:-1]
            at, to = offsets[:-1][full], offsets[1:][full] - 1
            first[at] = inside[at]
            last[to] = inside[to]
        self.begin = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc_start = np.searchsorted(self.begin, offsets)  # word ranges; doc i has [doc_start[i], doc_start[i + 1])
        powers, inverse = _tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.begin]) * inverse[self.begin] + (self.end - self.begin).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_start) - 1), self.counts)


_STEP = np.cumprod(np.full(64, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)
#: Factors of a second, independent hash of runs.
OTHER = np.cumprod(np.full(64, np.uint64(0xA3B195354A39B70D)), dtype=np.uint64)


def grams(hashes: np.ndarray, k: int, step: np.ndarray = _STEP) -> np.ndarray:
    """Hash of each run of k hashes; the caller drops runs that cross a document's end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * step[0]
    for j in range(1, k):
        total += hashes[j : j + n] * step[j]
    return mix(total + np.uint64(k))


def valid_starts(words: Words, k: int) -> np.ndarray:
    """Mask over the runs of k words that stay inside one document."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = words.doc
    return doc[:n] == doc[k - 1 : k - 1 + n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of n positions that lie in some [start, start + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each place; the caller drops those that cross a document's end."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    return mix((total[k:] - total[:n]) * inverse[:n] + np.uint64(k))


def inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """Mask over the places of runs of k bytes that stay inside one document."""
    n = int(offsets[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    edge = np.zeros(n + 1, np.int64)
    size = np.diff(offsets)
    full = size >= k
    np.add.at(edge, offsets[:-1][full], 1)
    np.add.at(edge, offsets[1:][full] - k + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def distinct_hashes(doc: np.ndarray, hashes: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct (doc, hash), whether each occurs more than once, and with `places` an index of each."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    out = doc[at], hashes[at], np.diff(np.append(at, len(doc))) > 1
    return (*out, order[at]) if places else out
