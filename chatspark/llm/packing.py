"""Packing of token sequences by non-negative least squares over the histogram of lengths.

Documents are cut into full windows and a rest. The rests' histogram (at most `window` counts, summed
on the executors) goes to the driver, where shallow combinations of lengths that fill a window exactly
are enumerated, their repeat counts solved by non-negative least squares and rounded down to what the
histogram holds. Each piece finds its place from its length and its rank among pieces of that length;
ranks come from counts by task, so a length that a third of all pieces have needs no common task. What
the combinations don't take is packed greedily: in order of length into one stream, cut at window
boundaries. The last, partial window is split into powers of two, which need no padding.

Null or empty text has its end id alone. Repeated rows each have their pieces. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.llm.stage import written
from chatspark.llm.tokens import ChunkEncoder

WINDOW = 2048
END_ID = 1
#: Offsets by task and length up to this many rows (48 MB) are broadcast; more are joined by shuffle.
MAX_BROADCAST_ROWS = 1_000_000


#: Triples have a shortest length that is a multiple of window / GRID: some ten thousand instead of a third of a million.
GRID = 64


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows (a, b, c) of present lengths with a <= b <= c and a + b + c = window; a is 0 for pairs."""
    lengths = np.flatnonzero(present)
    lengths = lengths[(lengths > 0) & (lengths < window)]
    out = [np.zeros((0, 3), np.int64)]
    shortest = lengths[(3 * lengths <= window) & (lengths % max(1, window // GRID) == 0)]
    for a in [0, *shortest.tolist()]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        c = window - a - b
        keep = present[c] > 0
        out.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(out)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, by accelerated projected gradient."""
    target = histogram.astype(float)
    target[0] = 0

    def times(x):
        out = np.zeros(len(target))
        for j in range(3):
            out += np.bincount(combos[:, j], x, len(target))
        out[0] = 0
        return out

    def back(r):
        return r[combos].sum(1)

    if not len(combos):
        return np.zeros(0)
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 0.95 / norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """Where the pieces of each length go: combinations first, the rest into the stream."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window = window
        combos = combinations(window, histogram > 0)
        wanted = solve_counts(combos, histogram)
        left = histogram.astype(np.int64).copy()
        chosen: list[tuple[np.ndarray, int]] = []
        order = np.argsort(-wanted, kind="stable")
        rounded = np.floor(wanted + 1e-6).astype(np.int64)

        def take(combo: np.ndarray, most: int) -> None:
            parts, times = np.unique(combo[combo > 0], return_counts=True)
            n = min(most, int((left[parts] // times).min()))
            if n > 0:
                left[parts] -= n * times
                chosen.append((combo[combo > 0], n))

        if left[window]:
            take(np.array([window]), int(left[window]))
        for i in order[rounded[order] > 0]:
            take(combos[i], int(rounded[i]))
        for i in np.flatnonzero(combos[:, 0] == 0) if len(combos) else []:
            take(combos[i], int(left.max()))
        #: by length: first rank of each slot run, its first sequence, its offset; ranks from taken[length] on stream
        slots: dict[int, list[tuple[int, int, int]]] = {}
        ranks = np.zeros(window + 1, np.int64)
        sequence = 0
        for combo, n in chosen:
            at = 0
            for length in combo.tolist():
                slots.setdefault(length, []).append((int(ranks[length]), sequence, at))
                ranks[length] += n
                at += length
            sequence += n
        self.slots = {k: np.array(v, np.int64) for k, v in slots.items()}
        self.taken = ranks
        tokens = left * np.arange(window + 1)
        self.stream_base = np.concatenate([[0], np.cumsum(tokens)[:-1]])
        self.stream_tokens = int(tokens.sum())
        self.first_stream = sequence

    def slot(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces in combinations; sequence -1 for those in the stream."""
        sequence, offset = np.full(len(length), -1), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            mine = np.flatnonzero((length == n) & (rank < self.taken[n]))
            if len(mine):
                runs = self.slots[int(n)]
                k = np.searchsorted(runs[:, 0], rank[mine], "right") - 1
                sequence[mine] = runs[k, 1] + rank[mine] - runs[k, 0]
                offset[mine] = runs[k, 2]
        return sequence, offset

    def cuts(self, at: int, length: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the parts of a stream piece that begins at token `at` of the stream."""
        out = []
        while length:
            sequence, low, high = self._span(at)
            n = min(length, high - at)
            out.append((n, sequence, at - low))
            at, length = at + n, length - n
        return out

    def _span(self, at: int) -> tuple[int, int, int]:
        """(sequence, first and end token) of the stream's sequence that holds token `at`."""
        full = self.stream_tokens // self.window
        if at < full * self.window:
            return self.first_stream + at // self.window, at // self.window * self.window, (at // self.window + 1) * self.window
        low, rest, sequence = full * self.window, self.stream_tokens % self.window, self.first_stream + full
        while True:
            size = 1 << (rest.bit_length() - 1)
            if at < low + size:
                return sequence, low, low + size
            low, rest, sequence = low + size, rest - size, sequence + 1


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """Full windows and rests: the rest keeps its ids; `rank` counts the task's pieces of that length."""
    schema = "doc_id long, doc_tokens long, start long, length int, ids_crc32 long, ids binary, task int, rank long"

    def run(batches):
        encoder = ChunkEncoder.load(tokenizer)
        end = np.array([end_id], encoder.dtype)
        task, ranks = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                ids = np.concatenate([found, end])
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    n = len(part)
                    rows.append((doc_id, len(ids), start, n, _crc(part), part.tobytes() if n < window else None, task, ranks[n]))
                    ranks[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each document."""
    spark = docs.sparkSession
    pieces = written(_pieces(docs, tokenizer, window, end_id), "pieces")
    counts = written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    plan = spark.sparkContext.broadcast(Plan(histogram, window))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    if counts.count() <= MAX_BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("rank")).alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(batches):
        p, kind = plan.value, ChunkEncoder.load(tokenizer).dtype
        for batch in batches:
            length, rank = batch["length"].to_numpy().astype(np.int64), batch["rank"].to_numpy()
            sequence, offset = p.slot(length, rank)
            placed = sequence >= 0
            keep = pa.array(placed)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            whole = [batch["doc_id"].filter(keep), batch["start"].filter(keep), pa.array(length[placed]), batch["ids_crc32"].filter(keep), batch["doc_tokens"].filter(keep), pa.array(sequence[placed]), pa.array(offset[placed])]
            yield pa.RecordBatch.from_arrays(whole, names=names)
            rest = np.flatnonzero(~placed)
            if len(rest):
                rows = []
                some = batch.take(pa.array(rest))
                for doc_id, start, n, r, ids, total in zip(*[some[c].to_pylist() for c in ("doc_id", "start", "length", "rank", "ids", "doc_tokens")]):
                    done = 0
                    for size, seq, at in p.cuts(int(p.stream_base[n] + (r - p.taken[n]) * n), n):
                        rows.append((doc_id, start + done, size, _crc(np.frombuffer(ids, kind)[done : done + size]), total, seq, at))
                        done += size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return ranked.mapInArrow(place, schema)
