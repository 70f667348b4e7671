"""N-gram Jaccard join with prefix filters under several global token orders.

A document's tokens are its distinct word shingles. Two sets with Jaccard similarity of at
least t share a token among the first |s| - ceil(t|s|) + 1 of each under every global order.
Order 1 is by rarity (a fixed-size count sketch of all shingles) and generates candidates by
an equi-join on the token. Orders 2 and 3 permute the tokens by other hashes; a candidate pair
must also share a prefix token under these before its sets are compared.

Texts that are equal, and texts with equal shingle sets (by 128 bits), are one class throughout, so
copies cost one row. A token that more than HOT classes have in their prefix would make a quadratic
number of pairs: the classes that such lists connect are parted by their order 2 prefixes, with one row for
a class and token however many long lists it is in, and only the parts within HOT make pairs. What is still
longer than that are groups of near copies, or pass for such: they form clusters, parted once more by the
order 3 prefixes, whose sets are compared in blocks of bounded size, those of
similar sizes only, by a matrix product. A block returns a spanning forest of its links and the number of
each class' links. No pair is dropped, and no group meets in one task.

Documents without words or with null text have no shingles, get n_shingles 0 and are their own
component; a null doc_id counts as the smallest; a document of fewer words than a shingle has its whole sequence as its one shingle.
Repeated rows link as equal texts do. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.components import components
from chatspark.llm.seqhash import WHITE, Words, grams, lower_ascii, mix, text_blocks
from chatspark.llm.stage import distinct_texts, drop_written, fresh, keyed_rows, row_key, written, written_by_key

#: The rarity sketch has a counter for each so many bytes of text, but at most MAX_SKETCH, a byte each when broadcast.
SKETCH_BYTES = 48
MIN_SKETCH, MAX_SKETCH = 1 << 16, 1 << 26
#: Counters in a slice, the unit in which tasks' sketches are summed.
SLICE = 1 << 16
#: Lists up to this many classes make pairs; longer ones are parted by the next order.
HOT = 64
#: Classes and tokens in a block of a cluster.
BLOCK = 256
BLOCK_TOKENS = 1 << 21
#: Tokens of dense lists up to this many (24 MB) are broadcast with their first class; more are joined by shuffle.
MAX_BROADCAST_HEADS = 1_000_000
#: Keys of dropped rows up to this many (32 MB) are broadcast against the documents; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
_LEAST = -(1 << 63)
_SEEDS = (np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in text_blocks(texts):
        words = Words(lower_ascii(data), offsets, WHITE)
        hashes = grams(words.hash, k)
        for a, b in zip(words.doc_start[:-1], words.doc_start[1:]):
            if b - a >= k:
                yield np.unique(hashes[a : b - k + 1])
            elif b > a:
                yield grams(words.hash[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def digest(tokens: np.ndarray) -> bytes:
    """128 bits of a shingle set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int) -> int:
    return n - ceil(n * percent / 100) + 1


def _order(tokens: np.ndarray, rarity: np.ndarray | None, seed: np.uint64) -> np.ndarray:
    """Positions of the tokens in a global order: by rarity first, if given, then by a seeded hash."""
    hashed = mix(tokens ^ seed)
    if rarity is None:
        return np.argsort(hashed)
    return np.lexsort((hashed, rarity[tokens & np.uint64(len(rarity) - 1)]))


def sketch_size(texts: DataFrame) -> int:
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    return min(MAX_SKETCH, max(MIN_SKETCH, 1 << int(size // SKETCH_BYTES).bit_length()))


def _pack(counts: np.ndarray) -> bytes:
    """Counts by byte planes, compressed: a task's counts are small."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _scan(texts: DataFrame, k: int, sketch: int) -> DataFrame:
    """A row (key, first_id, least_id, n, digest) for each text, and the task's part of the sketch as rows (slice, counts)."""
    schema = "key binary, first_id long, least_id long, n long, digest binary, slice int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        counts = np.zeros(sketch, np.uint32)
        for batch in batches:
            n, digests, pending = [], [], []
            for tokens in shingle_sets(batch["text"], k):
                n.append(len(tokens))
                digests.append(digest(tokens))
                pending.append(tokens)
            if pending:
                place, times = np.unique(np.concatenate(pending) & np.uint64(sketch - 1), return_counts=True)
                counts[place.astype(np.int64)] += times.astype(np.uint32)
            empty = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["first_id"], batch["least_id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), empty.cast(pa.int32()), empty.cast(pa.binary())], names=names)
        for i, part in enumerate(np.split(counts, sketch // SLICE)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([_pack(part)], pa.binary())], names=names)

    return texts.select("key", "first_id", "least_id", "text").mapInArrow(run, schema)


def _rarity(scan: DataFrame, sketch: int) -> np.ndarray:
    """The sketch in quarter powers of two: one byte a counter, MAX_SKETCH bytes at most."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch["slice"].to_pylist(), batch["counts"]):
                part = _unpack(part.as_buffer().to_pybytes()).astype(np.uint64)
                total[i] = total[i] + part if i in total else part
        for i, sums in total.items():
            steps = np.minimum(4 * np.log2(1.0 + sums), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["slice", "steps"])

    rows = scan.filter("slice is not null").select("slice", "counts").repartition(16, "slice").mapInArrow(run, "slice int, steps binary").collect()
    out = np.zeros(sketch, np.uint8)
    for row in rows:
        out[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row.steps, np.uint8)
    return out


def _of_classes(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, text): one text of each class; the texts stay where they are."""
    return texts.join(classes.select(F.col("cls").alias("first_id")).hint("shuffle_hash"), "first_id").select(F.col("first_id").alias("cls"), "text")


def _postings(texts: DataFrame, k: int, percent: int, rarity) -> DataFrame:
    """(token, cls, n) for the order 1 prefix of each class."""

    def run(batches):
        for batch in batches:
            tokens, size, own = [], [], []
            for s in shingle_sets(batch["text"], k):
                first = s[_order(s, rarity.value, _SEEDS[0])[: prefix_length(len(s), percent)]]
                tokens.append(first)
                size.append(np.full(len(first), len(s), np.int32))
                own.append(len(first))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(batch["cls"].to_numpy(), own)), pa.array(np.concatenate(size))], names=["token", "cls", "n"])

    return texts.select("cls", "text").mapInArrow(run, "token long, cls long, n int")


def _joined(rows: DataFrame, key: list[str]) -> DataFrame:
    """(cls, root): components of the classes that share a key; a class alone with all its keys has no row."""
    heads = written(rows.groupBy(*key).agg(F.min("cls").alias("head")), "heads")
    if heads.count() <= MAX_BROADCAST_HEADS:
        heads = F.broadcast(heads)
    found = components(rows.join(heads, key).select("cls", "head").distinct(), "cls", "head")
    return found.select(F.col("node").alias("cls"), "root")


def _second_postings(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, cls, n) for the order 2 prefix of each class (cls, n, root): a token stands for the root and one of order 2."""

    def run(batches):
        for batch in batches:
            second = [np.frombuffer(x, np.uint64) for x in batch["second"].to_pylist()]
            own = [len(x) for x in second]
            root = np.repeat(batch["root"].to_numpy().view(np.uint64), own)
            token = mix(mix(root) + np.concatenate(second)) if second else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *[pa.array(np.repeat(batch[c].to_numpy(), own)) for c in ("cls", "n")]], names=["token", "cls", "n"])

    return rooted.join(sets.select("cls", "second"), "cls").select("cls", "n", "root", "second").mapInArrow(run, "token long, cls long, n int")


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a token, or rows (a, token, n) for tokens with more than HOT classes.

    Reads postings sorted by token and class as a stream, and holds at most HOT rows of an unfinished list.
    """
    pick = {s: np.triu_indices(s, 1) for s in range(2, HOT + 1)}

    def lists(token, cls, n):
        """Pairs and hot rows of complete lists."""
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        for s in np.unique(sizes):
            at = starts[sizes == s]
            if s > HOT:
                index = (at[:, None] + np.arange(s)).ravel()
                yield cls[index], np.zeros(len(index), np.int64), token[index], n[index], np.ones(len(index), bool)
            elif s > 1:
                i, j = pick[int(s)]
                i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                near = 100 * np.minimum(n[i], n[j]).astype(np.int64) >= percent * np.maximum(n[i], n[j]).astype(np.int64)
                i, j = i[near], j[near]
                yield cls[i], cls[j], token[i], n[i], np.zeros(len(i), bool)

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        hot = None  # token of a list whose first rows have gone out as hot
        for batch in batches:
            cols = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("token", "cls", "n"))]
            token, cls, _ = cols
            if not len(token):
                continue
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            cols = [c[keep] for c in cols]
            token = cols[0]
            out = []
            if hot is not None:
                more = int(np.searchsorted(token != hot, True))
                index = slice(0, more)
                out.append((cols[1][index], np.zeros(more, np.int64), token[index], cols[2][index], np.ones(more, bool)))
                cols = [c[more:] for c in cols]
                token = cols[0]
                if len(token):
                    hot = None
            if len(token):
                last = int(len(token) - np.searchsorted(token[::-1] != token[-1], True))
                if last:
                    out += lists(*[c[:last] for c in cols])
                held = [c[last:] for c in cols]
                if len(held[0]) > HOT:
                    hot = held[0][0]
                    out.append((held[1], np.zeros(len(held[1]), np.int64), held[0], held[2], np.ones(len(held[0]), bool)))
                    held = [c[:0] for c in held]
            else:
                held = [c[:0] for c in cols]
            yield from frames(out)
        if len(held[0]):
            yield from frames(lists(*held))

    def frames(parts):
        for columns in parts:
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "token", "n", "hot"])

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(parts, "token").sortWithinPartitions("token", "cls").mapInArrow(run, "a long, b long, token long, n int, hot boolean")


def _sets(texts: DataFrame, k: int, percent: int, rarity) -> DataFrame:
    """(cls, tokens, second, third) of (cls, text): the set and its prefixes under orders 2 and 3."""

    def run(batches):
        for batch in batches:
            rows = []
            for s in shingle_sets(batch["text"], k):
                m = prefix_length(len(s), percent)
                second = np.sort(s[_order(s, rarity.value, _SEEDS[1])[:m]])
                third = np.sort(s[_order(s, None, _SEEDS[2])[:m]])
                rows.append((s.tobytes(), second.tobytes(), third.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch["cls"], *[pa.array(c, pa.binary()) for c in zip(*rows)]], names=["cls", "tokens", "second", "third"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, tokens binary, second binary, third binary")


def similar(shared: int, n: int, m: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def _with_sides(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    side = lambda x: sets.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _filtered(pairs: DataFrame, sets: DataFrame, columns: list[str], keep) -> DataFrame:
    """The pairs (a, b) for which keep(arrays of a's and b's columns) holds."""

    def run(batches):
        for batch in batches:
            sides = zip(*[batch[f"{c}_{x}"].to_pylist() for c in columns for x in "ab"])
            yield batch.select(["a", "b"]).filter(pa.array([keep(*[np.frombuffer(x, np.uint64) for x in row]) for row in sides], pa.bool_()))

    return _with_sides(pairs, sets, columns).mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The similar pairs (a, b). Only those that share prefix tokens under orders 2 and 3 too have their sets compared."""

    def near(s2, t2, s3, t3):
        return len(np.intersect1d(s2, t2, True)) > 0 and len(np.intersect1d(s3, t3, True)) > 0

    def same(s, t):
        return similar(len(np.intersect1d(s, t, True)), len(s), len(t), percent)

    candidates = written(_filtered(pairs, sets, ["second", "third"], near), "candidates")
    return _filtered(candidates, sets, ["tokens"], same)


def _forest(links: np.ndarray) -> np.ndarray:
    """Least index of each node's component, by a link matrix."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(tokens: list[np.ndarray], percent: int) -> np.ndarray:
    """Mask of similar pairs among the sets, by a product over their shared tokens."""
    size = np.array([len(t) for t in tokens])
    every = np.concatenate(tokens)
    row = np.repeat(np.arange(len(tokens)), size)
    kinds, column, count = np.unique(every, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    several = count[column] > 1
    row, column = row[several], column[several]
    common = np.zeros((len(tokens), len(tokens)), np.int32)
    width = 2048
    for low in range(0, len(kinds), width):
        a, b = np.searchsorted(column, [low, low + width])
        if b > a:
            part = np.zeros((len(tokens), width), np.float32)
            part[row[a:b], column[a:b] - low] = 1
            common += (part @ part.T).astype(np.int32)
    common = common.astype(np.int64)
    links = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(links, False)
    return links


def _clusters(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, n, root): classes that hot lists of two orders connect, parted by the prefixes of order 3."""

    def run(batches):
        for batch in batches:
            third = [np.frombuffer(x, np.uint64) for x in batch["third"].to_pylist()]
            own = [len(x) for x in third]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(batch[c].to_numpy(), own)) for c in ("cls", "root")], pa.array(np.concatenate(third).view(np.int64) if third else np.zeros(0, np.int64))], names=["cls", "root", "token"])

    by_two = _joined(hot.select("cls", "token"), ["token"])
    third = by_two.join(sets.select("cls", "third"), "cls").select("cls", "root", "third").mapInArrow(run, "cls long, root long, token long")
    return _joined(third, ["root", "token"]).join(hot.select("cls", "n").distinct(), "cls")


def _cluster_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links (a, b) among the classes of each cluster, block by block, with the number of all links of a where b is null.

    A step of sizes is as wide as similar sets can differ, so only blocks of one step or of two neighbouring ones
    are compared. A block has BLOCK sets and about BLOCK_TOKENS tokens at most.
    """
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-6
    stepped = clusters.withColumn("step", F.floor(F.log("n") / width).cast("long"))
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_TOKENS)) / F.exp((F.col("step") + 1) * width)))
    counts = written(stepped.groupBy("root", "step").agg(F.ceil(F.count(F.lit(1)) / F.first(most)).alias("blocks")), "blocks")
    near = lambda d, c: counts.select("root", (F.col("step") - d).alias("step"), F.col("blocks").alias(c))
    placed = stepped.join(counts, ["root", "step"]).join(near(1, "above"), ["root", "step"], "left").join(near(-1, "below"), ["root", "step"], "left")
    every = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<bigint>"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    meet = lambda low, i, high, j: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"))
    step = F.col("step")
    meets = F.concat(
        F.transform(every("blocks"), lambda x: meet(step, F.least(F.col("block"), x), step, F.greatest(F.col("block"), x))),
        F.transform(every("above"), lambda x: meet(step, F.col("block"), step + 1, x)), F.transform(every("below"), lambda x: meet(step - 1, x, step, F.col("block"))),
    )
    rows = placed.withColumn("block", block).select("cls", "root", (F.col("step") * (1 << 32) + F.col("block")).alias("place"), F.explode(meets).alias("m")).select("cls", "root", "place", "m.*").join(sets.select("cls", "tokens"), "cls")

    def run(table: pa.Table) -> pa.Table:
        cls = table["cls"].to_numpy()
        links = block_links([np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()], percent)
        place = table["place"].to_numpy()
        low, i, high, j = (table[c][0].as_py() for c in ("low", "i", "high", "j"))
        if (low, i) != (high, j):  # pairs within a block are the block's own
            links &= place[:, None] != place[None, :]
        label = _forest(links)
        moved = label != np.arange(len(label))
        n = links.sum(1).astype(np.int64)
        a, b = np.concatenate([cls[moved], cls[n > 0]]), pa.array([*cls[label[moved]].tolist(), *[None] * int((n > 0).sum())], pa.int64())
        return pa.table({"a": a, "b": b, "n": np.concatenate([np.zeros(int(moved.sum()), np.int64), n[n > 0]])})

    return rows.groupBy("root", "low", "i", "high", "j").applyInArrow(run, "a long, b long, n long")


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id (null as _LEAST), key, n_shingles, component_id, n_links of each row, and whether it is the first of its component."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), "text")
    texts = distinct_texts(docs)
    sketch = sketch_size(texts)
    scan = written(_scan(texts, k, sketch), "scan")
    rarity = spark.sparkContext.broadcast(_rarity(scan, sketch))
    known = scan.filter("slice is null").select("key", "first_id", "least_id", "n", "digest")
    classes = written(known.filter("n > 0").groupBy("digest").agg(F.min("first_id").alias("cls"), F.min("least_id").alias("least_id")), "classes")
    lists = written(_lists(_postings(_of_classes(texts, classes), k, percent, rarity), percent), "lists")
    ordered = lambda x: x.filter("not hot").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hot = lists.filter("hot").select("token", F.col("a").alias("cls"), "n")
    pairs = ordered(lists)
    involved = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(hot.select("cls")).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = written_by_key(_sets(_of_classes(texts, involved), k, percent, rarity).repartition(parts, "cls"), "cls", "sets")
    drop_written(spark, texts)
    clusters = None
    if not hot.isEmpty():
        by_one = written(_joined(hot.select("cls", "token"), ["token"]).join(hot.select("cls", "n").distinct(), "cls"), "by_one")
        second = written(_lists(_second_postings(by_one, sets), percent), "second_lists")
        pairs = pairs.unionByName(ordered(second))
        dense = second.filter("hot").select("token", F.col("a").alias("cls"), "n")
        if not dense.isEmpty():
            clusters = written(_clusters(dense, sets), "dense")
    links = written(_verify(written(pairs.distinct(), "pairs"), sets, percent), "links")
    counted, more = links, None
    if clusters is not None:
        found = written(_cluster_links(clusters, sets, percent), "cluster_links")
        more = found.filter("b is null").select(F.col("a").alias("cls"), "n")
        place = lambda x: clusters.select(F.col("cls").alias(x), F.col("root").alias(f"root_{x}"))
        counted = links.join(place("a"), "a", "left").join(place("b"), "b", "left").filter("root_a is null or root_b is null or root_a != root_b").select("a", "b")
        links = links.unionByName(found.filter("b is not null").select("a", "b"))
    roots = components(links, "a", "b").select(F.col("node").alias("cls"), "root")
    degree = counted.select(F.col("a").alias("cls"), F.lit(1).cast("long").alias("n")).unionByName(counted.select(F.col("b").alias("cls"), F.lit(1).cast("long").alias("n")))
    degree = (degree if more is None else degree.unionByName(more)).groupBy("cls").agg(F.sum("n").alias("n_links"))
    rooted = classes.join(roots, "cls", "left").join(degree, "cls", "left").select("digest", "cls", "least_id", F.coalesce("root", "cls").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rooted = written(rooted, "rooted")
    labels = rooted.groupBy("root").agg(F.min("cls").alias("head"), F.min("least_id").alias("component_id"))
    by_class = written(rooted.join(labels, "root").select("digest", "head", "component_id", "n_links"), "by_class")
    by_key = written(known.join(by_class, "digest", "left").select("key", "least_id", F.expr("n = 0 or first_id = head").alias("head"), F.col("n").alias("n_shingles"), F.expr("if(n > 0, component_id, null)").alias("component_id"), F.expr("if(n > 0, n_links, 0)").alias("n_links")), "labels")
    rows = keyed_rows(docs).join(by_key, "key")
    first = (F.col("n_shingles") == 0) | (F.col("head") & (F.col("doc_id") == F.col("least_id")))
    return rows.select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links", first.alias("first"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (verified links of its class in the search) for each row.

    component_id is the smallest doc_id that links of at least `percent` similarity reach.
    """
    shown = lambda c: F.nullif(F.col(c), F.lit(_LEAST)).alias(c)
    return _labelled(docs, k, percent).select(shown("doc_id"), "n_shingles", shown("component_id"), "n_links")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that have the smallest doc_id of their component (of texts that share it, the first by key), with all their columns."""
    found = _labelled(docs.select("doc_id", "text"), k, percent)
    gone = fresh(docs.columns, "gone")
    dropped = written(found.filter("not first").select(row_key(F.col("doc_id"), F.lower(F.hex("key"))).alias(gone)).distinct(), "gone")
    if dropped.count() <= MAX_BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    own = row_key(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST)), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    return docs.join(dropped, own == F.col(gone), "left_anti")
