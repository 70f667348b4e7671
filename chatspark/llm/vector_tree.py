"""Nearest neighbours by largest inner product: a hierarchical k-means tree, traversed best bin first.

The tree is fitted on at most SAMPLE different vectors, drawn by hash; every row is then indexed by descending it. A further
coordinate, sqrt(M^2 - |x|^2) with M the largest norm, makes the largest inner product the smallest distance, so vectors of
any norms can share a tree. A query walks the tree with a priority queue, the node whose centre has the largest inner product first, and
gets its leaves in that order. How many it visits is calibrated: for CALIBRATION queries the nearest of all rows are found by
brute force, and visits are widened until RECALL of these lie in visited leaves; with recall=1 all leaves are visited, which is exact.

Equal vectors are one class with its k + 1 smallest ids; more of them can be in no result, as ties go to smaller ids. Leaves are
dealt in cells of about CELL_ROWS classes, several cells for a large leaf, and a cell that more than QUERY_ROWS queries visit is
copied for each so many. A task holds one cell and streams the cell's queries past it.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of another length than the most
common one, nor rows without an id. Rows that share an id are rows of their own, as queries and as candidates. A query has fewer than k rows
where there are fewer others; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.llm.stage import written

#: Vectors that the tree is fitted on, children of a node, and sample vectors of a leaf.
SAMPLE, CHILDREN, LEAF = 16_384, 16, 48
ROUNDS = 8
#: Queries whose neighbours are found by brute force, and the share of these that visited leaves must hold.
CALIBRATION, RECALL = 256, 0.95
CELL_ROWS, QUERY_ROWS = 4096, 65_536
#: Queries that meet a cell at a time.
BLOCK = 256
_FOUND = "query binary, key binary, least long, score double"


class Tree:
    """Centres of all nodes; children follow each other. Node 0 is the root."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, first, count, todo = [sample.mean(axis=0)], [0], [0], [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            part = self._split(sample[rows], rng) if len(rows) > LEAF else None
            if part is None:
                continue
            label, middle = part
            first[node], count[node] = len(centres), len(middle)
            todo += [(len(centres) + i, rows[label == i]) for i in range(len(middle))]
            centres.extend(middle)
            first += [0] * len(middle)
            count += [0] * len(middle)
        self.centres, self.first, self.count = np.array(centres), np.array(first), np.array(count)
        self.leaf = np.where(self.count == 0, np.cumsum(self.count == 0) - 1, -1)
        self.leaves = int((self.count == 0).sum())

    @staticmethod
    def _split(x: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray] | None:
        """Labels and centres of Lloyd's rounds; None if the vectors don't fall apart."""
        middle = x[rng.choice(len(x), min(CHILDREN, len(x)), replace=False)]
        for _ in range(ROUNDS):
            label = Tree.nearest(x, middle)
            used = np.unique(label)
            middle = np.stack([x[label == i].mean(axis=0) for i in used])
        label = Tree.nearest(x, middle)
        used, label = np.unique(label, return_inverse=True)
        return (label, middle[used]) if len(used) > 1 else None

    @staticmethod
    def nearest(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return (x @ middle.T - (middle * middle).sum(axis=1) / 2).argmax(axis=1)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.count[node]:
                out[rows] = self.leaf[node]
                continue
            a, n = self.first[node], self.count[node]
            label = self.nearest(x[rows], self.centres[a : a + n])
            todo += [(a + i, rows[label == i]) for i in range(n)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves of a best-bin-first walk."""
        score = self.centres @ query
        queue, out = [(-score[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                out.append(int(self.leaf[node]))
            for child in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(queue, (-score[child], child))
        return out


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with an id whose vector takes part: id, its bytes as doubles, a key of 128 bits, length and norm."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).filter(pc.and_(pc.is_valid(batch["id"]), pc.is_valid(batch["vector"]))).combine_chunks()
        if not rows.num_rows:
            continue
        lists = rows["vector"].combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        parent, n = pc.list_parent_indices(lists).to_numpy(), rows.num_rows
        ok = (np.bincount(parent, ~np.isfinite(values), n) == 0) & (np.bincount(parent, values != 0, n) > 0)
        size = pc.list_value_length(lists).to_numpy()
        at = np.concatenate([[0], np.cumsum(size)])
        ids = rows["id"].to_pylist()
        kept = [(ids[i], values[at[i] : at[i + 1]]) for i in np.nonzero(ok)[0]]
        data = [v.tobytes() for _, v in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in kept], pa.int64()), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in data], pa.binary()), pa.array(data, pa.binary()), pa.array(size[ok], pa.int64()), pa.array([float(np.sqrt(v @ v)) for _, v in kept], pa.float64())],
            names=["id", "key", "bytes", "size", "norm"],
        )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the largest norm."""
    return np.column_stack([x, np.sqrt(np.maximum(largest * largest - (x * x).sum(axis=1), 0))])


def _best(q: np.ndarray, names: list[bytes], x: np.ndarray, keys: list[bytes], least: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best classes of each query by the scores of a block, and all that tie with the last; scores anew, summed alike for every pair."""
    at = max(score.shape[1] - k, 0)
    bound = np.partition(score, at, axis=1)[:, at]
    bound = bound - 1e-9 * np.maximum(1, np.abs(bound))
    i, j = np.nonzero((score >= bound[:, None]) & np.isfinite(score))
    exact = np.concatenate([(q[i[a : a + 8192]] * x[j[a : a + 8192]]).sum(axis=1) for a in range(0, len(i), 8192)] or [np.zeros(0)])
    return pa.RecordBatch.from_arrays([pa.array([names[a] for a in i], pa.binary()), pa.array([keys[b] for b in j], pa.binary()), pa.array(least[j]), pa.array(exact)], names=["query", "key", "least", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least", "key"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _all_rows(classes: DataFrame, queries: list, size: int, k: int) -> DataFrame:
    """The k best classes of a bounded list of queries (key, bytes), by brute force over all."""
    names = [bytes(r.key) for r in queries]
    q = np.stack([np.frombuffer(bytes(r.bytes), np.float64) for r in queries])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, keys, least = _matrix(batch["bytes"], size), batch["key"].to_pylist(), batch["least"].to_numpy()
                for a in range(0, len(q), BLOCK):
                    yield _best(q[a : a + BLOCK], names[a : a + BLOCK], x, keys, least, q[a : a + BLOCK] @ x.T, k)

    return _first(classes.select("key", "least", "bytes").mapInArrow(run, _FOUND), k)


def calibrated_visits(tree: Tree, largest: float, queries: list, truth: DataFrame, leaves: DataFrame, recall: float) -> int:
    """The fewest leaves of the walk that hold `recall` of the queries' true neighbours."""
    if recall >= 1:
        return tree.leaves
    place = {}
    for r in queries:
        v = np.frombuffer(bytes(r.bytes), np.float64)
        place[bytes(r.key)] = np.argsort(tree.visits(np.append(v, 0.0), tree.leaves))
    at = np.sort([place[bytes(r.query)][r.leaf] for r in truth.join(leaves.select("key", "leaf"), "key").filter("query != key").select("query", "leaf").collect()])
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else tree.leaves


def _walks(tree: Tree, most: int, cells: np.ndarray, splits: np.ndarray):
    """A row (cell, part, key, bytes, leaves) for each cell that holds leaves of a query's walk."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, data in zip(batch["key"].to_pylist(), batch["bytes"].to_pylist()):
                seen: dict[int, list[int]] = {}
                for leaf in tree.visits(np.append(np.frombuffer(data, np.float64), 0.0), most):
                    for cell in range(cells[leaf, 0], cells[leaf, 0] + cells[leaf, 1]):
                        seen.setdefault(cell, []).append(leaf)
                for cell, own in seen.items():
                    for x, v in zip(out, (cell, int.from_bytes(key[8:12], "little") % int(splits[cell]), (key, data), own)):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([k for k, _ in out[2]], pa.binary()), pa.array([d for _, d in out[2]], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], names=["cell", "part", "key", "bytes", "leaves"])

    return run


def _search(size: int, k: int):
    """Rows of a cell come first and are kept; its queries stream past them, each meeting the leaves that it visits."""

    def run(batches):
        own, rows, x = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = np.stack([table["cell"].to_numpy(), table["part"].to_numpy(), table["is_query"].to_numpy(zero_copy_only=False).astype(np.int64)])
            cuts = np.concatenate([[0], np.nonzero((group[:, 1:] != group[:, :-1]).any(axis=0))[0] + 1, [table.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = table.slice(a, b - a)
                if (group[0, a], group[1, a]) != own:
                    own, rows, x = (group[0, a], group[1, a]), [], None
                if not group[2, a]:
                    rows.append(part)
                    continue
                if not rows:
                    continue
                if x is None:
                    held = pa.concat_tables(rows).sort_by("leaf").combine_chunks()
                    x, keys, least, leaf = _matrix(held["bytes"].combine_chunks(), size), held["key"].to_pylist(), held["least"].to_numpy(), held["leaf"].to_numpy()
                    present, begin = np.unique(leaf, return_index=True)
                    end = np.append(begin[1:], len(leaf))
                for c in range(0, part.num_rows, BLOCK):
                    block = part.slice(c, BLOCK).combine_chunks()
                    q, lists = _matrix(block["bytes"].combine_chunks(), size), block["leaves"].combine_chunks()
                    visitor, visited = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
                    score = np.full((len(q), len(x)), -np.inf)
                    for one, a1, b1 in zip(present, begin, end):
                        mine = visitor[visited == one]
                        score[mine, a1:b1] = q[mine] @ x[a1:b1].T
                    yield _best(q, block["key"].to_pylist(), x, keys, least, score, k)

    return run


def nearest(rows: DataFrame, asked: Column, k: int, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (id, vector) for which `asked` (of id) holds; see the module."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    typed = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    valid = written(typed.mapInArrow(_valid, "id long, key binary, bytes binary, size long, norm double").withColumn("row", F.monotonically_increasing_id()), "vectors")
    usual = valid.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), "size").first()
    if usual is None:
        return empty
    size, largest = usual.size, usual.norm
    valid = valid.filter(F.col("size") == size)
    order = F.row_number().over(Window.partitionBy("key").orderBy("id", "row"))
    members = valid.select("key", "id", "row", "bytes").withColumn("_r", order).filter(F.col("_r") <= k + 1)
    classes = members.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members"), F.first("bytes").alias("bytes"))
    classes = written(classes.withColumn("least", F.col("members")[0]["id"]), "classes")
    total = classes.count()
    part = F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    sample = classes.filter(part <= SAMPLE / total).select("bytes").limit(SAMPLE + SAMPLE // 8).toArrow()["bytes"]
    if not len(sample):
        sample = classes.select("bytes").limit(SAMPLE).toArrow()["bytes"]
    tree = Tree(_lifted(_matrix(sample, size), largest))

    def indexed(batches):
        for batch in batches:
            leaf = tree.descend(_lifted(_matrix(batch["bytes"], size), largest)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    index = written(classes.select("key", "least", "bytes").mapInArrow(indexed, "key binary, least long, bytes binary, leaf long"), "index")
    queries = written(valid.filter(asked).select("key").distinct().join(classes.select("key", "bytes"), "key"), "queries")
    tried = queries.orderBy(F.xxhash64("key")).limit(CALIBRATION).collect()
    if not tried:
        return empty
    truth = _all_rows(classes, tried, size, k + 1) if recall < 1 else None
    most = calibrated_visits(tree, largest, tried, truth, index, recall)

    cells, of_cell = _cells(index, tree.leaves)
    visits = queries.mapInArrow(_walks(tree, most, cells, np.ones(of_cell, np.int64)), "cell long, part long, key binary, bytes binary, leaves array<long>")
    asking = np.ones(of_cell, np.int64)
    if queries.count() > QUERY_ROWS:
        for r in visits.groupBy("cell").count().collect():
            asking[r.cell] = -(-r["count"] // QUERY_ROWS)
        visits = queries.mapInArrow(_walks(tree, most, cells, asking), "cell long, part long, key binary, bytes binary, leaves array<long>")

    def dealt(batches):
        for batch in batches:
            leaf = batch["leaf"].to_numpy()
            salt = np.array([int.from_bytes(key[4:8], "little") for key in batch["key"].to_pylist()], np.int64)
            cell = cells[leaf, 0] + salt % np.maximum(cells[leaf, 1], 1) if batch.num_rows else leaf
            times = asking[cell]
            at = pa.array(np.repeat(np.arange(len(cell)), times))
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(cell).take(at), pa.array(part), *(batch[c].take(at) for c in ("key", "bytes", "leaf", "least"))], names=["cell", "part", "key", "bytes", "leaf", "least"])

    held = index.mapInArrow(dealt, "cell long, part long, key binary, bytes binary, leaf long, least long").withColumns({"leaves": F.lit(None).cast("array<long>"), "is_query": F.lit(False)})
    asks = visits.withColumns({"leaf": F.lit(None).cast("long"), "least": F.lit(None).cast("long"), "is_query": F.lit(True)})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = held.unionByName(asks).repartition(parts, "cell", "part").sortWithinPartitions("cell", "part", "is_query")
    found = written(_first(met.mapInArrow(_search(size, k + 1), _FOUND), k + 1), "found")
    near = found.join(classes.select("key", "members"), "key").select("query", "score", F.explode("members").alias("m")).select("query", "score", "m.*")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    lists = near.withColumn("_r", place).filter(F.col("_r") <= k + 1).groupBy(F.col("query").alias("key")).agg(F.array_sort(F.collect_list(F.struct("_r", "id", "row", "score"))).alias("near"))
    answers = valid.filter(asked).select("key", F.col("id").alias("query_id"), F.col("row").alias("_own")).join(lists, "key")
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("_own")), 1, k)
    ranked = answers.select("query_id", F.posexplode(others).alias("_at", "_x"))
    return ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_x.id").alias("vec_id"), F.col("_x.score").alias("score"))


def _cells(index: DataFrame, leaves: int) -> tuple[np.ndarray, int]:
    """(first cell, cells) of each leaf, and the number of cells: small leaves share one, large ones have several."""
    counts = np.zeros(leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():
        counts[r.leaf] = r["count"]
    out, cell, held = np.zeros((leaves, 2), np.int64), 0, 0
    for leaf, n in enumerate(counts):
        if held and held + n > CELL_ROWS:
            cell, held = cell + 1, 0
        own = max(1, -(-int(n) // CELL_ROWS))
        out[leaf] = cell, own
        held += n
        if own > 1:
            cell, held = cell + own, 0
    return out, cell + 1


def vector_search(embeddings: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """The k nearest of each vector whose vec_id is divisible by `every`, among all other rows of (vec_id, embedding)."""
    return nearest(embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), F.col("id") % every == 0, k, recall)
