"""Search in past messages: neighbours of a vector from an inverted file, messages that contain the query's words, and both fused.

Vectors are dealt to the cells of a k-means model, every one of them, and a cell's list to blocks of BLOCK_ROWS. A query
is a row: it goes to the blocks of the cells that it probes, nearest centre first, and for its words to blocks of all rows that know no cells. How many cells
it probes is calibrated against all of them; probing all is exact. Only what ended before the query's cutoff counts.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.blocks import meet
from chatspark.sources.scratch import written

BLOCK_ROWS = 8192
#: Vectors that the cells are fitted on at most, and queries whose neighbours in all cells calibrate the probes.
SAMPLE, TRIED = 200_000, 128
#: Queries that meet a block at a time, and words whose rows a block remembers.
AT_ONCE, REMEMBERED = 256, 4096
#: What no word holds: white space and ASCII marks but the underscore.
_APART = re.compile(r"[\s!-/:-@\[-^`{-~]+")
#: A neighbour's least cosine; the share of the vector in the score, and what a message gains that both routes find.
LEAST, DENSE_SHARE, BOTH = 0.01, 0.6, 1.15
#: A hit's window: messages to either side, and seconds that they may be away.
BESIDE, SECONDS = 2, 600
_ROUTES = "case_id long, route string, id long, chat_id long, pos long, ts long, value double, cell long"


def unit(vectors: list, size: int) -> np.ndarray:
    """Rows of length one; of a vector that is null, zero or of another size, zeros."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size and None not in v:
            out[i] = v
    return np.nan_to_num(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12))


def words(text: Column) -> Column:
    """Distinct words of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)")))


class Cells:
    """Centres of the cells; the last cell, which has no centre, takes rows without a vector."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.n, self.size = centres, len(centres), centres.shape[1] if len(centres) else 0

    @classmethod
    def fit(cls, rows: DataFrame, cells: int, seed: int = 5) -> Cells:
        """k-means over the rows' unit vectors, all of them up to SAMPLE, a share drawn by hash beyond."""
        known = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0))
        usual = known.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
        if usual is None:
            return cls(np.zeros((0, 0)))
        if cells == 1:
            return cls(np.zeros((1, usual["size"])))
        share = min(1.0, SAMPLE / usual["count"])
        drawn = known.filter((F.size("vector") == usual["size"]) & ~F.exists("vector", lambda x: x.isNull()) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)))
        raw = drawn.select(array_to_vector(F.col("vector").cast("array<double>")).alias("raw"))
        vectors = written(Normalizer(inputCol="raw", outputCol="features").transform(raw).select("features"))
        found = min(cells, max(1, vectors.count() // 4))
        if found == 1:
            return cls(np.zeros((1, usual["size"])))
        return cls(np.stack(KMeans(k=found, seed=seed, maxIter=10, initMode="random").fit(vectors).clusterCenters()))

    def of(self, v: np.ndarray) -> np.ndarray:
        near = (v @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1)
        return np.where((v != 0).any(axis=1), near, self.n)

    def probed(self, v: np.ndarray, n: int) -> np.ndarray:
        """The first n cells of each query, by cosine with the centres."""
        c = self.centres / np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-12)
        return np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :n]


def inverted_file(messages: DataFrame, cells: Cells) -> tuple[DataFrame, np.ndarray]:
    """(messages with cell and block, first block and number of blocks of each cell): each list in blocks, and every row in one."""

    def run(batches):
        for batch in batches:
            v = unit(batch["vector"].to_pylist(), cells.size) if cells.n else None
            cell = cells.of(v) if v is not None and len(v) else np.full(batch.num_rows, cells.n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"{c} {t}" for c, t in messages.dtypes) + ", cell long"
    dealt = written(messages.mapInArrow(run, schema))
    blocks, at = np.zeros((cells.n + 1, 2), np.int64), 0
    for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect():
        blocks[r.cell] = at, -(-r.n // BLOCK_ROWS)
        at += blocks[r.cell, 1]
    first, number = (F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in blocks[:, i]]), F.col("cell").cast("int") + 1) for i in (0, 1))
    return dealt.withColumn("block", first + F.pmod(F.xxhash64("id"), number)), blocks


def _asks(cases: DataFrame, cells: Cells, blocks: np.ndarray, probes: int, keywords: bool) -> DataFrame:
    """Each case for each block that it meets: all for its words, those of the cells that it probes for its vector."""
    every = [(c, b) for c, (a, n) in enumerate(blocks.tolist()) for b in range(a, a + n)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(batch["vector"].to_pylist(), cells.size) if cells.n else np.zeros((batch.num_rows, 1))
            near = cells.probed(v, probes) if cells.n else np.zeros((batch.num_rows, 0), int)
            at, block, dense = [], [], []
            for i in range(batch.num_rows):
                mine = set(near[i].tolist()) if v[i].any() else set()
                for cell, b in every:
                    if keywords or cell in mine:
                        at.append(i)
                        block.append(b)
                        dense.append(cell in mine)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(block, pa.int64()), pa.array(dense, pa.bool_())], names=[*batch.schema.names, "block", "dense"])

    return cases.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in cases.dtypes) + ", block long, dense boolean")


class _Words:
    """Which texts contain a word, from inverted lists of the texts' own words and of their runs of one to three characters."""

    def __init__(self, texts: list[str]):
        rows, grams = defaultdict(list), defaultdict(list)
        for i, text in enumerate(texts):
            for word in set(_APART.split(text)):
                rows[word].append(i)
        self.n, self.words, self.known = len(texts), list(rows), {}
        self.ends = np.cumsum([0, *map(len, rows.values())])
        self.rows = np.fromiter((i for x in rows.values() for i in x), np.int64, self.ends[-1])
        for i, word in enumerate(self.words):
            for gram in {word[a : a + n] for n in (1, 2, 3) for a in range(len(word) - n + 1)}:
                grams[gram].append(i)
        self.grams = dict(grams)

    def holding(self, term: str) -> np.ndarray:
        """For each text whether it contains the term, which has no white space and no ASCII mark but the underscore."""
        if (found := self.known.get(term)) is None:
            lists = [self.grams.get(term[a : a + 3], []) for a in range(max(1, len(term) - 2))]
            least = min(lists, key=len)
            words = np.array(least if len(term) <= 3 else [i for i in least if term in self.words[i]], np.int64)
            size, found = self.ends[words + 1] - self.ends[words], np.zeros(self.n, bool)
            found[self.rows[np.arange(size.sum()) + np.repeat(self.ends[words] - np.cumsum(size) + size, size)]] = True
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[term] = found
        return found


def _narrowed(at: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Places among which are the first k by the keys, the first key first; more than k only where all keys tie."""
    sure = []
    for key in keys:
        if len(at) <= k:
            break
        x = key[at]
        last = np.partition(x, k - 1)[k - 1]
        sure.append(at[x < last])
        at, k = at[x == last], k - len(sure[-1])
    return np.concatenate([*sure, at])


class _Block:
    def __init__(self, table: pa.Table, size: int):
        self.row = {c: table[c].to_numpy(zero_copy_only=False) for c in ("id", "chat_id", "pos", "ts", "account", "cell")}
        self.words, self.hay = None, table["hay"]
        self.vector = unit(table["vector"].to_pylist(), size)

    def holding(self, term: str) -> np.ndarray:
        if self.words is None:
            self.words, self.hay = _Words(self.hay.to_pylist()), None
        return self.words.holding(term)

    def allowed(self, case: dict) -> np.ndarray:
        out = (self.row["ts"] < case["cutoff"]) & (self.row["account"] == case["account"]) & ~np.isin(self.row["id"], case["blocked"] or [])
        return out & ~np.isin(self.row["chat_id"], case["excluded"] or [])

    def first(self, case: int, route: str, value: np.ndarray, good: np.ndarray, order: list[np.ndarray], k: int) -> pa.RecordBatch:
        at = _narrowed(np.nonzero(good)[0], [*reversed(order), self.row["chat_id"], self.row["pos"]], k)
        at = at[np.lexsort([x[at] for x in (self.row["pos"], self.row["chat_id"], *order)])[:k]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), case)), pa.array([route] * len(at), pa.string()), *(pa.array(self.row[c][at]) for c in ("id", "chat_id", "pos", "ts")), pa.array(value[at].astype(float)), pa.array(self.row["cell"][at])],
            names=["case_id", "route", "id", "chat_id", "pos", "ts", "value", "cell"],
        )


def _met(held: DataFrame, asked: DataFrame, size: int, k: int) -> DataFrame:
    """The k best of each route, case and block."""

    def answer(block: _Block, table: pa.Table):
        for a in range(0, table.num_rows, AT_ONCE):
            part = table.slice(a, AT_ONCE)
            cases = part.select(["case_id", "cutoff", "account", "excluded", "blocked", "terms", "dense"]).to_pylist()
            cosine = np.round(unit(part["vector"].to_pylist(), size) @ block.vector.T, 9)
            for i, case in enumerate(cases):
                free = block.allowed(case)
                if case["dense"]:
                    yield block.first(case["case_id"], "dense", cosine[i], free & (cosine[i] >= LEAST), [-cosine[i]], k)
                if case["terms"]:
                    hits = np.sum([block.holding(t) for t in case["terms"]], axis=0)
                    yield block.first(case["case_id"], "keyword", hits, free & (hits > 0), [-block.row["ts"], -hits], k)

    return meet(held.select("block", "id", "chat_id", "pos", "ts", "account", "hay", "vector", "cell"), asked, lambda t: _Block(t, size), answer, _ROUTES)


def _ranked(routes: DataFrame, k: int) -> DataFrame:
    newest = F.when(F.col("route") == "keyword", -F.col("ts"))
    place = F.row_number().over(Window.partitionBy("case_id", "route").orderBy(F.desc("value"), newest, "chat_id", "pos"))
    return routes.withColumn("rank", place - 1).filter(F.col("rank") < k)


def calibrated_probes(cases: DataFrame, held: DataFrame, cells: Cells, blocks: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells that hold `recall` of the neighbours that TRIED cases (drawn by hash) have in all cells."""
    if recall >= 1 or cells.n <= 1:
        return cells.n
    tried = written(cases.filter("vector is not null").orderBy(F.xxhash64("case_id")).limit(TRIED))
    asked = _asks(tried.withColumn("terms", F.lit(None).cast("array<string>")), cells, blocks, cells.n, False)
    true = _ranked(_met(held, asked, cells.size, k), k).select("case_id", "cell").collect()
    own = tried.select("case_id", "vector").collect()
    order = cells.probed(unit([r.vector for r in own], cells.size), cells.n) if own else np.zeros((0, cells.n), int)
    place = {r.case_id: np.argsort(o) for r, o in zip(own, order)}
    at = np.sort([place[r.case_id][r.cell] for r in true])
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else cells.n


def search_routes(cases: DataFrame, messages: DataFrame, k: int, cells: int = 64, recall: float = 0.95) -> DataFrame:
    """(case_id, route, id, chat_id, pos, ts, value, rank): the first max(20, 5k) messages of each case by cosine, and by words contained.

    Cases: case_id, account, cutoff, excluded (chats), blocked (ids), query, vector. Messages: id, chat_id, pos, ts, account, sender, text,
    vector. Equal cosines go by chat and place, equal counts of words by the later time first.
    """
    limit = max(20, 5 * k)
    index = Cells.fit(messages, cells if recall < 1 else 1)  # what is probed whole needs no cells
    hay = F.lower(F.concat_ws(" ", "sender", "text"))
    held, blocks = inverted_file(messages.select(*[F.col(c).cast("long").alias(c) for c in ("id", "chat_id", "pos", "ts", "account")], hay.alias("hay"), "vector"), index)
    asks = written(cases.select("case_id", "account", "cutoff", "excluded", "blocked", words(F.col("query")).alias("terms"), "vector"))
    probes = calibrated_probes(asks, held, index, blocks, limit, recall)
    if index.n <= 1:
        return _ranked(_met(held, _asks(asks, index, blocks, probes, True), index.size, limit), limit).drop("cell")
    # Words have no cells: their blocks are full ones, so a query meets few.
    whole, none = Cells(np.zeros((0, 0))), F.lit(None).cast("array<float>")
    texts, every = inverted_file(held.drop("cell", "block").withColumn("vector", none), whole)
    near = _met(held.withColumn("hay", F.lit("")), _asks(asks.withColumn("terms", F.lit(None).cast("array<string>")), index, blocks, probes, False), index.size, limit)
    contained = _met(texts, _asks(asks.withColumn("vector", none), whole, every, 0, True), whole.size, limit)
    return _ranked(near.unionByName(contained), limit).drop("cell")


def fused(routes: DataFrame) -> DataFrame:
    """(case_id, id, chat_id, pos, ts, score, routes, place): .6 cosine and .4 of the words found over the most found, more for what both routes have."""
    most = F.max(F.when(F.col("route") == "keyword", F.col("value"))).over(Window.partitionBy("case_id"))
    own = lambda r: F.max(F.when(F.col("route") == r, F.col("value")))
    both = routes.withColumn("_most", most).groupBy("case_id", "id", "chat_id", "pos", "ts").agg(own("dense").alias("_d"), (own("keyword") / F.max("_most")).alias("_k"))
    score = DENSE_SHARE * F.coalesce("_d", F.lit(0.0)) + (1 - DENSE_SHARE) * F.coalesce("_k", F.lit(0.0))
    score = F.round(score * F.when(F.col("_d").isNotNull() & F.col("_k").isNotNull(), BOTH).otherwise(1.0), 7)
    names = F.concat_ws(",", F.when(F.col("_d").isNotNull(), "dense"), F.when(F.col("_k").isNotNull(), "keyword"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "chat_id", "pos"))
    return both.select("case_id", "id", "chat_id", "pos", "ts", score.alias("score"), names.alias("routes")).withColumn("place", place - 1)


def hit_contexts(hits: DataFrame, cases: DataFrame, messages: DataFrame, k: int) -> DataFrame:
    """(case_id, n, hit_id, score, messages): the first k hits with the messages beside them that the case may see; a hit is left out whose window has a message of an earlier one.

    Windows reach BESIDE places to either side and SECONDS away. A case has 2 max(20, 5k) hits at most.
    """
    offsets = F.explode(F.sequence(F.lit(-BESIDE), F.lit(BESIDE))).alias("_o")
    spread = hits.select("case_id", "place", "score", F.col("id").alias("hit_id"), "chat_id", F.col("pos").alias("_pos"), F.col("ts").alias("_ts"), offsets).withColumn("pos", F.col("_pos") + F.col("_o"))
    met = spread.join(messages.select("chat_id", "pos", "id", "ts"), ["chat_id", "pos"]).join(cases.select("case_id", "cutoff", "blocked"), "case_id")
    seen = met.filter((F.col("ts") < F.col("cutoff")) & ~F.coalesce(F.array_contains("blocked", F.col("id")), F.lit(False)) & (F.abs(F.col("ts") - F.col("_ts")) <= SECONDS))
    windows = seen.groupBy("case_id", "place", "score", "hit_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("w")).select("case_id", "place", "score", "hit_id", F.col("w.id").alias("messages"))

    def run(table: pd.DataFrame) -> pd.DataFrame:
        out, known = [], set()
        for row in table.sort_values("place").itertuples():
            if len(out) < k and known.isdisjoint(row.messages):
                known.update(row.messages)
                out.append((row.case_id, len(out), row.hit_id, row.score, list(row.messages)))
        return pd.DataFrame(out, columns=["case_id", "n", "hit_id", "score", "messages"])

    return windows.groupBy("case_id").applyInPandas(run, "case_id long, n long, hit_id long, score double, messages array<long>")


def memory_search(cases: DataFrame, messages: DataFrame, k: int, cells: int = 64, recall: float = 0.95) -> DataFrame:
    """hit_contexts() of the fused routes."""
    return hit_contexts(fused(search_routes(cases, messages, k, cells, recall)), cases, messages, k)


def dense_route(queries: DataFrame, pool: DataFrame, k: int, cells: int = 64, recall: float = 1.0) -> DataFrame:
    """(case_id, id, cosine, rank): the k nearest rows (id, vector) of each query (case_id, vector), from LEAST on; all rows with recall=1."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = pool.select(F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("chat_id"), F.col("id").cast("long").alias("pos"), F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("account"), F.lit("").alias("hay"), "vector")
    index = Cells.fit(rows, cells if recall < 1 else 1)
    held, blocks = inverted_file(rows, index)
    asks = written(queries.select("case_id", F.lit(0).cast("long").alias("account"), F.lit(1).cast("long").alias("cutoff"), none("array<long>").alias("excluded"), none("array<long>").alias("blocked"), none("array<string>").alias("terms"), "vector"))
    probes = calibrated_probes(asks, held, index, blocks, k, recall)
    found = _ranked(_met(held, _asks(asks, index, blocks, probes, False), index.size, k), k)
    return found.select("case_id", "id", F.col("value").alias("cosine"), "rank")
