"""The best rows of each case by shared terms, from blocks of an inverted index whose bounds are good enough."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators.blocks import Postings, flat_terms, meet
from chatspark.sources.scratch import written

#: Rows of a block, and how many size classes a doubling of the number of terms has.
BLOCK_ROWS, CLASSES = 512, 3
_FOUND = "case_id long, id long, overlap long, score double"


def term_ids(queries: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, terms) and (id, terms, total): bags of the terms that any query has, as lists of (t, n) with numbers for terms."""
    vocabulary = written(queries.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    bags = lambda rows, key: rows.join(vocabulary, "term").groupBy(key).agg(F.collect_list(F.struct("t", F.col("n").cast("long").alias("n"))).alias("terms"), F.sum("n").alias("total"))
    return written(bags(queries, "case_id").drop("total")), bags(postings, "id")


def size_blocks(rows: DataFrame, size: str = "total") -> DataFrame:
    """Adds block: rows of like size together, dealt by hash within a size class.

    Classes are logarithmic, so there are some tens of them whatever the rows, and only their counts come to the driver.
    """
    label = F.floor(F.log2(F.greatest(F.col(size), F.lit(1))) * CLASSES).cast("long")
    counts = {r._class: r.n for r in rows.groupBy(label.alias("_class")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, table, at = [], [], 0
    for c in sorted(counts):
        own = -(-counts[c] // BLOCK_ROWS)
        first += [F.lit(c), F.lit(at).cast("long")]
        table += [F.lit(c), F.lit(own).cast("long")]
        at += own
    if not counts:
        return rows.withColumn("block", F.lit(0).cast("long"))
    return rows.withColumn("block", F.create_map(*first)[label] + F.pmod(F.xxhash64("id"), F.create_map(*table)[label]))


def block_bounds(queries: DataFrame, held: DataFrame, weight: float) -> DataFrame:
    """(case_id, block, bound): no row of the block scores more for the case.

    A block shares at most the smaller of the case's count and the block's largest for each term, and no more terms in all than its
    largest row has.
    """
    most = held.select("block", F.inline("terms")).groupBy("block", "t").agg(F.max("n").alias("_most"))
    whole = held.groupBy("block").agg(F.max("total").alias("_total"), F.max("static").alias("_static"))
    shared = queries.select("case_id", F.inline("terms")).join(most, "t").groupBy("case_id", "block").agg(F.sum(F.least("n", "_most")).alias("_shared"))
    return shared.join(whole, "block").select("case_id", "block", (weight * F.least("_shared", "_total") + F.col("_static")).alias("bound"))


def _evaluated(queries: DataFrame, held: DataFrame, chosen: DataFrame, weight: float, k: int, descending: bool) -> DataFrame:
    """The k best rows of each chosen (case_id, block), and only those that reach the case's threshold `least`."""

    def make(table: pa.Table):
        return Postings(table["terms"]), table["id"].to_numpy(), table["static"].to_numpy()

    def answer(state, table: pa.Table):
        postings, ids, static = state
        lists = table["asked"].combine_chunks()
        row, term, count = flat_terms(lists)
        bounds = np.searchsorted(row, np.arange(len(lists) + 1))
        for i, (case, least) in enumerate(zip(table["case_id"].to_pylist(), table["least"].to_pylist())):
            overlap = postings.overlap(term[bounds[i] : bounds[i + 1]], count[bounds[i] : bounds[i + 1]])
            score = np.floor((weight * overlap + static) * 1e6 + 0.5) / 1e6
            good = np.nonzero((overlap > 0) & ((score >= least) if least is not None else True))[0]
            best = good[np.lexsort((-ids[good] if descending else ids[good], -score[good]))[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), case)), pa.array(ids[best]), pa.array(overlap[best].astype(np.int64)), pa.array(score[best])], names=["case_id", "id", "overlap", "score"])

    asked = chosen.join(queries.withColumnRenamed("terms", "asked"), "case_id").select("block", "case_id", "asked", "least")
    return meet(held.select("block", "id", "terms", "static"), asked, make, answer, _FOUND)


def pruned_topk(queries: DataFrame, postings: DataFrame, static: DataFrame, k: int, weight: float = 1.0, descending: bool = False) -> DataFrame:
    """(case_id, id, overlap, score, rank): the k rows of each case with the largest weight * overlap + static, of those that share a term.

    Queries (case_id, term, n), postings (id, term, n), static (id, static). Equal scores go by id. Each case first meets the block with
    the largest bound; its k-th score there is a threshold, and of the other blocks only those whose bound reaches it are read.
    No (case, row) pair is shuffled but k for each case and block that is read.
    """
    asked, bags = term_ids(queries, postings)
    held = written(size_blocks(written(bags.join(static, "id"))))
    bounds = written(block_bounds(asked, held, weight))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("bound"), "block"))
    first = written(bounds.withColumn("_p", place).filter("_p = 1").select("case_id", "block", F.lit(None).cast("double").alias("least")))
    found = written(_evaluated(asked, held, first, weight, k, descending))
    order = [F.desc("score"), F.desc("id") if descending else F.col("id")]
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    threshold = found.withColumn("_r", rank).filter(F.col("_r") == k).select("case_id", F.col("score").alias("least"))
    rest = bounds.join(first, ["case_id", "block"], "left_anti").join(threshold, "case_id", "left").filter("least is null or bound + 1e-5 >= least")
    more = _evaluated(asked, held, rest.select("case_id", "block", "least"), weight, k, descending)
    return found.unionByName(more).withColumn("rank", rank - 1).filter(F.col("rank") < k)
