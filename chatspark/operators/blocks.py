"""Blocks of rows, past which the rows that ask for something are streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meet(held: DataFrame, asked: DataFrame, make: Callable, answer: Callable, schema: str) -> DataFrame:
    """What `answer(state, rows)` yields for the asked rows of each block, `state` being `make(held rows)`.

    Both sides have `block`, and else their own columns. One shuffle brings a block's held rows before its asked ones; only the held rows,
    whose number the caller bounds, are kept, and asked rows pass in Arrow batches however many there are.
    """
    both = held.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "block").sortWithinPartitions("block", "_asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, state = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            block, asks = table["block"].to_numpy(), table["_asks"].to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.nonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1]))[0] + 1, [len(block)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if block[a] != own:
                    own, rows, state = block[a], [], None
                if not asks[a]:
                    rows.append(table.slice(a, b - a))
                elif rows or state is not None:
                    if state is None:
                        state, rows = make(pa.concat_tables(rows).combine_chunks()), []
                    yield from answer(state, table.slice(a, b - a).combine_chunks())

    return ordered.mapInArrow(run, schema)


class Postings:
    """The inverted lists of a block: for each term the places of its rows and the counts there."""

    def __init__(self, lists: pa.ChunkedArray):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        place, term, count = flat_terms(lists)
        order = np.argsort(term, kind="stable")
        self.term, self.place, self.count, self.rows = term[order], place[order], count[order], len(lists)

    def overlap(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each row of the block, the smaller count summed over the terms that it shares."""
        low, high = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        return np.bincount(self.place[at], np.minimum(self.count[at], np.repeat(counts, n)), self.rows)


def flat_terms(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of an array of lists of (t, n)."""
    import pyarrow.compute as pc

    flat = lists.flatten()
    return pc.list_parent_indices(lists).to_numpy(), flat.field("t").to_numpy(), flat.field("n").to_numpy()
