"""Exchange of hashes that several documents share, used by the substring operators.

Documents send (hash, doc) rows; the answer has the rows whose hash some other document
(or some document with a smaller id) also sent. Rows are dealt by hash,
sorted by Spark (which spills) and read as a stream, so a hash that a third of all
documents share needs no more memory than a rare one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_hashes(rows: DataFrame) -> DataFrame:
    """The distinct rows (hash, doc) whose hash occurs with another doc, or with `often`: at several places of one."""

    def run(batches):
        held = None
        before = None  # hash of the last row that went out
        for batch in batches:
            cols = [batch["hash"].to_numpy(), batch["doc"].to_numpy(), batch["often"].to_numpy(zero_copy_only=False)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if len(cols[0]) < 2:
                held = cols if len(cols[0]) else None
                continue
            yield from answer([c[:-1] for c in cols], before, cols[0][-1])
            before = cols[0][-2]
            held = [c[-1:] for c in cols]
        if held is not None:
            yield from answer(held, before, None)

    def answer(cols, before, after):
        hashes, doc, often = cols
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[0] = before is not None and before == hashes[0]
        following = np.zeros(len(hashes), bool)
        following[:-1] = same[1:]
        following[-1] = after is not None and after == hashes[-1]
        keep = same | following | often
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array(doc[keep])], names=["hash", "doc"])

    return _dealt(rows).mapInArrow(run, "hash long, doc long")


def later_hashes(rows: DataFrame) -> DataFrame:
    """The rows (hash, doc) whose (hash, other) also occurs with a smaller `least`: two hashes are 128 bits, so matches are of equal words."""

    def run(batches):
        before = None  # (hash, other, smallest least) of the group that the last batch ended in
        for batch in batches:
            hashes, other, doc, least = (batch[c].to_numpy() for c in ("hash", "other", "doc", "least"))
            if not len(hashes):
                continue
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (other[1:] != other[:-1])
            new[0] = before is None or before[:2] != (hashes[0], other[0])
            first = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), -1))
            smallest = least[np.maximum(first, 0)]
            if before is not None:
                smallest[first < 0] = before[2]
            before = (hashes[-1], other[-1], smallest[-1])
            keep = least > smallest
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array(doc[keep])], names=["hash", "doc"])

    return _dealt(rows, "other", "least").mapInArrow(run, "hash long, doc long")


def _dealt(rows: DataFrame, *then: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "hash").sortWithinPartitions("hash", *(then or ["doc"]))


def by_document(rows: DataFrame) -> DataFrame:
    """(doc, hashes): what the exchange answered to each document; its size is bounded by the document's."""
    return rows.groupBy("doc").agg(F.collect_list("hash").alias("hashes"))


def minimizers(values: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minimum of each window of `width` values, mask of the values that are the minimum of a valid window).

    All places of a tie count, so what is selected depends on the window's content alone.
    `valid` masks the windows.
    """
    from chatspark.llm.seqhash import sliding_min

    least = sliding_min(values, width)
    best = np.where(valid, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    largest = ~sliding_min(~np.concatenate([pad, best, pad]), width)
    return least, (largest == values) & (values > 0)
