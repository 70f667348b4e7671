"""Connected components of an edge table by hooking and shortcutting (the FastSV scheme)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.stage import drop_written, written

MAX_ROUNDS = 60
#: Parents of up to this many nodes (32 MB) are broadcast to the edges; more are joined by shuffle.
MAX_BROADCAST_NODES = 1_000_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of the edges (of longs), root being the least node of its component.

    Every node points to a parent, at first its least neighbour or itself. In a round each edge offers its far end's
    grandparent to its near end and to the near end's parent, and a node takes the least of these and its own
    grandparent; it ends when no grandparent changes. The offers are combined by task before they meet, so a node of
    many edges is no heavy group. A round is two jobs written to the shared folder, so the loop's plan stays short
    and a lost executor costs one round. Loops and repeated edges are allowed; null ends are ignored.
    """
    pairs = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v"), "edges")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = _grandparents(written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("parent")), "parents"))
    before = None
    for _ in range(MAX_ROUNDS):
        n, sign = state.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("node", "grandparent"), F.lit(1 << 40)))).first()
        if sign == before:
            break
        before = sign
        near, far = state.select(F.col("node").alias("u"), F.col("parent").alias("p")), state.select(F.col("node").alias("v"), F.col("grandparent").alias("least"))
        if n <= MAX_BROADCAST_NODES:
            near, far = F.broadcast(near), F.broadcast(far)
        offers = both.join(far, "v").join(near, "u").select(F.explode(F.array("u", "p")).alias("node"), "least")
        own = state.select("node", F.least("parent", "grandparent").alias("least"))
        new = _grandparents(written(offers.unionByName(own).groupBy("node").agg(F.min("least").alias("parent")), "parents"))
        drop_written(state.sparkSession, state)
        state = new
    else:
        raise RuntimeError("components did not converge")
    drop_written(state.sparkSession, pairs)
    return state.select("node", F.col("grandparent").alias("root"))


def _grandparents(parents: DataFrame) -> DataFrame:
    """(node, parent) with each parent's own parent."""
    of = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grandparent"))
    if parents.count() <= MAX_BROADCAST_NODES:
        of = F.broadcast(of)
    out = written(parents.join(of, "parent").select("node", "parent", "grandparent"), "nodes")
    drop_written(parents.sparkSession, parents)
    return out
