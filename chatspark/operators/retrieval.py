"""Recall and ranking of history for cases."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.sources.scratch import written


def term_postings(rows: DataFrame, terms: Column) -> DataFrame:
    """(id, term, n): the bag of terms of each row."""
    return rows.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def term_overlap(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(case_id, id, overlap): sum over shared terms of the smaller count. Queries have case_id, term, n.

    The join on term is sort-merge unless Spark finds the queries small; hot terms are split by adaptive skew joins, none is dropped.
    """
    q = queries.select("case_id", "term", F.col("n").alias("_q"))
    return pool.join(q, "term").groupBy("case_id", "id").agg(F.sum(F.least("n", "_q")).alias("overlap"))


def rule_score(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds score: the weighted sum of the named columns (null as 0)."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return pairs.withColumn("score", F.round(total, 6))


def topk_rank(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each case with their rank (from 0)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return scored.withColumn("rank", rank - 1).filter(F.col("rank") < k)


def rrf_fusion(routes: DataFrame, weights: dict[str, float], constant: int = 10) -> DataFrame:
    """(case_id, id, score): over the routes, weight * (constant + 1) / (constant + rank + 1) summed."""
    w = F.coalesce(*[F.when(F.col("route") == r, F.lit(x)) for r, x in weights.items()], F.lit(0.0))
    return routes.groupBy("case_id", "id").agg(F.round(F.sum(w * (constant + 1) / (constant + 1 + F.col("rank"))), 9).alias("score"))


def route_union(routes: DataFrame) -> DataFrame:
    """(case_id, id, best, place): by the best rank over the routes, then id."""
    best = routes.groupBy("case_id", "id").agg(F.min("rank").alias("best"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("best", "id")))


def mmr_select(rows: DataFrame, k: int, balance: float = 0.8, budget: int | None = None) -> DataFrame:
    """Greedy choice by balance * relevance - (1 - balance) * largest similarity to what is chosen; equal contents once.

    Rows (case_id, id, relevance, vector, content, chars) are the bounded candidates of a case.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["relevance", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(table["vector"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        left, seen, used, out = list(range(len(table))), set(), 0, []
        closest = np.zeros(len(table))
        while left and len(out) < k:
            i = max(left, key=lambda j: (balance * table.relevance[j] - (1 - balance) * closest[j], -j))
            left.remove(i)
            if table.content[i] in seen or (budget is not None and used + table.chars[i] > budget):
                continue
            seen.add(table.content[i])
            used += table.chars[i]
            out.append(i)
            closest = np.maximum(closest, v @ v[i])
        return pd.DataFrame({"case_id": table.case_id[out], "id": table.id[out], "place": range(len(out))})

    return rows.groupBy("case_id").applyInPandas(run, "case_id long, id long, place long")


def diversity_cap(rows: DataFrame, limits: dict[str, int], k: int) -> DataFrame:
    """Of each case's ranked (bounded) candidates, those whose buckets aren't full yet, at most k. Null buckets have no limit."""
    names = list(limits)

    def run(table: pd.DataFrame) -> pd.DataFrame:
        counts: dict[tuple, int] = {}
        out = []
        ordered = table.sort_values("rank")
        for i, *values in zip(ordered.index, *(ordered[n] for n in names)):
            keys = [(n, v) for n, v in zip(names, values) if not pd.isna(v)]
            if len(out) < k and all(counts.get(x, 0) < limits[x[0]] for x in keys):
                out.append(i)
                for x in keys:
                    counts[x] = counts.get(x, 0) + 1
        return table.loc[out, ["case_id", "id", "rank"]]

    return rows.groupBy("case_id").applyInPandas(run, "case_id long, id long, rank long")


def budget_select(rows: DataFrame, k: int, budget: int) -> DataFrame:
    """(case_id, id, decision) in order of score: selected, duplicate, over_count or over_budget; what doesn't fit is passed over."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["score", "id"], ascending=[False, True])
        seen, used, taken, out = set(), 0, 0, []
        for content, chars in zip(table.content, table.chars):
            if content in seen:
                out.append("duplicate")
            elif taken >= k:
                out.append("over_count")
            elif used + chars > budget:
                out.append("over_budget")
            else:
                seen.add(content)
                used, taken = used + chars, taken + 1
                out.append("selected")
        return pd.DataFrame({"case_id": table.case_id, "id": table.id, "decision": out})

    return rows.groupBy("case_id").applyInPandas(run, "case_id long, id long, decision string")


def budget_sweep(rows: DataFrame, budgets: list[int], k: int) -> DataFrame:
    """Selected and rejected counts of budget_select at each budget; the rows are made once."""
    rows, out = written(rows), None
    for b in budgets:
        one = budget_select(rows, k, b).groupBy(F.lit(b).alias("budget")).agg(
            F.sum((F.col("decision") == "selected").cast("long")).alias("selected"), F.sum((F.col("decision") == "over_budget").cast("long")).alias("over_budget"),
            F.count_distinct(F.when(F.col("decision") == "over_budget", F.col("case_id"))).alias("cases_rejecting"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def hit_windows(windows: DataFrame) -> DataFrame:
    """Hits (case_id, chat_id, rank, start, end) in order of rank, without those that overlap an earlier one; a case's hits are bounded."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("rank")
        out, kept = [], {}  # by chat: starts and ends of what stays, in order; they don't overlap
        for i, chat, start, end in zip(table.index, table.chat_id, table.start, table.end):
            starts, ends = kept.setdefault(chat, ([], []))
            at = bisect.bisect_left(ends, start)
            if at == len(starts) or starts[at] > end:
                starts.insert(at, start)
                ends.insert(at, end)
                out.append(i)
        return table.loc[out, ["case_id", "chat_id", "rank", "start", "end"]]

    return windows.groupBy("case_id").applyInPandas(run, "case_id long, chat_id long, rank long, start long, end long")


def dense_coverage(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows covered by a vector of exactly the stripped text, and the rest."""
    known = vectors.select(F.trim("text").alias("_t")).distinct().withColumn("_v", F.lit(True))
    joined = texts.withColumn("_t", F.trim("text")).join(known, "_t", "left")
    return joined.agg(F.count(F.lit(1)).alias("total"), F.count("_v").alias("covered")).withColumn("keyword_only", F.col("total") - F.col("covered"))


def retrieval_diff(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Keys of two recalls that differ, and the fields (missing or extra rows have all)."""
    x, y = a.select(*key, F.struct(*fields).alias("_x")), b.select(*key, F.struct(*fields).alias("_y"))
    both = x.join(y, key, "full")
    return both.select(*key, F.array_compact(F.array(*[F.when(~F.col(f"_x.{f}").eqNullSafe(F.col(f"_y.{f}")), F.lit(f)) for f in fields])).alias("fields")).filter("size(fields) > 0")


def char_batches(rows: DataFrame, limit: int, overlap: int = 8) -> DataFrame:
    """(chat_id, pos, batch): rows of a chat packed in order into batches of at most `limit` characters; each batch begins with the last `overlap` rows of the one before, room permitting."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("pos")
        pos, chars = table.pos.tolist(), table.chars.tolist()
        out, batch, held, size = [], 0, [], 0
        for i, n in enumerate(chars):
            if held and size + n > limit:
                out += [(j, batch) for j in held]
                batch += 1
                held = held[-overlap:]
                while held and sum(chars[j] for j in held) + n > limit:
                    held.pop(0)
                size = sum(chars[j] for j in held)
            held.append(i)
            size += n
        out += [(j, batch) for j in held]
        return pd.DataFrame({"chat_id": table.chat_id.iloc[0], "pos": [pos[j] for j, _ in out], "batch": [b for _, b in out]})

    return rows.select("chat_id", "pos", "chars").groupBy("chat_id").applyInPandas(run, "chat_id long, pos long, batch long")
