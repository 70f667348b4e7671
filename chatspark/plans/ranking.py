"""Queries: pairs, labels and ranking metrics; an order is a target, its lines the candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatspark.operators import graded as G
from chatspark.operators import ranking as K
from chatspark.plans.registry import query
from chatspark.plans.tables import table

#: CTE ob: target, id, score, z, grade, side, features
OB = """ob AS (SELECT l_orderkey AS target_id, l_linenumber * 100000 + l_partkey AS id, CAST(l_quantity AS INTEGER) AS score, CASE WHEN l_orderkey % 13 = 5 AND l_linenumber = 2 THEN NULL ELSE CAST(l_suppkey % 3 = 0 AS INTEGER) END AS z, l_suppkey % 4 AS grade,
  CASE WHEN l_orderkey % 5 = 0 THEN 'validation' ELSE 'fit' END AS split, l_returnflag AS flag, l_linestatus AS status, l_partkey % 50 AS part FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""


def observations(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    one = l.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min_by(F.struct("l_quantity", "l_suppkey", "l_returnflag", "l_linestatus"), F.struct("l_suppkey", "l_extendedprice")).alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "x.*")
    z = F.when((F.col("l_orderkey") % 13 == 5) & (F.col("l_linenumber") == 2), F.lit(None)).otherwise((F.col("l_suppkey") % 3 == 0).cast("int"))
    return one.select(
        F.col("l_orderkey").alias("target_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("id"), F.col("l_quantity").cast("int").alias("score"), z.alias("z"), (F.col("l_suppkey") % 4).alias("grade"),
        F.when(F.col("l_orderkey") % 5 == 0, "validation").otherwise("fit").alias("split"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_partkey") % 50).alias("part"),
        F.col("l_linenumber").alias("line"),
    )


@query(f"WITH {OB} SELECT a.target_id, a.id AS better, b.id AS worse, round(1.0 / count(*) OVER (PARTITION BY a.target_id), 9) AS weight FROM ob a JOIN ob b ON a.target_id = b.target_id AND a.grade > b.grade")
def pref_pairs(spark, d):
    return K.pref_pairs(observations(spark, d))


@query(f"WITH {OB}, s AS (SELECT target_id FROM ob GROUP BY target_id HAVING count(z) = count(*) AND min(z) < max(z)) SELECT a.target_id, a.id AS win, b.id AS lose FROM ob a JOIN ob b USING (target_id) JOIN s USING (target_id) WHERE a.z = 1 AND b.z = 0")
def directed_pairs(spark, d):
    return K.directed_pairs(observations(spark, d))


@query(f"WITH {OB}, v AS (SELECT part, dense_rank() OVER (ORDER BY part) AS code FROM (SELECT DISTINCT part FROM ob WHERE split = 'fit' AND part % 3 <> 1)) SELECT id, target_id, CAST(coalesce(code, 0) AS INTEGER) AS code FROM ob LEFT JOIN v USING (part)")
def cat_encode(spark, d):
    return K.cat_encode(observations(spark, d), (F.col("split") == "fit") & (F.col("part") % 3 != 1), "part").select("id", "target_id", "code")


@query(f"WITH {OB} SELECT target_id * 1000000 + id AS id, round(CASE flag WHEN 'A' THEN 0.5 WHEN 'N' THEN -0.25 ELSE 0 END + CASE status WHEN 'O' THEN 1.5 ELSE 0 END, 6) AS score FROM ob")
def linear_score(spark, d):
    w = spark.createDataFrame([("flag", "A", 0.5), ("flag", "N", -0.25), ("status", "O", 1.5)], "field string, value string, weight double")
    return K.linear_score(observations(spark, d).withColumn("id", F.col("target_id") * 1000000 + F.col("id")), w, ["flag", "status"])


_FUSE = "fu AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), sc AS (SELECT sqrt(avg(a * a)) AS sa, sqrt(avg(b * b)) AS sb FROM fu WHERE vec_id % 5 <> 0), fs AS (SELECT vec_id, label, 0.8 * a / sa + 0.2 * b / sb AS m FROM fu, sc)"


def _fused(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return K.score_fusion(e, F.col("vec_id") % 5 != 0, "a", "b")


@query(f"WITH {_FUSE} SELECT vec_id, round(m, 4) AS fused, round(1 / (1 + exp(-m)), 4) AS probability FROM fs")
def score_fusion(spark, d):
    return _fused(spark, d).select("vec_id", F.round("fused", 4).alias("fused"), F.round("probability", 4).alias("probability"))


@query("WITH p AS (SELECT l_returnflag, (l_quantity - 0.5) / 50 AS p, CAST(l_suppkey % 2 = 0 AS INTEGER) AS y FROM lineitem) SELECT l_returnflag, count(*) AS total, CAST(sum(CAST(CAST(p >= 0.5 AS INTEGER) = y AS BIGINT)) AS BIGINT) AS correct, round(avg(-CASE WHEN y = 1 THEN ln(greatest(0.000001, least(0.999999, p))) ELSE ln(1 - greatest(0.000001, least(0.999999, p))) END), 6) AS logloss FROM p GROUP BY ALL")
def prob_metrics(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", ((F.col("l_quantity") - 0.5) / 50).alias("probability"), (F.col("l_suppkey") % 2 == 0).cast("int").alias("label"))
    return K.prob_metrics(rows, ["l_returnflag"])


def _expected(rel: str, by: str, k: int) -> str:
    """CTEs up to xp: hit and positives of each target of a relation with score and z."""
    return f"""tied AS (SELECT {by}, score, count(*) AS n, sum(z) AS pos FROM {rel} GROUP BY ALL), ab AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM tied),
tk AS (SELECT *, CAST(greatest(0, least(n, {k} - above)) AS BIGINT) AS take FROM ab), ms AS (SELECT *, CASE WHEN take = 0 THEN 1.0 ELSE list_aggregate(list_transform(range(take), lambda i: greatest(0.0, (n - pos - i) / (n - i))), 'product') END AS miss FROM tk),
xp AS (SELECT {by}, round(1 - product(miss), 6) AS hit, round(sum(take * pos / n), 6) AS positives FROM ms GROUP BY ALL)"""


@query(f"WITH {OB}, lb AS (SELECT * FROM ob WHERE z IS NOT NULL), {_expected('lb', 'target_id', 3)} SELECT * FROM xp")
def topk_expectation(spark, d):
    """Expected hits at 3 with ties broken uniformly."""
    return K.topk_expectation(observations(spark, d).filter("z is not null"), 3)


_GRADED = f"gr AS (SELECT target_id, grade, unnest([{{'method': 'plain', 'score': CAST(score AS DOUBLE)}}, {{'method': 'by_part', 'score': CAST(part % 7 AS DOUBLE)}}], recursive := true) FROM ob), st AS (SELECT *, CAST(grade >= threshold AS INTEGER) AS z FROM (SELECT *, unnest([1, 2, 3]) AS threshold FROM gr)), av AS (SELECT method, threshold, target_id, max(z) AS available FROM st GROUP BY ALL)"


@query(" UNION ALL ".join(f"(WITH {OB}, {_GRADED}, {_expected('st', 'method, threshold, target_id', k)} SELECT method, CAST(threshold AS INTEGER) AS threshold, {k} AS k, count(*) AS targets, CAST(sum(available) AS BIGINT) AS available, round(avg(hit), 5) AS hit_rate, round(avg(CASE WHEN available = 1 THEN hit END), 5) AS hit_rate_given_available FROM xp JOIN av USING (method, threshold, target_id) GROUP BY ALL)" for k in (1, 3)))
def graded_comparison(spark, d):
    """Two saved scores of an order's lines, by their first and first three."""
    rows = observations(spark, d).withColumn("plain", F.col("score")).withColumn("by_part", F.col("part") % 7)
    return K.graded_comparison(rows, ["plain", "by_part"], [1, 3], [1, 2, 3])


@query(f"""WITH {OB}, o AS (SELECT * FROM ob WHERE z IS NOT NULL), s AS (SELECT score, sum(z) AS p, sum(1 - z) AS q FROM o GROUP BY score), c AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM s WINDOW w AS (ORDER BY score DESC)),
w AS (SELECT a.target_id, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS win, count(*) AS n FROM o a JOIN o b USING (target_id) WHERE a.z = 1 AND b.z = 0 GROUP BY 1),
t AS (SELECT target_id, avg(z) AS y FROM (SELECT *, max(score) OVER (PARTITION BY target_id) AS m FROM o) WHERE score = m GROUP BY 1)
SELECT (SELECT round(sum(q * (cp - p + p / 2)) / (sum(p) * sum(q)), 6) FROM c) AS roc_auc, (SELECT round(sum(p * cp / (cp + cq)) / sum(p), 6) FROM c) AS average_precision, (SELECT round(avg(auc), 6) FROM w) AS within_auc, (SELECT round(CAST(sum(win) AS DOUBLE) / sum(n), 6) FROM w) AS pair_accuracy, (SELECT round(avg(y), 6) FROM t) AS top1_yield""")
def rank_metrics(spark, d):
    return K.rank_metrics(observations(spark, d).filter("z is not null"))


@query(f"""WITH {OB}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id) AS r, row_number() OVER (PARTITION BY target_id ORDER BY grade DESC, id) AS i, avg(grade) OVER (PARTITION BY target_id, score) AS g FROM ob),
p AS (SELECT target_id, {', '.join(f"sum(CASE WHEN r <= {k} THEN g / log2(r + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN i <= {k} THEN grade / log2(i + 1) ELSE 0 END) AS i{k}" for k in (1, 3, 5))} FROM r GROUP BY target_id) SELECT count(*) AS targets, {', '.join(f"round(avg(d{k} / i{k}), 6) AS ndcg_{k}" for k in (1, 3, 5))} FROM p WHERE i1 > 0""")
def ndcg(spark, d):
    return K.ndcg(observations(spark, d))


@query(f"""WITH {OB}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id) AS r FROM ob), p AS (SELECT t AS threshold, target_id, sum(CAST(grade >= t AS BIGINT)) AS p, max(CAST(grade >= t AND r <= 2 AS INT)) AS h, avg(CASE WHEN r <= 2 THEN grade END) AS m FROM r, (SELECT unnest([1, 2, 3]) AS t) GROUP BY ALL)
SELECT threshold, CAST(sum(p) AS BIGINT) AS positives, round(avg(h), 6) AS hit_rate, round(avg(m), 6) AS mean_grade FROM p GROUP BY threshold""")
def graded_metrics(spark, d):
    return K.graded_metrics(observations(spark, d), 2)


@query(f"""WITH {OB}, t AS (SELECT target_id, arg_max(z, (score, -id)) AS model, max(score) AS s FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id) AS r FROM ob) WHERE r = 1 GROUP BY 1), tt AS (SELECT target_id, z AS model FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id) AS r FROM ob) WHERE r = 1),
b AS (SELECT target_id, z AS base FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY id) AS r FROM ob WHERE target_id % 11 <> 3) WHERE r = 1)
SELECT count(*) AS targets, count(*) FILTER (base IS NULL OR model IS NULL) AS excluded, count(*) FILTER (model > base) AS wins, count(*) FILTER (model < base) AS losses, count(*) FILTER (model = base) AS ties FROM tt LEFT JOIN b USING (target_id)""")
def selection_vs_baseline(spark, d):
    o = observations(spark, d)
    base = o.filter("target_id % 11 != 3").groupBy("target_id").agg(F.min("id").alias("id"))
    return K.selection_vs_baseline(o, base, ("line",))


@query(f"""WITH {OB}, m AS (SELECT target_id, sum(z) AS model, count(z) AS n FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id) AS r FROM ob) WHERE r <= 2 GROUP BY 1), b AS (SELECT target_id, sum(z) AS base, count(z) AS n FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY id) AS r FROM ob) WHERE r <= 2 GROUP BY 1)
SELECT count(*) AS targets, count(*) FILTER (model > base) AS wins, count(*) FILTER (model < base) AS losses FROM m JOIN b USING (target_id) WHERE m.n = 2 AND b.n = 2""")
def topk_vs_baseline(spark, d):
    """Two choices of the model against the first two ids, where both pairs are labelled; lines that share an id go by their number, the order of `ob`."""
    from pyspark.sql.window import Window

    def first(order, name):
        r = F.row_number().over(Window.partitionBy("target_id").orderBy(*order))
        return observations(spark, d).withColumn("r", r).filter("r <= 2").groupBy("target_id").agg(F.sum("z").alias(name), F.count("z").alias("n")).filter("n = 2").drop("n")

    both = first([F.desc("score"), F.asc_nulls_last("id"), F.col("line")], "model").join(first([F.asc_nulls_last("id"), F.col("line")], "base"), "target_id")
    return both.agg(F.count(F.lit(1)).alias("targets"), F.sum((F.col("model") > F.col("base")).cast("long")).alias("wins"), F.sum((F.col("model") < F.col("base")).cast("long")).alias("losses"))


@query()
def paired_bootstrap(spark, d):
    """Interval of the difference between a target's best and mean grade, by the target's remainder; tested for coverage and determinism."""
    per = observations(spark, d).groupBy("target_id").agg((F.max("grade") - F.avg("grade")).alias("delta"))
    return K.paired_bootstrap(per.withColumn("cohort", (F.col("target_id") % 4).cast("string")), "cohort")


@query(f"WITH {OB}, p AS (SELECT target_id, count(*) AS n, count(z) AS l, coalesce(sum(z), 0) AS o FROM ob GROUP BY 1) SELECT CASE WHEN l = 0 THEN 'none' WHEN l < n THEN 'incomplete' WHEN o = 0 THEN 'all_zero' WHEN o = n THEN 'all_one' ELSE 'mixed' END AS kind, count(*) AS targets, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(o) AS BIGINT) AS ones FROM p GROUP BY 1")
def label_summary(spark, d):
    return K.label_summary(observations(spark, d))


_REP = f"{OB}, rp AS (SELECT target_id, id, split, CAST((target_id + id + k) % 3 = 0 AS INTEGER) AS label FROM ob, (SELECT unnest([1, 2]) AS k) WHERE z = 1 AND NOT (target_id % 9 = 4 AND k = 2))"


def _repeats(spark, d):
    o = observations(spark, d).filter("z = 1").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).filter("not (target_id % 9 = 4 and k = 2)")
    return o.select("target_id", "id", "split", ((F.col("target_id") + F.col("id") + F.col("k")) % 3 == 0).cast("int").alias("label"))


@query(f"WITH {_REP}, s AS (SELECT target_id, id, sum(label) AS s, count(*) AS n FROM rp GROUP BY ALL) SELECT target_id, id, CAST(z + CASE WHEN z = 1 THEN s ELSE 0 END AS BIGINT) AS grade FROM ob LEFT JOIN s USING (target_id, id) WHERE z = 0 OR (z = 1 AND n = 2)")
def graded_labels(spark, d):
    return K.graded_labels(observations(spark, d), _repeats(spark, d), 2)


@query(f"WITH {_REP}, s AS (SELECT split, target_id, id, sum(label) AS positives, count(*) AS n FROM rp GROUP BY ALL) SELECT split, CAST(positives AS BIGINT) AS positives, count(*) AS identities FROM s WHERE n = 2 GROUP BY ALL")
def stability_summary(spark, d):
    return K.stability_summary(_repeats(spark, d), 2)


_STK = f"{OB}, st AS (SELECT split, 'part' AS field, CAST(part AS VARCHAR) AS value FROM ob UNION ALL SELECT split, 'id', CAST(id AS VARCHAR) FROM ob)"


@query(f"WITH {_STK}, p AS (SELECT field, value, count(*) FILTER (split = 'fit') AS f, count(*) FILTER (split <> 'fit') AS v FROM st GROUP BY ALL) SELECT field, count(*) FILTER (f > 0) AS fit_values, count(*) FILTER (f = 1) AS singletons, CAST(sum(v) AS BIGINT) AS validation_rows, CAST(sum(CASE WHEN f > 0 THEN v ELSE 0 END) AS BIGINT) AS known_rows FROM p GROUP BY field")
def cross_coverage(spark, d):
    return K.cross_coverage(observations(spark, d), F.col("split") == "fit", ["part", "id"])


@query(f"""WITH {OB}, st AS (SELECT target_id, 'flag' AS field, flag AS value FROM ob UNION ALL SELECT target_id, 'part', coalesce(CAST(CASE WHEN part % 7 <> 2 THEN part END AS VARCHAR), 'unknown') FROM ob), v AS (SELECT field, value, count(*) AS n FROM st GROUP BY ALL),
m AS (SELECT field, count(*) FILTER (k > 1) AS mixed_contexts FROM (SELECT field, target_id, count(DISTINCT value) AS k FROM st GROUP BY ALL) GROUP BY field)
SELECT field, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN value <> 'unknown' THEN n ELSE 0 END) AS BIGINT) AS known, count(*) FILTER (n >= 10) AS categories, mixed_contexts FROM v JOIN m USING (field) GROUP BY field, mixed_contexts""")
def field_profile(spark, d):
    o = observations(spark, d).withColumn("part", F.when(F.col("part") % 7 != 2, F.col("part")))
    return K.field_profile(o, "target_id", ["flag", "part"])


@query(f"""WITH {OB}, r AS (SELECT *, rank() OVER (PARTITION BY target_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY target_id, score) - 1) / 2 AS r FROM ob),
p AS (SELECT a.target_id, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END AS w, b.grade AS low FROM ob a JOIN ob b ON a.target_id = b.target_id AND a.grade > b.grade), pt AS (SELECT target_id, avg(w) AS a, avg(CASE WHEN low > 0 THEN w END) AS p FROM p GROUP BY 1),
g AS (SELECT target_id, score, count(*) AS m, sum(grade) AS g FROM ob GROUP BY ALL), b AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY target_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
k AS (SELECT target_id, k, sum(g * least(greatest(k - before, 0), m) / m) / sum(least(greatest(k - before, 0), m)) AS v FROM b, (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL), z AS (SELECT count(*) AS c, count(*) FILTER (grade > 0) AS p FROM ob GROUP BY target_id)
SELECT 'mean_rank' AS measure, CAST(grade AS VARCHAR) AS key, count(*) AS n, round(avg(r), 6) AS value FROM r GROUP BY grade UNION ALL SELECT 'ordered_pairs', '', count(a), round(avg(a), 6) FROM pt UNION ALL SELECT 'positive_pairs', '', count(p), round(avg(p), 6) FROM pt
UNION ALL SELECT 'grade_at', CAST(k AS VARCHAR), count(*), round(avg(v), 6) FROM k GROUP BY k UNION ALL SELECT 'positives', CAST(p AS VARCHAR), count(*), NULL FROM z GROUP BY p UNION ALL SELECT 'candidates', CAST(c AS VARCHAR), count(*), NULL FROM z GROUP BY c""")
def graded_report(spark, d):
    return G.graded_report(observations(spark, d))


@query()
def tuned_pairwise(spark, d):
    """The penalty of a pairwise model chosen on later orders, with the losses; tested against a fit in plain NumPy."""
    o = observations(spark, d).withColumns({"f1": F.col("score") / 50.0, "f2": (F.col("flag") == "A").cast("double"), "f3": (F.col("status") == "O").cast("double")})
    when = table(spark, d, "orders").select(F.col("o_orderkey").alias("target_id"), F.unix_timestamp("o_orderdate").alias("cutoff_ts"))
    targets = when.withColumn("answer_ids", F.array("target_id"))
    materials = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("target_id")).agg((F.max(F.unix_timestamp("l_shipdate")) - 90 * 86400).alias("end_ts"), F.collect_set("l_partkey").alias("message_ids"))
    weights, trials = G.tuned_pairwise(targets, materials, o, ["f1", "f2", "f3"])
    return spark.createDataFrame([("weight", k, round(v, 6)) for k, v in sorted(weights.items())] + [("loss", str(c), round(x, 6)) for c, x in trials], "kind string, name string, value double")


@query()
def pairwise_lr(spark, d):
    """Coefficients of three features learned from preference pairs; tested for direction on planted preferences."""
    o = observations(spark, d).withColumn("f1", F.col("score") / 50.0).withColumn("f2", (F.col("flag") == "A").cast("double")).withColumn("f3", (F.col("status") == "O").cast("double"))
    model = K.pairwise_lr(K.pair_differences(o, ["f1", "f2", "f3"]), ["f1", "f2", "f3"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(model.items())], "feature string, weight double")
