"""Queries: inventories, names and addresses; a customer is a person, its orders the evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatspark.operators import knowledge as N
from chatspark.plans.registry import query
from chatspark.plans.tables import MSG, messages, table


@query(f"WITH {MSG}, r AS (SELECT chat_id % 20 AS sender, kind AS name, is_self, ts, chat_id, message_id, row_number() OVER (PARTITION BY chat_id % 20, kind ORDER BY ts, message_id) AS k FROM msg) SELECT sender, name, count(*) AS n, CAST(sum(CAST(is_self AS BIGINT)) AS BIGINT) AS own, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT chat_id) AS chats, string_agg(CAST(message_id AS VARCHAR), ',' ORDER BY ts, message_id) FILTER (k <= 2) AS evidence FROM r GROUP BY sender, name")
def identity_inventory(spark, d):
    m = messages(spark, d).withColumn("sender", F.col("chat_id") % 20).withColumnRenamed("kind", "name")
    return N.identity_inventory(m).withColumn("evidence", F.array_join("evidence", ","))


@query(f"WITH {MSG} SELECT chat_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS participants FROM msg WHERE chat_type = 'group' GROUP BY chat_id")
def group_inventory(spark, d):
    return N.group_inventory(messages(spark, d).withColumnRenamed("kind", "sender")).withColumn("participants", F.array_join("participants", ","))


_CL = "cl AS (SELECT 'a' || (o_custkey % 300) AS alias, 'o' || (o_orderkey % 500) AS owner, 'i' || (o_orderkey % 1000) AS identity, o_orderpriority AS source FROM orders)"


def _claims(spark, d):
    tag = lambda p, e: F.concat(F.lit(p), e.cast("string"))
    return table(spark, d, "orders").select(tag("a", F.col("o_custkey") % 300).alias("alias"), tag("o", F.col("o_orderkey") % 500).alias("owner"), tag("i", F.col("o_orderkey") % 1000).alias("identity"), F.col("o_orderpriority").alias("source"))


@query(f"WITH {_CL} SELECT 'alias_with_owners' AS kind, alias AS name, count(DISTINCT owner) AS n FROM cl GROUP BY alias HAVING n > 1 UNION ALL SELECT 'name_with_identities', owner, count(DISTINCT identity) FROM cl GROUP BY owner HAVING count(DISTINCT identity) > 1")
def alias_conflicts(spark, d):
    return N.alias_conflicts(_claims(spark, d))


@query("WITH u AS (SELECT o_custkey % 50 AS source, o_custkey % 7 AS target, o_orderpriority AS alias, o_orderstatus AS usage, o_custkey % 3 AS chat_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderkey AS message_id FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY source, target, alias, chat_id, usage ORDER BY ts, message_id) AS k FROM u) SELECT source, target, alias, chat_id, usage, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, string_agg(CAST(message_id AS VARCHAR), ',' ORDER BY ts, message_id) FILTER (k <= 3) AS evidence FROM r GROUP BY ALL")
def address_records(spark, d):
    k = F.col("o_custkey")
    u = table(spark, d, "orders").select((k % 50).alias("source"), (k % 7).alias("target"), F.col("o_orderpriority").alias("alias"), F.col("o_orderstatus").alias("usage"), (k % 3).alias("chat_id"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("o_orderkey").alias("message_id"))
    return N.address_records(u).withColumn("evidence", F.array_join("evidence", ","))


@query("WITH r AS (SELECT ' E' || (o_custkey % 200) || ' ' AS entity, CASE WHEN o_custkey % 200 < 190 THEN 'person' ELSE o_orderstatus END AS type, [o_orderpriority, o_orderstatus] AS labels, o_orderkey % 9 AS material FROM orders), k AS (SELECT *, substr(sha256(lower(trim(entity))), 1, 24) AS entity_id FROM r), l AS (SELECT entity_id, array_to_string(list_sort(list(DISTINCT x)), ',') AS labels FROM (SELECT entity_id, unnest(labels) AS x FROM k) GROUP BY 1) SELECT entity_id, min(type) AS type, l.labels AS labels, array_to_string(list_sort(list(DISTINCT material)), ',') AS origins, count(DISTINCT type) > 1 AS conflict FROM k JOIN l USING (entity_id) GROUP BY entity_id, l.labels")
def knowledge_compose(spark, d):
    o = table(spark, d, "orders")
    r = o.select(
        F.concat(F.lit(" E"), (F.col("o_custkey") % 200).cast("string"), F.lit(" ")).alias("entity"), F.when(F.col("o_custkey") % 200 < 190, "person").otherwise(F.col("o_orderstatus")).alias("type"),
        F.array("o_orderpriority", "o_orderstatus").alias("labels"), F.array("o_orderkey").alias("evidence"), (F.col("o_orderkey") % 9).alias("material"),
    )
    merged, bad = N.knowledge_compose(r)
    out = merged.join(bad.select("entity_id", F.lit(True).alias("conflict")), "entity_id", "left").na.fill(False, ["conflict"])
    return out.select("entity_id", "type", F.array_join("labels", ",").alias("labels"), F.array_join("origins", ",").alias("origins"), "conflict")


@query("SELECT o_custkey AS subject, o_orderpriority AS field, count(*) AS n, array_to_string(list_sort(list(o_orderkey)), ',') AS evidence FROM orders GROUP BY ALL HAVING count(*) > 1")
def attribute_groups(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("field"), F.array("o_orderkey").alias("evidence"))
    return N.attribute_groups(r).withColumn("evidence", F.array_join("evidence", ","))


@query("WITH c AS (SELECT lower(trim('  O' || (o_custkey % 40) || '  X')) AS o, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'o' || (o_custkey % 40) || ' x' ELSE 'a' || (o_orderkey % 30) || CASE WHEN o_orderkey % 4 = 0 THEN '?' ELSE '' END END AS a, o_orderstatus AS s FROM orders), n AS (SELECT regexp_replace(o, '\\s+', ' ', 'g') AS owner, a AS alias, s FROM c) SELECT owner, alias, count(*) AS n, CASE WHEN contains(alias, '?') THEN 'uncertain' ELSE '' END AS flags, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM n WHERE alias <> '' AND alias <> owner GROUP BY owner, alias")
def alias_refine(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 40).cast("string")
    alias = F.when(k % 11 == 0, "  ").when(k % 13 == 0, F.concat(F.lit("O"), c, F.lit(" x"))).otherwise(F.concat(F.lit("A"), (k % 30).cast("string"), F.when(k % 4 == 0, "?").otherwise("")))
    claims = o.select(F.concat(F.lit("  O"), c, F.lit("  X")).alias("owner"), alias.alias("alias"), F.col("o_orderstatus").alias("source"))
    return N.alias_refine(claims).withColumn("flags", F.array_join("flags", ",")).withColumn("sources", F.array_join("sources", ","))


@query("WITH m AS (SELECT DISTINCT o_custkey AS chat_id, o_orderstatus AS sender FROM orders), two AS (SELECT chat_id, min(sender) AS a, max(sender) AS b FROM m GROUP BY 1 HAVING count(*) = 2), v AS (SELECT o_custkey AS chat_id, o_orderstatus AS sender, o_orderpriority AS alias FROM orders) SELECT CASE WHEN sender = a THEN b ELSE a END AS target, alias, count(*) AS n, CASE WHEN count(*) >= 2 THEN 'kept' ELSE 'weak' END AS strength FROM v JOIN two USING (chat_id) GROUP BY ALL")
def vocative_claims(spark, d):
    o = table(spark, d, "orders")
    members = o.select(F.col("o_custkey").alias("chat_id"), F.col("o_orderstatus").alias("sender")).distinct()
    return N.vocative_claims(o.select(F.col("o_custkey").alias("chat_id"), F.col("o_orderstatus").alias("sender"), F.col("o_orderpriority").alias("alias")), members)


@query("WITH nm AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS name, p_size % 3 AS identity FROM part UNION SELECT 'the', 1 UNION SELECT 'der', 2 UNION SELECT 'para', 3 UNION SELECT 'dans', 4 UNION SELECT 'dans', 5), o AS (SELECT name, count(DISTINCT identity) AS identities FROM nm GROUP BY name) SELECT conv_id * 1000 + turn AS message_id, name, identities FROM conversations JOIN o ON regexp_matches(text, '(^|[^0-9A-Za-z_])' || name || '($|[^0-9A-Za-z_])')")
def mention_scan(spark, d):
    own = spark.createDataFrame([("the", 1), ("der", 2), ("para", 3), ("dans", 4), ("dans", 5)], "name string, identity int")
    names = table(spark, d, "part").select(F.lower(F.split("p_name", " ")[0]).alias("name"), (F.col("p_size") % 3).cast("int").alias("identity")).distinct().unionByName(own)
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")
    return N.mention_scan(c, names)


@query("WITH c AS (SELECT l_orderkey AS target_id, l_linestatus = 'O' AS object_match, l_returnflag AS reason FROM lineitem) SELECT 'candidates_per_target' AS measure, CAST(k AS VARCHAR) AS value, count(*) AS n FROM (SELECT count(*) AS k FROM c GROUP BY target_id) GROUP BY k UNION ALL SELECT 'object_match', CAST(object_match AS VARCHAR), count(*) FROM c GROUP BY object_match UNION ALL SELECT 'reason', reason, count(*) FROM c GROUP BY reason")
def inventory_summary(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target_id"), (F.col("l_linestatus") == "O").alias("object_match"), F.col("l_returnflag").alias("reason"))
    return N.inventory_summary(c)


@query(f"WITH {MSG} SELECT count(*) AS total, CAST(sum(CAST(chat_type = 'group' AS BIGINT)) AS BIGINT) AS group_rows, count(*) = 10000 AS total_ok, sum(CAST(chat_type = 'group' AS BIGINT)) = 7500 AS group_ok, count(*) >= 5000 AS pool_ok FROM msg")
def composition_check(spark, d):
    return N.composition_check(messages(spark, d), 10000, 7500, 5000)
