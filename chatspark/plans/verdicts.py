"""Queries: experiment records, the measurement bank, noise and latency, over `orders` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.operators import bank as B
from chatspark.operators import timing as T
from chatspark.operators import verdicts as V
from chatspark.plans.registry import query
from chatspark.plans.tables import table

#: CTEs rec (final record of each case), journal (with repeats), cases
REC = """rec AS (SELECT 'e' || (o_custkey % 8) AS source_exp, 'c' || (o_orderkey % 2000) AS case_id, o_orderkey AS line_no, CASE WHEN o_orderpriority < '3' THEN 'private' ELSE 'group' END AS chat_type,
  CASE WHEN o_orderkey % 53 = 7 THEN 'failed' ELSE 'ok' END AS status, CAST(floor(o_totalprice) AS BIGINT) % 2 = 0 AS identified_baseline, CAST(floor(o_totalprice) AS BIGINT) % 3 = 0 AS identified_candidate,
  [CAST(floor(o_totalprice) AS BIGINT) % 2 = 0, o_custkey % 3 = 0, o_custkey % 5 < 2] AS baseline_votes, [CAST(floor(o_totalprice) AS BIGINT) % 3 = 0, o_custkey % 7 < 3, o_custkey % 4 = 0] AS candidate_votes FROM orders),
fin AS (SELECT *, n - 1 AS retries FROM (SELECT *, row_number() OVER (PARTITION BY source_exp, case_id ORDER BY line_no DESC) AS r, count(*) OVER (PARTITION BY source_exp, case_id) AS n FROM rec) WHERE r = 1),
mv AS (SELECT *, list_sum(list_transform(baseline_votes, lambda x: CAST(x AS INT))) * 2 > 3 AS fb, list_sum(list_transform(candidate_votes, lambda x: CAST(x AS INT))) * 2 > 3 AS fc, identified_baseline <> identified_candidate AS verified FROM fin)"""


def journal(spark, d):
    """Orders as journal rows: eight experiments, two thousand cases, later rows of a case replace earlier ones."""
    o = table(spark, d, "orders")
    price = F.floor("o_totalprice")
    b, c = price % 2 == 0, price % 3 == 0
    k = F.col("o_custkey")
    return o.select(
        F.concat(F.lit("e"), (k % 8).cast("string")).alias("source_exp"), F.concat(F.lit("c"), (F.col("o_orderkey") % 2000).cast("string")).alias("case_id"), F.col("o_orderkey").alias("line_no"),
        F.when(F.col("o_orderpriority") < "3", "private").otherwise("group").alias("chat_type"), F.when(F.col("o_orderkey") % 53 == 7, "failed").otherwise("ok").alias("status"),
        b.alias("identified_baseline"), c.alias("identified_candidate"), F.array(b, k % 3 == 0, k % 5 < 2).alias("baseline_votes"), F.array(c, k % 7 < 3, k % 4 == 0).alias("candidate_votes"),
    )


def finals(spark, d):
    return V.final_records(journal(spark, d), ["source_exp", "case_id"])


def verified(spark, d):
    """Final records with votes only where the two sides differ."""
    differs = F.col("identified_baseline") != F.col("identified_candidate")
    r = finals(spark, d)
    return r.withColumn("baseline_votes", F.when(differs, F.col("baseline_votes"))).withColumn("candidate_votes", F.when(differs, F.col("candidate_votes")))


@query(f"WITH {REC} SELECT source_exp, case_id, line_no, retries, status FROM fin")
def final_records(spark, d):
    return finals(spark, d).select("source_exp", "case_id", "line_no", "retries", "status")


@query(f"WITH {REC} SELECT source_exp, case_id, fb AS baseline_final, fc AS candidate_final FROM mv")
def majority_vote(spark, d):
    return finals(spark, d).select("source_exp", "case_id", V.majority("baseline_votes").alias("baseline_final"), V.majority("candidate_votes").alias("candidate_final"))


_AB = f"""{REC}, s AS (SELECT source_exp, count(*) AS attempted, count(*) FILTER (status = 'failed') AS failures, CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (status <> 'failed') AS pairs,
  count(*) FILTER (status <> 'failed' AND identified_baseline) AS ib, count(*) FILTER (status <> 'failed' AND identified_candidate) AS ic, count(*) FILTER (status <> 'failed' AND chat_type = 'group') AS g,
  count(*) FILTER (status <> 'failed' AND chat_type = 'group' AND identified_baseline) AS gb, count(*) FILTER (status <> 'failed' AND chat_type = 'group' AND identified_candidate) AS gc,
  count(*) FILTER (status <> 'failed' AND identified_baseline AND NOT identified_candidate) AS wins, count(*) FILTER (status <> 'failed' AND identified_candidate AND NOT identified_baseline) AS losses,
  count(*) FILTER (status <> 'failed' AND verified AND fb AND NOT fc) AS wc, count(*) FILTER (status <> 'failed' AND verified AND fc AND NOT fb) AS lc, count(*) FILTER (status <> 'failed' AND verified AND fb = fc) AS contested FROM mv GROUP BY source_exp),
ab AS (SELECT source_exp, attempted, failures, retries, round(failures / attempted, 4) AS failure_rate, pairs, ib AS identified_baseline, ic AS identified_candidate, round(ib / pairs, 4) AS rate_baseline, round(ic / pairs, 4) AS rate_candidate,
  round(gb / CASE WHEN g > 0 THEN g ELSE pairs END, 4) AS rate_baseline_group, round(gc / CASE WHEN g > 0 THEN g ELSE pairs END, 4) AS rate_candidate_group, wins, losses, pairs - wins - losses AS ties, wins - losses AS net_win_raw,
  wc AS wins_confirmed, lc AS losses_confirmed, contested, wc - lc AS net_win_confirmed FROM s)"""


@query(f"WITH {_AB} SELECT * FROM ab")
def ab_metrics(spark, d):
    return V.ab_metrics(verified(spark, d), ["source_exp"])


@query(f"WITH {_AB} SELECT source_exp, CASE WHEN failure_rate >= 0.03 THEN 'experiment_incomplete' WHEN net_win_confirmed >= greatest(1, ceil(0.011 * pairs)) THEN 'merge_to_iteration_baseline' WHEN net_win_confirmed < 0 THEN 'reject' ELSE 'observe' END AS development, CASE WHEN failure_rate >= 0.03 THEN 'experiment_incomplete' WHEN identified_candidate < identified_baseline AND net_win_confirmed >= greatest(1, ceil(0.011 * pairs)) THEN 'adopt' ELSE 'reject' END AS fixed_test FROM ab")
def decide(spark, d):
    m = V.ab_metrics(verified(spark, d), ["source_exp"])
    dev = V.decide(m, "development", 0.011, 0.03).withColumnRenamed("verdict", "development")
    return V.decide(dev, "fixed_test", 0.011, 0.03).select("source_exp", "development", F.col("verdict").alias("fixed_test"))


@query()
def sign_test(spark, d):
    """Exact p values of the confirmed wins and losses of each experiment; tested against binomial sums."""
    m = V.ab_metrics(verified(spark, d), ["source_exp"])
    return m.select("source_exp", "wins_confirmed", "losses_confirmed", F.round(V.sign_test("wins_confirmed", "losses_confirmed"), 9).alias("sign_p"))


@query(f"""WITH {REC}, ex AS (SELECT DISTINCT source_exp, case_id, 1 AS expected FROM rec), j AS (SELECT coalesce(ex.source_exp, mv.source_exp) AS source_exp, expected, mv.case_id AS seen, mv.* EXCLUDE (source_exp, case_id), coalesce(status = 'ok' AND verified, false) AS v, o.fb2, o.fc2
  FROM ex FULL JOIN (SELECT * FROM mv WHERE line_no % 101 <> 0) mv USING (source_exp, case_id) LEFT JOIN (SELECT line_no, CASE WHEN line_no % 17 = 0 THEN NOT fb ELSE fb END AS fb2, fc AS fc2 FROM mv) o USING (line_no))
SELECT source_exp, count(*) FILTER (seen IS NULL) AS missing, count(*) FILTER (expected IS NULL) AS unexpected, count(*) FILTER (status = 'failed') > count(expected) * 0.05 AS too_many_failures, CAST(0 AS BIGINT) AS vote_count_errors, CAST(0 AS BIGINT) AS first_vote_errors,
  count(*) FILTER (v AND (fb <> fb2 OR fc <> fc2)) AS majority_errors, count(*) FILTER (v AND fb AND NOT fc) AS wins, count(*) FILTER (v AND fc AND NOT fb) AS losses FROM j GROUP BY source_exp""")
def confirmed_metrics(spark, d):
    """Some cases have no row, some a stored majority that their votes don't bear out."""
    r = verified(spark, d)
    fb = V.majority("baseline_votes")
    rows = r.filter("line_no % 101 != 0").withColumn("baseline_final", F.when(F.col("line_no") % 17 == 0, ~fb).otherwise(fb)).withColumn("candidate_final", V.majority("candidate_votes"))
    return V.confirmed_metrics(rows.drop("retries"), journal(spark, d).select("source_exp", "case_id").distinct(), 2, 0.05, ["source_exp"])


_COH = f"""{REC}, cs AS (SELECT 'c' || i AS case_id, CASE WHEN i % 3 = 0 THEN 'familiar' ELSE 'observed_first' END AS familiarity, CASE WHEN i % 4 = 0 THEN 'private' ELSE 'group' END AS chat_type FROM (SELECT DISTINCT o_orderkey % 2000 AS i FROM orders)),
one AS (SELECT * FROM mv WHERE source_exp = 'e0'), j AS (SELECT cs.*, status, identified_baseline AS ib, identified_candidate AS ic FROM cs LEFT JOIN one USING (case_id))"""


def _cases(spark, d):
    i = table(spark, d, "orders").select((F.col("o_orderkey") % 2000).alias("i")).distinct()
    return i.select(F.concat(F.lit("c"), F.col("i").cast("string")).alias("case_id"), F.when(F.col("i") % 3 == 0, "familiar").otherwise("observed_first").alias("familiarity"), F.when(F.col("i") % 4 == 0, "private").otherwise("group").alias("chat_type"))


@query(f"WITH {_COH} SELECT familiarity, chat_type, count(*) AS attempted, count(*) FILTER (status <> 'failed') AS pairs, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status <> 'failed' AND ib) AS identified_baseline, count(*) FILTER (status <> 'failed' AND ic) AS identified_candidate FROM j GROUP BY familiarity, chat_type")
def cohort_metrics(spark, d):
    return V.cohort_metrics(_cases(spark, d), finals(spark, d).filter("source_exp = 'e0'"))


@query(f"WITH {_COH} SELECT coalesce(chat_type, 'all') AS cohort, count(*) AS expected, count(*) FILTER (status IS NULL) AS missing, count(*) FILTER (status <> 'failed') AS measured, round(count(*) FILTER (status <> 'failed') / count(*), 6) AS coverage, count(*) FILTER (status <> 'failed' AND ib) AS identified_baseline, count(*) FILTER (status <> 'failed' AND ic) AS identified_candidate FROM j GROUP BY GROUPING SETS ((), (chat_type))")
def quality_cohorts(spark, d):
    return V.quality_cohorts(_cases(spark, d), finals(spark, d).filter("source_exp = 'e0'"))


@query(f"WITH {REC} SELECT count(*) AS pairs, count(*) FILTER (identified_baseline) AS human_flagged, count(*) FILTER (identified_candidate) AS generated_flagged, count(*) FILTER (identified_baseline AND identified_candidate) AS both_flagged, count(*) FILTER (verified) AS triggered, count(*) FILTER (fb) AS base_correct, count(*) FILTER (fc) AS corrected_correct, count(*) FILTER (NOT fb AND fc) AS helped, count(*) FILTER (fb AND NOT fc) AS harmed FROM mv")
def correction_report(spark, d):
    r = finals(spark, d)
    return V.correction_report(r.select(F.col("identified_baseline").alias("human_flagged"), F.col("identified_candidate").alias("generated_flagged"), V.majority("baseline_votes").alias("base_correct"), V.majority("candidate_votes").alias("corrected_correct")))


@query(f"WITH {REC} SELECT source_exp, count(*) AS n, CASE WHEN count(*) >= 30 AND stddev_pop(CAST(fb AS INT)) > 0 AND stddev_pop(CAST(fc AS INT)) > 0 THEN round(corr(CAST(fb AS INT), CAST(fc AS INT)), 6) END AS phi, round(avg(CAST(fb = fc AS INT)), 6) AS agreement FROM mv GROUP BY source_exp")
def noise_phi(spark, d):
    return V.noise_phi(_with_finals(spark, d))


def _with_finals(spark, d):
    return finals(spark, d).withColumn("baseline_final", V.majority("baseline_votes")).withColumn("candidate_final", V.majority("candidate_votes"))


@query(f"""WITH {REC}, p AS (SELECT *, 'p' || (CAST(substr(source_exp, 2) AS INT) % 3) AS pair_fp FROM mv), w AS (SELECT pair_fp, source_exp, avg(CAST(fb AS INT) - CAST(fc AS INT)) AS net FROM p GROUP BY ALL),
x AS (SELECT a.pair_fp, a.source_exp AS x, b.source_exp AS y, avg(CAST(a.fb AS INT) - CAST(b.fc AS INT)) AS net FROM p a JOIN p b ON a.pair_fp = b.pair_fp AND a.case_id = b.case_id AND a.source_exp <> b.source_exp GROUP BY ALL)
SELECT * FROM (SELECT pair_fp, count(*) AS n_within, round(var_samp(net), 9) AS var_within FROM w GROUP BY pair_fp) LEFT JOIN (SELECT pair_fp, count(*) AS n_repaired, round(var_samp(net), 9) AS var_repaired FROM x GROUP BY pair_fp) USING (pair_fp)""")
def noise_inflation(spark, d):
    r = _with_finals(spark, d).withColumn("pair_fp", F.concat(F.lit("p"), (F.substring("source_exp", 2, 9).cast("int") % 3).cast("string")))
    return V.noise_inflation(r)


def records_for_bank(spark, d):
    r = finals(spark, d).withColumnRenamed("line_no", "source_line").drop("retries", "chat_type")
    odd = F.col("source_line") % 31 == 0
    side = lambda s: F.sha2(F.concat(F.lit(f"{s}:"), F.col("source_exp")), 256)
    r = r.withColumn("case_id", F.when(F.col("source_line") % 97 == 0, "").otherwise(F.col("case_id"))).withColumn("baseline_votes", F.when(odd, F.transform("baseline_votes", lambda v: ~v)).otherwise(F.col("baseline_votes")))
    return r.select("*", side("b").alias("baseline_fp"), side("c").alias("candidate_fp"), F.lit("j").alias("judge_fp"), F.col("source_line").alias("created_at"))


_BANK = f"""{REC}, r AS (SELECT source_exp, CASE WHEN line_no % 97 = 0 THEN '' ELSE case_id END AS case_id, line_no AS source_line, status, identified_baseline, identified_candidate, CASE WHEN line_no % 31 = 0 THEN list_transform(baseline_votes, lambda v: NOT v) ELSE baseline_votes END AS baseline_votes, candidate_votes,
  sha256('b:' || source_exp) AS bfp, sha256('c:' || source_exp) AS cfp FROM fin),
sides AS (SELECT source_exp, case_id, source_line, 'baseline' AS side, bfp AS side_fp, least(bfp, cfp) || '|' || greatest(bfp, cfp) || '|j' AS pk, identified_baseline AS initial, baseline_votes AS votes FROM r WHERE status = 'ok' AND case_id <> ''
  UNION ALL SELECT source_exp, case_id, source_line, 'candidate', cfp, least(bfp, cfp) || '|' || greatest(bfp, cfp) || '|j', identified_candidate, candidate_votes FROM r WHERE status = 'ok' AND case_id <> ''),
bank AS (SELECT source_exp, source_line, case_id, side, side_fp, sha256(pk) AS pair_fp, CAST(round_no AS INTEGER) AS round_no, CASE WHEN round_no = 0 THEN 'initial' ELSE 'verify' END AS round_kind, CAST(CASE WHEN round_no = 0 THEN initial ELSE votes[round_no + 1] END AS INTEGER) AS verdict
  FROM sides, (SELECT unnest(range(0, 3)) AS round_no) WHERE round_no = 0 OR votes[1] = initial)"""


@query(f"WITH {_BANK} SELECT source_exp, source_line, case_id, side, side_fp, pair_fp, round_kind, round_no, verdict FROM bank")
def bank_explode(spark, d):
    return B.bank_explode(records_for_bank(spark, d)).select("source_exp", "source_line", "case_id", "side", "side_fp", "pair_fp", "round_kind", "round_no", "verdict")


@query(f"WITH {_BANK} SELECT source_exp, count(*) AS pairs, count(*) FILTER (verdict <> p) AS flips FROM (SELECT *, lag(verdict) OVER (PARTITION BY source_exp, case_id, side ORDER BY round_no) AS p FROM bank WHERE round_kind = 'verify') WHERE p IS NOT NULL GROUP BY source_exp")
def noise_flip_rate(spark, d):
    return V.noise_flip_rate(B.bank_explode(records_for_bank(spark, d)))


@query(f"""WITH {_BANK} SELECT 'conflict' AS action, source_exp, source_line, side, round_no FROM bank WHERE source_line % 5 = 0 AND source_line % 7 = 0
UNION ALL SELECT 'insert', source_exp, source_line, side, round_no FROM bank WHERE source_line % 5 <> 0""")
def bank_upsert(spark, d):
    """A fifth of the measurements is banked already, a seventh of these with another verdict."""
    new = B.bank_explode(records_for_bank(spark, d))
    there = new.filter("source_line % 5 = 0").withColumn("verdict", F.when(F.col("source_line") % 7 == 0, 1 - F.col("verdict")).otherwise(F.col("verdict")))
    insert, conflicts = B.bank_upsert(there, new, ["verdict", "case_id"])
    names = new.select(*B.KEY, "side", "round_no")
    out = ["source_exp", "source_line", "side", "round_no"]
    return conflicts.join(names, B.KEY).select(F.lit("conflict").alias("action"), *out).unionByName(insert.select(F.lit("insert").alias("action"), *out))


@query(f"""WITH {_BANK} SELECT source_exp, source_line, side, round_no, CASE WHEN source_line % 11 = 0 THEN 'missing' WHEN source_line % 13 = 0 THEN 'changed' END AS state, CASE WHEN source_line % 11 <> 0 THEN 'verdict' ELSE '' END AS fields FROM bank WHERE source_line % 11 = 0 OR source_line % 13 = 0""")
def bank_audit(spark, d):
    new = B.bank_explode(records_for_bank(spark, d))
    held = new.filter("source_line % 11 != 0").withColumn("verdict", F.when(F.col("source_line") % 13 == 0, 1 - F.col("verdict")).otherwise(F.col("verdict")))
    return B.bank_audit(held, new, ["verdict", "case_id", "round_kind"]).join(new.select(*B.KEY, "side", "round_no"), B.KEY).select("source_exp", "source_line", "side", "round_no", "state", F.array_join("fields", ",").alias("fields"))


@query(f"""WITH {_BANK}, s AS (SELECT case_id, source_exp, side, max(verdict) FILTER (round_no = 0) AS initial, count(DISTINCT round_no) FILTER (round_no > 0) AS rounds, min(source_line) AS created_at, max(source_line) AS line FROM bank GROUP BY ALL),
p AS (SELECT case_id, source_exp, count(initial) AS sides, min(initial) AS lo, max(initial) AS hi, min(rounds) AS rounds, min(created_at) AS created_at, max(line) AS line FROM s GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at, source_exp) AS rr FROM p WHERE sides = 2 AND (lo = hi OR rounds >= 2)),
cs AS (SELECT DISTINCT 'c' || (o_orderkey % 2500) AS case_id FROM orders) SELECT case_id, u.source_exp AS replay_from, u.line AS replay_line FROM cs LEFT JOIN (SELECT * FROM u WHERE rr = 1) u USING (case_id)""")
def bank_plan(spark, d):
    cases = table(spark, d, "orders").select(F.concat(F.lit("c"), (F.col("o_orderkey") % 2500).cast("string")).alias("case_id")).distinct()
    return B.bank_plan(B.bank_explode(records_for_bank(spark, d)), cases, 2)


@query(f"WITH {_BANK}, p AS (SELECT case_id, count(*) AS rounds, count(DISTINCT source_exp) AS sources, bool_and(side_fp IS NOT NULL) AS complete FROM bank GROUP BY case_id) SELECT case_id, rounds, sources, complete FROM p WHERE rounds >= 6")
def bank_replay_join(spark, d):
    """Cases that some sources have in full, with what can be reused."""
    bank = B.bank_explode(records_for_bank(spark, d))
    return bank.groupBy("case_id").agg(F.count(F.lit(1)).alias("rounds"), F.count_distinct("source_exp").alias("sources"), F.bool_and(F.col("side_fp").isNotNull()).alias("complete")).filter("rounds >= 6")


@query(f"WITH {REC} SELECT source_exp, case_id, sha256(source_exp || '|' || case_id || '|b') AS side_fp, sha256(least(source_exp, case_id) || '|' || greatest(source_exp, case_id) || '|j') AS pair_fp FROM fin")
def fingerprints(spark, d):
    a, b = F.col("source_exp"), F.col("case_id")
    return finals(spark, d).select(a, b, B.fingerprint(a, b, F.lit("b")).alias("side_fp"), B.pair_fingerprint(a, b, F.lit("j")).alias("pair_fp"))


@query()
def uuid5_nonce(spark, d):
    """Deterministic nonces of the cases; tested against the standard library's uuid5."""
    r = finals(spark, d)
    return r.select("source_exp", "case_id", B.uuid5(F.concat_ws(":", "source_exp", "case_id", F.lit("0"))).alias("nonce"))


@query("""WITH r AS (SELECT 'c' || (o_custkey % 500) AS case_id, CAST(floor(o_totalprice) AS BIGINT) % 4 AS round_no, o_orderkey % 2 = 0 AS b, o_orderkey % 3 = 0 AS c FROM orders WHERE o_orderkey % 7 <> 1),
g AS (SELECT case_id, max(CAST(b AS INT)) FILTER (round_no = 0) AS b0, max(CAST(c AS INT)) FILTER (round_no = 0) AS c0, count(DISTINCT round_no) AS rounds, sum(CAST(b AS INT)) AS b, sum(CAST(c AS INT)) AS c FROM r GROUP BY case_id)
SELECT case_id, CASE WHEN b0 <> c0 AND rounds < 4 THEN 'pending' ELSE 'complete' END AS state, b0 - c0 AS initial_net, CASE WHEN coalesce(NOT (b0 <> c0 AND rounds < 4), rounds >= 4) THEN CASE WHEN b0 = c0 THEN b0 = 1 ELSE 2 * b > rounds END END AS baseline_final, CASE WHEN coalesce(NOT (b0 <> c0 AND rounds < 4), rounds >= 4) THEN CASE WHEN b0 = c0 THEN c0 = 1 ELSE 2 * c > rounds END END AS candidate_final FROM g""")
def comparison_records(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 7 != 1")
    rows = o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 500).cast("string")).alias("case_id"), (F.floor("o_totalprice") % 4).alias("round_no"), (F.col("o_orderkey") % 2 == 0).alias("baseline_hit"), (F.col("o_orderkey") % 3 == 0).alias("candidate_hit"))
    return V.comparison_records(rows, 3)


_L = "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END"


def timed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_linestatus").alias("stage"), F.col("l_orderkey").alias("case_id"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_extendedprice")).alias("elapsed_ms"))


@query(f"SELECT l_returnflag AS side, l_linestatus AS stage, count({_L}) AS measured, round(avg({_L}), 4) AS mean, round(quantile_cont({_L}, 0.5), 4) AS p50, round(quantile_disc({_L}, 0.95), 4) AS p95, count(*) - count({_L}) AS missing FROM lineitem GROUP BY ALL")
def latency_dist(spark, d):
    return T.latency_dist(timed(spark, d), ["side", "stage"], "elapsed_ms")


@query(f"SELECT side, stage, v AS value FROM (SELECT l_returnflag AS side, l_linestatus AS stage, {_L} AS v, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem WHERE {_L} IS NOT NULL WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY {_L})) WHERE r = least(n, floor(n * 0.95) + 1)")
def latency_index_pct(spark, d):
    return T.latency_index_pct(timed(spark, d), ["side", "stage"], "elapsed_ms", 0.95)


@query("""WITH e AS (SELECT l_orderkey AS case_id, l_returnflag AS side, CASE WHEN l_linenumber % 3 = 0 THEN 'cache' ELSE 'attempt' END AS kind, l_quantity AS ms FROM lineitem), c AS (SELECT case_id, side, sum(CASE WHEN kind = 'attempt' THEN 1 ELSE 0 END) AS attempts, sum(CASE WHEN kind = 'attempt' THEN ms END) AS ms FROM e GROUP BY ALL)
SELECT side, count(*) AS cases, CAST(sum(attempts) AS BIGINT) AS attempts, round(avg(attempts), 6) AS mean_attempts, round(avg(ms), 4) AS mean_elapsed_ms FROM c GROUP BY side""")
def attempt_totals(spark, d):
    """An order is a case, its lines of one return flag an operation with events."""
    item = F.struct(F.when(F.col("l_linenumber") % 3 == 0, "cache").otherwise("attempt").alias("kind"), F.col("l_quantity").alias("elapsed_ms"))
    ops = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("side")).agg(F.collect_list(item).alias("events"))
    return T.attempt_totals(ops, ["side"])


@query("WITH w AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS b, sum(l_quantity) FILTER (l_returnflag = 'N') AS c FROM lineitem GROUP BY 1) SELECT count(*) AS pairs, round(avg((1 - c / b) * 100), 4) AS mean_reduction_pct FROM w WHERE b IS NOT NULL AND c IS NOT NULL AND b > 0")
def paired_speed(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("side"), F.col("l_quantity").alias("elapsed_ms"))
    return T.paired_speed(rows, "A", "N")


#: Every order opens a window of up to some hours, every line is an event, both at a second of their day.
_START = "CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 7919 % 86400"
_WIN = f"win AS (SELECT o_orderkey AS window_id, {_START} AS start_ts, {_START} + 600 + 3600 * (o_orderkey % 5) AS end_ts FROM orders)"


def _windows(spark, d):
    k = F.col("o_orderkey")
    start = F.unix_timestamp("o_orderdate") + k * 7919 % 86400
    return table(spark, d, "orders").select(k.alias("window_id"), start.alias("start_ts"), (start + 600 + 3600 * (k % 5)).alias("end_ts"), "o_custkey")


_ASG = f"""{_WIN}, ev AS (SELECT l_orderkey * 8 + l_linenumber AS event_id, CAST(epoch(l_shipdate) AS BIGINT) + (l_orderkey * 8 + l_linenumber) * 17 % 86400 AS ts, l_linestatus AS stage, l_returnflag = 'R' AS cached, CASE WHEN l_quantity > 48 THEN 'failed' ELSE 'ok' END AS status, CAST(l_quantity AS BIGINT) * 360 AS elapsed FROM lineitem),
evd AS (SELECT event_id, min(ts) AS ts, min(stage) AS stage, bool_and(cached) AS cached, min(status) AS status, min(elapsed) AS elapsed FROM ev GROUP BY event_id), m AS (SELECT event_id, count(*) AS n, min(window_id) AS window_id FROM evd JOIN win ON ts BETWEEN start_ts AND end_ts GROUP BY event_id),
asg AS (SELECT evd.*, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN window_id END AS window_id FROM evd LEFT JOIN m USING (event_id))"""


def _assigned(spark, d):
    event = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    ev = table(spark, d, "lineitem").groupBy(event.alias("event_id")).agg(
        F.min(F.unix_timestamp("l_shipdate") + event * 17 % 86400).alias("ts"), F.min("l_linestatus").alias("stage"), F.bool_and(F.col("l_returnflag") == "R").alias("cached"),
        F.min(F.when(F.col("l_quantity") > 48, "failed").otherwise("ok")).alias("status"), F.min(F.col("l_quantity").cast("long") * 360).alias("elapsed"),
    )
    return T.window_assign(ev, _windows(spark, d).drop("o_custkey"))


@query(f"WITH {_ASG} SELECT event_id, ts, window_id, matches FROM asg")
def window_assign(spark, d):
    return _assigned(spark, d).select("event_id", "ts", "window_id", "matches")


@query(f"WITH {_ASG} SELECT window_id, stage, count(*) AS operations, sum(CAST(status = 'failed' AS BIGINT)) AS failed, sum(CAST(cached AS BIGINT)) AS cache_hits, sum(elapsed) AS elapsed, sum(CAST(ts + elapsed > end_ts AS BIGINT)) AS crossing FROM asg JOIN win USING (window_id) GROUP BY ALL")
def stage_window_agg(spark, d):
    ends = _windows(spark, d).select("window_id", F.col("end_ts").alias("window_end"))
    return T.stage_window_agg(_assigned(spark, d).filter("window_id is not null").join(ends, "window_id"))


@query(f"""WITH w AS (SELECT o_custkey % 16 AS worker, {_START} AS s, {_START} + 600 + 3600 * (o_orderkey % 5) AS e FROM orders),
n AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY worker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM w), i AS (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n),
g AS (SELECT worker, k, min(s) AS s, max(e) AS e, sum(e - s) AS total FROM i GROUP BY ALL) SELECT worker, max(e) - min(s) AS span, CAST(sum(e - s) AS BIGINT) AS active, CAST(max(e) - min(s) - sum(e - s) AS BIGINT) AS uncovered, CAST(sum(total) - sum(e - s) AS BIGINT) AS overlapping FROM g GROUP BY worker""")
def active_time(spark, d):
    return T.active_time(_windows(spark, d).withColumn("worker", F.col("o_custkey") % 16), ["worker"])


_ERR = ["HTTP 429 from upstream", "Read timed out", "SSL: unexpected EOF", "boom"]


@query("WITH e AS (SELECT lower((['HTTP 429 from upstream', 'Read timed out', 'SSL: unexpected EOF', 'boom'])[event_id % 4 + 1] || ' ' || props) AS t FROM events WHERE event_type = 'error') SELECT CASE WHEN regexp_matches(t, '429|too many requests') THEN 'http_429' WHEN regexp_matches(t, 'timed? ?out') THEN 'read_timeout' WHEN regexp_matches(t, 'ssl|tls|eof') THEN 'tls_eof' ELSE 'other' END AS category, count(*) AS n FROM e GROUP BY 1")
def failure_categories(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'")
    text = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in _ERR]), (F.col("event_id") % 4 + 1).cast("int")), "props")
    return e.select(text.alias("error")).groupBy(T.failure_category("error").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 60 = 31 THEN o_orderkey + 1 WHEN o_orderkey % 60 = 32 THEN o_orderkey - 1 ELSE o_orderkey - 1 END AS origin FROM orders WHERE o_orderkey % 120 <> 84),
f AS (SELECT id, id AS cur, 0 AS hops FROM c UNION ALL SELECT f.id, c.origin, hops + 1 FROM f JOIN c ON c.id = f.cur WHERE c.origin IS NOT NULL AND hops < 40),
l AS (SELECT id, arg_max(cur, hops) AS cur, max(hops) AS hops FROM f GROUP BY id)
SELECT l.id AS call_id, CASE WHEN c.id IS NOT NULL AND hops <= 16 THEN cur END AS root_id, CASE WHEN c.id IS NOT NULL AND hops <= 16 THEN hops END AS hops, CASE WHEN c.id IS NULL THEN 'missing' WHEN hops >= 32 THEN 'cycle' WHEN hops > 16 THEN 'too_deep' ELSE 'measured' END AS state FROM l LEFT JOIN c ON c.id = l.cur""")
def cache_lineage(spark, d):
    k = F.col("o_orderkey")
    origin = F.when(k % 12 == 0, F.lit(None)).when(k % 60 == 31, k + 1).otherwise(k - 1)
    return T.cache_lineage(table(spark, d, "orders").filter("o_orderkey % 120 != 84").select(k.alias("call_id"), origin.alias("origin_id")))


@query("SELECT l_shipdate IS NOT NULL AND l_returnflag = 'N' AS recent, l_linestatus AS layer, count(DISTINCT l_partkey) AS entries, sum(CAST(l_linenumber > 1 AS BIGINT)) AS hits, sum(CAST(l_linenumber <= 1 AS BIGINT)) AS writes FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL")
def cache_usage(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_linestatus").alias("layer"), F.col("l_partkey").alias("entry_id"), (F.col("l_linenumber") > 1).alias("hit"))
    return T.cache_usage(rows).withColumn("recent", F.lit(True))
