"""Scores and choices where rows of a target share an id, as large part keys make them."""

import datetime

import duckdb
import oracle
import pytest

from chatspark.operators import ranking as K
from chatspark.plans import QUERIES, SQL

ROWS = "target_id long, id long, line int, score int, z int"


def lines(path):
    """Lines of three orders; 1:100003 and 2:3 of an order share an id."""
    when = datetime.datetime(1996, 1, 1)
    row = lambda order, line, part, supp, quantity, flag, status: (order, part, supp, line, quantity, 10.0 * part, 0.0, 0.0, flag, status, when)
    made = [row(1, 1, 100003, 4, 7.0, "A", "O"), row(1, 2, 3, 3, 7.0, "N", "F"), row(1, 3, 9, 4, 2.0, "R", "F"), row(1, 4, 9, 3, 1.0, "R", "O"), row(2, 2, 8, 3, 5.0, "A", "O"), row(2, 3, 8, 4, 6.0, "N", "O"), row(2, 1, 100008, 4, 5.0, "A", "F"), row(4, 1, 1, 3, 1.0, "N", "F"), row(4, 2, 1, 5, 2.0, "N", "F")]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", made)
    con.execute(f"COPY t TO '{path}/lineitem.parquet' (FORMAT parquet)")


def test_linear_score_keeps_rows(spark, tmp_path):
    lines(tmp_path)
    assert oracle.compare(QUERIES["linear_score"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), SQL["linear_score"]) is None


def test_linear_score_adds_equal_weights(spark):
    rows = spark.createDataFrame([(1, "x", 2), (1, "x", 3), (None, None, 2)], "id long, a string, b int")
    weights = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 0.5), ("b", "2", 4.0), ("b", "x", 9.0)], "field string, value string, weight double")
    assert sorted((r.id or 0, r.score) for r in K.linear_score(rows, weights, ["a", "b"]).collect()) == [(0, 4.0), (1, 1.5), (1, 5.5)]


def test_selection_counts_a_target_once(spark, tmp_path):
    lines(tmp_path)
    out = QUERIES["selection_vs_baseline"](spark, str(tmp_path)).first()
    assert out.targets == 3 and out.excluded + out.wins + out.losses + out.ties == 3


@pytest.mark.parametrize("ties,want", [(("line",), (1, 0)), (("z",), (0, 1))])
def test_selection_settles_ties(spark, ties, want):
    """The base's id has two rows; `ties` says which counts."""
    rows = spark.createDataFrame([(1, 5, 2, 3, 0), (1, 5, 1, 3, 1), (1, 9, 3, 8, 1), (2, 4, 1, 2, None), (2, 4, 2, 2, 0)], ROWS)
    base = spark.createDataFrame([(1, 5)], "target_id long, id long")
    out = K.selection_vs_baseline(rows, base, ties).first()
    assert out.targets == 2 and out.excluded == 1 and (out.ties, out.wins) == want


def test_topk_takes_lines_in_order(spark, tmp_path):
    """Where lines that share an id cross the cut the lower one counts, as in the SQL's relation."""
    lines(tmp_path)
    made = f"SELECT * REPLACE (o AS l_orderkey, x[1] AS l_linenumber, x[2] AS l_partkey, x[3] + o AS l_suppkey, x[4] AS l_quantity) FROM (SELECT * FROM '{tmp_path}/lineitem.parquet' LIMIT 1), range(300) t(o), (SELECT unnest([[1, 5, 0, 9], [2, 100003, 1, 4], [3, 3, 2, 8]]) AS x)"
    (tmp_path / "many").mkdir()
    duckdb.connect().execute(f"COPY (SELECT * EXCLUDE (o, x) FROM ({made}) ORDER BY l_linenumber DESC) TO '{tmp_path}/many/lineitem.parquet' (FORMAT parquet)")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # rows of a target come from several tasks
    try:
        out = QUERIES["topk_vs_baseline"](spark, f"{tmp_path}/many").first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    z = lambda o, line, supp: None if o % 13 == 5 and line == 2 else int((o + supp) % 3 == 0)
    pairs = [(z(o, 3, 2), z(o, 2, 1)) for o in range(300) if z(o, 2, 1) is not None]
    assert (out.targets, out.wins, out.losses) == (len(pairs), sum(m > b for m, b in pairs), sum(m < b for m, b in pairs))
