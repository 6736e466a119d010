import duckdb
import pytest

import __spark_entry__
from docframe.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(same, name):
    same(QUERIES[name], SQL[name])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_ann_finds_the_vectors_themselves(spark):
    rows = QUERIES["vector_ann"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["query"], r["vec_id"]) for r in rows if r["rank"] == 1 and r["score"] == 1.0} == {(k, k) for k in range(0, 500, 100)}


def test_right_join_has_unmatched_orders(spark):
    matched = QUERIES["join_nested_right"](spark, "/root/testdata/sf0.001").selectExpr("c_custkey IS NOT NULL AS m").distinct().collect()
    assert {r["m"] for r in matched} == {True, False}


def test_joins_take_every_customer(spark, duck):
    every = {k for (k,) in duck.sql("SELECT c_custkey FROM customer").fetchall()}
    for name in ("join_nested_left", "join_nested_chain"):
        assert {r["c_custkey"] for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()} == every


def test_lineage_starts_everywhere(spark, duck):
    rows = QUERIES["dag_ancestors"](spark, "/root/testdata/sf0.001").collect()
    assert {r["root"] for r in rows} == {k for (k,) in duck.sql("SELECT DISTINCT conv_id || '/' || turn FROM conversations").fetchall()}
    assert max(r["depth"] for r in rows) > 3


@pytest.mark.parametrize("name", ["scored_between", "scored_query"])
def test_scores_halfway_are_rounded_as_in_sql(spark, tmp_path, name):
    """Scores that would lie halfway between two of four digits, but for a double's last bit; and balances at or over the ends, null, NaN."""
    rows = [(4131.6, 10), (3013.2, 2), (2706.0, 14), (3415.6, 0), (4187.6, 22), (16.0, 3), (16.0, 17), (46.4, 7), (46.4, 9), (0.0, 8), (8000.0, 12), (8000.01, 10), (-0.01, 10), (None, 11), (float("nan"), 9)]
    at = str(tmp_path / "customer.parquet")
    spark.createDataFrame([(k, *r, "BUILDING") for k, r in enumerate(rows)], "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(at)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{at}/*.parquet'")
    expected = con.sql(SQL[name]).fetchall()
    assert expected and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select("c_custkey", "score").collect())) == sorted(expected)
