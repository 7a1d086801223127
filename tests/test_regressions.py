"""Regressions of queries whose names recur: each row is held against its own baseline."""

from lodestone.operators import bench as B


def test_names_that_recur(spark):
    cur = spark.createDataFrame([("q10", k, 0.0, 1.0, 1.0, True) for k in (10, 100, 101)], "query_id string, k long, recall double, cost double, binding_rate double, contradiction_fired boolean")
    old = spark.createDataFrame([("q10", k, 0.45, 1.0, True) for k in (10, 100)], "query_id string, k long, recall double, cost double, contradiction_fired boolean")
    got = B.regressions(cur, old, keys=("query_id", "k")).collect()
    assert sorted(map(tuple, got)) == [("q10", "recall_drop")] * 2


def test_query_at_a_thousand_suppliers(spark):
    import duckdb

    from lodestone import plans

    sf = "/root/testdata/sf0.1"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW supplier AS SELECT * FROM '{sf}/supplier.parquet'")
    want = c.sql(plans.oracle_sql()["regressions"]).fetchall()
    assert sorted(tuple(r) for r in plans.queries()["regressions"](spark, sf).collect()) == sorted(want)
