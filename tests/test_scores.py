"""Scores of benchmark runs from their reports and the ground truth."""

from lodestone.operators import bench as B


def test_scored(spark):
    ground = spark.createDataFrame([
        ("q1", ["a.com", "b.com"], ["x.com", "y.com"], [("a.com", "pricing.entry_usd_month", "10"), ("a.com", "pricing.model", " Seat"), ("b.com", "pricing.free_tier", "True"), ("c.com", "pricing.model", "flat"), ("a.com", "company.stage", "seed")]), ("q2", [], [], []),
    ], "query_id string, must_include array<string>, known_absent array<string>, facts array<struct<entity:string,attribute:string,value:string>>")
    runs = spark.createDataFrame([(1, "q1", 0.5), (2, "q1", 0.1), (3, "q2", 0.2), (4, "q9", 0.3), (5, "q1", 0.0)], "run_id long, query_id string, cost double")
    found = spark.createDataFrame([
        (1, "web:a.com", 10.9, "SEAT", None), (1, "web:a.com", 50.0, "flat", None), (1, "web:x.com", None, None, None), (1, "gh:b.com", 1.0, "x", True), (2, "web:a.com", 11.1, None, None), (2, "web:b.com", None, None, True), (2, "web:y.com", None, None, None), (2, "web:x.com", None, None, None), (3, "web:a.com", None, None, None),
    ], "run_id long, entity_key string, price double, model string, free_tier boolean")
    got = {r.run_id: (r.recall, r.precision, r.fact_accuracy) for r in B.scored(runs, found, ground).collect()}
    assert got == {1: (0.5, 0.5, 2 / 5), 2: (1.0, 0.0, 1 / 5), 3: (1.0, 1.0, 1.0), 4: (1.0, 1.0, 1.0), 5: (0.0, 1.0, 0.0)}
    assert B.scored(runs.limit(0), found, ground).count() == 0
