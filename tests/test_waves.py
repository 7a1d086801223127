"""Dispatch waves: right for chains and cycles, and each turn moves only what the turn before found."""

from pyspark.sql import functions as F

from lodestone.operators import schedule as SC

KIND = "run_id string, node_key string, depends_on array<string>, service string, priority int"


def moved(spark):
    """Rows written to shuffles so far."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_turns_move_only_what_is_left(spark):
    n, k = 20_000, F.col("id")
    node, before = k.cast("string"), (k - 1).cast("string")
    tasks = spark.range(n).select(F.lit("r").alias("run_id"), node.alias("node_key"), F.when(k % 100 < 6, F.when(k % 100 > 0, F.array(before)).otherwise(F.array().cast("array<string>"))).otherwise(F.array(F.lit("none"))).alias("depends_on"), F.lit("x").alias("service"), k.cast("int").alias("priority"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        start = moved(spark)
        got = {r.depth: r["count"] for r in SC.dispatch_waves(tasks, {"x": 3}).groupBy("depth").count().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {0: n - 5 * n // 100, **{d: n // 100 for d in range(1, 6)}}
    assert moved(spark) - start < 7 * n  # 13.5 times as many before


def test_cycles_chains_and_repeats(spark):
    rows = [("r", "a", [], "x", 1), ("r", "b", ["a", "gone"], "x", 2), ("r", "c", ["b", "b"], "y", 1), ("r", "p", ["q"], "x", 1), ("r", "q", ["p"], "x", 1), ("r", "z", ["q", "a"], "x", 1), ("s", "a", ["b"], "x", 1), ("s", "b", None, "x", 1)]
    got = {(r.run_id, r.node_key): (r.depth, r.wave) for r in SC.dispatch_waves(spark.createDataFrame(rows, KIND), {"x": 1, "y": 2}).collect()}
    assert got == {("r", "a"): (0, 1), ("r", "b"): (1, 1), ("r", "c"): (2, 1), ("s", "b"): (0, 1), ("s", "a"): (1, 1)}
    assert SC.dispatch_waves(spark.createDataFrame(rows[3:5], KIND), {"x": 1}).count() == 0
