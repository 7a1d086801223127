"""Profiles of repositories: no task's share of the claims grows with the table."""

from pyspark.sql import functions as F

from lodestone.operators import evidence as E
from lodestone.plans import tasks


def test_claims_are_moved_once_and_joined_with_nothing(spark):
    plan = tasks.oss_profiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1, plan


def test_parts_stay_of_one_size(spark):
    def most(n):
        k = F.col("id")
        repos = spark.range(n).select(k.alias("source_id"), F.concat(F.lit("o/r"), k.cast("string")).alias("repo"), k.alias("stars"), F.lit("MIT").alias("license"), F.lit(None).cast("date").alias("last_commit"), F.lit(None).cast("double").alias("velocity"))
        rows = E.oss_sourced(repos, each=500).withColumn("run_id", F.lit("r")).withColumn("as_of", F.lit(None).cast("date")).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz"))
        none = spark.createDataFrame([], "run_id string, source_id long, attribute string, char_start int")
        out = E.persist_structured(none, rows, F.lit("A"), F.lit("2024-01-02").cast("timestamp_ntz"))
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[1] == 3 * n
        return sizes[0]

    assert most(20_000) < 1.5 * most(4_000)
