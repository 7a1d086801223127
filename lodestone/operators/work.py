"""Lineage cuts for iterative operators (checkpoints in the session's shared folder), global numbers."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of a local session or of the warehouse."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            given = tempfile.mkdtemp(prefix="lodestone-") if sc.master.startswith("local") and "cluster" not in sc.master else spark.conf.get("spark.sql.warehouse.dir") + "/_lodestone"
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir().rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str, each: int, rows: int | None = None) -> DataFrame:
    """df hash partitioned by the keys into parts of about `each` rows, which adaptive execution doesn't merge: what is sorted or grouped in a task by these keys (or more) stays of one size, however large the table is. Counts df first, unless its rows are given."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((df.count() if rows is None else rows) / each))
    return df.repartition(parts, *keys)


def numbered(df: DataFrame, order: list[Column], name: str, *, first: int = 1) -> DataFrame:
    """df with its global place in this order. Rows are range partitioned and numbered within partitions; only the partitions' sizes meet in one task."""
    placed = keep(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + first).cast("long")).drop("_part", "_at", "_before")


class Scratch:
    """Tables written to the shared folder and read back: they cut lineage, survive lost executors, and have sizes that the planner can trust (a checkpoint keeps the estimate of its plan, which is squared by every join of a loop). A table goes when another takes its name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if old := self.made.get(name):
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.made[name] = path
        return self.spark.read.schema(df.schema).parquet(path)
