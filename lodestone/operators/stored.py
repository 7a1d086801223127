"""Tables that stay where they are: upserts that rewrite only what they touch, and retention that drops whole partitions.

A keyed table is cut into directories by a hash of its key, and within each into buckets by the key. An upsert reads only
the directories that its keys fall into (partition pruning), joins them to the new rows bucket by bucket, so that only
the new rows are shuffled, and overwrites these directories alone (dynamic partition overwrite); all others keep their
files. A dated table has a directory per day, which retention drops by name, without reading a row.

One writer a table. An upsert that fails before its commit leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"


class Keyed:
    """A table in the session's catalog: columns as given, then PART. Rows are unique by keys; null keys are keys like any other."""

    def __init__(self, spark: SparkSession, name: str, keys: list[str], *, parts: int = 256, buckets: int = 64):
        self.spark, self.name, self.keys, self.parts, self.buckets = spark, name, keys, parts, buckets

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int").alias(PART)

    def create(self, rows: DataFrame, path: str | None = None) -> None:
        """rows: unique by keys."""
        dealt = rows.select("*", self._part()).repartition(self.buckets, *self.keys)
        writer = dealt.write.format("parquet").partitionBy(PART).bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        (writer.option("path", path) if path else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def merged(self, new: DataFrame, values: Callable[[str], Column]) -> DataFrame:
        """The touched directories as they will be. values: a column's value of old and new (structs `old` and `new`; one of them may be null)."""
        touched = [r[0] for r in new.select(self._part()).distinct().collect()]  # `parts` numbers at most
        old = self.spark.table(self.name).filter(F.col(PART).isin(touched))
        columns = [c for c in old.columns if c != PART]
        left = old.select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.struct(*columns).alias("old"))
        right = new.select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.struct(*columns).alias("new"))
        both = left.join(right.hint("shuffle_merge"), [f"_{k}" for k in self.keys], "full")
        return both.select(*(F.coalesce(f"new.{k}", f"old.{k}").alias(k) if k in self.keys else values(k).alias(k) for k in columns))

    def upsert(self, new: DataFrame, values: Callable[[str], Column] | None = None) -> int:
        """new: unique by keys, which aren't null here. Rows come in, or take the place of those of their key; values says how (the new row's, if not given). How many directories were rewritten."""
        take = values or (lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")))
        after = self.merged(new, take).select("*", self._part())
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            after.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        return new.select(self._part()).distinct().count()


def keep_newest(at: str) -> Callable[[str], Column]:
    """Values for upsert: of old and new the row with the later `at`, the old one if they tie or the new one has none."""
    newer = F.col("old").isNull() | F.coalesce(F.col(f"new.{at}") > F.col(f"old.{at}"), F.col(f"old.{at}").isNull() & F.col(f"new.{at}").isNotNull())
    return lambda c: F.when(newer, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))


def sticky(columns: list[str]) -> Callable[[str], Column]:
    """Values for upsert: the new row's, but an old value of these columns stays where the new one has none."""
    return lambda c: F.coalesce(f"new.{c}", f"old.{c}") if c in columns else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))


class Dated:
    """An append-only table with a directory per day of a timestamp."""

    def __init__(self, spark: SparkSession, name: str, at: str, *, path: str | None = None):
        self.spark, self.name, self.at, self.path = spark, name, at, path

    def append(self, rows: DataFrame) -> None:
        day = rows.withColumn("day", F.date_format(F.col(self.at), "yyyy-MM-dd"))
        spread = day.repartition("day", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))  # a busy day is written by several tasks
        writer = spread.write.format("parquet").partitionBy("day").mode("append")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop("day")

    def retain(self, first_day: str) -> list[str]:
        """Drops the days before first_day (yyyy-MM-dd); their names."""
        days = [r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]  # a row per day
        gone = sorted(d for d in days if d < first_day)
        if gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP " + ", ".join(f"PARTITION (day = '{d}')" for d in gone))
        return gone
