"""Table mutations as DataFrame functions: insert-or-ignore, upserts, eviction, retention, pinning, merging, state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.work import numbered


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of `new` to append: the first of each key that `old` doesn't have."""
    return first_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: Column, *, sticky: list[str] | None = None) -> DataFrame:
    """Latest version of each key; sticky columns keep the value of the oldest one that has any."""
    every = old.unionByName(new)
    out = first_per_key(every, keys, [version.desc()])
    if not sticky:
        return out
    kept = every.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), version)).alias(c) for c in sticky))
    return out.drop(*sticky).join(kept, keys).select(*old.columns)


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of both; new values win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def append_events(old: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """new with ids that go on after those of old."""
    last = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    return numbered(new, order, "id").join(F.broadcast(last)).withColumn("id", F.col("id") + F.col("_last")).drop("_last")


def evict(df: DataFrame, now: Column, *, expires: str = "ttl_expires_at", pinned: str = "is_pinned", text: str = "extracted_text") -> DataFrame:
    """The text of expired rows goes, the row stays; pinned ones keep it."""
    return df.withColumn(text, F.when((F.col(expires) < now) & ~F.col(pinned), None).otherwise(F.col(text)))


def retain(df: DataFrame, now: Column, days: int, *, at: str = "created_at") -> DataFrame:
    return df.filter(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def pin(sources: DataFrame, cited: DataFrame, key: str = "id", cited_key: str = "source_id") -> DataFrame:
    """is_pinned for what is cited; pins stay."""
    marks = cited.select(F.col(cited_key).alias(key)).distinct().withColumn("_cited", F.lit(True))
    return sources.join(marks, key, "left").withColumn("is_pinned", F.col("is_pinned") | F.coalesce("_cited", F.lit(False))).drop("_cited")


def repoint(df: DataFrame, canon: DataFrame, column: str) -> DataFrame:
    """column by the map (id, canonical_id); ids not in it stay."""
    return df.join(canon.select(F.col("id").alias(column), "canonical_id"), column, "left").withColumn(column, F.coalesce("canonical_id", column)).drop("canonical_id")


def merge_entities(entities: DataFrame, aliases: DataFrame, claims: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """canon: id, canonical_id (others are their own). Losers leave entities; their keys, and all aliases that named them, become aliases of the canonical one; claims are repointed."""
    losers = canon.filter("id != canonical_id")
    kept = entities.join(losers.select("id"), "id", "left_anti")
    own = entities.join(losers, "id").select(F.col("entity_key").alias("alias_key"), F.col("canonical_id").alias("entity_id"))
    moved = repoint(aliases, losers, "entity_id").select("alias_key", "entity_id").unionByName(own).dropDuplicates(["alias_key"])
    return kept, moved, repoint(claims, losers, "entity_id")


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """entity_key, display_name, maturity, meta (map): the new name and tier win, new keys of meta win, old ones stay."""
    n = new.select("entity_key", *(F.col(c).alias("_" + c) for c in ("display_name", "maturity", "meta")), F.lit(True).alias("_new"))
    both = old.join(n, "entity_key", "full")
    pick = lambda c: F.when(F.col("_new"), F.col("_" + c)).otherwise(F.col(c)).alias(c)
    empty = F.create_map().cast("map<string,string>")
    return both.select("entity_key", pick("display_name"), pick("maturity"), merge_maps(F.coalesce("meta", empty), F.coalesce("_meta", empty)).alias("meta"))


def insert_returning(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that are there after inserting: the new one, or the old one that has its key."""
    held = old.join(new.select(*keys).distinct(), keys, "left_semi")
    return held.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def allowed_by_switch(requests: DataFrame, state: DataFrame) -> DataFrame:
    """requests with `open`: the kill switch, a table of one row (kill_switch), closes all; without a row all is open."""
    switch = state.agg(F.coalesce(F.bool_or("kill_switch"), F.lit(False)).alias("_off"))
    return requests.join(F.broadcast(switch)).withColumn("open", ~F.col("_off")).drop("_off")


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under folder/name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def stored_bytes(spark, folder: str, ceiling: int | None = None) -> dict:
    """Bytes of a folder of tables, and their share of a ceiling."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    n = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return {"bytes": n, "share": n / ceiling if ceiling else None}


def vector_literal(v: Column) -> Column:
    return F.to_json(v)


def parse_vector(s: Column) -> Column:
    return F.from_json(s, "array<float>")


def latest_state(events: DataFrame, key: str, state: str, order: Column) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, order).alias(state))


def cached(requests: DataFrame, cache: DataFrame, keys: list[str], now: Column, *, expires: str | None = "expires_at") -> DataFrame:
    """requests with the cached columns and `hit`; expired entries count as absent."""
    fresh = cache.filter(F.col(expires) > now) if expires else cache
    return requests.join(fresh.withColumn("hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def not_cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct key once that has no entry: what is to be fetched or embedded."""
    return requests.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the JSON of the parts, in the order given."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def resolve_alias(keys: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id of (key): the entity of that key, else the one whose alias it is."""
    e = entities.select(F.col("entity_key").alias("key"), F.col("id").alias("_own"))
    a = aliases.select(F.col("alias_key").alias("key"), F.col("entity_id").alias("_other"))
    return keys.join(e, "key", "left").join(a, "key", "left").withColumn("entity_id", F.coalesce("_own", "_other")).drop("_own", "_other")


def count_where(conditions: dict[str, Column]) -> list[Column]:
    return [F.count_if(c).alias(n) for n, c in conditions.items()]


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
