"""The plan that needs no model: discovery, and community mining if there are keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions.text import strip
from lodestone.operators.discover import PROFILE_LIMIT

DISCOVER, PROFILE, PRICING, MINE = 3, 2, 1, 4  # fixed values: weights of task kinds
VENUES = ["hn", "github", "stackexchange"]  # fixed values


def query_variants(category: Column, segment: Column, geography: Column, keywords: Column) -> Column:
    """Trimmed, not empty, each once, in order."""
    first = F.array(category, F.concat_ws(" ", category, segment), F.concat_ws(" ", category, geography))
    return F.array_distinct(F.filter(F.transform(F.concat(first, keywords), strip), lambda x: x != ""))


def fallback_plan(briefs: DataFrame, profiled: int = PROFILE_LIMIT) -> DataFrame:
    """briefs: run_id, category, segment, geography, keywords. Rows (run_id, node_key, kind, args, budget_weight)."""
    variants = query_variants(F.col("category"), F.coalesce("segment", F.lit("")), F.coalesce("geography", F.lit("")), F.col("keywords"))
    discover = briefs.select("run_id", F.lit("t1").alias("node_key"), F.lit("discover_competitors").alias("kind"), F.to_json(F.struct(variants.alias("query_variants"), F.lit(profiled).alias("max_profile_count"))).alias("args"), F.lit(DISCOVER + profiled * (PROFILE + PRICING)).alias("budget_weight"))
    mine = briefs.filter(F.size("keywords") > 0).select("run_id", F.lit("t2").alias("node_key"), F.lit("mine_community").alias("kind"), F.to_json(F.struct("keywords", F.array(*map(F.lit, VENUES)).alias("venues"))).alias("args"), F.lit(MINE).alias("budget_weight"))
    return discover.unionByName(mine)


def fields_to_ask(briefs: DataFrame) -> DataFrame:
    """briefs: run_id, field_confidence (map). The uncertain fields that would change the plan, by doubt times weight, two at most (ties to the smaller name)."""
    weight = F.create_map(*(F.lit(x) for kv in fixed.FIELD_WEIGHT.items() for x in kv))
    rows = briefs.select("run_id", F.explode("field_confidence").alias("field", "confidence")).withColumn("_w", weight[F.col("field")]).filter((F.col("confidence") < fixed.LOW_CONFIDENCE) & F.col("_w").isNotNull())
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc((1 - F.col("confidence")) * F.col("_w")), "field"))
    return rows.withColumn("place", place).filter(F.col("place") <= fixed.MOST_FIELDS).select("run_id", "field", "place")


def overridden(briefs: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Each field by its override where there is one that is not null."""
    o = overrides.select("run_id", *(F.col(f).alias("_" + f) for f in fields))
    both = briefs.join(o, "run_id", "left")
    return both.select(*(F.coalesce("_" + c, c).alias(c) if c in fields else F.col(c) for c in briefs.columns))
