"""Report sections and the assembled document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import claims as C


def positioning(maturity: Column, platforms: Column, model: Column) -> Column:
    """A sentence of tier, platforms in order and pricing model."""
    names = F.array_sort(F.array_distinct(F.coalesce(platforms, F.array().cast("array<string>"))))
    tier = F.coalesce(F.concat(F.upper(F.substring(maturity, 1, 1)), F.lower(maturity.substr(F.lit(2), F.length(maturity)))), F.lit("Unclassified"))
    return F.concat(F.concat_ws(" ", F.concat(tier, F.lit(" competitor")), F.when(F.size(names) > 0, F.concat(F.lit("on "), F.array_join(names, ", "))), F.when(model != "", F.concat(F.lit("with "), model, F.lit("-based pricing")))), F.lit("."))


def pain_points(findings: DataFrame) -> DataFrame:
    return findings.filter("kind = 'pain_point'").select(F.col("label").alias("theme"), F.col("n_claims").alias("support_count"), F.col("n_threads").alias("distinct_threads"), F.col("best_grade").alias("grade"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "claim_ids")


def statement(kind: str, reviewed: Column | None = None) -> Column:
    """The sentence of a theme finding (n_claims, n_threads, label)."""
    start = F.concat(F.col("n_claims").cast("string"), F.lit(" users across "), F.col("n_threads").cast("string"), F.lit(" threads "))
    if kind == "pain_point":
        return F.concat(start, F.lit("report "), F.col("label"))
    return F.concat(start, F.lit("request "), F.col("label"), F.lit("; not found among "), (F.lit(0) if reviewed is None else reviewed).cast("string"), F.lit(" reviewed competitors"))


def landscape(claims: DataFrame) -> DataFrame:
    """Median and spread of all entry prices, zeros and no ids if there are none. One row."""
    p = C.live(claims).filter("attribute = 'pricing.entry_usd_month'")
    return p.agg(F.coalesce(F.median("value_num").cast("double"), F.lit(0.0)).alias("median"), F.struct(F.coalesce(F.min("value_num").cast("double"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("value_num").cast("double"), F.lit(0.0)).alias("hi")).alias("spread"), F.sort_array(F.collect_list("id")).alias("claim_ids"))


def competitors(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with model, entry price and free tier; a model of `free` needs no price, it is 0."""
    live = C.live(claims)
    text = F.coalesce(F.col("value_text"), F.col("value_num").cast("string"))
    facts = C.pivot_latest(live.withColumn("value_text", text), ["pricing.model", "pricing.entry_usd_month", "pricing.free_tier"])
    facts = facts.select("entity_id", F.col("`pricing.model`").alias("model"), F.col("`pricing.entry_usd_month`").cast("double").alias("price"), (F.col("`pricing.free_tier`") == "true").alias("free_tier"))
    facts = facts.withColumn("price", F.when((F.col("model") == "free") & F.col("price").isNull(), 0.0).otherwise(F.col("price"))).filter("model is not null and price is not null and free_tier is not null")
    platforms = live.filter("attribute = 'product.platforms'").groupBy("entity_id").agg(F.collect_set("value_text").alias("platforms"))
    out = facts.join(entities, facts.entity_id == entities.id).drop("id").join(platforms, "entity_id", "left")
    return out.withColumn("positioning", positioning(F.col("maturity"), F.col("platforms"), F.col("model")))


def contradiction_section(claims: DataFrame) -> DataFrame:
    """Winners and what they superseded, per entity and attribute. The winner side of the membership is its own semi join."""
    lost = claims.filter("superseded_by is not null")
    won = claims.join(lost.select(F.col("superseded_by").alias("id")).distinct(), "id", "left_semi")
    both = lost.withColumn("winner", F.lit(False)).unionByName(won.withColumn("winner", F.lit(True)))
    return both.groupBy("entity_id", "attribute").agg(F.array_sort(F.collect_list(F.struct((~F.col("winner")).alias("lost"), F.col("id").alias("src"), F.coalesce("value_text", F.col("value_num").cast("string")).alias("v"), "grade"))).alias("values"))


def assemble(sections: dict[str, DataFrame]) -> DataFrame:
    """One row with an array (or, for one-row sections named in it, a struct) per section, and its JSON. Every cited finding must name a claim."""
    out = None
    for name, df in sections.items():
        row = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = row if out is None else out.join(F.broadcast(row))
    return out.withColumn("payload", F.to_json(F.struct(*sections)))


def all_bound(findings: DataFrame) -> DataFrame:
    """Fails the job if a finding has no claims."""
    return findings.withColumn("_ok", F.assert_true(F.size("claim_ids") > 0, F.lit("a finding without claims"))).filter("_ok is null").drop("_ok")
