"""Findings from themes that embeddings bring together: cluster first, then promote, label and word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.operators import claims as C
from lodestone.operators import ledger as L
from lodestone.operators import vectors as V


def clustered(claims: DataFrame, vectors: DataFrame, threshold: float = fixed.SIMILARITY) -> DataFrame:
    """claims (id, slug, ...) with cluster: the smallest claim that a chain of similar vectors (id, v) reaches. A claim without a vector is its own cluster."""
    of = V.similar_groups(vectors.join(claims.select("id"), "id", "left_semi"), threshold)
    return claims.join(of, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))


def promoted_themes(claims: DataFrame) -> DataFrame:
    """claims: id, cluster, slug, source_id, grade, confidence. Clusters with enough claims from enough threads: theme (the slug most claims have, ties to the claim that comes first), claim_ids, support_count, distinct_threads, best_grade, confidence (mean)."""
    stats = claims.groupBy("cluster").agg(F.count("*").alias("support_count"), F.count_distinct("source_id").alias("distinct_threads"), F.min("grade").alias("best_grade"), F.avg("confidence").alias("confidence"), F.sort_array(F.collect_list("id")).alias("claim_ids"))
    good = stats.filter((F.col("support_count") >= fixed.PROMOTE_CLAIMS) & (F.col("distinct_threads") >= fixed.PROMOTE_THREADS))
    labels = C.cluster_labels(claims.select("cluster", "slug", F.col("id").alias("ord")))
    return good.join(labels, "cluster").withColumnRenamed("label", "theme")


def _drafts(themes: DataFrame, kind: str, statement: Column) -> DataFrame:
    return themes.select(F.lit(kind).alias("kind"), statement.alias("statement"), "claim_ids", "support_count", "confidence", "theme", "distinct_threads", "best_grade")


def _said(verb: str, *rest: Column) -> Column:
    return F.concat(F.col("support_count").cast("string"), F.lit(" users across "), F.col("distinct_threads").cast("string"), F.lit(f" threads {verb} "), F.col("theme"), *rest)


def pain_points(complaints: DataFrame, vectors: DataFrame, threshold: float = fixed.SIMILARITY) -> DataFrame:
    return _drafts(promoted_themes(clustered(complaints, vectors, threshold)), "pain_point", _said("report"))


def feature_gaps(requests: DataFrame, vectors: DataFrame, shipped: DataFrame, reviewed: DataFrame, threshold: float = fixed.SIMILARITY) -> DataFrame:
    """Requested themes that no shipped feature (slug) has; reviewed: one row, n, the competitors that were looked at."""
    themes = C.feature_gaps(promoted_themes(clustered(requests, vectors, threshold)).withColumnRenamed("theme", "label"), shipped).withColumnRenamed("label", "theme")
    return _drafts(themes.join(F.broadcast(reviewed.select(F.col("n").alias("_n")))), "feature_gap", _said("request", F.lit("; not found among "), F.col("_n").cast("string"), F.lit(" reviewed competitors")))


def all_findings(claims: DataFrame, entities: DataFrame, vectors: DataFrame, threshold: float = fixed.SIMILARITY) -> DataFrame:
    """All findings of all runs, from their live claims: competitors, pain points, feature gaps and the pricing observation.

    claims: id, run_id, entity_id, attribute, value_text, value_num, source_id, grade, confidence, superseded_by;
    entities: id, entity_key, display_name; vectors: id (of a complaint or request), v. Themes are clustered within their
    run and family. A run without eligible themes, or with prices of too few entities, has no such findings.
    """
    live = claims.filter("superseded_by is null")
    named = live.join(entities.filter(~F.col("entity_key").startswith("category:")).select(F.col("id").alias("entity_id"), "display_name"), "entity_id")
    per = named.groupBy("run_id", "entity_id", "display_name").agg(F.sort_array(F.collect_list("id")).alias("claim_ids"), F.count("*").alias("support_count"))
    none = {"confidence": "double", "theme": "string", "distinct_threads": "long", "best_grade": "string"}
    blank = lambda *names: [F.lit(None).cast(none[c]).alias(c) for c in names]
    competitors = per.select("run_id", F.lit("competitor").alias("kind"), F.concat("display_name", F.lit(" verified with "), F.col("support_count").cast("string"), F.lit(" bound claims")).alias("statement"), "claim_ids", "support_count", *blank(*none))

    family = F.substring_index("attribute", ".", 1)
    themed = live.filter(family.isin("complaint", "request") & ~F.col("attribute").endswith(".reactions")).select("id", "run_id", family.alias("family"), F.expr("substring(attribute, instr(attribute, '.') + 1)").alias("slug"), "source_id", "grade", "confidence")
    grouped = vectors.join(themed.select("id", F.concat_ws(":", "family", F.col("run_id").cast("string")).alias("_g")), "id")
    of = V.similar_groups(grouped, threshold, by="_g")
    joined = themed.join(of, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    themes = promoted_themes(joined).join(joined.groupBy("cluster").agg(F.first("run_id").alias("run_id"), F.first("family").alias("family")), "cluster")
    pains = themes.filter("family = 'complaint'").select("run_id", F.lit("pain_point").alias("kind"), _said("report").alias("statement"), "claim_ids", "support_count", "confidence", "theme", "distinct_threads", "best_grade")
    shipped = live.filter(F.col("attribute").rlike(r"^feature\..*\.present$") & (F.col("value_text") == "true")).select("run_id", F.split_part("attribute", F.lit("."), F.lit(2)).alias("theme")).distinct()
    reviewed = per.groupBy("run_id").agg(F.count("*").alias("_n"))
    gaps = themes.filter("family = 'request'").join(shipped, ["run_id", "theme"], "left_anti").join(reviewed, "run_id", "left").select("run_id", F.lit("feature_gap").alias("kind"), _said("request", F.lit("; not found among "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" reviewed competitors")).alias("statement"), "claim_ids", "support_count", "confidence", "theme", "distinct_threads", "best_grade")

    prices = live.filter("attribute = 'pricing.entry_usd_month' and value_num is not null")
    stats = prices.groupBy("run_id").agg(F.count_distinct("entity_id").alias("n"), F.min("value_num").cast("double").alias("low"), F.max("value_num").cast("double").alias("high"), F.sort_array(F.collect_list("id")).alias("claim_ids"), F.count("*").alias("support_count"), F.avg("confidence").alias("confidence")).filter(F.col("n") >= fixed.OBSERVATION_ENTITIES)
    middle = L.continuous(prices.select("run_id", F.col("value_num").cast("double").alias("x")), ["run_id"], "x", {"median": 0.5})
    usd = lambda c: F.format_string("%.2f", F.col(c))
    observed = stats.join(middle, "run_id").select("run_id", F.lit("pricing_observation").alias("kind"), F.concat(F.lit("Entry pricing observed across "), F.col("n").cast("string"), F.lit(" competitors: median $"), usd("median"), F.lit("/mo (range $"), usd("low"), F.lit("-$"), usd("high"), F.lit(")")).alias("statement"), "claim_ids", "support_count", "confidence", *blank("theme", "distinct_threads", "best_grade"))
    return competitors.unionByName(pains).unionByName(gaps).unionByName(observed)
