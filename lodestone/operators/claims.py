"""Claims: gates and binding, contradictions, coverage, promotion, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import scoring as S
from lodestone.functions import text as T


def live(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("superseded_by").isNull())


def gate(raw: DataFrame, *, text: str = "text") -> DataFrame:
    """raw: attribute, value_text, value_num, quote, text. Adds drop_reason (the first gate that fails, null if kept), char_start, char_end, quote_context, context_offset."""
    kind = S.attribute_kind(F.col("attribute"))
    reason = F.when(kind.isNull(), "invalid_attribute").when(~S.value_fits(F.col("attribute"), kind, F.col("value_text"), F.col("value_num")), "value_type_mismatch").otherwise(T.span_drop_reason(F.col(text), F.col("quote")))
    out = raw.withColumn("drop_reason", reason).withColumn("_span", F.when(F.col("drop_reason").isNull(), T.bind_span(F.col(text), F.col("quote"))))
    out = out.withColumn("char_start", F.col("_span.start")).withColumn("char_end", F.col("_span.end"))
    window = T.context_window(F.col(text), F.col("char_start"), F.col("char_end"))
    return out.withColumn("_w", F.when(F.col("_span").isNotNull(), window)).withColumn("quote_context", F.col("_w.context")).withColumn("context_offset", F.col("_w.offset")).drop("_span", "_w")


def drop_counts(gated: DataFrame) -> DataFrame:
    return gated.filter("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


def comparison_key(attribute: Column, value_text: Column, value_num: Column) -> Column:
    """Numbers compare as numbers, else trimmed lower-case text; null is a value of its own, as is the empty text."""
    return F.when(S.attribute_kind(attribute) == "numeric", F.struct(F.lit("n").alias("k"), value_num.cast("string").alias("v"))).otherwise(F.struct(F.lit("t").alias("k"), F.coalesce(F.lower(T.strip(value_text)), F.lit("")).alias("v")))


KEYS = ("entity_id", "attribute")


def _compared(claims: DataFrame, grades: tuple) -> Column:
    """Live claims of these grades; lists hold many values by nature and never contradict."""
    return F.col("superseded_by").isNull() & F.col("grade").isin(*grades) & ~F.coalesce(S.attribute_kind(F.col("attribute")) == "list", F.lit(False))


def _own_key() -> Column:
    return comparison_key(F.col("attribute"), F.col("value_text"), F.col("value_num"))


def contradictions(claims: DataFrame, *, keys: tuple = KEYS, grades: tuple = ("A", "B", "C")) -> DataFrame:
    """Groups of live claims of these grades, lists aside, with more than one comparison key: group keys, n_claims, n_values."""
    counted = claims.filter(_compared(claims, grades)).groupBy(*keys).agg(F.count("*").alias("n_claims"), F.count_distinct(F.struct(_own_key().alias("k"))).alias("n_values"))
    return counted.filter("n_values > 1")


def resolve_contradictions(claims: DataFrame, *, keys: tuple = KEYS, grades: tuple = ("A", "B", "C")) -> DataFrame:
    """In each contradicting group all but the best (grade, then latest date, undated last, then smallest id) are superseded by it; it is marked contradicted.

    With columns confidence and confidence_inputs (struct best_grade, n_distinct_domains, age_days, contradicted) the
    winner's are computed anew as contradicted; without inputs its confidence stays.
    """
    best = Window.partitionBy(*keys).orderBy("grade", F.desc_nulls_last("as_of"), "id")
    mine = _compared(claims, grades)
    values = contradictions(claims, keys=keys, grades=grades).select(*(F.col(k).alias(f"_{k}") for k in keys), "n_values")
    taking = claims.filter(mine).withColumn("_n", F.row_number().over(best)).withColumn("_winner", F.first("id").over(best))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    ranked = taking.join(values, on, "left").withColumn("_fought", F.col("n_values").isNotNull())
    out = ranked.withColumn("superseded_by", F.when(F.col("_fought") & (F.col("_n") > 1), F.col("_winner"))).withColumn("contradicted", F.col("_fought") & (F.col("_n") == 1))
    if "confidence_inputs" in claims.columns:
        i = F.col("confidence_inputs")
        again = F.col("contradicted") & i.isNotNull()
        out = out.withColumn("confidence", F.when(again, S.confidence(i["best_grade"], i["n_distinct_domains"], i["age_days"], F.lit(True))).otherwise(F.col("confidence"))).withColumn("confidence_inputs", F.when(again, i.withField("contradicted", F.lit(True))).otherwise(i))
    rest = claims.filter(~F.coalesce(mine, F.lit(False))).withColumn("contradicted", F.lit(False))
    return out.select(*claims.columns, "contradicted").unionByName(rest)


def coverage(tasks: DataFrame) -> DataFrame:
    """tasks: kind, status, reason, weight. One row: done over terminal weight, and the kinds that failed, were skipped for the budget, or otherwise."""
    done = F.col("status") == "done"
    total = tasks.agg(F.coalesce(F.try_divide(F.sum(F.when(done, F.col("weight"))).cast("double"), F.sum(F.when(F.col("status").isin("done", "failed", "skipped"), F.col("weight")))), F.lit(0.0)).alias("coverage"))
    kinds = tasks.groupBy("kind").agg(F.bool_or(done).alias("any"), F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or((F.col("status") == "skipped") & F.col("reason").startswith("budget")).alias("budget"), F.bool_or(F.col("status") == "skipped").alias("skipped")).filter("not any")
    pick = lambda c, n: F.sort_array(F.collect_list(F.when(c, F.col("kind")))).alias(n)
    dead = kinds.agg(pick(F.col("failed"), "failed_branches"), pick(~F.col("failed") & F.coalesce("budget", F.lit(False)), "budget_skipped_branches"), pick(~F.col("failed") & F.col("skipped") & ~F.coalesce("budget", F.lit(False)), "other_skipped_branches"))
    return total.join(F.broadcast(dead))


def promoted(themes: DataFrame, keys: list[str], *, thread: str = "source_id", reactions: str | None = None) -> DataFrame:
    """Themes with enough claims from enough threads, or (with reactions) enough reactions."""
    cols = [F.count("*").alias("n_claims"), F.count_distinct(thread).alias("n_threads")] + ([F.coalesce(F.sum(reactions), F.lit(0)).alias("reactions")] if reactions else [])
    broad = (F.col("n_claims") >= fixed.PROMOTE_CLAIMS) & (F.col("n_threads") >= fixed.PROMOTE_THREADS)
    return themes.groupBy(*keys).agg(*cols).filter((F.col("reactions") >= fixed.PROMOTE_REACTIONS) if reactions else broad)


def cluster_labels(members: DataFrame) -> DataFrame:
    """members: cluster, slug, ord. Per cluster the most frequent slug, ties to the one seen first."""
    counted = members.groupBy("cluster", "slug").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))).filter("_r = 1").select("cluster", F.col("slug").alias("label"))


def theme_findings(claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """claims: id, slug, source_id, grade, confidence, ord; clusters: slug, cluster. Cluster first, promote after."""
    joined = claims.join(clusters, "slug")
    stats = joined.groupBy("cluster").agg(F.count("*").alias("n_claims"), F.count_distinct("source_id").alias("n_threads"), F.min("grade").alias("best_grade"), F.avg("confidence").alias("confidence"), F.sort_array(F.collect_list("id")).alias("claim_ids"))
    good = stats.filter((F.col("n_claims") >= fixed.PROMOTE_CLAIMS) & (F.col("n_threads") >= fixed.PROMOTE_THREADS))
    return good.join(cluster_labels(joined.select("cluster", "slug", "ord")), "cluster")


def feature_gaps(findings: DataFrame, shipped: DataFrame) -> DataFrame:
    """Findings whose label no shipped feature has."""
    return findings.join(shipped.select(F.col("slug").alias("label")).distinct(), "label", "left_anti")


def freshness(dates: DataFrame, today: Column, column: str = "effective") -> DataFrame:
    """Median age in whole days (half to even), oldest date; 0 and today if there is none."""
    age = F.date_diff(today, F.col(column))
    return dates.agg(F.coalesce(F.bround(F.median(age)).cast("int"), F.lit(0)).alias("median_age_days"), F.coalesce(F.min(column), today).alias("oldest"))


def pivot_latest(claims: DataFrame, attributes: list[str], *, entity: str = "entity_id", value: str = "value_text") -> DataFrame:
    """One row per entity with a column per attribute: the value of the claim with the largest id."""
    wanted = claims.filter(F.col("attribute").isin(attributes))
    return wanted.groupBy(entity).pivot("attribute", attributes).agg(F.max_by(value, "id"))


def price_observation(prices: DataFrame, *, keys: tuple = (), entity: str = "entity_id", value: str = "value_num") -> DataFrame:
    """Median, spread and ids, per group if keys are given; a row only if enough entities have a price. The ids are the row's content, so a group is as large as its report."""
    found = prices.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"), F.sort_array(F.collect_list("id")).alias("claim_ids"), F.count_distinct(entity).alias("n_entities"))
    return found.filter(F.col("n_entities") >= fixed.OBSERVATION_ENTITIES)


def binding_rate(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of claims whose quote stands in the source's text; rows without text don't count."""
    held = claims.join(sources, "source_id").filter("extracted_text is not null")
    return held.agg(F.try_divide(F.count_if(F.contains("extracted_text", "quote")), F.count("*")).alias("binding_rate"))


def bind_statement(statements: DataFrame, findings: DataFrame, *, text: str = "text", key: str = "statement_id") -> DataFrame:
    """Sentences whose marks all name known findings stay, without marks; with the claims of these findings, in order."""
    parts = statements.select(key, F.posexplode(T.sentences(F.col(text))).alias("pos", "sentence")).withColumn("ids", T.markers(F.col("sentence"))).filter(F.size("ids") > 0)
    cited = parts.select(key, "pos", "sentence", F.posexplode("ids").alias("k", "finding_id")).join(findings.select("finding_id", "claim_ids"), "finding_id", "left")
    whole = cited.groupBy(key, "pos", "sentence").agg(F.bool_and(F.col("claim_ids").isNotNull()).alias("known"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "claim_ids"))), lambda x: x["claim_ids"])).alias("claims")).filter("known")
    return whole.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", T.without_markers(F.col("sentence")).alias("s")))), lambda x: x["s"]), " ").alias("statement"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "claims"))), lambda x: x["claims"]))).alias("claim_ids"))


def citation_fault(cited: Column, findings: DataFrame, statements: DataFrame, *, key: str = "statement_id") -> DataFrame:
    """Per statement, what is wrong with the findings that it cites (an array column): unknown ids first, then too few different ones, then no pain point; null if nothing."""
    each = statements.select(key, F.explode_outer(F.array_distinct(cited)).alias("finding_id"))
    met = each.join(findings.select("finding_id", F.col("kind").alias("_kind"), F.lit(True).alias("_known")), "finding_id", "left")
    seen = met.groupBy(key).agg(F.sort_array(F.collect_set(F.when(F.col("finding_id").isNotNull() & F.col("_known").isNull(), F.col("finding_id")))).alias("unknown"), F.count("finding_id").alias("n"), F.count_if(F.col("_kind") == "pain_point").alias("pains"))
    fault = F.when(F.size("unknown") > 0, "unknown_finding").when(F.col("n") < fixed.SYNTHESIS_FINDINGS, "too_few_findings").when(F.col("pains") < fixed.SYNTHESIS_PAINS, "no_pain_point")
    return seen.select(key, "unknown", fault.alias("fault"))


def can_synthesise(findings: DataFrame) -> DataFrame:
    """Enough findings with claims, at least one pain point."""
    cited = F.size("claim_ids") > 0
    return findings.agg(((F.count_if(cited) >= fixed.SYNTHESIS_FINDINGS) & (F.count_if(cited & (F.col("kind") == "pain_point")) >= fixed.SYNTHESIS_PAINS)).alias("ok"))
