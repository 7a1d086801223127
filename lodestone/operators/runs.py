"""Operational views over runs: metrics with thresholds, maintenance, drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import scoring as S
from lodestone.operators import claims as C
from lodestone.operators import ledger as L
from lodestone.operators import tables as X


def metrics(runs: DataFrame, tasks: DataFrame, claims: DataFrame, sources: DataFrame, stats: DataFrame, thresholds: dict[str, float], now: Column) -> DataFrame:
    """Rows (key, value, threshold, breached): cost per run of 30 days, p95 seconds, runs today, task failure rate, drop rate, binding rate."""
    recent = runs.filter(F.col("started_at") > now - F.expr("interval 30 days"))
    seconds = "percentile_cont(0.95) WITHIN GROUP (ORDER BY unix_seconds(cast(finished_at as timestamp)) - unix_seconds(cast(started_at as timestamp)))"
    rows = {
        "cost_per_run": recent.agg(F.avg(F.col("cost_usd").cast("double"))),
        "p95_seconds": recent.filter("finished_at is not null").agg(F.expr(seconds)),
        "runs_today": runs.agg(F.count_if(F.col("started_at") >= F.date_trunc("day", now)).cast("double")),
        "task_failure_rate": tasks.join(recent.select(F.col("id").alias("run_id")), "run_id").agg(L.ratio(F.col("status") == "failed")),
        "drop_rate": L.drop_rate(stats),
        "binding_rate": C.binding_rate(claims, sources),
    }
    parts = [df.toDF("value").select(F.lit(k).alias("key"), F.col("value").cast("double").alias("value"), F.lit(thresholds.get(k)).cast("double").alias("threshold")) for k, df in rows.items()]
    return X.union(*parts).withColumn("breached", S.breached(F.col("value"), F.col("threshold"), F.col("key") == "binding_rate"))


def all_metrics(runs: DataFrame, tasks: DataFrame, claims: DataFrame, sources: DataFrame, stats: DataFrame, credits: DataFrame, stored: DataFrame, now: Column, *, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The eight operational metrics: key, value (null where there is nothing to measure), unit, threshold, alert_level, breached.

    runs: id, started_at, finished_at, cost_usd; tasks: run_id, status; claims: run_id, source_id, quote; sources: id,
    extracted_text (evicted texts aren't checked); stats: recorded_at, claims_bound, claims_dropped (map); credits:
    spent_at, credits_usd; stored: one row, bytes. All but the runs of the day, the month's search spend and the size are
    of the last 30 days. The latency is taken from ranks over range parts, the rest are sums, so no task sees all rows.
    """
    since = now - F.make_interval(days=F.lit(fixed.METRIC_DAYS))
    recent = runs.filter(F.col("started_at") > since)
    ids = recent.select(F.col("id").alias("run_id"))
    seconds = recent.filter("finished_at is not null").select(((F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000).alias("s"))
    p95 = L.continuous(seconds, [], "s", {"value": 0.95})
    checked = claims.join(ids, "run_id").join(sources.select(F.col("id").alias("source_id"), "extracted_text"), "source_id").filter("extracted_text is not null")
    drops = stats.filter(F.col("recorded_at") > since).select(F.coalesce("claims_bound", F.lit(0)).alias("b"), F.aggregate(F.coalesce(F.map_values("claims_dropped"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("d"))
    rows = {
        "runs_today": runs.agg(F.count_if(F.col("started_at") >= F.date_trunc("day", now))),
        "cost_per_run_mean": recent.agg(F.avg(F.col("cost_usd").cast("double"))),
        "search_spend_mtd": credits.filter(F.col("spent_at") >= F.date_trunc("month", now)).agg(F.coalesce(F.sum(F.col("credits_usd").cast("double")), F.lit(0.0))),
        "sentence_binding_rate": checked.agg(L.ratio(F.contains("extracted_text", "quote"))),
        "extraction_drop_rate": drops.agg(F.try_divide(F.sum("d").cast("double"), F.sum("d") + F.sum("b"))),
        "p95_run_latency_s": p95.agg(F.max("value")),
        "task_failure_rate": tasks.join(ids, "run_id").agg(L.ratio(F.col("status") == "failed")),
        "db_size_pct": stored.agg(F.max("bytes") / fixed.DB_CEILING_BYTES),
    }
    limit = {k: (thresholds or {}).get(k, fixed.METRICS[k][1]) for k in rows}
    parts = [df.toDF("value").select(F.lit(k).alias("key"), F.col("value").cast("double").alias("value"), F.lit(fixed.METRICS[k][0]).alias("unit"), F.lit(limit[k]).alias("threshold"), F.lit(fixed.METRICS[k][2]).alias("alert_level")) for k, df in rows.items()]
    return X.union(*parts).withColumn("breached", S.breached(F.col("value"), F.col("threshold"), F.col("key") == fixed.BELOW))


def maintenance(sources: DataFrame, events: DataFrame, cited: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Pins what benchmark runs cite, then evicts expired texts, then drops old events."""
    return X.evict(X.pin(sources, cited), now), X.retain(events, now, fixed.EVENT_DAYS)


def visible(runs: DataFrame, user: str | None) -> DataFrame:
    return runs.filter(F.col("is_public") | (F.col("user_id") == user) if user else F.col("is_public"))


def claim_detail(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with their source's text, or the stored context once that is evicted, and the other claims of the source."""
    s = sources.select(F.col("id").alias("source_id"), "canonical_url", "extracted_text")
    others = claims.groupBy("source_id").agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    out = claims.join(s, "source_id").join(others, "source_id").withColumn("shown", F.coalesce("extracted_text", "quote_context"))
    start = F.when(F.col("extracted_text").isNotNull(), F.col("char_start")).otherwise(F.col("context_offset"))
    out = out.withColumn("before", F.substring("shown", F.lit(1), start)).withColumn("marked", F.substring("shown", start + 1, F.length("quote"))).withColumn("after", F.col("shown").substr(start + 1 + F.length("quote"), F.length("shown")))
    return out.withColumn("also", F.array_remove("_ids", F.col("id"))).drop("_ids")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """outcomes: run_id, kind, result. Counters of searches, fetches, hits and entities."""
    on = lambda kind, result=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if result is None else F.col("result") == result))
    return outcomes.groupBy("run_id").agg(on("search").alias("searches"), on("search", "degraded").alias("degraded"), on("fetch").alias("fetches"), on("fetch", "hit").alias("cache_hits"), on("entity", "verified").alias("verified"), on("entity", "rejected").alias("rejected"), on("entity", "insufficient").alias("insufficient"))


def claims_in_full(claims: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with their entity and source: for each winner or loser of a contradiction, who says what and where."""
    e = entities.select(F.col("id").alias("entity_id"), "entity_key", "display_name")
    s = sources.select(F.col("id").alias("source_id"), "canonical_url", "fetched_at")
    return claims.join(e, "entity_id").join(s, "source_id")


def inspected(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """What a run found, by entity name and attribute: the value as text, whichever kind it is."""
    e = entities.select(F.col("id").alias("entity_id"), "display_name")
    shown = claims.join(e, "entity_id").select("display_name", "attribute", F.coalesce("value_text", F.col("value_num").cast("string")).alias("value"), "grade", "id")
    return shown.orderBy("display_name", "attribute", "id")


def report_list(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs that have a report, the latest first, unfinished last."""
    return runs.join(reports.select("run_id", "payload"), runs["id"] == F.col("run_id")).drop("run_id").orderBy(F.col("finished_at").desc_nulls_last(), "id")


def replayed(run: DataFrame, new_id: Column, now: Column) -> DataFrame:
    """A run's query as a new run, which the caches serve."""
    return run.select(new_id.alias("id"), "query", F.lit("queued").alias("status"), now.alias("started_at"))


def finding_detail(findings: DataFrame, claims: DataFrame) -> DataFrame:
    """Findings with the claims that carry them, in the order the finding lists them."""
    rows = findings.select("finding_id", F.posexplode("claim_ids").alias("place", "id"))
    return rows.join(claims, "id").orderBy("finding_id", "place")


def run_totals(runs: DataFrame, calls: DataFrame, searches: DataFrame) -> DataFrame:
    """Per run: what the model and the searches cost, and the share of model calls that a cache served (0 without calls)."""
    c = calls.groupBy("run_id").agg(F.sum("cost_usd").cast("double").alias("llm_usd"), L.ratio(F.col("cache_hit"), empty=0.0).alias("hit_rate"))
    s = searches.groupBy("run_id").agg(F.sum("credits_usd").cast("double").alias("search_usd"))
    both = runs.select(F.col("id").alias("run_id")).join(c, "run_id", "left").join(s, "run_id", "left")
    return both.select("run_id", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("llm_usd", "search_usd", "hit_rate"))).withColumn("total_usd", F.col("llm_usd") + F.col("search_usd"))


def executor_coverage(tasks: DataFrame) -> DataFrame:
    """Per run the share of its finished tasks that are done, by count; 0 if none is finished."""
    over = F.count_if(F.col("status").isin("done", "failed", "skipped"))
    return tasks.groupBy("run_id").agg(F.coalesce(F.try_divide(F.count_if(F.col("status") == "done").cast("double"), over), F.lit(0.0)).alias("coverage"))
