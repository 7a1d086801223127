"""Benchmark scores and regression rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.operators import ledger as L


def recall(expected: Column, found: Column) -> Column:
    """Share of expected that was found; 1 if nothing is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(expected, found)) / F.size(expected))


def precision(absent: Column, found: Column) -> Column:
    """1 less the share of found that is known to be absent; 1 if nothing was found."""
    return F.when(F.size(found) == 0, 1.0).otherwise(1.0 - F.size(F.array_intersect(absent, found)) / F.size(found))


def fact_matches(attribute: Column, expected: Column, price: Column, model: Column, free_tier: Column) -> Column:
    """Whether a report's competitor bears out a fact: prices within FACT_TOLERANCE, free tiers and models as they are said, whatever the case; other attributes and missing values don't match."""
    said = lambda c: F.lower(T.strip(c))
    by_price = F.abs(expected.try_cast("double") - price) <= fixed.FACT_TOLERANCE
    return F.coalesce(F.when(attribute == "pricing.entry_usd_month", by_price).when(attribute == "pricing.free_tier", said(expected).isin("true", "1", "yes") == free_tier).when(attribute == "pricing.model", said(expected) == said(model)), F.lit(False))


def scored(runs: DataFrame, competitors: DataFrame, ground: DataFrame) -> DataFrame:
    """runs: run_id, query_id and what else a score carries; competitors of their reports: run_id, entity_key, price, model, free_tier; ground: query_id, must_include, known_absent, facts (entity, attribute, value). Per run: recall, precision, fact_accuracy, and what it carries. precision is 1 less the share of what is known to be absent that was found all the same.

    Domains are those of web entities, each once however often a report names it; a fact is looked up at its domain's
    competitor, the first by price if there are several. A run without competitors finds nothing; a query without ground
    truth scores 1.
    """
    web = competitors.filter(F.col("entity_key").startswith("web:")).select("run_id", F.substring("entity_key", 5, 1 << 30).alias("domain"), "price", "model", "free_tier")
    one = web.groupBy("run_id", "domain").agg(F.min(F.struct("price", "model", "free_tier")).alias("c"))
    asked = runs.select("run_id", "query_id").join(ground, "query_id")
    wanted = lambda c, name: asked.select("run_id", F.explode(F.array_distinct(c)).alias("domain")).join(one.select("run_id", "domain"), ["run_id", "domain"], "left_semi").groupBy("run_id").agg(F.count("*").alias(name))
    facts = asked.select("run_id", F.inline("facts")).join(one.withColumnRenamed("domain", "entity"), ["run_id", "entity"], "left")
    held = facts.groupBy("run_id").agg(F.count_if(fact_matches(F.col("attribute"), F.col("value"), F.col("c.price"), F.col("c.model"), F.col("c.free_tier"))).alias("_held"))
    met = runs.join(ground.select("query_id", F.size("must_include").alias("_m"), F.size("known_absent").alias("_a"), F.size("facts").alias("_f")), "query_id", "left").join(wanted(F.col("must_include"), "_found"), "run_id", "left").join(wanted(F.col("known_absent"), "_wrong"), "run_id", "left").join(held, "run_id", "left")
    share = lambda n, of: F.when(F.coalesce(F.col(of), F.lit(0)) <= 0, 1.0).otherwise(F.coalesce(F.col(n), F.lit(0)) / F.col(of))
    wrong = F.when(F.coalesce(F.col("_a"), F.lit(0)) <= 0, 1.0).otherwise(1.0 - F.coalesce(F.col("_wrong"), F.lit(0)) / F.col("_a"))
    return met.select(*runs.columns, share("_found", "_m").alias("recall"), wrong.alias("precision"), share("_held", "_f").alias("fact_accuracy"))


def fact_accuracy(matches: Column) -> Column:
    """Aggregate: share of facts that match, 1 if there are none."""
    return F.coalesce(F.avg(matches.cast("double")), F.lit(1.0))


def regressions(current: DataFrame, baseline: DataFrame, *, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rows (query_id, rule). Any query: a binding rate below 1. Against a baseline: recall fell, cost rose; and the trap query's contradiction, which fired in the baseline, doesn't fire. keys: what a baseline's row has in common with its current one, unique in the baseline."""
    old = baseline.select(*keys, F.col("recall").alias("old_recall"), F.col("cost").alias("old_cost"), F.col("contradiction_fired").alias("old_fired"))
    both = current.join(old, list(keys), "left")
    rules = F.array(
        F.when(F.col("binding_rate") < 1, "unbound"),
        F.when(F.col("old_recall") - F.col("recall") > fixed.RECALL_DROP, "recall_drop"),
        F.when((F.col("old_cost") > 0) & (F.col("cost") > F.col("old_cost") * (1 + fixed.COST_RISE)), "cost_rise"),
        F.when((F.col("query_id") == fixed.TRAP_QUERY) & F.col("old_fired") & ~F.col("contradiction_fired"), "trap_silent"),
    )
    return both.select("query_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


def structural_binding(sections: Column) -> Column:
    """sections: array of arrays, the findings that each prose section cites. Share that cite any, 1 without sections."""
    return F.when(F.size(sections) == 0, 1.0).otherwise(F.size(F.filter(sections, lambda x: F.size(x) > 0)) / F.size(sections))


def omitted_sections(failed_branches: Column) -> Column:
    return F.filter(failed_branches, lambda x: x.endswith("_synthesis"))


def run_rates(runs: DataFrame) -> DataFrame:
    """runs: used_fallback, failed_branches. One row: share of fallback plans, share of the three synthesis sections that were left out; 0 without runs."""
    out = F.try_divide(F.sum(F.size(omitted_sections(F.col("failed_branches")))).cast("double"), F.count("*") * 3)
    return runs.agg(F.coalesce(F.avg(F.col("used_fallback").cast("double")), F.lit(0.0)).alias("fallback_rate"), F.coalesce(out, F.lit(0.0)).alias("rejection_rate"))


def summary(df: DataFrame, values: list[str]) -> DataFrame:
    """Per column a row (measure, mean, p50, p95): nearest rank, half to even; zeros without rows."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values))).alias("e")).select("e.*").filter("x is not null")
    at = L.at_ranks(long, ["measure"], "x", {"p50": L.nearest(0.5), "p95": L.nearest(0.95)})
    found = long.groupBy("measure").agg(F.avg("x").alias("mean")).join(at, "measure")
    named = df.sparkSession.createDataFrame([(v,) for v in values], "measure string")
    return named.join(found, "measure", "left").select("measure", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "p50", "p95")))


def branch_tally(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode("failed_branches").alias("branch")).groupBy("branch").agg(F.count("*").alias("n"))


def of_split(queries: DataFrame, split: str, as_of: Column, *, confirm: bool = False) -> DataFrame:
    """Benchmark queries (query_id, split, facts with verified_on) of a split. Held-out ones only for those who confirm; a stale fact fails the job."""
    if split == "held_out" and not confirm:
        raise PermissionError("held-out queries are read once, at the end: confirm=True")
    chosen = queries.filter(F.col("split") == split)
    late = F.exists("facts", lambda f: F.date_diff(as_of, f["verified_on"]) > fixed.STALE_DAYS)
    return chosen.withColumn("_ok", F.assert_true(~F.coalesce(late, F.lit(False)), F.concat(F.lit("stale facts: "), "query_id"))).filter("_ok is null").drop("_ok")


def write_snapshot(scores: DataFrame, folder: str, day: str) -> None:
    """A JSON file per query under folder/day, fields in order of their names."""
    names = sorted(scores.columns)
    scores.select(F.to_json(F.struct(*names)).alias("value"), "query_id").repartition("query_id").write.partitionBy("query_id").mode("overwrite").text(f"{folder}/{day}")


def stale_facts(facts: DataFrame, as_of: Column) -> DataFrame:
    return facts.filter(F.date_diff(as_of, F.col("verified_on")) > fixed.STALE_DAYS)
