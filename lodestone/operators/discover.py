"""Discovery: hits to candidates, ranking and tiers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.functions.fixed import FUNDING_LIMIT, PROFILE_LIMIT, VERIFY_LIMIT
from lodestone.operators import entities as N
from lodestone.operators import tables as X
from lodestone.operators.work import Scratch


def aggregate_hits(hits: DataFrame, *, run: tuple[str, ...] = ()) -> DataFrame:
    """hits: run's columns, url, title, snippet, rank, variant, weight, ord. Per candidate: hit_count, best_rank, the first snippet that isn't empty."""
    rows = hits.withColumn("c", U.candidate(F.col("url"), F.col("title"))).filter("c is not null")
    return rows.groupBy(*run, "c.scheme", "c.value").agg(F.min_by("c.name", "ord").alias("name"), F.sum("weight").alias("hit_count"), F.min(F.col("rank") + 1000 * F.col("variant")).alias("best_rank"), F.min_by("snippet", F.when(F.coalesce(F.length("snippet"), F.lit(0)) > 0, F.col("ord"))).alias("snippet"), F.min("ord").alias("ord"))


def top_candidates(candidates: DataFrame, limit: int = VERIFY_LIMIT, *, run: tuple[str, ...] = ()) -> DataFrame:
    if run:
        return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*run).orderBy(F.desc("hit_count"), "best_rank", "ord"))).filter(F.col("_r") <= limit).drop("_r")
    return candidates.orderBy(F.desc("hit_count"), "best_rank", "ord").limit(limit)


def seed_repositories(candidates: DataFrame, repos: DataFrame, *, run: tuple[str, ...] = ()) -> DataFrame:
    """candidates of aggregate_hits and repositories (full_name, description, rank) found for the first query; curated lists go, each repository weighs like two hits."""
    kept = repos.filter(~U.is_list_repo(F.col("full_name"), F.col("description")))
    more = kept.select(*run, F.lit("gh").alias("scheme"), F.col("full_name").alias("value"), F.col("full_name").alias("name"), F.lit(2).cast("long").alias("hit_count"), F.col("rank").cast("long").alias("best_rank"), F.lit("").alias("snippet"), (F.col("rank") + (1 << 40)).cast("long").alias("ord"))
    old = candidates.select(*run, "scheme", "value", "name", F.col("hit_count").cast("long"), F.col("best_rank").cast("long"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.col("ord").cast("long"))
    return old.unionByName(more).groupBy(*run, "scheme", "value").agg(F.min_by("name", "ord").alias("name"), F.sum("hit_count").alias("hit_count"), F.min("best_rank").alias("best_rank"), F.min_by("snippet", F.when(F.length("snippet") > 0, F.col("ord"))).alias("snippet"), F.min("ord").alias("ord"))


def ranked(entities: DataFrame, profiled: int = PROFILE_LIMIT, *, run: tuple[str, ...] = ()) -> DataFrame:
    """entities: entity_id, entity_key, hit_count, best_rank, snippet, maturity, ord. One row per entity, that with most hits; score, place, tier, and whether funding is looked for."""
    one = entities.withColumn("_r", F.row_number().over(Window.partitionBy(*run, "entity_id").orderBy(F.desc("hit_count"), "best_rank", "ord"))).filter("_r = 1").drop("_r")
    scored = one.withColumn("score", F.col("hit_count") * 3.0 - F.col("best_rank") * 0.1 + F.when(F.col("maturity").eqNullSafe("hobby"), 0.0).otherwise(2.0))
    # the verified candidates of a run, VERIFY_LIMIT at most; without run's columns, those of one run
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy(*run).orderBy(F.desc("score"), "ord")))
    return placed.withColumn("tier", F.when(F.col("place") <= profiled, "profile").when(F.col("place") <= 2 * profiled, "pricing").otherwise("none")).withColumn("funding", F.col("place") <= FUNDING_LIMIT)


def spawned(places: DataFrame, *, funding: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """places of ranked: the tasks that discovery adds (node_key, kind, entity_key, snippet, weight). Repositories get their own kind in both tiers."""
    gh = F.col("entity_key").startswith("gh:")
    full = F.col("tier") == "profile"
    kind = F.when(gh, "oss_profile").when(full, "profile_product").otherwise("extract_pricing")
    prefix = F.when(gh, "oss:").when(full, "profile:").otherwise("pricing:")
    weight = F.when(gh | ~full, 1).otherwise(2)
    rows = places.filter("tier != 'none'").select(*run, F.concat(prefix, "entity_key").alias("node_key"), kind.alias("kind"), "entity_key", F.when(full & ~gh, F.nullif("snippet", F.lit(""))).alias("snippet"), weight.alias("weight"))
    if not funding:
        return rows
    more = places.filter("funding").select(*run, F.concat(F.lit("funding:"), "entity_key").alias("node_key"), F.lit("find_funding").alias("kind"), "entity_key", F.lit(None).cast("string").alias("snippet"), F.lit(1).alias("weight"))
    return rows.unionByName(more)


SIGNALS = {"homepage_url": "string", "backlink_repo": "string", "repository_url": "string", "domain_age_days": "long", "last_commit_at": "timestamp", "stars": "long", "star_velocity": "double", "has_funding": "boolean", "stage": "string", "installs": "long", "downloads": "long"}


class Discovery(NamedTuple):
    tasks: DataFrame
    stats: DataFrame
    entities: DataFrame
    aliases: DataFrame
    verified: DataFrame


def discover_runs(hits: DataFrame, repos: DataFrame, responses: DataFrame, cache: DataFrame, signals: DataFrame, old: DataFrame, now: Column, *, profiled: int = PROFILE_LIMIT, funding: bool = False) -> Discovery:
    """Discovery of all runs from search results to tasks. hits and repositories carry run_id, signals (scheme, value and any of SIGNALS) are by entity key, old are the entities that are known.

    Of each run the best candidates (VERIFY_LIMIT) are verified, each key once for all runs; what is verified is resolved
    to entities, merged along aliases; candidates of one entity count as the one with most hits; the entities of a run
    are ranked and get their tasks. A key whose source failed, or that has no answer, drops its candidate only.
    """
    run, ws = ("run_id",), Scratch(hits.sparkSession, "discovery")
    seen = ws.keep("seen", seed_repositories(aggregate_hits(hits, run=run), repos, run=run))
    keyed = ws.keep("keyed", top_candidates(seen, run=run).withColumn("key", N.derived_key(F.col("scheme"), F.col("value"))))
    sound = keyed.filter("key is not null")
    results, entries = N.verify(sound.select("scheme", F.col("key").alias("value")).distinct(), responses, cache, now)
    results = ws.keep("results", results)
    once = X.first_per_key(sound, ["scheme", "key"], [F.asc("run_id"), F.asc("ord")])
    known = signals.select("scheme", F.col("value").alias("key"), *((F.col(c) if c in signals.columns else F.lit(None)).cast(t).alias(c) for c, t in SIGNALS.items()))
    evidence = ws.keep("evidence", once.join(known, ["scheme", "key"], "left").select("scheme", F.col("value").alias("raw_value"), F.col("name").alias("display_name"), "ord", *SIGNALS))
    entities, aliases = N.resolve(evidence, results, old, now)
    entities, aliases = ws.keep("entities", entities), ws.keep("aliases", aliases)
    named = results.filter("verified").select("scheme", F.col("value").alias("key"), "entity_key").join(aliases.select(F.col("alias_key").alias("entity_key"), F.col("entity_key").alias("_to")), "entity_key", "left").select("scheme", "key", F.coalesce("_to", "entity_key").alias("entity_key"))
    of = entities.select("entity_key", "maturity", F.coalesce(F.col("meta")["insufficient_signal"] == "true", F.lit(False)).alias("insufficient"))
    found = sound.join(named, ["scheme", "key"]).join(of, "entity_key").select("run_id", "entity_key", F.col("entity_key").alias("entity_id"), "hit_count", "best_rank", "snippet", "maturity", "ord", "insufficient")
    places = ws.keep("places", ranked(found, profiled, run=run))
    tasks = spawned(places, funding=funding, run=run)
    counts = seen.groupBy("run_id").agg(F.count("*").alias("candidates_seen"))
    checked = keyed.groupBy("run_id").agg(F.count("*").alias("candidates_checked"))
    good = places.groupBy("run_id").agg(F.count("*").alias("entities_verified"), F.count_if("insufficient").alias("insufficient_signal"))
    made = tasks.groupBy("run_id").agg(F.count("*").alias("spawned"))
    stats = counts.join(checked, "run_id", "left").join(good, "run_id", "left").join(made, "run_id", "left").fillna(0, ["candidates_checked", "entities_verified", "insufficient_signal", "spawned"])
    return Discovery(tasks, stats, entities, aliases, entries)


def first_success(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """attempts: keys, pos, path, ok. The first candidate path that worked."""
    return attempts.filter("ok").groupBy(*keys).agg(F.min_by("path", "pos").alias("path"))
