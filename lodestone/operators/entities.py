"""Entities: verification over recorded responses, and resolution from evidence to merged entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import graph as G
from lodestone.operators import tables as X
from lodestone.operators.work import Scratch

#: Responses by scheme and value: error (of the transport, null if there was an answer), status, body text, homepage,
#: repositories in order, how many results an answer names, and the states of further addresses that were asked.
RESPONSE = "scheme string, value string, error string, status int, text string, homepage string, repositories array<string>, n_results int, more_status array<int>"
_RESULT = ["verified", "grade", "reason", "homepage_url", "repository_url"]


def derived_key(scheme: Column, raw: Column) -> Column:
    """The value of an entity key; null if the raw value has none."""
    return F.when(scheme == "web", U.web_key(raw)).when(scheme == "gh", U.gh_key(raw)).when(scheme == "pypi", U.pypi_key(raw)).when(scheme.isin(fixed.SCHEMES), U.plain_key(raw))


def repository_in(candidates: Column) -> Column:
    """The first of the addresses that lies on github.com."""
    return F.try_element_at(F.filter(candidates, lambda x: F.lower(x).contains("github.com")), F.lit(1))


def outcome(scheme: Column) -> Column:
    """struct(reason, failed) of a response row: why the entity is not verified (null: it is), and whether nothing can be said."""
    status, http = F.col("status"), F.concat(F.lit("http_"), F.col("status").cast("string"))
    other = F.when(status != 200, http)
    none = F.when(F.coalesce("n_results", F.lit(0)) < 1, "not_found")
    by = {
        "web": F.when(F.col("error").isNotNull(), F.col("error")).when(status != 200, http).when(T.looks_parked(F.coalesce("text", F.lit(""))), "parked_page"),
        "gh": F.when(status == 404, "http_404"),
        "npm": other,
        "pypi": other,
        "chrome": F.when(status != 200, http).when(T.looks_parked(F.coalesce("text", F.lit(""))), "listing_not_found"),
        "ios": none,
        "hf": F.when(~F.exists(F.concat(F.array("status"), F.coalesce("more_status", F.array().cast("array<int>"))), lambda x: x.eqNullSafe(F.lit(200))), "not_found"),
        "ph": none,
    }
    reason = F.lit(None).cast("string")
    for name, c in by.items():
        reason = F.when(scheme == name, c).otherwise(reason)
    silent = (scheme != "web") & F.col("error").isNotNull()
    refused = (scheme.isin("gh", "ios") & (status != 200)) & ~((scheme == "gh") & (status == 404))
    return F.struct(reason.alias("reason"), F.coalesce(silent | refused, F.lit(False)).alias("failed"))


def verify(keys: DataFrame, responses: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """keys: scheme, value (each once). Fresh entries of the cache (entity_key, expires_at and the result) answer first, failures too; the rest is judged by its recorded response.

    Gives the results of all keys that can be judged, and the new cache entries. Keys whose source failed have no result.
    """
    asked = keys.select("scheme", "value", F.concat_ws(":", "scheme", "value").alias("entity_key"))
    fresh = cache.filter(F.col("expires_at") > now).select("entity_key", *_RESULT)
    held = asked.join(fresh, "entity_key")
    todo = asked.join(fresh.select("entity_key"), "entity_key", "left_anti").join(responses, ["scheme", "value"]).withColumn("_o", outcome(F.col("scheme"))).filter(~F.col("_o.failed"))
    good = F.col("_o.reason").isNull()
    judged = todo.select(
        "entity_key", "scheme", "value", good.alias("verified"), F.when(F.col("scheme") == "ph", "B").otherwise("A").alias("grade"), F.col("_o.reason").alias("reason"),
        F.when(good & (F.col("scheme") == "gh"), F.nullif("homepage", F.lit(""))).alias("homepage_url"), F.when(good & F.col("scheme").isin("npm", "pypi"), repository_in(F.coalesce("repositories", F.array().cast("array<string>")))).alias("repository_url"),
    )
    new = judged.select("entity_key", *_RESULT, now.alias("checked_at"), (now + F.make_interval(hours=F.lit(fixed.VERIFY_HOURS))).alias("expires_at"))
    return held.select("entity_key", "scheme", "value", *_RESULT).unionByName(judged), new


def resolve(evidence: DataFrame, results: DataFrame, old: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """evidence: scheme, raw_value, display_name, ord, homepage_url, backlink_repo, repository_url and the maturity signals; results of verify.

    Verified keys become entities (display name, tier, meta with rule, sufficiency and grade), merged with the old ones
    and with each other along the alias edges that evidence and results give. Gives entities (under their canonical key)
    and aliases (alias_key, entity_key).
    """
    rows = evidence.withColumn("value", derived_key(F.col("scheme"), F.col("raw_value"))).filter("value is not null").join(results.filter("verified").select("entity_key", "scheme", "value", "grade", F.col("homepage_url").alias("_home"), F.col("repository_url").alias("_repo")), ["scheme", "value"])
    rows = X.first_per_key(rows, ["entity_key"], [F.desc("ord")])
    tier = S.maturity(domain_age_days=F.col("domain_age_days"), last_commit_at=F.col("last_commit_at"), stars=F.col("stars"), star_velocity=F.col("star_velocity"), has_funding=F.col("has_funding"), stage=F.col("stage"), installs=F.col("installs"), downloads=F.col("downloads"), shared_host=(F.col("scheme") == "web") & U.is_shared_host(F.col("value")), now=now)
    ws = Scratch(rows.sparkSession, "resolve")  # keys and tiers are read again by each kind of edge, by entities and by aliases
    rows = ws.keep("rows", rows.withColumn("_t", tier))
    meta = F.create_map(F.lit("maturity_rule"), F.col("_t.rule"), F.lit("insufficient_signal"), F.col("_t.insufficient").cast("string"), F.lit("verification_grade"), F.col("grade"))
    made = rows.select("entity_key", "display_name", F.col("_t.tier").alias("maturity"), meta.alias("meta"), "ord")
    linked = rows.select("scheme", "value", U.web_key(F.coalesce("homepage_url", "_home")).alias("homepage_key"), U.gh_key(F.col("backlink_repo")).alias("backlink_repo"), U.gh_key(F.regexp_replace(F.coalesce("repository_url", "_repo"), r"^git\+", "")).alias("repository"))
    named = G.canonical_keys(G.alias_edges(linked).select("a", "b"))
    canon = ws.keep("canon", made.join(named.withColumnRenamed("key", "entity_key"), "entity_key", "left").withColumn("canonical", F.coalesce("canonical", "entity_key")))
    # of a merged group the canonical key's own row speaks if it is there, else the latest
    own = X.first_per_key(canon, ["canonical"], [(F.col("entity_key") == F.col("canonical")).desc(), F.desc("ord")])
    entities = X.upsert_entities(old, own.select(F.col("canonical").alias("entity_key"), "display_name", "maturity", "meta"))
    aliases = canon.filter("entity_key != canonical").select(F.col("entity_key").alias("alias_key"), F.col("canonical").alias("entity_key"))
    return entities.join(aliases.select(F.col("alias_key").alias("entity_key")), "entity_key", "left_anti"), aliases
