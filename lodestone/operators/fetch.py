"""The fetch chain over recorded responses: cache, no-crawl, robots, conditional request, retries, gates, and the next cache.

Per URL, in its canonical form: a fresh cache entry answers at once; domains that may not be crawled and paths that the
host's robots file forbids are refused; else a request goes out, with the validators of any old entry, and its recorded
attempts are read: timeouts and retryable states are tried again, RETRIES attempts at most. An answer of "not modified"
renews the old entry; other states than 200 are kept for a day without text; of the rest the content type, the text's
length and consent walls are checked, and what passes is kept for a week. Each URL is fetched once, however often it is
asked for. Everything is joins on the canonical URL or the host; no group is gathered.

cache: canonical_url, root_key, http_status, extracted_text, content_hash, etag, last_modified, retrieval_reason,
fetched_at, ttl_expires_at. responses: canonical_url, attempt (from 0), status (null: it timed out), content_type, etag,
last_modified, final_url, html.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.sources import pages

CACHE = ["canonical_url", "root_key", "http_status", "extracted_text", "content_hash", "etag", "last_modified", "retrieval_reason", "fetched_at", "ttl_expires_at"]


def answered(responses: DataFrame, most: int = fixed.RETRIES) -> DataFrame:
    """Per canonical_url the attempt that counts, as a struct r: the first whose state isn't retried, else the last of `most`; null if that one timed out."""
    kept = responses.filter(F.col("attempt") < most)
    final = F.col("status").isNotNull() & (~F.col("status").isin(fixed.RETRY_STATUS) | (F.col("attempt") == most - 1))
    fields = [c for c in responses.columns if c != "canonical_url"]
    return kept.groupBy("canonical_url").agg(F.min_by(F.struct(*fields), F.when(final, F.col("attempt"))).alias("r"))


def fetch(requests: DataFrame, cache: DataFrame, robots: DataFrame, responses: DataFrame, now: Column, *, agent: str, extract: Callable[[Column], Column] = pages.html_text, reason: str = "fetch") -> tuple[DataFrame, DataFrame]:
    """requests: url, and what else they carry, with `force` to pass over fresh entries. (1) requests with canonical_url, outcome (hit, miss, conditional_304, no_url, no_crawl, robots, timeout, content_type, thin), http_status and extracted_text; (2) the cache rows that are new or renewed."""
    asked = requests.withColumn("canonical_url", U.canonical_url(F.col("url")))
    forced = F.coalesce(F.col("force"), F.lit(False)) if "force" in requests.columns else F.lit(False)
    each = asked.filter("canonical_url is not null").groupBy("canonical_url").agg(F.max(forced).alias("force"))
    old = cache.select("canonical_url", F.struct(*(c for c in CACHE if c != "canonical_url")).alias("old"))
    seen = each.join(old, "canonical_url", "left").withColumn("host", U.host(F.col("canonical_url")))
    fresh = F.coalesce((F.col("old.ttl_expires_at") > now) & ~F.col("force"), F.lit(False))
    barred = U.in_domains(F.col("host"), fixed.NO_CRAWL)
    open_ = seen.filter(~fresh & ~barred)
    free = pages.allowed(open_.select("host", F.col("canonical_url").alias("url")), robots, agent).select(F.col("url").alias("canonical_url"), "allowed")
    said = answered(responses.join(open_.select("canonical_url"), "canonical_url", "left_semi"))
    sent = open_.join(free, "canonical_url").join(said, "canonical_url", "left")
    # a validator that still holds is answered by "not modified"
    same = (F.col("r.status") == 200) & (F.col("old.etag").eqNullSafe(F.col("r.etag")) & F.col("r.etag").isNotNull() | F.col("old.last_modified").eqNullSafe(F.col("r.last_modified")) & F.col("r.last_modified").isNotNull())
    status = F.when(F.coalesce(same, F.lit(False)), 304).otherwise(F.col("r.status")).cast("int")
    read = sent.withColumn("status", status).withColumn("text", F.when(F.col("allowed") & (F.col("status") == 200), extract(F.col("r.html"))))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("r.content_type", F.lit("")), ";", 1)))
    outcome = (
        F.when(~F.col("allowed"), "robots").when(F.col("status").isNull(), "timeout").when((F.col("status") == 304) & F.col("old").isNotNull(), "conditional_304").when(F.col("status") != 200, "miss")
        .when((kind != "") & ~kind.isin(fixed.CONTENT_TYPES), "content_type").when(F.col("text").isNull() | (F.col("text") == "") | T.is_consent_wall(F.col("text"), F.col("r.html")), "thin").otherwise("miss")
    )
    # https that a redirect has proven is adopted
    proven = F.col("canonical_url").startswith("http://") & F.lower(F.col("r.final_url")).startswith("https://")
    done = read.withColumn("outcome", outcome).withColumn("stored_url", F.when(F.coalesce(proven, F.lit(False)), U.canonical_url(F.col("canonical_url"), https=True)).otherwise(F.col("canonical_url")))
    lasting, short = now + F.make_interval(days=F.lit(fixed.POSITIVE_TTL_DAYS)), now + F.make_interval(hours=F.lit(fixed.NEGATIVE_TTL_HOURS))
    renewed, good = F.col("outcome") == "conditional_304", (F.col("outcome") == "miss") & (F.col("status") == 200)
    of = lambda c, new: F.when(renewed, F.col(f"old.{c}")).when(good, new).alias(c)
    stored = done.filter(F.col("outcome").isin("miss", "conditional_304")).select(
        F.when(renewed, F.col("canonical_url")).otherwise(F.col("stored_url")).alias("canonical_url"), F.when(renewed, F.col("old.root_key")).otherwise(F.coalesce(U.public_key(F.col("host")), F.col("host"))).alias("root_key"),
        F.when(renewed, F.col("old.http_status")).otherwise(F.col("status")).cast(cache.schema["http_status"].dataType).alias("http_status"), of("extracted_text", F.col("text")), of("content_hash", F.sha2("text", 256)), of("etag", F.col("r.etag")), of("last_modified", F.col("r.last_modified")),
        F.when(renewed, F.col("old.retrieval_reason")).otherwise(reason).alias("retrieval_reason"), now.cast(cache.schema["fetched_at"].dataType).alias("fetched_at"), F.when(renewed | good, lasting).otherwise(short).cast(cache.schema["ttl_expires_at"].dataType).alias("ttl_expires_at"), F.col("canonical_url").alias("_asked"),
    )
    hits = seen.filter(fresh).select("canonical_url", F.lit("hit").alias("outcome"), F.col("old.http_status").cast("int").alias("http_status"), F.col("old.extracted_text").alias("extracted_text"))
    refused = seen.filter(~fresh & barred).select("canonical_url", F.lit("no_crawl").alias("outcome"), F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("extracted_text"))
    kept = F.col("outcome").isin("miss", "conditional_304")
    went = done.select("canonical_url", "outcome", F.when(kept, F.when(renewed, F.col("old.http_status")).otherwise(F.col("status"))).cast("int").alias("http_status"), F.when(renewed, F.col("old.extracted_text")).when(good, F.col("text")).alias("extracted_text"))
    known = hits.unionByName(refused).unionByName(went)
    out = asked.join(known, "canonical_url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("no_url")))
    return out, stored


def merged(cache: DataFrame, stored: DataFrame) -> DataFrame:
    """The next cache: rows of fetch() replace those of their canonical URL; of two that come to the same URL the one asked for by it stays."""
    own = stored.groupBy("canonical_url").agg(F.max_by(F.struct(*CACHE[1:]), F.struct((F.col("_asked") == F.col("canonical_url")).alias("own"), "_asked")).alias("r")).select("canonical_url", "r.*")
    return cache.select(*CACHE).join(own.select("canonical_url"), "canonical_url", "left_anti").unionByName(own)


def guess_paths(domains: DataFrame, known: DataFrame, cache: DataFrame, robots: DataFrame, responses: DataFrame, now: Column, *, agent: str, extract: Callable[[Column], Column] = pages.html_text, most: int = fixed.PATH_ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """domains: root_key, kind (pricing, docs, changelog); known: root_key, kind, found_path, ttl_expires_at.

    (1) per domain and kind found_path and from_cache; (2) the attempts (root_key, kind, pos, path, outcome): a kind's
    paths in order, up to the first that works (a price on it for pricing, any text else); (3) the entries of `known`
    that are new, for a week if a path was found, else for a day; (4) the cache rows of what was fetched on the way.
    """
    fresh = known.filter(F.col("ttl_expires_at") > now).select("root_key", "kind", F.col("found_path").alias("cached_path"), F.lit(True).alias("from_cache"))
    wanted = domains.select("root_key", "kind").distinct().join(fresh, ["root_key", "kind"], "left")
    paths = F.create_map(*(x for k, v in fixed.PATHS.items() for x in (F.lit(k), F.array(*map(F.lit, v[:most])))))
    tries = wanted.filter("from_cache is null").select("root_key", "kind", F.posexplode(paths[F.col("kind")]).alias("pos", "path")).withColumn("url", F.concat(F.lit("https://"), "root_key", "path"))
    out, stored = fetch(tries, cache, robots, responses, now, agent=agent, extract=extract, reason="path_guess")
    good = F.coalesce((F.col("http_status") == 200) & F.when(F.col("kind") == "pricing", T.looks_priced(F.col("extracted_text"))).otherwise(F.length("extracted_text") > 0), F.lit(False))
    judged = out.withColumn("good", good)
    first = judged.filter("good").groupBy("root_key", "kind").agg(F.min("pos").alias("at"), F.min_by("path", "pos").alias("found"))
    reached = judged.join(first, ["root_key", "kind"], "left").filter(F.col("at").isNull() | (F.col("pos") <= F.col("at")))
    attempts = reached.select("root_key", "kind", "pos", "path", F.when(F.col("good"), "hit").otherwise("miss").alias("outcome"))
    found = wanted.join(first, ["root_key", "kind"], "left").select("root_key", "kind", F.coalesce("cached_path", "found").alias("found_path"), F.coalesce("from_cache", F.lit(False)).alias("from_cache"))
    lasting, short = now + F.make_interval(days=F.lit(fixed.POSITIVE_TTL_DAYS)), now + F.make_interval(hours=F.lit(fixed.NEGATIVE_TTL_HOURS))
    entries = found.filter("not from_cache").select("root_key", "kind", "found_path", F.when(F.col("found_path").isNotNull(), lasting).otherwise(short).alias("ttl_expires_at"))
    used = stored.join(reached.select(F.col("canonical_url").alias("_asked")).distinct(), "_asked", "left_semi")
    return found, attempts, entries, used
