"""The fetch chain, path guesses and public suffix rules over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import sentences as SE
from lodestone.functions import suffixes as X
from lodestone.functions import urls as U
from lodestone.operators import bench as BE
from lodestone.operators import discover as D
from lodestone.operators import fetch as FE
from lodestone.operators import ledger as L
from lodestone.operators import runs as RUN
from lodestone.operators import stored as ST
from lodestone.operators.work import shared_dir
from lodestone.plans._common import NOW, table
from lodestone.sources import content as CO
from lodestone.sources import replay as R

AGENT = "bot"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _plain(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", " ")


def _recorded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages as requests; a quarter of their URLs lies in the cache, a quarter did once; some fail, some are forbidden, some of the wrong type."""
    p = table(spark, d, "pages")
    of = p.withColumn("canonical_url", U.canonical_url(F.col("url"))).groupBy("canonical_url").agg(F.min("page_id").alias("k"), F.min_by("html", "page_id").alias("html"))
    k, none = F.col("k"), F.lit(None).cast("string")
    kept = of.filter("k % 4 < 2").select(
        "canonical_url", F.lit("old").alias("root_key"), F.lit(200).alias("http_status"), F.concat(F.lit("text "), k.cast("string")).alias("extracted_text"), F.sha2(k.cast("string"), 256).alias("content_hash"), F.concat(F.lit("e"), (k % 3).cast("string")).alias("etag"), none.alias("last_modified"),
        F.lit("old").alias("retrieval_reason"), (_now() - F.expr("interval 8 days")).alias("fetched_at"), (_now() + F.when(k % 4 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))).alias("ttl_expires_at"),
    )
    attempts = F.when(k % 5 == 0, F.array(F.lit(503), F.lit(200))).when(k % 5 == 1, F.array(F.lit(404))).otherwise(F.array(F.lit(200)))
    responses = of.filter("k % 7 != 6").select("canonical_url", F.posexplode(attempts).alias("attempt", "status"), F.when(k % 11 == 3, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), F.lit("e0").alias("etag"), none.alias("last_modified"), F.col("canonical_url").alias("final_url"), "html")
    host = U.host(F.col("canonical_url"))
    robots = of.select(host.alias("host")).distinct().filter(F.length("host") % 3 == 0).select("host", F.lit("User-agent: *\nDisallow: /fr").alias("body"))
    return p.select("page_id", "url"), kept, robots, responses


def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    out, _ = FE.fetch(*_recorded(spark, d), _now(), agent=AGENT, extract=_plain)
    return out.select("page_id", "canonical_url", "outcome", F.col("http_status").cast("long").alias("http_status"), F.sha2("extracted_text", 256).alias("text_hash"))


def fetch_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cache that the next run finds."""
    requests, kept, robots, responses = _recorded(spark, d)
    _, stored = FE.fetch(requests, kept, robots, responses, _now(), agent=AGENT, extract=_plain)
    return FE.merged(kept, stored).select("canonical_url", "root_key", F.col("http_status").cast("long").alias("http_status"), "content_hash", "etag", "retrieval_reason", F.col("ttl_expires_at").cast("string").alias("expires"))


def _guesses(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Suppliers as domains; a tenth has an entry, two fifths answer some path."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    key = F.concat(F.lit("s"), k.cast("string"), F.lit(".com"))
    kind = F.element_at(F.array(*map(F.lit, fixed.PATHS)), (k % 3 + 1).cast("int"))
    known = s.filter("s_suppkey % 5 = 0").select(key.alias("root_key"), kind.alias("kind"), F.when(k % 2 == 0, "/known").alias("found_path"), (_now() + F.when(k % 10 < 5, F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))).alias("ttl_expires_at"))
    paths = F.create_map(*(x for name, v in fixed.PATHS.items() for x in (F.lit(name), F.array(*map(F.lit, v)))))
    each = s.select(k.alias("k"), key.alias("root_key"), F.posexplode(paths[kind]).alias("pos", "path")).filter((F.col("k") + F.col("pos")) % 5 < 2)
    url = F.concat(F.lit("https://"), "root_key", "path")
    responses = each.select(url.alias("canonical_url"), F.lit(0).alias("attempt"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), url.alias("final_url"), F.when((F.col("k") + F.col("pos")) % 2 == 0, "<p>$ 5</p>").otherwise("<p>words</p>").alias("html"))
    _, kept, robots, _ = _recorded(spark, d)
    return FE.guess_paths(s.select(key.alias("root_key"), kind.alias("kind")), known, kept, robots, responses, _now(), agent=AGENT, extract=_plain)


def path_guesses(spark: SparkSession, d: str) -> DataFrame:
    found, attempts, entries, _ = _guesses(spark, d)
    tried = attempts.groupBy("root_key", "kind").agg(F.count("*").alias("tried"), F.count_if(F.col("outcome") == "hit").alias("hits"))
    new = entries.select("root_key", "kind", F.col("ttl_expires_at").cast("string").alias("expires"))
    return found.join(tried, ["root_key", "kind"], "left").join(new, ["root_key", "kind"], "left").select("root_key", "kind", "found_path", "from_cache", F.coalesce("tried", F.lit(0)).alias("tried"), F.coalesce("hits", F.lit(0)).alias("hits"), "expires")


def suffix_rules(spark: SparkSession, d: str) -> DataFrame:
    """Customers' hosts under plain, wildcard, exception and private rules, and none: by the rule table, and beside it by the expressions."""
    k = F.col("c_custkey")
    ends = ["example.co.uk", "b.ck", "www.ck", "github.io", "city.kawasaki.jp", "foo.kawasaki.jp", "kobe.jp", "us.compute.amazonaws.com", "unknown.zz", "com", "co.uk", "10.0.0.1", "a..com"]
    host = F.concat(F.when(k % 3 == 0, F.concat(F.lit("a."), F.lit("t"), (k % 50).cast("string"), F.lit("."))).when(k % 3 == 1, F.concat(F.lit("T"), (k % 7).cast("string"), F.lit("."))).otherwise(""), F.element_at(F.array(*map(F.lit, ends)), (k % len(ends) + 1).cast("int")))
    hosts = table(spark, d, "customer").select("c_custkey", host.alias("host"))
    out = X.resolved(hosts, X.built_in(spark))
    same = F.col("web_key").eqNullSafe(U.web_key(F.col("host"))) & F.col("public_key").eqNullSafe(U.public_key(F.col("host")))
    return out.select("c_custkey", "host", "suffix", "web_key", "public_key", "shared", same.alias("same"))


def _discovered(spark: SparkSession, d: str) -> D.Discovery:
    """Pages as search results of three runs, parts as repositories; one domain is parked, a fifth of the repositories is gone, a seventh belongs to a domain's product."""
    k, r = F.col("page_id"), F.col("p_partkey")
    hits = table(spark, d, "pages").select((k % 3).alias("run_id"), "url", F.lit("").alias("title"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("snippet"), (k % 10).alias("rank"), (k % 2).alias("variant"), F.lit(1).alias("weight"), k.alias("ord"))
    p = table(spark, d, "part")
    name = F.concat(F.when(r % 4 == 0, "x/awesome-").otherwise("x/tool"), r.cast("string"))
    repos = p.select((r % 3).alias("run_id"), name.alias("full_name"), F.lit("A tool").alias("description"), r.alias("rank"))
    none = lambda t: F.lit(None).cast(t)
    web = table(spark, d, "pages").select(U.web_key(F.col("url")).alias("value")).distinct().filter("value is not null")
    answers = web.select(F.lit("web").alias("scheme"), "value", none("string").alias("error"), F.lit(200).alias("status"), F.when(F.col("value") == "example.net", "This domain is parked").otherwise(F.repeat(F.lit("real words "), 20)).alias("text"), none("string").alias("homepage"), none("array<string>").alias("repositories"), none("int").alias("n_results"), none("array<int>").alias("more_status"))
    gh = p.select(F.lit("gh").alias("scheme"), name.alias("value"), none("string").alias("error"), F.when(r % 5 == 0, 404).otherwise(200).alias("status"), none("string").alias("text"), F.when(r % 7 == 0, "https://www.example.com/").alias("homepage"), none("array<string>").alias("repositories"), none("int").alias("n_results"), none("array<int>").alias("more_status"))
    signals = web.select(F.lit("web").alias("scheme"), "value", F.lit(5000).alias("domain_age_days"), none("long").alias("stars")).unionByName(p.select(F.lit("gh").alias("scheme"), name.alias("value"), none("int").alias("domain_age_days"), (r * 10).cast("long").alias("stars")))
    empty = spark.range(0)
    cache = empty.select(none("string").alias("entity_key"), none("boolean").alias("verified"), *(none("string").alias(c) for c in ("grade", "reason", "homepage_url", "repository_url")), none("timestamp").alias("expires_at"))
    old = empty.select(*(none("string").alias(c) for c in ("entity_key", "display_name", "maturity")), none("map<string,string>").alias("meta"))
    return D.discover_runs(hits, repos, answers.unionByName(gh), cache, signals, old, _now(), funding=True)


def discover_tasks(spark: SparkSession, d: str) -> DataFrame:
    return _discovered(spark, d).tasks.withColumn("weight", F.col("weight").cast("long"))


def discover_stats(spark: SparkSession, d: str) -> DataFrame:
    return _discovered(spark, d).stats


def path_rates(spark: SparkSession, d: str) -> DataFrame:
    """How well each guessed path does."""
    return L.path_rates(_guesses(spark, d)[1]).withColumn("rate", F.round("rate", 9))


def _routed(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    asked = e.select((k % 50).alias("run_id"), F.col("user_id").alias("provider"), (k % 500).alias("query"), k.alias("ord"), F.col("ts").cast("timestamp").alias("at"), (k % 4 / 8).alias("cost"), F.when(k % 13 == 0, "ProviderError").alias("error"))
    cache = spark.range(100).select(F.col("id").alias("query"), (_now() + F.when(F.col("id") % 2 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval -1 hour"))).alias("expires_at"))
    return R.route(asked, cache, _now(), 0.5)


def search_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What searches cost, by run."""
    return L.search_credits(_routed(spark, d)).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("credits_usd").alias("usd"))


def all_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs of forty days, lines as tasks, labelled documents as claims, events as statistics and search credits."""
    o, e, k = table(spark, d, "orders"), table(spark, d, "events"), F.col("o_orderkey")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    start = now - F.make_interval(days=(k % 40).cast("int"))
    runs = o.select(k.alias("id"), (F.col("o_totalprice") / 1_000_000).alias("cost_usd"), start.alias("started_at"), F.when(k % 6 != 0, start + F.make_interval(secs=(k % 900).cast("decimal(18,6)"))).alias("finished_at"))
    tasks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") == 3, "failed").otherwise("done").alias("status"))
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    claims = docs.select(F.col("doc_id").alias("run_id"), F.col("doc_id").alias("source_id"), F.concat(F.substring("text", 3, 24), F.when(F.col("quality") == 1, "").otherwise("~zq")).alias("quote"))
    sources = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("extracted_text")).dropDuplicates(["id"])
    stats = e.select(F.col("ts").cast("timestamp").alias("recorded_at"), (F.col("event_id") % 100).alias("claims_bound"), F.from_json("props", "map<string,bigint>").alias("claims_dropped"))
    credits = e.select(F.col("ts").cast("timestamp").alias("spent_at"), (F.col("event_id") % 4 / 8).alias("credits_usd"))
    stored = table(spark, d, "documents").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return RUN.all_metrics(runs, tasks, claims, sources, stats, credits, stored, now).withColumn("value", F.round("value", 6))


def bench_scores(spark: SparkSession, d: str) -> DataFrame:
    """Orders as benchmark runs of their customers' queries, lines as the competitors of their reports, scored against ground truth."""
    k, o = F.col("c_custkey"), table(spark, d, "orders")
    domain = lambda x: F.concat(F.lit("s"), (x % 40).cast("string"), F.lit(".com"))
    fact = lambda x, attribute, value: F.struct(domain(x).alias("entity"), F.lit(attribute).alias("attribute"), value.alias("value"))
    facts = F.array(fact(k, "pricing.entry_usd_month", (k % 9).cast("string")), fact(k + 1, "pricing.model", F.lit(" Seat ")), fact(k + 2, "pricing.free_tier", F.when(k % 2 == 0, "true").otherwise("false")), fact(k, "company.stage", F.lit("seed")))
    ground = table(spark, d, "customer").filter("c_custkey % 11 != 0").select(k.alias("query_id"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(domain(k), domain(k + 1), domain(k))).alias("must_include"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(domain(k + 2), domain(k + 3))).alias("known_absent"), facts.alias("facts"))
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("query_id"), F.col("o_totalprice").alias("cost_usd"))
    li, s = table(spark, d, "lineitem"), F.col("l_suppkey") + F.col("l_linenumber")
    found = li.select(F.col("l_orderkey").alias("run_id"), F.concat(F.when(F.col("l_linenumber") == 5, "gh:").otherwise("web:"), domain(s)).alias("entity_key"), (s % 9).cast("double").alias("price"), F.when(s % 2 == 0, "seat").otherwise("flat").alias("model"), (s % 3 == 0).alias("free_tier"))
    out = BE.scored(runs, found, ground)
    return out.select("run_id", "query_id", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "fact_accuracy")))


def stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a stored cache: a tenth comes again later with a new state, some come again too early, some are new."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    row = lambda key, days, state: (key.alias("key"), (F.lit("2024-06-01").cast("timestamp") + F.make_interval(days=days.cast("int"))).alias("at"), state.alias("state"))
    name = f"cache_{uuid.uuid4().hex}"
    kept = ST.Keyed(spark, name, ["key"], parts=32, buckets=8)
    kept.create(c.select(*row(k, k % 20, F.lit("old"))), f"{shared_dir(spark)}/{name}")
    again = c.filter("c_custkey % 10 = 0").select(*row(k, k % 30, F.lit("again")))
    kept.upsert(again.unionByName(c.filter("c_custkey % 25 = 0").select(*row(k + 1_000_000, F.lit(1), F.lit("fresh")))), ST.keep_newest("at"))
    return kept.read().select("key", F.col("at").cast("string").alias("at"), "state")


def stored_retention(spark: SparkSession, d: str) -> DataFrame:
    """Events as a dated table of which the days before January 10th are dropped."""
    name = f"events_{uuid.uuid4().hex}"
    log = ST.Dated(spark, name, "ts", path=f"{shared_dir(spark)}/{name}")
    log.append(table(spark, d, "events").select("event_id", "ts", "user_id"))
    log.retain("2024-01-10")
    return log.read().groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def main_content(spark: SparkSession, d: str) -> DataFrame:
    """What is content on every page."""
    return CO.with_content(table(spark, d, "pages")).select("page_id", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("n_chars"), "blocks", "kept")


def conversation_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", SE.segmented(F.col("text")).alias("sentences"))


_CANONICAL = r"""
u AS (SELECT page_id, html, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS place,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'ref', 'source', 'mc_cid', 'mc_eid'))) AS kept FROM pages),
c AS (SELECT page_id, html, regexp_replace(regexp_replace(place, ':.*$', ''), '^www\.', '') AS host, path, scheme || '://' || place || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM u),
g AS (SELECT canonical_url, any_value(host) AS host, any_value(path) AS path, min(page_id) AS k, regexp_replace(arg_min(html, page_id), '<[^>]*>', ' ', 'g') AS t, arg_min(html, page_id) AS html FROM c GROUP BY 1),
o AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'hit' WHEN regexp_matches(host, '(^|\.)(g2\.com|capterra\.com)$') THEN 'no_crawl' WHEN length(host) % 3 = 0 AND starts_with(path, '/fr') THEN 'robots' WHEN k % 7 = 6 THEN 'timeout'
    WHEN k % 5 = 1 THEN 'miss' WHEN k % 4 = 1 AND k % 3 = 0 THEN 'conditional_304' WHEN k % 11 = 3 THEN 'content_type'
    WHEN t IS NULL OR t = '' OR (length(t) < 200 AND regexp_matches(lower(t || ' ' || substr(html, 1, 2000)), 'accept cookies|cookie consent|we use cookies|manage preferences|accept all cookies')) THEN 'thin' ELSE 'miss' END AS outcome FROM g),
r AS (SELECT *, CASE WHEN outcome IN ('hit', 'conditional_304') THEN 200 WHEN outcome = 'miss' THEN CASE WHEN k % 5 = 1 THEN 404 ELSE 200 END END AS http_status,
    CASE WHEN outcome IN ('hit', 'conditional_304') THEN 'text ' || k WHEN outcome = 'miss' AND k % 5 <> 1 THEN t END AS text FROM o)
"""
_DISCOVERED = r"""
h AS (SELECT page_id, page_id % 3 AS run_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS value FROM pages),
c AS (SELECT run_id, 'web' AS scheme, value, count(*) AS hits, min(page_id % 10 + 1000 * (page_id % 2)) AS best, coalesce(arg_min('s' || page_id, page_id) FILTER (WHERE page_id % 3 <> 0), '') AS snippet, min(page_id) AS ord FROM h WHERE value <> '' GROUP BY 1, 3
  UNION ALL SELECT p_partkey % 3, 'gh', 'x/tool' || p_partkey, 2, p_partkey, '', p_partkey + 1099511627776 FROM part WHERE p_partkey % 4 <> 0),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY hits DESC, best, ord) <= 24),
k AS (SELECT *, CASE WHEN scheme = 'web' THEN regexp_extract(value, '([^.]+\.[a-z]+)$', 1) ELSE value END AS key, CASE WHEN scheme = 'gh' THEN substr(value, 7)::BIGINT END AS p FROM t),
v AS (SELECT * FROM k WHERE CASE WHEN scheme = 'web' THEN key <> 'example.net' ELSE p % 5 <> 0 END),
w AS (SELECT *, CASE WHEN scheme = 'web' THEN 'web:' || key WHEN p % 7 = 0 THEN 'web:example.com' ELSE 'gh:' || key END AS entity_key FROM v),
o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY run_id, entity_key ORDER BY hits DESC, best, ord) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY hits * 3.0::DOUBLE - best * 0.1::DOUBLE + CASE WHEN starts_with(entity_key, 'gh:') AND p * 10 < HOBBY THEN 0 ELSE 2 END DESC, ord) AS place FROM o),
s AS (SELECT run_id, CASE WHEN starts_with(entity_key, 'gh:') THEN 'oss:' WHEN place <= 8 THEN 'profile:' ELSE 'pricing:' END || entity_key AS node_key, CASE WHEN starts_with(entity_key, 'gh:') THEN 'oss_profile' WHEN place <= 8 THEN 'profile_product' ELSE 'extract_pricing' END AS kind, entity_key,
    CASE WHEN place <= 8 AND NOT starts_with(entity_key, 'gh:') AND snippet <> '' THEN snippet END AS snippet, (CASE WHEN place <= 8 AND NOT starts_with(entity_key, 'gh:') THEN 2 ELSE 1 END)::BIGINT AS weight FROM r WHERE place <= 16
  UNION ALL SELECT run_id, 'funding:' || entity_key, 'find_funding', entity_key, NULL, 1 FROM r WHERE place <= 3)
""".replace("HOBBY", str(fixed.HOBBY_STARS))
_RULES = ", ".join(f"('{r.lstrip('!').removeprefix('*.')}', {int(r[0] == '*')}, {str(r[0] == '!').lower()}, {str(p).lower()})" for rules, p in ((X.PUBLIC, False), (X.PRIVATE, True)) for r in rules)
SQL = {
    "fetch_outcomes": f"WITH {_CANONICAL} SELECT page_id, canonical_url, outcome, http_status::BIGINT AS http_status, sha256(text) AS text_hash FROM c JOIN r USING (canonical_url)",
    "fetch_cache": f"""
WITH {_CANONICAL}
SELECT canonical_url, CASE WHEN k % 4 < 2 AND outcome <> 'miss' THEN 'old' ELSE regexp_extract(host, '([^.]+\\.[a-z]+)$', 1) END AS root_key, CASE WHEN outcome = 'miss' THEN http_status ELSE 200 END::BIGINT AS http_status,
  CASE WHEN outcome = 'miss' THEN sha256(text) ELSE sha256(k::VARCHAR) END AS content_hash, CASE WHEN outcome = 'miss' THEN CASE WHEN http_status = 200 THEN 'e0' END ELSE 'e' || (k % 3) END AS etag,
  CASE WHEN outcome = 'miss' THEN 'fetch' ELSE 'old' END AS retrieval_reason,
  CASE WHEN outcome = 'conditional_304' OR (outcome = 'miss' AND http_status = 200) THEN '2024-07-07 00:00:00' WHEN outcome = 'miss' OR k % 4 = 0 THEN '2024-07-01 00:00:00' ELSE '2024-06-29 00:00:00' END AS expires
FROM r WHERE k % 4 < 2 OR outcome = 'miss'""",
    "path_guesses": """
WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.com' AS root_key, s_suppkey % 3 AS m, s_suppkey % 5 = 0 AND s_suppkey % 10 < 5 AS known FROM supplier),
p AS (SELECT k, m, unnest(CASE m WHEN 0 THEN ['/pricing', '/plans', '/pricing-plans', '/price'] WHEN 1 THEN ['/docs', '/documentation', '/developers', '/api'] ELSE ['/changelog', '/releases', '/whats-new', '/blog/changelog'] END) AS path, unnest([0, 1, 2, 3]) AS pos FROM s WHERE NOT known),
f AS (SELECT k, min(pos) AS place, arg_min(path, pos) AS path FROM p WHERE (k + pos) % 5 < 2 AND (m <> 0 OR (k + pos) % 2 = 0) GROUP BY k)
SELECT root_key, CASE m WHEN 0 THEN 'pricing' WHEN 1 THEN 'docs' ELSE 'changelog' END AS kind, CASE WHEN known THEN CASE WHEN k % 2 = 0 THEN '/known' END ELSE path END AS found_path, known AS from_cache,
  CASE WHEN known THEN 0 ELSE coalesce(place + 1, 4) END::BIGINT AS tried, (path IS NOT NULL AND NOT known)::BIGINT AS hits, CASE WHEN NOT known THEN CASE WHEN path IS NULL THEN '2024-07-01 00:00:00' ELSE '2024-07-07 00:00:00' END END AS expires
FROM s LEFT JOIN f USING (k)""",
    "discover_tasks": f"WITH {_DISCOVERED} SELECT * FROM s",
    "discover_stats": f"""
WITH {_DISCOVERED}
SELECT run_id, (SELECT count(*) FROM c WHERE c.run_id = x.run_id) AS candidates_seen, (SELECT count(*) FROM t WHERE t.run_id = x.run_id) AS candidates_checked, (SELECT count(*) FROM r WHERE r.run_id = x.run_id) AS entities_verified, 0::BIGINT AS insufficient_signal, (SELECT count(*) FROM s WHERE s.run_id = x.run_id) AS spawned
FROM (SELECT DISTINCT run_id FROM c) x""",
    "path_rates": """
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 AS m FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 10 < 5)),
p AS (SELECT k, m, unnest(CASE m WHEN 0 THEN ['/pricing', '/plans', '/pricing-plans', '/price'] WHEN 1 THEN ['/docs', '/documentation', '/developers', '/api'] ELSE ['/changelog', '/releases', '/whats-new', '/blog/changelog'] END) AS path, unnest([0, 1, 2, 3]) AS pos FROM s),
g AS (SELECT *, (k + pos) % 5 < 2 AND (m <> 0 OR (k + pos) % 2 = 0) AS good FROM p),
f AS (SELECT k, min(pos) AS place FROM g WHERE good GROUP BY k)
SELECT CASE m WHEN 0 THEN 'pricing' WHEN 1 THEN 'docs' ELSE 'changelog' END AS kind, path, count(*) AS tried, count(*) FILTER (good) AS hits, round(count(*) FILTER (good) / count(*)::DOUBLE, 9) AS rate
FROM g LEFT JOIN f USING (k) WHERE place IS NULL OR pos <= place GROUP BY 1, 2""",
    "search_ledger": """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 500 < 100 AND event_id % 2 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 4 / 8.0::DOUBLE END AS cost, event_id % 500 < 100 AND event_id % 2 = 0 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, event_id, cost AS paid, CASE WHEN cost > 0 THEN [struct_pack(ts := ts, c := cost)] ELSE [] END AS q FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN s < 0.5 THEN cost ELSE 0 END, CASE WHEN s < 0.5 AND cost > 0 THEN list_append(q, struct_pack(ts := ts, c := cost)) ELSE q END
  FROM (SELECT e.*, list_filter(r.q, lambda x: x.ts >= e.ts - INTERVAL 24 HOURS) AS q, coalesce(list_sum(list_transform(list_filter(r.q, lambda x: x.ts >= e.ts - INTERVAL 24 HOURS), lambda x: x.c)), 0) AS s FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) e)
SELECT event_id % 50 AS run_id, count(*) AS n, sum(paid)::DOUBLE AS usd FROM r WHERE paid > 0 GROUP BY 1""",
    "all_metrics": """
WITH r AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE / 1000000 AS cost, o_orderkey % 40 AS age, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 900)::DOUBLE END AS secs FROM orders), n AS (SELECT * FROM r WHERE age < 30),
m AS (SELECT 'runs_today' AS key, (count(*) FILTER (age = 0))::DOUBLE AS value, 'runs' AS unit, 4.0::DOUBLE AS threshold, 'degradation' AS alert_level FROM r
  UNION ALL SELECT 'cost_per_run_mean', avg(cost), 'USD', 0.1242, 'degradation' FROM n
  UNION ALL SELECT 'search_spend_mtd', coalesce(sum(event_id % 4 / 8.0::DOUBLE), 0), 'USD', 7.0, 'degradation' FROM events WHERE ts >= TIMESTAMP '2024-01-01'
  UNION ALL SELECT 'sentence_binding_rate', count(*) FILTER (contains(text, substr(text, 3, 24) || CASE WHEN quality = 1 THEN '' ELSE '~zq' END)) / nullif(count(*), 0)::DOUBLE, 'fraction', 1.0, 'page' FROM labels JOIN documents USING (doc_id) JOIN n ON n.id = doc_id WHERE text IS NOT NULL AND doc_id % 4 <> 0
  UNION ALL SELECT 'extraction_drop_rate', sum(k) / (sum(k) + sum(b))::DOUBLE, 'fraction', 0.3, 'degradation' FROM (SELECT event_id % 100 AS b, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 30 DAYS)
  UNION ALL SELECT 'p95_run_latency_s', percentile_cont(0.95) WITHIN GROUP (ORDER BY secs), 'seconds', 512.0, 'degradation' FROM n WHERE secs IS NOT NULL
  UNION ALL SELECT 'task_failure_rate', count(*) FILTER (l_linenumber = 3) / nullif(count(*), 0)::DOUBLE, 'fraction', 0.1, 'degradation' FROM lineitem JOIN n ON l_orderkey = n.id
  UNION ALL SELECT 'db_size_pct', sum(strlen(text)) / 524288000.0::DOUBLE, 'fraction', 0.7, 'degradation' FROM documents)
SELECT key, round(value, 6) AS value, unit, threshold, alert_level, coalesce(CASE WHEN key = 'sentence_binding_rate' THEN value < threshold ELSE value > threshold END, false) AS breached FROM m""",
    "bench_scores": """
WITH w AS (SELECT l_orderkey AS run_id, 's' || ((l_suppkey + l_linenumber) % 40) || '.com' AS domain, min(struct_pack(price := ((l_suppkey + l_linenumber) % 9)::DOUBLE, model := CASE WHEN (l_suppkey + l_linenumber) % 2 = 0 THEN 'seat' ELSE 'flat' END, free_tier := (l_suppkey + l_linenumber) % 3 = 0)) AS c FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1, 2),
a AS (SELECT o_orderkey AS run_id, o_custkey AS k, o_custkey % 11 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS known, 's' || (o_custkey % 40) || '.com' AS d0, 's' || ((o_custkey + 1) % 40) || '.com' AS d1, 's' || ((o_custkey + 2) % 40) || '.com' AS d2, 's' || ((o_custkey + 3) % 40) || '.com' AS d3 FROM orders),
j AS (SELECT a.*, w0.c AS c0, w1.c AS c1, w2.c AS c2, w3.c AS c3 FROM a LEFT JOIN w w0 ON w0.run_id = a.run_id AND w0.domain = d0 LEFT JOIN w w1 ON w1.run_id = a.run_id AND w1.domain = d1 LEFT JOIN w w2 ON w2.run_id = a.run_id AND w2.domain = d2 LEFT JOIN w w3 ON w3.run_id = a.run_id AND w3.domain = d3)
SELECT run_id, k AS query_id, CASE WHEN NOT known OR k % 5 = 0 THEN 1.0::DOUBLE ELSE round(((c0 IS NOT NULL)::INT + (c1 IS NOT NULL)::INT) / 3.0::DOUBLE, 9) END AS recall,
  CASE WHEN NOT known OR k % 4 = 0 THEN 1.0::DOUBLE ELSE 1 - ((c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT) / 2.0::DOUBLE END AS precision,
  CASE WHEN NOT known THEN 1.0::DOUBLE ELSE (coalesce(abs(k % 9 - c0.price) <= 1, false)::INT + coalesce(c1.model = 'seat', false)::INT + coalesce(c2.free_tier = (k % 2 = 0), false)::INT) / 4.0::DOUBLE END AS fact_accuracy
FROM j""",
    "stored_upsert": """
WITH o AS (SELECT c_custkey AS key, TIMESTAMP '2024-06-01' + to_days((c_custkey % 20)::INT) AS at, 'old' AS state FROM customer),
n AS (SELECT c_custkey AS key, TIMESTAMP '2024-06-01' + to_days((c_custkey % 30)::INT) AS at, 'again' AS state FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, TIMESTAMP '2024-06-02', 'fresh' FROM customer WHERE c_custkey % 25 = 0)
SELECT key, strftime(CASE WHEN o.key IS NULL OR n.at > o.at THEN n.at ELSE o.at END, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN o.key IS NULL OR n.at > o.at THEN n.state ELSE o.state END AS state FROM o FULL JOIN n USING (key)""",
    "stored_retention": "SELECT user_id, count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1",
    "suffix_rules": f"""
WITH rules(s, more, but, private) AS (VALUES {_RULES}),
h AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a.t' || (c_custkey % 50) || '.' WHEN 1 THEN 'T' || (c_custkey % 7) || '.' ELSE '' END || ['example.co.uk', 'b.ck', 'www.ck', 'github.io', 'city.kawasaki.jp', 'foo.kawasaki.jp', 'kobe.jp', 'us.compute.amazonaws.com', 'unknown.zz', 'com', 'co.uk', '10.0.0.1', 'a..com'][(c_custkey % 13 + 1)::INT] AS host FROM customer),
l AS (SELECT c_custkey, host, string_split(lower(host), '.') AS l, NOT list_contains(string_split(lower(host), '.'), '') AND regexp_matches(host, '[A-Za-z][A-Za-z0-9-]*$') AND NOT regexp_matches(host, '[0-9]$') AS sound FROM h),
e AS (SELECT c_custkey, l, k, array_to_string(l[len(l) - k + 1:], '.') AS s FROM (SELECT *, unnest(generate_series(1, len(l))) AS k FROM l WHERE sound)),
m AS (SELECT c_custkey, more, but, private, k FROM e JOIN rules USING (s) WHERE k + more <= len(l)),
z AS (SELECT c_custkey, coalesce(max(k - 1) FILTER (but), max(k + more)) AS a, coalesce(max(k - 1) FILTER (but AND NOT private), max(k + more) FILTER (NOT private)) AS p FROM m GROUP BY 1),
n AS (SELECT l.*, coalesce(a, 1) AS a, coalesce(p, 1) AS p FROM l LEFT JOIN z USING (c_custkey)),
x AS (SELECT *, CASE WHEN sound THEN array_to_string(l[len(l) - a + 1:], '.') END AS suffix, CASE WHEN sound AND len(l) > a THEN array_to_string(l[len(l) - a:], '.') END AS web_key, CASE WHEN sound AND len(l) > p THEN array_to_string(l[len(l) - p:], '.') END AS public_key FROM n)
SELECT c_custkey, host, suffix, web_key, public_key, web_key IS DISTINCT FROM public_key AS shared, true AS same FROM x""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "main_content", "conversation_sentences"]}  # these two are held against plain versions in the tests
