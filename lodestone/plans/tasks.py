"""Entities, evidence tasks, schedules, reports and benchmark summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import prompts as PR
from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import bench as B
from lodestone.operators import claims as C
from lodestone.operators import discover as D
from lodestone.operators import entities as N
from lodestone.operators import evidence as E
from lodestone.operators import ledger as L
from lodestone.operators import planner as PL
from lodestone.operators import report as P
from lodestone.operators import runs as RUN
from lodestone.operators import schedule as SC
from lodestone.operators import tables as X
from lodestone.operators.work import dealt
from lodestone.plans._common import now, table
from lodestone.sources import pages as PG
from lodestone.sources import replay as R
from lodestone.streaming import events as EV

RESULT = ["entity_key", "verified", "grade", "reason", "homepage_url", "repository_url"]


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _text(c: Column) -> Column:
    return c.cast("string")


# ---- entities


def _responses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, p = F.col("p_partkey"), table(spark, d, "part")
    key = [_pick(fixed.SCHEMES, k % 8).alias("scheme"), F.concat(F.lit("v"), _text(k)).alias("value")]
    body = F.concat(F.repeat(F.lit("word "), F.col("p_size")), F.when(k % 29 == 0, "Buy this domain").otherwise(""))
    rows = p.filter("p_partkey % 9 != 0").select(
        *key, F.when(k % 23 == 0, "ConnectError").alias("error"), _pick([200, 200, 404, 500], F.floor(k / 8) % 4).alias("status"), body.alias("text"), F.when(k % 2 == 0, F.concat(F.lit("https://h"), _text(k))).otherwise("").alias("homepage"),
        F.when(k % 3 == 0, F.array(F.lit("https://example.org"), F.concat(F.lit("https://GitHub.com/o/"), _text(k)))).otherwise(F.array(F.lit("https://example.org"))).alias("repositories"), (k % 3).cast("int").alias("n_results"), F.when(k % 5 == 0, F.array(F.lit(200))).otherwise(F.array(F.lit(404))).alias("more_status"),
    )
    return p.select(*key), rows


def verify_entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts as keys of all schemes with recorded answers; some are in the cache, fresh or not, some have no answer."""
    keys, responses = _responses(spark, d)
    cache = keys.filter("cast(substring(value, 2) as int) % 10 = 0").select(F.concat_ws(":", "scheme", "value").alias("entity_key"), F.lit(False).alias("verified"), F.lit("A").alias("grade"), F.lit("cached").alias("reason"), F.lit(None).cast("string").alias("homepage_url"), F.lit(None).cast("string").alias("repository_url"), F.when(F.expr("cast(substring(value, 2) as int) % 20 = 0"), now() + F.expr("interval 1 hour")).otherwise(now() - F.expr("interval 1 hour")).alias("expires_at"))
    return N.verify(keys, responses, cache, now())[0].select(*RESULT)


def verification_cache(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of the answers, failures too, and until when."""
    keys, responses = _responses(spark, d)
    none = spark.createDataFrame([], "entity_key string, verified boolean, grade string, reason string, homepage_url string, repository_url string, expires_at timestamp_ntz")
    return N.verify(keys, responses, none, now())[1].select("entity_key", "verified", "reason", _text(F.col("expires_at")).alias("expires_at"))


def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as web entities, parts as repositories whose homepage is one of them: merged, tiered, named by the canonical key."""
    k = F.col("k")
    null = lambda kind: F.lit(None).cast(kind)
    web = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).select(F.lit("web").alias("scheme"), F.concat(F.lit("https://www.s"), _text(k), F.lit(".com/x")).alias("raw_value"), F.concat(F.lit("S"), _text(k)).alias("display_name"), k.alias("ord"), null("string").alias("homepage_url"), null("bigint").alias("stars"))
    gh = table(spark, d, "part").select(F.col("p_partkey").alias("k")).select(F.lit("gh").alias("scheme"), F.concat(F.lit("https://github.com/Own"), _text(k % 9), F.lit("/Repo"), _text(k), F.lit(".git")).alias("raw_value"), F.concat(F.lit("P"), _text(k)).alias("display_name"), k.alias("ord"), F.when(k % 6 != 0, F.concat(F.lit("https://s"), _text(k % 150), F.lit(".com"))).alias("homepage_url"), k.alias("stars"))
    rows = web.unionByName(gh)
    evidence = rows.select("*", *(null("string").alias(c) for c in ("backlink_repo", "repository_url", "stage")), *(null("bigint").alias(c) for c in ("domain_age_days", "installs", "downloads")), null("double").alias("star_velocity"), null("date").alias("last_commit_at"), F.lit(False).alias("has_funding"))
    keys = evidence.select("scheme", N.derived_key(F.col("scheme"), F.col("raw_value")).alias("value"), "ord").withColumn("entity_key", F.concat_ws(":", "scheme", "value"))
    results = keys.select("entity_key", "scheme", "value", (F.col("ord") % 7 != 0).alias("verified"), F.lit("A").alias("grade"), null("string").alias("homepage_url"), null("string").alias("repository_url"))
    old = spark.createDataFrame([("web:s1.com", "Old", "hobby", {"kept": "x", "maturity_rule": "old"}), ("web:other.com", "Other", "indie", {"kept": "y"})], "entity_key string, display_name string, maturity string, meta map<string,string>")
    entities, _ = N.resolve(evidence, results, old, now())
    return entities.select("entity_key", "display_name", "maturity", F.col("meta")["maturity_rule"].alias("rule"), F.col("meta")["kept"].alias("kept"))


# ---- evidence


def _sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("source_id"), F.lit("r").alias("run_id"), (F.col("doc_id") % 10).alias("entity_id"), F.concat(F.lit("https://d"), _text(F.col("doc_id")), F.lit(".com")).alias("canonical_url"), (now() - F.make_interval(days=(F.col("doc_id") % 60).cast("int"))).alias("fetched_at"), F.col("text").alias("extracted_text"), F.sha2("text", 256).alias("content_hash"), "n_chars")


def _cache(sources: DataFrame) -> DataFrame:
    t, n = F.col("extracted_text"), F.lit(None).cast("double")
    made = lambda attribute, text, num, quote: F.struct(F.lit(attribute).alias("attribute"), text.alias("value_text"), num.alias("value_num"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("date").alias("as_of"), quote.alias("quote"))
    claims = F.array(made("company.stage", F.lit("seed"), n, F.substring(t, 11, 30)), made("oss.stars", F.lit(None).cast("string"), F.when(F.col("n_chars") % 3 != 0, F.col("n_chars").cast("double")), F.substring(t, 1, 15)), made("made.up", F.lit("x"), n, F.substring(t, 1, 9)), made("pricing.model", F.lit("flat"), n, F.substring(t, 21, 5)))
    return sources.filter("source_id % 4 != 0").select("content_hash", F.lit("v1").alias("extractor_version"), claims.alias("claims")).dropDuplicates(["content_hash"])


def extract_cached(spark: SparkSession, d: str) -> DataFrame:
    """Raw claims of the extraction cache, gated against their source each time."""
    s = _sources(spark, d)
    return E.extract(s, _cache(s), F.lit("v1")).select("source_id", "attribute", F.coalesce("drop_reason", F.lit("kept")).alias("outcome"), F.col("char_start").cast("long").alias("char_start"))


def not_extracted(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    return E.not_extracted(s, _cache(s), F.lit("v1")).select("source_id")


def persist_claims(spark: SparkSession, d: str) -> DataFrame:
    """Bound claims, graded, scored and inserted where none stands yet."""
    s = _sources(spark, d)
    gated = E.extract(s, _cache(s), F.lit("v1"))
    old = s.filter("source_id % 5 = 0").select("run_id", "source_id", F.lit("company.stage").alias("attribute"), F.lit(10).alias("char_start"))
    out = E.persist(old, gated, _pick(["A", "B", "C"], F.col("source_id") % 3), now())
    return out.select("source_id", "attribute", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.col("context_offset").cast("long").alias("context_offset"), "grade", F.round("confidence", 9).alias("confidence"))


def snippet_claims(spark: SparkSession, d: str) -> DataFrame:
    """What a snippet may claim (no prices), and what a funding page may (funding only)."""
    s = _sources(spark, d)
    kept = E.extract(s, _cache(s), F.lit("v1")).filter("drop_reason is null")
    mark = lambda df, use: df.select("source_id", "attribute", F.lit(use).alias("use"))
    return X.union(mark(E.without_prices(kept), "snippet"), mark(E.funding_claims(kept), "funding"))


def _repos(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("source_id"), F.concat(F.lit("own"), _text(F.col("p_size")), F.lit("/repo"), _text(k)).alias("repo"), (k * 13 % 7000).alias("stars"), F.when(k % 3 != 0, "MIT").alias("license"), F.when(k % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))).alias("last_commit"), F.when(k % 5 != 0, (k % 1000) / 64).alias("velocity"))


def oss_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as repositories: a synthetic source each, up to five claims bound to it."""
    rows = E.oss_sourced(_repos(spark, d)).withColumn("run_id", F.lit("r")).withColumn("as_of", F.lit(None).cast("date")).withColumn("fetched_at", now())
    none = spark.createDataFrame([], "run_id string, source_id long, attribute string, char_start int").limit(0)  # seen to be empty, so nothing is joined with it
    out = E.persist_structured(none, rows, F.lit("A"), now())
    return out.select("source_id", "attribute", "value_text", "value_num", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.round("confidence", 9).alias("confidence"))


def _community(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    hits = c.select(_pick(["hn", "stackexchange", "github"], F.col("turn") % 3).alias("venue"), F.col("role").alias("keyword"), "conv_id", "turn", F.substring("text", 1, 40).alias("title"), F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("http://u/"), _text(F.col("conv_id")))).alias("url"), (F.col("conv_id") % 50).alias("points"), F.col("turn").alias("n_comments"), F.lit(" b ").alias("body"), F.concat(F.lit("o/r"), _text(F.col("conv_id") % 5)).alias("repo"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("venue", "keyword").orderBy("conv_id", "turn")) - 1)


def community_documents(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as hits of three venues: a document per venue and keyword, of its share of the threads."""
    return E.community_docs(_community(spark, d), "run", 2, 3).select("canonical_url", "root_key", "text")


def synthetic_sources(spark: SparkSession, d: str) -> DataFrame:
    """Community documents beside those of an earlier day: fresh and the same stay, the rest is renewed."""
    docs = E.community_docs(_community(spark, d), "run", 2, 3)
    early = now() - F.expr("interval 2 days")
    old = docs.select("canonical_url", "root_key", F.col("text").alias("extracted_text"), F.sha2(F.when(F.col("root_key") == "github", "changed").otherwise(F.col("text")), 256).alias("content_hash"), F.lit(200).alias("http_status"), early.alias("fetched_at"), F.when(F.col("root_key") == "hn", now() + F.expr("interval 1 day")).when(F.col("root_key") == "github", now() + F.expr("interval 1 day")).otherwise(early).alias("ttl_expires_at"), "retrieval_reason")
    out = E.synthetic_sources(old.unionByName(old.limit(1).withColumn("canonical_url", F.lit("https://gone"))), docs, now())
    return out.select("canonical_url", _text(F.col("fetched_at")).alias("fetched_at"), _text(F.col("ttl_expires_at")).alias("expires")).filter("canonical_url != 'https://gone'")


def _web(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("entity_id"), F.concat(F.when(k % 4 == 0, "gh:").otherwise("web:"), F.lit("s"), _text(k), F.lit(".com")).alias("entity_key"))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = [table(spark, d, "supplier").select(F.concat(F.lit("s"), _text(k), F.lit(".com")).alias("root_key"), F.lit(kind).alias("path_kind"), k.alias("k"), F.posexplode(F.array(*map(F.lit, paths))).alias("pos", "path")) for kind, paths in fixed.PATHS.items()]
    return X.union(*rows).withColumn("ok", (F.col("k") + F.col("pos") + F.length("path_kind")) % 3 == 0)


def profile_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that profiling reads of each supplier's site."""
    return E.profile_pages(_web(spark, d), _attempts(spark, d)).select("entity_id", "path", "url")


def pricing_pages(spark: SparkSession, d: str) -> DataFrame:
    return E.pricing_page(_web(spark, d), _attempts(spark, d)).select("entity_id", "path", "url")


def page_claims(spark: SparkSession, d: str) -> DataFrame:
    """Fetched pages with cached extractions: claims graded by the kind of page."""
    s = _sources(spark, d).withColumn("http_status", F.when(F.col("source_id") % 6 == 0, 404).otherwise(200))
    pages = s.select(F.col("canonical_url").alias("url"), _pick(["/", "/pricing", "/blog/post", "/changelog/"], F.col("source_id") % 4).alias("path"))
    return E.page_claims(pages, s, _cache(s), F.lit("v1")).filter("drop_reason is null").select("source_id", "attribute", "grade")


def trend_signals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    words = ["view", "click", "no posts", "error", "purchase", "signup"]
    keywords = spark.createDataFrame(list(enumerate(words)), "pos int, keyword string")
    views = R.twelve_months(e.filter("event_type != 'click'").groupBy(F.initcap("event_type").alias("article")).agg(F.collect_list(F.struct(F.lit("2024040100").alias("timestamp"), (F.col("event_id") % 3).alias("views"))).alias("items")))
    return E.trends(e.select(F.col("event_type").alias("keyword")), views, keywords)


def funding_queries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", E.funding_query(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise(""), F.lit("x.com")).alias("query"))


def discover_competitors(spark: SparkSession, d: str) -> DataFrame:
    """Pages as search results of two variants, parts as repositories that were found: candidates, places, and the tasks they lead to."""
    h = table(spark, d, "pages").select("url", F.lit("").alias("title"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), _text(F.col("page_id")))).alias("snippet"), (F.col("page_id") % 10).alias("rank"), (F.col("page_id") % 2).alias("variant"), F.lit(1).alias("weight"), F.col("page_id").alias("ord"))
    repos = table(spark, d, "part").filter("p_partkey < 12").select(F.concat(F.when(F.col("p_partkey") % 4 == 0, "x/awesome-").otherwise("x/tool"), _text(F.col("p_partkey"))).alias("full_name"), F.when(F.col("p_partkey") == 5, "A curated list").otherwise("fine").alias("description"), F.col("p_partkey").alias("rank"))
    found = D.top_candidates(D.seed_repositories(D.aggregate_hits(h), repos))
    entities = found.select(F.concat_ws(":", "scheme", "value").alias("entity_key"), F.concat_ws(":", "scheme", "value").alias("entity_id"), "hit_count", "best_rank", "snippet", F.when(F.col("ord") % 5 == 0, "hobby").alias("maturity"), "ord")
    return D.spawned(D.ranked(entities), funding=True).withColumn("weight", F.col("weight").cast("long"))


# ---- caches and ledgers


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations")
    key = X.cache_key((F.col("conv_id") % 40).alias("prompt"), F.lit("m").alias("model"))
    requests = c.select((F.col("conv_id") % 7).alias("run_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("task_id"), F.lit("m").alias("model"), key.alias("cache_key"), (F.col("conv_id") % 40).alias("p"))
    responses = spark.range(25).select(X.cache_key(F.col("id").alias("prompt"), F.lit("m").alias("model")).alias("cache_key"), F.concat(F.lit("c"), _text(F.col("id"))).alias("content"), *(F.lit(n).alias(c) for c, n in (("input_tokens", 10), ("output_tokens", 5), ("cached_tokens", 0))))
    return requests, responses


def llm_cache(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are kept, with their ledger rows, which cost nothing."""
    requests, responses = _requests(spark, d)
    return L.llm_ledger(requests, responses)[0].select("task_id", "cache_key", "content", "cost_usd", "cache_hit")


def llm_misses(spark: SparkSession, d: str) -> DataFrame:
    requests, responses = _requests(spark, d)
    return L.llm_ledger(requests, responses)[1].select("cache_key")


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    requests, responses = _requests(spark, d)
    hits, _ = L.llm_ledger(requests, responses)
    asked = requests.filter("p >= 25").withColumn("cost_usd", F.col("p") / 64).withColumn("cache_hit", F.lit(False))
    calls = X.union(hits.select("run_id", "cost_usd", "cache_hit"), asked.select("run_id", "cost_usd", "cache_hit"))
    searches = table(spark, d, "events").select((F.col("user_id") % 9).alias("run_id"), F.lit(0.0625).alias("credits_usd"))
    return RUN.run_totals(spark.range(9), calls, searches)


def repaired_usage(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as requests, turns as attempts: the last answer, and the tokens of all."""
    c = table(spark, d, "conversations")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("role").alias("content")).alias("message"))).alias("choices"), F.struct(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), F.struct((F.col("turn") % 3).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage")))
    return L.repaired_usage(c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("attempt"), body.alias("body")))


def search_route(spark: SparkSession, d: str) -> DataFrame:
    """Events as search requests of providers: hits, failures, and refusals once a day's allowance is spent."""
    e = table(spark, d, "events")
    r = e.select(F.col("user_id").alias("provider"), (F.col("event_id") % 500).alias("query"), F.col("event_id").alias("ord"), F.col("ts").alias("at"), (F.col("event_id") % 4 / 8).alias("cost"), F.when(F.col("event_id") % 13 == 0, "ProviderError").alias("error"))
    cache = spark.range(100).select(F.col("id").alias("query"), F.when(F.col("id") % 2 == 0, now() + F.expr("interval 1 hour")).otherwise(now() - F.expr("interval 1 hour")).alias("expires_at"))
    return R.route(r, cache, now(), 0.5).select("ord", "hit", "charged", "degraded", "reason")


def month_spend(spark: SparkSession, d: str) -> DataFrame:
    """Credits of the last day's month by user, and none for users without any."""
    e = table(spark, d, "events").select("user_id", "ts", (F.col("event_id") % 17 / 16).alias("usd"))
    return L.spent(e, "usd", keys=["user_id"], since=F.lit("2024-01-15").cast("timestamp_ntz"), at="ts")


def conditional_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Stale sources and what their servers said: unchanged, changed, failed, or nothing."""
    k = F.col("doc_id")
    stale = table(spark, d, "documents").select(F.concat(F.lit("u"), _text(k)).alias("canonical_url"), F.col("lang").alias("extracted_text"), F.lit("e0").alias("etag"), F.sha2("lang", 256).alias("content_hash"), (now() - F.expr("interval 1 day")).alias("ttl_expires_at"))
    responses = table(spark, d, "documents").filter("doc_id % 5 != 0").select(F.concat(F.lit("u"), _text(k)).alias("canonical_url"), _pick([304, 200, 503], k % 3).alias("status"), F.col("source").alias("text"), F.lit("e1").alias("etag"))
    return PG.refresh(stale, responses, now()).select("canonical_url", "extracted_text", "etag", "content_hash", _text(F.col("ttl_expires_at")).alias("expires"))


# ---- schedules


def _leased(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks of customers, each after the one before."""
    k, s = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    status = F.when(k % 7 == 0, "failed").when(k % 3 == 0, "done").when(k % 5 == 0, "running").otherwise("pending")
    o = table(spark, d, "orders").withColumn("before", F.lag("o_orderkey").over(s))
    return o.select(F.col("o_custkey").alias("run_id"), k.alias("id"), _text(k).alias("node_key"), F.when(F.col("before").isNull() | (k % 2 == 0), F.array().cast("array<string>")).otherwise(F.array(_text(F.col("before")))).alias("depends_on"), status.alias("status"), (k % 4).alias("priority"), F.when(k % 5 == 0, "t").alias("lease_token"), F.when(k % 5 == 0, F.when(k % 2 == 0, now() - F.expr("interval 1 minute")).otherwise(now() + F.expr("interval 1 minute"))).alias("lease_expires_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))


def next_tasks(spark: SparkSession, d: str) -> DataFrame:
    return SC.next_tasks(_leased(spark, d))


def claim_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks after each run's next one is claimed."""
    return SC.claim(_leased(spark, d), F.lit("new"), now())[0].select("id", "status", "lease_token", F.col("attempts").cast("long").alias("attempts"))


def task_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Leases that are over are freed, runs that took too long end, and what can't be reached is skipped."""
    t = SC.sweep(_leased(spark, d), now())
    t = SC.skip_rest(t, table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("run_id")))
    return SC.skip_unreachable(t).select("id", "status", "error")


def executor_coverage(spark: SparkSession, d: str) -> DataFrame:
    return RUN.executor_coverage(_leased(spark, d)).select("run_id", F.round("coverage", 9).alias("coverage"))


def throttled(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests to hosts, a quarter of a second apart at least."""
    e = table(spark, d, "events").select("event_id", F.concat("event_type", _text(F.col("user_id") % 2)).alias("host"), (F.col("event_id") % 997 / 8).alias("at"))
    return SC.throttled(e, "host", "at", "event_id").select("event_id", "starts")


def dispatch_waves(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as tasks, every third after the first: depth, and wave within the slots of a service."""
    n = F.col("l_linenumber")
    lines = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", each=SC.TASKS_EACH).distinct()  # an order's lines lie in one part
    deps = F.when(n > 4, F.array(_text(n - 3), F.lit("1"))).when(n > 2, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
    have = F.collect_set(_text(n)).over(Window.partitionBy("l_orderkey"))
    t = lines.withColumn("have", have).select(F.col("l_orderkey").alias("run_id"), _text(n).alias("node_key"), F.array_intersect(deps, F.col("have")).alias("depends_on"), F.when(n % 2 == 0, "crawl").otherwise("search").alias("service"), n.alias("priority"))
    return SC.dispatch_waves(t, {"crawl": 2, "search": 1}).select("run_id", "node_key", F.col("depth").cast("long").alias("depth"), F.col("wave").cast("long").alias("wave"))


def plan_lowered(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators import graph as G

    k, n = F.col("n_nationkey"), table(spark, d, "nation")
    tasks = n.select(_text(k).alias("node_key"), F.when(k % 5 == 0, "discover_competitors").otherwise("mine_community").alias("kind"), F.lit(1).alias("weight"))
    edges = n.filter("n_nationkey > 2").select(_text(k % 3).alias("a"), _text(k).alias("b"))
    return G.lowered(tasks, edges, charged={"discover_competitors": 3}).select("node_key", F.array_join("depends_on", ",").alias("deps"), F.col("weight").cast("long").alias("weight"))


def events_until_end(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    log = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 90 == 0, "report.ready").when(F.col("event_id") % 170 == 0, "run.failed").otherwise(F.col("event_type")).alias("event_type"))
    return EV.until_end(log).select("run_id", "id")


# ---- plans


def fallback_plan(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    briefs = c.select(k.alias("run_id"), F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("category"), F.when(k % 3 == 0, "smb").alias("segment"), F.when(k % 4 == 0, "EU").otherwise("").alias("geography"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("kw"), F.lower("c_mktsegment"))).alias("keywords"))
    return PL.fallback_plan(briefs).select("run_id", "node_key", "kind", "args", F.col("budget_weight").cast("long").alias("budget_weight"))


def fields_to_ask(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    conf = F.create_map(F.lit("category"), (k % 8) / 8, F.lit("segment"), (k % 4) / 4, F.lit("geography"), (k % 16) / 16, F.lit("other"), F.lit(0.0))
    return PL.fields_to_ask(c.select(k.alias("run_id"), conf.alias("field_confidence"))).select("run_id", "field", F.col("place").cast("long").alias("place"))


def brief_overrides(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    briefs = c.select(k.alias("run_id"), F.col("c_mktsegment").alias("category"), F.lit("old").alias("segment"))
    new = c.filter("c_custkey % 2 = 0").select(k.alias("run_id"), F.when(k % 3 == 0, "new").alias("category"), F.when(k % 4 == 0, "seg").alias("segment"))
    return PL.overridden(briefs, new, ["category", "segment"])


# ---- reports


def claims_in_full(spark: SparkSession, d: str) -> DataFrame:
    """Lines as claims of suppliers out of orders as sources."""
    claims = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("value_text"))
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("web:"), _text(F.col("s_suppkey"))).alias("entity_key"), F.col("s_name").alias("display_name"))
    sources = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("canonical_url"), F.to_date("o_orderdate").alias("fetched_at"))
    return RUN.claims_in_full(claims, entities, sources).select("id", "entity_key", "display_name", "canonical_url", "fetched_at", "value_text")


def inspected_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("entity_id"), F.col("l_shipdate").cast("date").cast("string").alias("attribute"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("value_text"), F.col("l_linenumber").alias("value_num"), F.lit("A").alias("grade"))
    return RUN.inspected(claims, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("display_name")))


def report_list(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")).alias("finished_at"))
    reports = table(spark, d, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("payload")).dropDuplicates(["run_id"]).withColumn("payload", F.lit("p"))
    return RUN.report_list(runs, reports)


def finding_detail(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value_text"))
    found = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("finding_id")).agg(F.sort_array(F.collect_set("l_orderkey")).alias("claim_ids"))
    return RUN.finding_detail(found, claims).select("finding_id", F.col("place").cast("long").alias("place"), "id", "value_text")


def claim_detail(spark: SparkSession, d: str) -> DataFrame:
    """Claims of documents, of which some lost their text: what stands before, in and after the quote, and the source's other claims."""
    s = _sources(spark, d).filter("length(extracted_text) >= 60")
    span = lambda df, at: df.select((F.col("source_id") * 2 + int(at > 5)).alias("id"), "source_id", F.substring("extracted_text", at + 1, 10).alias("quote"), F.lit(at).alias("char_start"), F.lit(at + 10).alias("char_end"), F.substring("extracted_text", 1, 40).alias("quote_context"), F.lit(at).alias("context_offset"))
    claims = X.union(span(s, 5), span(s, 20).filter("source_id % 3 = 0"))
    sources = s.select(F.col("source_id").alias("id"), "canonical_url", F.when(F.col("source_id") % 2 == 0, F.substring("extracted_text", 1, 50)).alias("extracted_text"))
    return RUN.claim_detail(claims, sources).select("id", "before", "marked", "after", F.array_join("also", ",").alias("also"))


def visible_runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 0).alias("is_public"), _text(F.col("o_custkey") % 10).alias("user_id"))
    return RUN.visible(runs, "4").select("id")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    out = e.select((F.col("user_id") % 10).alias("run_id"), F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "fetch").otherwise("entity").alias("kind"), _pick(["degraded", "hit", "verified", "rejected", "insufficient"], F.col("event_id") % 5).alias("result"))
    return RUN.run_summary(out)


def maintenance_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources after a maintenance pass: what benchmark runs cite is pinned first and keeps its text."""
    k = F.col("doc_id")
    sources = table(spark, d, "documents").select(k.alias("id"), F.col("lang").alias("extracted_text"), (k % 50 == 0).alias("is_pinned"), F.when(k % 3 == 0, now() - F.expr("interval 1 day")).otherwise(now() + F.expr("interval 1 day")).alias("ttl_expires_at"))
    cited = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("source_id"))
    events = table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"))
    return RUN.maintenance(sources, events, cited, now())[0].select("id", "extracted_text", "is_pinned")


def pricing_landscape(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    claims = table(spark, d, "part").select(k.alias("id"), F.when(k % 2 == 0, "pricing.entry_usd_month").otherwise("oss.stars").alias("attribute"), F.col("p_retailprice").alias("value_num"), F.when(k % 10 == 0, k + 1).alias("superseded_by"))
    out = P.landscape(claims)
    return out.select(F.round("median", 4).alias("median"), F.col("spread.lo").alias("lo"), F.col("spread.hi").alias("hi"), F.array_join("claim_ids", ",").alias("claim_ids"))


def pain_points(spark: SparkSession, d: str) -> DataFrame:
    """Themes of events as findings: the report's section, and the sentence of each."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_claims"), F.count_distinct("user_id").alias("n_threads"), F.sort_array(F.collect_list("event_id")).alias("claim_ids"))
    f = e.select(F.when(F.col("event_type") != "view", "pain_point").otherwise("feature_gap").alias("kind"), F.col("event_type").alias("label"), "n_claims", "n_threads", F.lit("C").alias("best_grade"), F.when(F.col("event_type") != "click", 0.5).alias("confidence"), "claim_ids")
    said = P.pain_points(f).join(f.select(F.col("label").alias("theme"), P.statement("pain_point").alias("statement"), P.statement("feature_gap", F.lit(3)).alias("gap")), "theme")
    return said.select("theme", "support_count", "distinct_threads", "confidence", "statement", "gap", F.array_join("claim_ids", ",").alias("claim_ids"))


def assembled_report(spark: SparkSession, d: str) -> DataFrame:
    """The document of two sections, as JSON; a finding without claims would fail the job."""
    f = P.all_bound(table(spark, d, "nation").select(F.col("n_name").alias("label"), F.array("n_nationkey").alias("claim_ids")))
    out = P.assemble({"findings": f.filter("label < 'D'").select("label").orderBy("label"), "regions": table(spark, d, "region").agg(F.count("*").alias("n"))})
    return out.select(F.size("findings").cast("long").alias("n_findings"), F.get_json_object("payload", "$.regions[0].n").alias("regions"))


def citation_faults(spark: SparkSession, d: str) -> DataFrame:
    """Statements of parts that cite findings; 0 to 9 are known, multiples of 4 are pain points."""
    k = F.col("p_partkey")
    cited = F.filter(F.array(k % 3, k % 7, k % 11, k % 5), lambda x: x != 2)
    findings = spark.range(10).select(F.col("id").alias("finding_id"), F.when(F.col("id") % 4 == 0, "pain_point").otherwise("other").alias("kind"))
    out = C.citation_fault(F.col("cited"), findings, table(spark, d, "part").select(k.alias("statement_id"), cited.alias("cited")))
    return out.select("statement_id", F.array_join("unknown", ",").alias("unknown"), "fault")


# ---- benchmark


def _scores(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("s_suppkey"), table(spark, d, "supplier")
    branches = F.filter(F.array(F.when(k % 2 == 0, "mvp_synthesis"), F.when(k % 3 == 0, "risks_synthesis"), F.when(k % 5 == 0, "funding")), lambda x: x.isNotNull())
    cites = F.when(k % 4 == 0, F.array().cast("array<array<bigint>>")).otherwise(F.array(F.array(k), F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k, k)), F.array(k)))
    return s.select(k.alias("run_id"), branches.alias("failed_branches"), cites.alias("sections"), (k % 7 == 0).alias("used_fallback"), (k * 37 % 101 / 4).alias("cost"), F.when(k % 6 != 0, k * 11 % 97 / 8).alias("seconds"))


def report_quality(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return s.select("run_id", F.round(B.structural_binding(F.col("sections")), 9).alias("binding"), F.array_join(B.omitted_sections(F.col("failed_branches")), ",").alias("omitted"))


def run_rates(spark: SparkSession, d: str) -> DataFrame:
    out = B.run_rates(_scores(spark, d))
    return out.select(F.round("fallback_rate", 9).alias("fallback_rate"), F.round("rejection_rate", 9).alias("rejection_rate"))


def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).withColumn("none", F.lit(None).cast("double"))
    return B.summary(s, ["cost", "seconds", "none"]).withColumn("mean", F.round("mean", 9))


def branch_tally(spark: SparkSession, d: str) -> DataFrame:
    return B.branch_tally(_scores(spark, d))


def tuning_split(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as queries: those to tune with, none with a stale fact."""
    k = F.col("item_id")
    q = table(spark, d, "benchmark").select(k.alias("query_id"), F.when(k % 5 < 3, "tuning").otherwise("held_out").alias("split"), F.array(F.struct(F.date_sub(F.lit("2024-06-30").cast("date"), (k % 50).cast("int")).alias("verified_on"))).alias("facts"))
    return B.of_split(q.withColumn("query_id", _text(F.col("query_id"))), "tuning", F.lit("2024-06-30").cast("date")).select("query_id")


# ---- tables and functions


def insert_returning(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("old").alias("note"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("new").alias("note"))
    return X.insert_returning(old, new, ["id"])


def kill_switch(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "nation").select("n_nationkey")
    off = X.allowed_by_switch(r, spark.createDataFrame([(True,)], "kill_switch boolean"))
    on = X.allowed_by_switch(r, spark.createDataFrame([], "kill_switch boolean"))
    return X.union(off.withColumn("row", F.lit("set")), on.withColumn("row", F.lit("none")))


def appended_events(spark: SparkSession, d: str) -> DataFrame:
    """New events go on with the numbers after the old ones, in the order of their time."""
    e = table(spark, d, "events")
    old, new = e.filter("event_type = 'view'").select(F.col("event_id").alias("id")), e.filter("event_type != 'view'").select("event_id", "ts")
    return X.append_events(old, new, [F.asc("ts"), F.asc("event_id")]).select("event_id", "id")


def vector_round_trip(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").filter("embedding is not null")
    back = X.parse_vector(X.vector_literal(F.col("embedding")))
    return v.select("vec_id", F.size(back).cast("long").alias("n"), (back == F.col("embedding")).alias("same"))


def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    """Registrable domains that speak of each nation's customers, one at least."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    url = F.when(k % 5 != 0, F.concat(F.lit("https://a.b"), _text(k % 4), F.when(k % 2 == 0, ".co.uk").otherwise(".com"), F.lit("/x")))
    return c.withColumn("u", url).groupBy("c_nationkey").agg(S.domain_count(U.web_key(F.col("u"))).alias("n"))


def host_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of shared services and others: tenants, their public domain, and repositories that are mere lists."""
    k, s = F.col("s_suppkey"), table(spark, d, "supplier")
    h = F.concat(F.lit("t"), _text(k), _pick([".github.io", ".example.com", ".co.uk", ".vercel.app"], k % 4))
    name = F.concat(F.lit("o/"), F.when(k % 3 == 0, "Awesome-").otherwise("tool-"), _text(k))
    return s.select("s_suppkey", U.is_shared_host(h).alias("shared"), U.public_key(h).alias("public_key"), U.is_list_repo(name, F.when(k % 5 == 0, "A List of the best tools")).alias("is_list"))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("s_suppkey"), table(spark, d, "supplier")
    link = F.concat(F.lit('<https://x?per=1&page='), _text(k), F.lit('>; rel="next", <https://x?page='), _text(k + 5), F.lit('>; rel="last"'))
    return s.select(
        "s_suppkey", S.threads_per_call(F.lit(20), k % 4, k % 3).cast("long").alias("threads"), S.clamp(k / 64 - 0.5).alias("clamped"), T.retry_after(F.when(k % 2 == 0, _text(k)).otherwise("Fri, 01 Jan")).alias("retry_after"), T.last_page(link).cast("long").alias("last_page"),
        T.issue_repo(F.concat(F.lit("https://github.com/o/r"), _text(k), F.lit("/issues/7"))).alias("repo"), T.capitalised_article(F.concat(F.lit(" big dATA "), _text(k))).alias("article"), PR.extractor_version(F.lit("extract"), _text(k), F.lit("m")).alias("version"),
        T.utf16_offset(F.lit("a😀b😀c"), (k % 6).cast("int")).cast("long").alias("utf16"), T.error_note(F.array(F.struct(F.lit("a.b").alias("loc"), _text(k).alias("msg")), F.struct(F.lit("c").alias("loc"), F.lit("bad").alias("msg")))).alias("note"),
    )


def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.sha2(PR.render("Role {{ role }}:\n{{body}}", {"role": F.col("role"), "body": PR.untrusted("text", F.col("text"))}), 256).alias("prompt_hash"))


_PART = "SELECT p_partkey AS k, ['web', 'gh', 'npm', 'pypi', 'chrome', 'ios', 'hf', 'ph'][p_partkey % 8 + 1] AS scheme, [200, 200, 404, 500][p_partkey // 8 % 4 + 1] AS status, p_partkey % 23 = 0 AS broken, 5 * p_size < 80 + CASE WHEN p_partkey % 29 = 0 THEN -15 ELSE 1 END OR p_partkey % 29 = 0 AS parked FROM part"
_JUDGED = f"""
SELECT scheme || ':v' || k AS entity_key, reason IS NULL AS verified, CASE WHEN scheme = 'ph' THEN 'B' ELSE 'A' END AS grade, reason, CASE WHEN reason IS NULL AND scheme = 'gh' AND k % 2 = 0 THEN 'https://h' || k END AS homepage_url,
 CASE WHEN reason IS NULL AND scheme IN ('npm', 'pypi') AND k % 3 = 0 THEN 'https://GitHub.com/o/' || k END AS repository_url, k
FROM (SELECT *, CASE WHEN scheme = 'web' THEN CASE WHEN broken THEN 'ConnectError' WHEN status <> 200 THEN 'http_' || status WHEN parked THEN 'parked_page' END
 WHEN scheme = 'gh' THEN CASE WHEN status = 404 THEN 'http_404' END WHEN scheme IN ('npm', 'pypi') THEN CASE WHEN status <> 200 THEN 'http_' || status END
 WHEN scheme = 'chrome' THEN CASE WHEN status <> 200 THEN 'http_' || status WHEN parked THEN 'listing_not_found' END WHEN scheme = 'hf' THEN CASE WHEN status <> 200 AND k % 5 <> 0 THEN 'not_found' END
 ELSE CASE WHEN k % 3 < 1 THEN 'not_found' END END AS reason FROM ({_PART}) WHERE k % 9 <> 0 AND NOT (scheme <> 'web' AND broken) AND NOT (scheme = 'gh' AND status = 500) AND NOT (scheme = 'ios' AND status <> 200))"""
_BOUND = """
WITH d AS (SELECT doc_id, text, n_chars, min(n_chars) OVER (PARTITION BY text) AS n FROM documents), h AS (SELECT DISTINCT text FROM documents WHERE doc_id % 4 <> 0),
c AS (SELECT doc_id, text, unnest(['company.stage', 'oss.stars', 'made.up', 'pricing.model']) AS attribute, unnest([substr(text, 11, 30), substr(text, 1, 15), substr(text, 1, 9), substr(text, 21, 5)]) AS q, n_chars % 3 <> 0 AS num FROM d SEMI JOIN h ON h.text = d.text),
b AS (SELECT doc_id AS source_id, attribute, q, instr(text, q) AS p, CASE WHEN attribute = 'made.up' THEN 'invalid_attribute' WHEN attribute = 'oss.stars' AND NOT num THEN 'value_type_mismatch' WHEN length(q) = 0 OR instr(text, q) = 0 THEN 'quote_not_in_source'
 WHEN instr(substr(text, instr(text, q) + 1), q) > 0 THEN 'quote_ambiguous' ELSE 'kept' END AS outcome FROM c)"""
_HITS = """
WITH h AS (SELECT ['hn', 'stackexchange', 'github'][turn % 3 + 1] AS venue, role, conv_id, turn, row_number() OVER (PARTITION BY turn % 3, role ORDER BY conv_id, turn) AS r,
 '- "' || substr(text, 1, 40) || '" (' AS s, CASE WHEN conv_id % 4 <> 0 THEN 'http://u/' || conv_id END AS url FROM conversations),
l AS (SELECT venue, role, r, CASE venue WHEN 'hn' THEN s || coalesce(url, 'no link') || ') — ' || (conv_id % 50) || ' points, ' || turn || ' comments' WHEN 'github' THEN s || coalesce(url, '') || ') — ' || (conv_id % 50) || ' reactions, repo o/r' || (conv_id % 5)
 ELSE s || coalesce(url, '') || ') — score ' || (conv_id % 50) || '. b' END AS line FROM h WHERE r <= 3),
t AS (SELECT 'community://' || venue || '/run/' || role AS canonical_url, venue AS root_key, 'Community discussion mentioning "' || role || '" on ' || venue || ':' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY r) || chr(10) AS text FROM l GROUP BY venue, role)"""
_TRIES = " UNION ALL ".join(f"SELECT s_suppkey AS k, '{kind}' AS kind, unnest({paths[:4]}) AS path, unnest([0, 1, 2, 3][1:{min(4, len(paths))}]) AS pos FROM supplier" for kind, paths in fixed.PATHS.items())
_FIRST = f"SELECT k, kind, arg_min(path, pos) AS path FROM ({_TRIES}) WHERE (k + pos + length(kind)) % 3 = 0 AND k % 4 <> 0 GROUP BY 1, 2"
_TASKS = """
t AS (SELECT o_custkey AS run_id, o_orderkey AS id, CASE WHEN o_orderkey % 2 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS dep,
 CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 5 = 0 THEN 'running' ELSE 'pending' END AS status, o_orderkey % 4 AS priority FROM orders)"""
_NEXT = "n AS (SELECT a.run_id, arg_min(a.id, (a.priority, a.id)) AS id FROM t a LEFT JOIN t b ON b.run_id = a.run_id AND b.id = a.dep WHERE a.status = 'pending' AND (a.dep IS NULL OR b.status = 'done') GROUP BY 1)"
_SCORES = """SELECT s_suppkey AS k, list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'mvp_synthesis' END, CASE WHEN s_suppkey % 3 = 0 THEN 'risks_synthesis' END, CASE WHEN s_suppkey % 5 = 0 THEN 'funding' END], lambda x: x IS NOT NULL) AS b,
 s_suppkey * 37 % 101 / 4 AS cost, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 11 % 97 / 8 END AS seconds FROM supplier"""
_SUM = "SELECT '{0}' AS measure, round(avg({0}), 9) AS mean, list_sort(list({0}) FILTER ({0} IS NOT NULL))[round_even(0.5 * (count({0}) - 1), 0)::INT + 1] AS p50, list_sort(list({0}) FILTER ({0} IS NOT NULL))[round_even(0.95 * (count({0}) - 1), 0)::INT + 1] AS p95 FROM s"

SQL = {
    "verify_entities": f"""
WITH j AS ({_JUDGED}), c AS (SELECT scheme || ':v' || k AS entity_key FROM ({_PART}) WHERE k % 20 = 0)
SELECT entity_key, verified, grade, reason, homepage_url, repository_url FROM j WHERE k % 20 <> 0 UNION ALL SELECT entity_key, false, 'A', 'cached', NULL, NULL FROM c""",
    "verification_cache": f"SELECT entity_key, verified, reason, '2024-07-01 00:00:00' AS expires_at FROM ({_JUDGED})",
    "resolve_entities": """
WITH e AS (SELECT 'web:s' || s_suppkey || '.com' AS key, 'S' || s_suppkey AS name, s_suppkey AS ord, NULL AS home, 'indie' AS tier, 'indie:insufficient_signal' AS rule FROM supplier WHERE s_suppkey % 7 <> 0
 UNION ALL SELECT 'gh:own' || (p_partkey % 9) || '/repo' || p_partkey, 'P' || p_partkey, p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN 'web:s' || (p_partkey % 150) || '.com' END, CASE WHEN p_partkey < 100 THEN 'hobby' ELSE 'indie' END, CASE WHEN p_partkey < 100 THEN 'hobby:low_scale' ELSE 'indie:default' END FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(home, key) ORDER BY key = coalesce(home, key) DESC, ord DESC) AS n, coalesce(home, key) AS canon FROM e),
o AS (SELECT 'web:s1.com' AS key, 'Old' AS name, 'hobby' AS tier, 'old' AS rule, 'x' AS kept UNION ALL SELECT 'web:other.com', 'Other', 'indie', NULL, 'y')
SELECT coalesce(r.canon, o.key) AS entity_key, coalesce(r.name, o.name) AS display_name, coalesce(r.tier, o.tier) AS maturity, coalesce(r.rule, o.rule) AS rule, o.kept FROM (SELECT * FROM r WHERE n = 1) r FULL JOIN o ON o.key = r.canon""",
    "extract_cached": f"{_BOUND} SELECT source_id, attribute, outcome, CASE WHEN outcome = 'kept' THEN p - 1 END AS char_start FROM b",
    "not_extracted": "SELECT doc_id AS source_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 4 <> 0)",
    "persist_claims": f"""{_BOUND}
SELECT source_id, attribute, p - 1 AS char_start, p - 1 + length(q) AS char_end, p - 1 - greatest(0, p - 2001) AS context_offset, ['A', 'B', 'C'][source_id % 3 + 1] AS grade, round([0.9, 0.75, 0.55][source_id % 3 + 1]::DOUBLE * pow(0.98::DOUBLE, (source_id % 60) / 30), 9) AS confidence
FROM b WHERE outcome = 'kept' AND NOT (source_id % 5 = 0 AND attribute = 'company.stage' AND p = 11)""",
    "snippet_claims": f"""{_BOUND}, u AS (SELECT unnest(['snippet', 'funding']) AS use)
SELECT source_id, attribute, use FROM b, u WHERE outcome = 'kept' AND CASE use WHEN 'snippet' THEN attribute <> 'pricing.model' ELSE attribute = 'company.stage' END""",
    "oss_profiles": r"""
WITH p AS (SELECT p_partkey AS k, 'own' || p_size || '/repo' || p_partkey AS repo, p_partkey * 13 % 7000 AS stars, CASE WHEN p_partkey % 3 <> 0 THEN 'MIT' END AS lic, CASE WHEN p_partkey % 4 <> 0 THEN strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d') END AS day, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 1000 / 64 END AS v FROM part),
t AS (SELECT *, repo || ': ' || stars || ' stars.' || chr(10) || 'License: ' || coalesce(lic, 'none declared') || '.' || chr(10) || coalesce('Last commit at ' || day || '.' || chr(10), '') AS text FROM p),
c AS (SELECT k, text, 'oss.repo' AS attribute, repo AS q, repo AS value_text, NULL::DOUBLE AS value_num FROM t UNION ALL SELECT k, text, 'oss.stars', stars || ' stars', NULL, stars::DOUBLE FROM t UNION ALL SELECT k, text, 'oss.license', 'License: ' || lic, lic, NULL FROM t WHERE lic IS NOT NULL
 UNION ALL SELECT k, text, 'oss.last_commit_at', 'Last commit at ' || day, day, NULL FROM t WHERE day IS NOT NULL UNION ALL SELECT k, text, 'oss.stars_90d_delta', stars || ' stars', NULL, round_even(v * 90, 0) FROM t WHERE v IS NOT NULL)
SELECT k AS source_id, attribute, value_text, value_num, instr(text, q) - 1 AS char_start, instr(text, q) - 1 + length(q) AS char_end, 0.9::DOUBLE AS confidence FROM c""",
    "community_documents": f"{_HITS} SELECT canonical_url, root_key, text FROM t",
    "synthetic_sources": f"{_HITS} SELECT canonical_url, CASE WHEN root_key = 'hn' THEN '2024-06-28 00:00:00' ELSE '2024-06-30 00:00:00' END AS fetched_at, CASE WHEN root_key = 'hn' THEN '2024-07-01 00:00:00' ELSE '2024-07-07 00:00:00' END AS expires FROM t",
    "profile_pages": f"SELECT s_suppkey AS entity_id, '/' AS path, 'https://s' || s_suppkey || '.com' AS url FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT k, path, 'https://s' || k || '.com' || path FROM ({_FIRST})",
    "pricing_pages": f"SELECT k AS entity_id, path, 'https://s' || k || '.com' || path AS url FROM ({_FIRST}) WHERE kind = 'pricing'",
    "page_claims": f"{_BOUND} SELECT source_id, attribute, CASE WHEN source_id % 4 >= 2 THEN 'B' ELSE 'A' END AS grade FROM b WHERE outcome = 'kept' AND source_id % 6 <> 0",
    "trend_signals": """
WITH k AS (SELECT unnest(['view', 'click', 'no posts', 'error', 'purchase']) AS keyword, unnest(['View', 'Click', 'No_Posts', 'Error', 'Purchase']) AS article)
SELECT keyword, article, (SELECT count(*) FROM events WHERE event_type = keyword) AS posts, CASE WHEN keyword <> 'click' THEN (SELECT nullif(sum(event_id % 3)::BIGINT, 0) FROM events WHERE event_type = keyword) END AS views FROM k""",
    "funding_queries": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'x.com' END || ' funding round investors' AS query FROM customer",
    "discover_competitors": r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS value FROM pages),
c AS (SELECT 'web:' || value AS key, count(*) AS hits, min(page_id % 10 + 1000 * (page_id % 2)) AS best, arg_min('s' || page_id, page_id) FILTER (WHERE page_id % 3 <> 0) AS snippet, min(page_id) AS ord FROM h WHERE value <> '' GROUP BY 1
 UNION ALL SELECT 'gh:x/tool' || p_partkey, 2, p_partkey, NULL, p_partkey + 1099511627776 FROM part WHERE p_partkey < 12 AND p_partkey % 4 <> 0 AND p_partkey <> 5),
f AS (SELECT * FROM c ORDER BY hits DESC, best, ord LIMIT 24),
r AS (SELECT *, row_number() OVER (ORDER BY hits * 3.0::DOUBLE - best * 0.1::DOUBLE + CASE WHEN ord % 5 = 0 THEN 0 ELSE 2 END DESC, ord) AS place FROM f)
SELECT CASE WHEN starts_with(key, 'gh:') THEN 'oss:' WHEN place <= 8 THEN 'profile:' ELSE 'pricing:' END || key AS node_key, CASE WHEN starts_with(key, 'gh:') THEN 'oss_profile' WHEN place <= 8 THEN 'profile_product' ELSE 'extract_pricing' END AS kind, key AS entity_key,
 CASE WHEN place <= 8 AND NOT starts_with(key, 'gh:') THEN snippet END AS snippet, (CASE WHEN place <= 8 AND NOT starts_with(key, 'gh:') THEN 2 ELSE 1 END)::BIGINT AS weight FROM r WHERE place <= 16
UNION ALL SELECT 'funding:' || key, 'find_funding', key, NULL, 1 FROM r WHERE place <= 3""",
    "llm_cache": """SELECT conv_id * 100 + turn AS task_id, sha256('{"prompt":' || (conv_id % 40) || ',"model":"m"}') AS cache_key, 'c' || (conv_id % 40) AS content, 0::DOUBLE AS cost_usd, true AS cache_hit FROM conversations WHERE conv_id % 40 < 25""",
    "llm_misses": """SELECT DISTINCT sha256('{"prompt":' || (conv_id % 40) || ',"model":"m"}') AS cache_key FROM conversations WHERE conv_id % 40 >= 25""",
    "run_totals": """
WITH r AS (SELECT unnest(range(9)) AS run_id), c AS (SELECT conv_id % 7 AS run_id, sum(CASE WHEN conv_id % 40 >= 25 THEN conv_id % 40 / 64 ELSE 0 END) AS llm, count(*) FILTER (WHERE conv_id % 40 < 25) / count(*)::DOUBLE AS hit FROM conversations GROUP BY 1),
s AS (SELECT user_id % 9 AS run_id, count(*) * 0.0625::DOUBLE AS search FROM events GROUP BY 1)
SELECT run_id, coalesce(llm, 0)::DOUBLE AS llm_usd, coalesce(search, 0)::DOUBLE AS search_usd, coalesce(hit, 0)::DOUBLE AS hit_rate, (coalesce(llm, 0) + coalesce(search, 0))::DOUBLE AS total_usd FROM r LEFT JOIN c USING (run_id) LEFT JOIN s USING (run_id)""",
    "repaired_usage": "SELECT conv_id AS request_id, arg_max(role, turn) AS content, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, sum(turn % 3)::BIGINT AS cached_tokens, count(*) > 1 AS repaired FROM conversations GROUP BY 1",
    "search_route": """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_id % 4 / 8 AS cost, event_id % 500 < 100 AND event_id % 2 = 0 AS hit, event_id % 13 = 0 AS broken, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s(user_id, i, ord, hit, charged, reason, log) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL::DOUBLE, NULL::VARCHAR, CAST([] AS STRUCT(t TIMESTAMP, c DOUBLE)[]) FROM e
 UNION ALL SELECT user_id, i, event_id, hit, CASE WHEN hit OR reason IS NOT NULL THEN 0 ELSE cost END, reason, CASE WHEN hit OR reason IS NOT NULL THEN log ELSE list_append(log, {'t': ts, 'c': cost::DOUBLE}) END
 FROM (SELECT e.user_id, e.i, e.event_id, e.hit, e.cost, e.ts, CASE WHEN e.hit THEN NULL WHEN coalesce(list_sum(list_transform(list_filter(s.log, lambda x: x.t >= e.ts - INTERVAL 24 HOURS), lambda x: x.c)), 0) >= 0.5 THEN 'allowance' WHEN e.broken THEN 'ProviderError' END AS reason,
  list_filter(s.log, lambda x: x.t >= e.ts - INTERVAL 24 HOURS) AS log FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT ord, hit, charged, reason IS NOT NULL AS degraded, reason FROM s WHERE i > 0""",
    "month_spend": "SELECT user_id, sum(event_id % 17 / 16)::DOUBLE AS spent FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1",
    "conditional_refresh": """
SELECT 'u' || doc_id AS canonical_url, CASE WHEN ok THEN source ELSE lang END AS extracted_text, CASE WHEN ok THEN 'e1' ELSE 'e0' END AS etag, sha256(CASE WHEN ok THEN source ELSE lang END) AS content_hash,
 CASE WHEN doc_id % 5 = 0 THEN '2024-06-29 00:00:00' WHEN doc_id % 3 < 2 THEN '2024-07-07 00:00:00' ELSE '2024-07-01 00:00:00' END AS expires FROM (SELECT *, doc_id % 5 <> 0 AND doc_id % 3 = 1 AS ok FROM documents)""",
    "next_tasks": f"WITH {_TASKS}, {_NEXT} SELECT run_id, id FROM n",
    "claim_tasks": f"WITH {_TASKS}, {_NEXT} SELECT t.id, CASE WHEN n.id IS NOT NULL THEN 'running' ELSE t.status END AS status, CASE WHEN n.id IS NOT NULL THEN 'new' WHEN t.id % 5 = 0 THEN 't' END AS lease_token, (n.id IS NOT NULL)::BIGINT AS attempts FROM t LEFT JOIN n ON n.id = t.id",
    "task_maintenance": f"""
WITH RECURSIVE {_TASKS}, a AS (SELECT run_id, id, dep, CASE WHEN status = 'running' AND id % 2 = 0 THEN 'pending' ELSE status END AS status FROM t),
b AS (SELECT run_id, id, dep, CASE WHEN status IN ('pending', 'running') AND run_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) THEN 'skipped' ELSE status END AS status, status IN ('pending', 'running') AND run_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) AS late FROM a),
r(id) AS (SELECT x.id FROM b x JOIN b y ON y.id = x.dep WHERE x.status = 'pending' AND y.status IN ('failed', 'skipped') UNION SELECT x.id FROM r JOIN b x ON x.dep = r.id WHERE x.status = 'pending')
SELECT id, CASE WHEN id IN (SELECT id FROM r) THEN 'skipped' ELSE status END AS status, CASE WHEN late THEN 'timeout' WHEN id IN (SELECT id FROM r) THEN 'unreachable: dependency did not complete' END AS error FROM b""",
    "executor_coverage": f"WITH {_TASKS} SELECT run_id, round(coalesce(count(*) FILTER (WHERE status = 'done') / nullif(count(*) FILTER (WHERE status IN ('done', 'failed', 'skipped')), 0)::DOUBLE, 0), 9) AS coverage FROM t GROUP BY 1",
    "throttled": """
WITH RECURSIVE e AS (SELECT event_id, event_type || (user_id % 2) AS host, event_id % 997 / 8 AS own, row_number() OVER (PARTITION BY event_type || (user_id % 2) ORDER BY event_id % 997 / 8, event_id) AS i FROM events),
r AS (SELECT host, i, event_id, own AS starts FROM e WHERE i = 1 UNION ALL SELECT e.host, e.i, e.event_id, greatest(e.own, r.starts + 0.25) FROM r JOIN e ON e.host = r.host AND e.i = r.i + 1)
SELECT event_id, starts::DOUBLE AS starts FROM r""",
    "dispatch_waves": """
WITH RECURSIVE t AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS n FROM lineitem),
e AS (SELECT run_id, n, unnest(CASE WHEN n > 4 THEN [n - 3, 1] WHEN n > 2 THEN [1] ELSE [] END) AS dep FROM t), g AS (SELECT e.* FROM e JOIN t ON t.run_id = e.run_id AND t.n = e.dep),
r AS (SELECT run_id, n, 0 AS depth FROM t UNION SELECT g.run_id, g.n, r.depth + 1 FROM r JOIN g ON g.run_id = r.run_id AND g.dep = r.n), m AS (SELECT run_id, n, max(depth) AS depth FROM r GROUP BY 1, 2)
SELECT run_id, n::VARCHAR AS node_key, depth::BIGINT AS depth, ceil(row_number() OVER (PARTITION BY run_id, depth, n % 2 ORDER BY n) / CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS wave FROM m""",
    "plan_lowered": "SELECT n_nationkey::VARCHAR AS node_key, CASE WHEN n_nationkey > 2 THEN (n_nationkey % 3)::VARCHAR ELSE '' END AS deps, (CASE WHEN n_nationkey % 5 = 0 THEN 3 ELSE 1 END)::BIGINT AS weight FROM nation",
    "events_until_end": "SELECT user_id AS run_id, event_id AS id FROM (SELECT *, min(CASE WHEN event_id % 90 = 0 OR event_id % 170 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS e FROM events) WHERE e IS NULL OR event_id <= e",
    "fallback_plan": """
WITH b AS (SELECT c_custkey AS k, lower(c_mktsegment) AS s, CASE WHEN c_custkey % 3 = 0 THEN 'smb' ELSE '' END AS g, CASE WHEN c_custkey % 4 = 0 THEN 'EU' ELSE '' END AS e FROM customer),
v AS (SELECT *, [trim(s), trim(s || ' ' || g), trim(s || ' ' || e)] || CASE WHEN k % 5 = 0 THEN [] ELSE ['kw', s] END AS l FROM b),
u AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS q FROM v)
SELECT k AS run_id, 't1' AS node_key, 'discover_competitors' AS kind, '{"query_variants":["' || array_to_string(q, '","') || '"],"max_profile_count":8}' AS args, 27::BIGINT AS budget_weight FROM u
UNION ALL SELECT k, 't2', 'mine_community', '{"keywords":["kw","' || s || '"],"venues":["hn","github","stackexchange"]}', 4 FROM u WHERE k % 5 <> 0""",
    "fields_to_ask": """
WITH f AS (SELECT c_custkey AS run_id, unnest(['category', 'segment', 'geography']) AS field, unnest([c_custkey % 8 / 8, c_custkey % 4 / 4, c_custkey % 16 / 16]) AS c, unnest([3.0, 2.0, 1.5]::DOUBLE[]) AS w FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (1 - c) * w DESC, field) AS place FROM f WHERE c < 0.6)
SELECT run_id, field, place FROM r WHERE place <= 2""",
    "brief_overrides": "SELECT c_custkey AS run_id, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_mktsegment END AS category, CASE WHEN c_custkey % 4 = 0 THEN 'seg' ELSE 'old' END AS segment FROM customer",
    "claims_in_full": "SELECT l_orderkey * 10 + l_linenumber AS id, 'web:' || s_suppkey AS entity_key, s_name AS display_name, o_orderpriority AS canonical_url, o_orderdate::DATE AS fetched_at, l_returnflag AS value_text FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey",
    "inspected_claims": "SELECT s_name AS display_name, l_shipdate::DATE::VARCHAR AS attribute, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linenumber::VARCHAR END AS value, 'A' AS grade, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey",
    "report_list": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS finished_at, 'p' AS payload FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)",
    "finding_detail": "SELECT f.l_partkey AS finding_id, f.n - 1 AS place, o_orderkey AS id, o_orderstatus AS value_text FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) f JOIN orders ON o_orderkey = f.l_orderkey",
    "claim_detail": """
WITH c AS (SELECT doc_id, w, doc_id * 2 + CASE WHEN w > 5 THEN 1 ELSE 0 END AS id, substr(text, 1, CASE WHEN doc_id % 2 = 0 THEN 50 ELSE 40 END) AS s FROM documents, (SELECT unnest([5, 20]) AS w) WHERE length(text) >= 60 AND (w = 5 OR doc_id % 3 = 0))
SELECT id, substr(s, 1, w) AS before, substr(s, w + 1, 10) AS marked, substr(s, w + 11) AS after, CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN w = 5 THEN id + 1 ELSE id - 1 END)::VARCHAR ELSE '' END AS also FROM c""",
    "visible_runs": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey % 10 = 4",
    "run_summary": """
WITH o AS (SELECT user_id % 10 AS run_id, CASE event_type WHEN 'view' THEN 's' WHEN 'click' THEN 'f' ELSE 'e' END AS k, event_id % 5 AS r FROM events)
SELECT run_id, count(*) FILTER (WHERE k = 's') AS searches, count(*) FILTER (WHERE k = 's' AND r = 0) AS degraded, count(*) FILTER (WHERE k = 'f') AS fetches, count(*) FILTER (WHERE k = 'f' AND r = 1) AS cache_hits, count(*) FILTER (WHERE k = 'e' AND r = 2) AS verified,
 count(*) FILTER (WHERE k = 'e' AND r = 3) AS rejected, count(*) FILTER (WHERE k = 'e' AND r = 4) AS insufficient FROM o GROUP BY 1""",
    "maintenance_sources": "SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 OR p THEN lang END AS extracted_text, p AS is_pinned FROM (SELECT *, doc_id % 50 = 0 OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS p FROM documents)",
    "pricing_landscape": "SELECT round(median(p_retailprice), 4) AS median, min(p_retailprice) AS lo, max(p_retailprice) AS hi, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS claim_ids FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 10 <> 0",
    "pain_points": """
SELECT event_type AS theme, count(*) AS support_count, count(DISTINCT user_id) AS distinct_threads, CASE WHEN event_type <> 'click' THEN 0.5 ELSE 0 END::DOUBLE AS confidence, count(*) || ' users across ' || count(DISTINCT user_id) || ' threads report ' || event_type AS statement,
 count(*) || ' users across ' || count(DISTINCT user_id) || ' threads request ' || event_type || '; not found among 3 reviewed competitors' AS gap, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS claim_ids FROM events WHERE event_type <> 'view' GROUP BY 1""",
    "assembled_report": "SELECT (SELECT count(*) FROM nation WHERE n_name < 'D') AS n_findings, (SELECT count(*) FROM region)::VARCHAR AS regions",
    "citation_faults": """
WITH c AS (SELECT p_partkey AS k, list_distinct(list_filter([p_partkey % 3, p_partkey % 7, p_partkey % 11, p_partkey % 5], lambda x: x <> 2)) AS l FROM part), u AS (SELECT *, list_filter(l, lambda x: x > 9) AS x FROM c)
SELECT k AS statement_id, array_to_string(list_sort(x), ',') AS unknown, CASE WHEN len(x) > 0 THEN 'unknown_finding' WHEN len(l) < 3 THEN 'too_few_findings' WHEN len(list_filter(l, lambda y: y % 4 = 0)) < 1 THEN 'no_pain_point' END AS fault FROM u""",
    "report_quality": f"SELECT k AS run_id, round(CASE WHEN k % 4 = 0 THEN 1 WHEN k % 3 = 0 THEN 2 / 3 ELSE 1 END::DOUBLE, 9) AS binding, array_to_string(list_filter(b, lambda x: x <> 'funding'), ',') AS omitted FROM ({_SCORES})",
    "run_rates": f"SELECT round(count(*) FILTER (WHERE k % 7 = 0) / count(*)::DOUBLE, 9) AS fallback_rate, round(sum(len(list_filter(b, lambda x: x <> 'funding'))) / (3 * count(*))::DOUBLE, 9) AS rejection_rate FROM ({_SCORES})",
    "run_summaries": f"WITH s AS ({_SCORES}) {_SUM.format('cost')} UNION ALL {_SUM.format('seconds')} UNION ALL SELECT 'none', 0, 0, 0",
    "branch_tally": f"SELECT branch, count(*) AS n FROM (SELECT unnest(b) AS branch FROM ({_SCORES})) GROUP BY 1",
    "tuning_split": "SELECT item_id::VARCHAR AS query_id FROM benchmark WHERE item_id % 5 < 3",
    "insert_returning": "SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'old' ELSE 'new' END AS note FROM orders",
    "kill_switch": "SELECT n_nationkey, row = 'none' AS open, row FROM nation, (SELECT unnest(['set', 'none']) AS row)",
    "appended_events": "SELECT event_id, (SELECT max(event_id) FROM events WHERE event_type = 'view') + row_number() OVER (ORDER BY ts, event_id) AS id FROM events WHERE event_type <> 'view'",
    "vector_round_trip": "SELECT vec_id, len(embedding) AS n, true AS same FROM embeddings WHERE embedding IS NOT NULL",
    "domain_counts": "SELECT c_nationkey, greatest(count(DISTINCT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 4 END), 1) AS n FROM customer GROUP BY 1",
    "host_kinds": """
SELECT s_suppkey, s_suppkey % 4 IN (0, 3) AS shared, CASE s_suppkey % 4 WHEN 0 THEN 'github.io' WHEN 1 THEN 'example.com' WHEN 2 THEN 't' || s_suppkey || '.co.uk' ELSE 'vercel.app' END AS public_key, s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS is_list FROM supplier""",
    "scalar_functions": """
SELECT s_suppkey, greatest(20 // greatest(s_suppkey % 4 * (s_suppkey % 3), 1), 1)::BIGINT AS threads, greatest(0, least(1, s_suppkey / 64 - 0.5))::DOUBLE AS clamped, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::DOUBLE END AS retry_after, s_suppkey + 5 AS last_page, 'o/r' || s_suppkey AS repo,
 'Big_Data_' || s_suppkey AS article, 'extract@' || substr(sha256(s_suppkey::VARCHAR), 1, 8) || '-m' AS version, [0, 1, 3, 4, 6, 7][s_suppkey % 6 + 1]::BIGINT AS utf16, 'a.b: ' || s_suppkey || '; c: bad' AS note FROM supplier""",
    "prompt_blocks": """SELECT conv_id, turn, sha256('Role ' || role || ':' || chr(10) || '<untrusted name="text">' || chr(10) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</untrusted>') AS prompt_hash FROM conversations""",
}
QUERIES = {name: globals()[name] for name in SQL}
