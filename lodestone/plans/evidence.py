"""Spans, text, URLs, claims, graphs and findings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import claims as C
from lodestone.operators import discover as D
from lodestone.operators import graph as G
from lodestone.operators import tables as X
from lodestone.operators import vectors as V
from lodestone.operators.search import quotes_in
from lodestone.plans._common import TODAY, now, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return quotes_in(table(spark, d, "documents").select("doc_id", "text"), quotes, "text", "quote")


def bind_span(spark: SparkSession, d: str) -> DataFrame:
    found = _pairs(spark, d).withColumn("s", T.bind_span(F.col("text"), F.col("quote"))).filter("s is not null")
    return found.select("doc_id", "item_id", F.col("s.start").cast("long").alias("char_start"), F.col("s.end").cast("long").alias("char_end"))


def span_drops(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve characters of each document bound in that document: unique, ambiguous or absent."""
    rows = table(spark, d, "documents").withColumn("quote", F.substring("text", 1, 12))
    return rows.groupBy(F.coalesce(T.span_drop_reason(F.col("text"), F.col("quote")), F.lit("bound")).alias("outcome")).agg(F.count("*").alias("n"))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    found = _pairs(spark, d).withColumn("s", T.bind_span(F.col("text"), F.col("quote"))).filter("s is not null")
    w = T.context_window(F.col("text"), F.col("s.start"), F.col("s.end"))
    return found.select("doc_id", "item_id", w["context"].alias("context"), w["offset"].cast("long").alias("context_offset"))


def quoting_claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labels as claims: those of good quality quote their document, the others what doesn't stand there."""
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("extracted_text"))
    quote = F.concat(F.substring("extracted_text", 3, 24), F.when(F.col("quality") == 1, "").otherwise("~zq"))
    claims = table(spark, d, "labels").select(F.col("doc_id").alias("source_id"), "quality").join(sources, "source_id").select("source_id", quote.alias("quote"))
    return claims, sources


def binding_rate(spark: SparkSession, d: str) -> DataFrame:
    return C.binding_rate(*quoting_claims(spark, d))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalise(F.col("text")), 256).alias("normal_hash"))


def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


def url_keys(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.host(u).alias("host"), U.web_key(u).alias("web_key"), U.in_domains(U.host(u), ["example.net", "g2.com"]).alias("no_crawl"), S.own_domain_kind(F.regexp_extract(u, "^[a-z]+://[^/?#]*([^?#]*)", 1)).alias("kind"))


def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.trim("p_brand").alias("owner"), F.regexp_replace("p_name", " ", "_").alias("repo"))
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "repo", F.lit(".git"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("git@github.com:"), "owner", F.lit("/"), "repo")).when(F.col("p_partkey") % 4 == 2, F.concat("owner", F.lit("/"), "repo")).otherwise(F.concat(F.lit("x/"), "owner", F.lit("/"), "repo"))
    return p.select("p_partkey", U.gh_key(raw).alias("gh_key"), U.pypi_key(F.concat(F.lit(" "), "owner", F.lit("__.x"))).alias("pypi_key"), U.plain_key(F.concat(F.lit(" "), "owner", F.lit("\t"))).alias("npm_key"))


def page_classes(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    text = F.regexp_replace(F.regexp_replace(html, "(?s)<script.*?</script>|<style.*?</style>", " "), "<[^>]*>", " ")
    status = F.element_at(F.array(*map(F.lit, [200, 304, 404, 200, 503, 200])), (F.col("page_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("page_id") % 7 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    return table(spark, d, "pages").withColumn("t", text).select("page_id", T.looks_parked(F.col("t")).alias("parked"), T.is_consent_wall(F.col("t"), html).alias("consent"), T.looks_priced(F.col("t")).alias("priced"), T.fetch_outcome(status, kind, F.col("t"), html).alias("outcome"))


def query_rejections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(T.query_rejection(F.col("text")), F.lit("accepted")).alias("outcome"))


ATTRIBUTES = ["pricing.model", "pricing.entry_usd_month", "product.platforms", "company.stage", "request.api"]


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Orders as claims of customers: text, numeric and list attributes, some superseded already, some undated, some without the inputs of their score."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey").cast("long")
    grade = F.when(F.col("o_totalprice") < 50_000, "A").when(F.col("o_totalprice") < 120_000, "B").when(F.col("o_totalprice") < 200_000, "C").otherwise("D")
    inputs = F.struct(grade.alias("best_grade"), (1 + k % 3).alias("n_distinct_domains"), (k % 100).cast("double").alias("age_days"), F.lit(False).alias("contradicted"))
    return o.select(
        k.alias("id"), F.col("o_custkey").cast("long").alias("entity_id"), F.element_at(F.array(*map(F.lit, ATTRIBUTES)), (k % 5 + 1).cast("int")).alias("attribute"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit("\t"))).otherwise(F.lower("o_orderstatus")).alias("value_text"), F.when(k % 11 != 0, (k % 4).cast("decimal(38,10)")).alias("value_num"),
        F.when(k % 13 != 0, F.to_date("o_orderdate")).alias("as_of"), F.to_date("o_orderdate").alias("day"), grade.alias("grade"), F.when(k % 17 == 0, k + 1).alias("superseded_by"), F.lit(0.5).alias("confidence"), F.when(k % 19 != 0, inputs).alias("confidence_inputs"),
    )


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return C.contradictions(_claims(spark, d))


def resolve_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return C.resolve_contradictions(_claims(spark, d)).select("id", "superseded_by", "contradicted", F.round("confidence", 9).alias("confidence"))


def confidence(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    age = S.age_days(F.col("day"), F.lit(None).cast("date"), now())
    return c.select("id", F.round(age, 6).alias("age_days"), F.round(S.confidence(F.col("grade"), (F.col("entity_id") % 7 + 1), age, F.col("id") % 3 == 0), 9).alias("confidence"))


def grades(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["own_domain_structured", "structured_api", "own_domain_prose", "launch_announcement", "aggregator", "community"]
    pick = lambda k: F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % k + 1).cast("int"))
    c = table(spark, d, "customer").withColumn("shown", pick(6)).withColumn("kind", F.when(F.col("c_custkey") % 5 == 0, "wayback_snapshot").otherwise(F.col("shown")))
    return c.select("c_custkey", S.grade_for(F.col("kind"), F.col("shown")).alias("grade"))


def maturity(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), F.col("s_suppkey")
    opt = lambda k, v: F.when(n % k != 0, v)
    out = S.maturity(domain_age_days=opt(4, n * 37 % 3000), last_commit_at=opt(3, F.date_sub(F.lit(TODAY).cast("date"), (n * 13 % 900).cast("int"))), stars=opt(5, n * 71 % 9000), star_velocity=F.lit(None).cast("double"), has_funding=n % 11 == 0, stage=F.when(n % 13 == 0, "series-b"), installs=opt(2, n * 997 % 200_000), downloads=opt(3, n * 1009 % 150_000), shared_host=n % 17 == 0, now=now())
    return s.select("s_suppkey", out["tier"].alias("tier"), out["rule"].alias("rule"), out["insufficient"].alias("insufficient"))


def vocabulary_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw claims with good and bad attributes, values and quotes: what becomes of each, and its span."""
    n = F.col("doc_id") % 8
    attribute = F.element_at(F.array(*map(F.lit, ["pricing.model", "oss.stars", "feature.dark-mode.present", "complaint.slow", "request.api.reactions", "made.up", "pricing.free_tier", "company.stage"])), (n + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", "text", attribute.alias("attribute"), F.when(F.col("doc_id") % 3 == 0, "flat").otherwise("true").alias("value_text"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("value_num"), F.substring("text", 1, 20).alias("quote"))
    return C.gate(rows).select("doc_id", "attribute", F.coalesce("drop_reason", F.lit("kept")).alias("outcome"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_counts(vocabulary_gate(spark, d).withColumn("drop_reason", F.nullif("outcome", F.lit("kept"))))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Events as tasks: a kind is what happened to a seventh of the users; some kinds only fail, some are only skipped, for one reason or another."""
    u = F.col("user_id") % 7
    status = F.when(u == 3, "failed").when(u == 5, "skipped").when(F.col("event_id") % 4 == 1, "failed").when(F.col("event_id") % 9 == 1, "running").otherwise("done")
    tasks = table(spark, d, "events").select(F.concat_ws("-", "event_type", u).alias("kind"), status.alias("status"), F.when(F.col("event_type").isin("click", "view"), "budget_weight").otherwise("timeout").alias("reason"), (F.col("event_id") % 4 + 1).alias("weight"))
    out = C.coverage(tasks)
    return out.select(F.round("coverage", 9).alias("coverage"), *[F.array_join(c, ",").alias(c) for c in ("failed_branches", "budget_skipped_branches", "other_skipped_branches")])


def promotion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("theme", F.concat_ws("-", "event_type", F.col("event_id") % 40))
    return C.promoted(e, ["theme"], thread="user_id").select("theme", "n_claims", "n_threads")


def reaction_promotion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("theme", F.col("user_id")).withColumn("r", F.get_json_object("props", "$.k").try_cast("long"))
    return C.promoted(e, ["theme"], thread="event_id", reactions="r").select("theme", "n_claims", "n_threads", "reactions")


def cosine_to_label(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with the first one of its label."""
    v = table(spark, d, "embeddings").filter("embedding is not null")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return v.join(first, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Components of the pairs of cosine fixed.SIMILARITY or more; a vector without such a pair is its own cluster."""
    v = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.similar_groups(v).select(F.col("id").alias("vec_id"), "cluster")


def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("cluster"), F.col("event_type").alias("slug"), F.col("event_id").alias("ord"))
    return C.cluster_labels(e)


def alias_graph(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as web keys, parts as repositories, an edge for every line that has both."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    e = li.select(F.concat(F.lit("web:"), (F.col("l_suppkey") + 1_000_000).cast("string")).alias("a"), F.concat(F.lit("gh:"), (F.col("l_partkey") + 1_000_000).cast("string")).alias("b"))
    return G.canonical_keys(e)


def theme_findings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").cast("long").alias("id"), F.concat_ws("-", "event_type", F.col("user_id") % 20).alias("slug"), F.col("user_id").alias("source_id"), F.when(F.col("event_id") % 3 == 0, "B").otherwise("C").alias("grade"), F.lit(0.5).alias("confidence"), F.col("event_id").alias("ord"))
    clusters_ = e.select("slug").distinct().withColumn("cluster", F.substring_index("slug", "-", -1))
    out = C.feature_gaps(C.theme_findings(e, clusters_), spark.createDataFrame([("click-1",), ("view-2",)], "slug string"))
    return out.select("cluster", "label", "best_grade", "n_claims", F.array_join("claim_ids", ",").alias("claim_ids"))


def pricing_pivot(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("attribute"), F.col("l_linestatus").alias("value_text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"))
    return C.pivot_latest(li, ["A", "N", "R"])


def price_landscape(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_partkey") % 300).alias("entity_id"), F.col("p_retailprice").alias("value_num"))
    out = C.price_observation(p, keys=("p_brand",))
    return out.select("p_brand", F.round("median", 4).alias("median"), "low", "high", "n_entities", F.array_join("claim_ids", ",").alias("claim_ids"))


def competitors(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with nations and regions: claims by entity and source, ids in order."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.array_join(F.sort_array(F.collect_list("s_suppkey")), ",").alias("ids"), F.count("*").alias("n"))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(S.effective_date(F.to_date("o_orderdate"), F.lit(None).cast("timestamp"), F.lit(TODAY).cast("date")).alias("effective"))
    return C.freshness(o, F.lit(TODAY).cast("date"))


def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit(", "), (F.col("conv_id") % 9).cast("string"), F.lit("] and [3][12]"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.markers(t), ",").alias("ids"), F.sha2(T.without_markers(t), 256).alias("plain_hash"))


def bind_statements(spark: SparkSession, d: str) -> DataFrame:
    """Cited sentences per part; findings 2, 4 and 5 are known, and a sentence that cites another one goes."""
    k = (F.col("p_partkey") % 7).cast("string")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("statement_id"), F.concat(F.lit("It costs $5.50, e.g. here [2]. Part is "), F.col("p_brand"), F.lit(" [4, "), k, F.lit("]. Nothing cited. Good ["), k, F.lit("]. ")).alias("text"))
    known = spark.createDataFrame([(2, [10, 11]), (4, [12]), (5, [10, 14])], "finding_id long, claim_ids array<long>")
    out = C.bind_statement(p, known)
    return out.select("statement_id", "statement", F.array_join("claim_ids", ",").alias("claims"))


def discover_hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("url", F.lit("").alias("title"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.col("page_id"))).alias("snippet"), (F.col("page_id") % 10).alias("rank"), (F.col("page_id") % 2).alias("variant"), F.lit(1).alias("weight"), F.col("page_id").alias("ord"))
    return D.top_candidates(D.aggregate_hits(h)).select("scheme", "value", "hit_count", "best_rank", "snippet")


def keep_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return X.first_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return X.insert_ignore(e.filter("event_type = 'signup' and event_id % 20 = 1").select("user_id"), e, ["user_id"], [F.asc("event_id")]).select("user_id", "event_id")


def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents by content hash: the first id and how many share it."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


_PAIR = "SELECT d.doc_id, b.item_id, d.text, b.text AS quote, instr(d.text, b.text) AS pos FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND length(b.text) > 0"
_BOUND = f"SELECT * FROM ({_PAIR}) WHERE instr(substr(text, pos + 1), quote) = 0"
_CLAIM = """SELECT o_orderkey::BIGINT AS id, o_custkey::BIGINT AS entity_id, ['pricing.model', 'pricing.entry_usd_month', 'product.platforms', 'company.stage', 'request.api'][o_orderkey % 5 + 1] AS attribute,
 lower(o_orderstatus) AS value_text, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 END AS value_num, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS as_of, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 1 END AS superseded_by,
 CASE WHEN o_totalprice < 50000 THEN 'A' WHEN o_totalprice < 120000 THEN 'B' WHEN o_totalprice < 200000 THEN 'C' ELSE 'D' END AS grade FROM orders"""
_TAKING = f"""SELECT *, CASE WHEN attribute = 'pricing.entry_usd_month' THEN 'n' || coalesce(value_num::VARCHAR, '~') ELSE 't' || value_text END AS k FROM ({_CLAIM})
 WHERE grade <> 'D' AND attribute <> 'product.platforms' AND superseded_by IS NULL"""
_SCORE = "least({base} * (1 + 0.05::DOUBLE * least({domains} - 1, 4)) * pow(0.98::DOUBLE, {age} / 30) * {factor}, 0.97)"
_BASE = "CASE grade WHEN 'A' THEN 0.9 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.55 ELSE 0.35 END::DOUBLE"
_STRIP = "regexp_replace(html, '<script.*?</script>|<style.*?</style>', ' ', 'gs')"

_GATE = """
WITH r AS (SELECT doc_id, ['pricing.model', 'oss.stars', 'feature.dark-mode.present', 'complaint.slow', 'request.api.reactions', 'made.up', 'pricing.free_tier', 'company.stage'][doc_id % 8 + 1] AS attribute,
 CASE WHEN doc_id % 3 = 0 THEN 'flat' ELSE 'true' END AS v, doc_id % 5 <> 0 AND n_chars IS NOT NULL AS num, text, substr(text, 1, 20) AS q FROM documents),
o AS (SELECT doc_id, attribute, q, CASE WHEN attribute = 'made.up' THEN 'invalid_attribute'
 WHEN attribute IN ('oss.stars', 'request.api.reactions') AND NOT num OR attribute IN ('feature.dark-mode.present', 'pricing.free_tier') AND v <> 'true' OR attribute = 'pricing.model' AND v <> 'flat' THEN 'value_type_mismatch'
 WHEN length(q) = 0 THEN 'quote_not_in_source' WHEN instr(substr(text, 2), q) > 0 THEN 'quote_ambiguous' ELSE 'kept' END AS outcome FROM r)
SELECT doc_id, attribute, outcome, CASE WHEN outcome = 'kept' THEN 0::BIGINT END AS char_start, CASE WHEN outcome = 'kept' THEN length(q) END AS char_end FROM o"""

SQL = {
    "bind_span": f"SELECT doc_id, item_id, (pos - 1)::BIGINT AS char_start, (pos - 1 + length(quote))::BIGINT AS char_end FROM ({_BOUND})",
    "span_drops": "SELECT CASE WHEN length(q) = 0 THEN 'quote_not_in_source' WHEN instr(substr(text, 2), q) > 0 THEN 'quote_ambiguous' ELSE 'bound' END AS outcome, count(*) AS n FROM (SELECT text, substr(text, 1, 12) AS q FROM documents) GROUP BY 1",
    "context_window": f"SELECT doc_id, item_id, substr(text, greatest(0, pos - 2001) + 1, least(length(text), pos - 1 + length(quote) + 2000) - greatest(0, pos - 2001)) AS context, (pos - 1 - greatest(0, pos - 2001))::BIGINT AS context_offset FROM ({_BOUND})",
    "binding_rate": "SELECT count(*) FILTER (WHERE contains(text, substr(text, 3, 24) || CASE WHEN quality = 1 THEN '' ELSE '~zq' END)) / count(*)::DOUBLE AS binding_rate FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "normalise_text": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t\f\v\r]+(\n|$)', '\1', 'g'), '\n+$', '') || chr(10)) AS normal_hash FROM documents",
    "canonical_url": r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'ref', 'source', 'mc_cid', 'mc_eid'))) AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k""",
    "url_keys": r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, regexp_extract(host, '([^.]+\.[a-z]+)$', 1) AS web_key, regexp_matches(host, '(^|\.)(example\.net|g2\.com)$') AS no_crawl,
 CASE WHEN regexp_matches(rtrim(path, '/'), '^/(changelog|releases|whats-new|blog)') THEN 'own_domain_prose' ELSE 'own_domain_structured' END AS kind FROM h""",
    "entity_keys": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN lower(trim(p_brand) || '/' || replace(p_name, ' ', '_')) END AS gh_key, lower(replace(trim(p_brand), '_', '-')) || '-x' AS pypi_key, lower(trim(p_brand)) AS npm_key FROM part",
    "page_classes": f"""
WITH t AS (SELECT page_id, html, regexp_replace({_STRIP}, '<[^>]*>', ' ', 'g') AS t FROM pages),
c AS (SELECT *, regexp_matches(lower(t), 'domain is for sale|this domain may be for sale|buy this domain|domain parking|this domain is parked|related searches|checkout the full domain') OR length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 80 AS parked,
 length(t) < 200 AND regexp_matches(lower(t || ' ' || substr(html, 1, 2000)), 'accept cookies|cookie consent|we use cookies|manage preferences|accept all cookies') AS consent,
 regexp_matches(t, '(?i)([$€£¥₹]\\s?\\d|(?:per\\s+(?:mo|month|seat|user|year)\\b|/\\s?(?:mo|month)\\b)|\\bfree\\b)') AS priced FROM t)
SELECT page_id, parked, consent, priced, CASE page_id % 6 WHEN 1 THEN 'not_modified' WHEN 2 THEN 'http_error' WHEN 4 THEN 'http_error' ELSE
 CASE WHEN page_id % 7 = 0 THEN 'content_type' WHEN consent THEN 'consent_wall' WHEN length(t) < 200 THEN 'thin' ELSE 'ok' END END AS outcome FROM c""",
    "query_rejections": r"""
SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 'too_long'
 WHEN regexp_matches(text, '(?i)ignore (all |any )?(previous|prior|above) instructions|disregard (the |all )?(above|prior|previous)|you are now|\bact as\b|system prompt|reveal your (system )?(prompt|instructions)|new instructions\s*:|\bjailbreak\b|</?(system|assistant|user)>') THEN 'injection_attempt'
 WHEN regexp_matches(lower(text), 'weapon|explosive|firearm|bioweapon|malware|ransomware|csam|child sexual|human trafficking|drug trafficking') THEN 'blocklisted_category'
 WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 3 OR regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?i)^\s*what(''?s| is)\s+\d+\s*[\+\-\*/]\s*\d+|write me a (poem|song|story|essay)|tell me a joke|what(''?s| is) the weather|who (is|was) the president|translate (this|the following)|^\s*(hi|hello|hey)[.!]?\s*$') THEN 'non_product'
 ELSE 'accepted' END AS outcome FROM conversations""",
    "contradictions": f"SELECT entity_id, attribute, count(*) AS n_claims, count(DISTINCT k) AS n_values FROM ({_TAKING}) GROUP BY 1, 2 HAVING n_values > 1",
    "resolve_contradictions": f"""
WITH c AS ({_CLAIM}), t AS ({_TAKING}), r AS (SELECT id, row_number() OVER w AS n, first(id) OVER w AS winner FROM t WINDOW w AS (PARTITION BY entity_id, attribute ORDER BY grade, as_of DESC NULLS LAST, id)),
v AS (SELECT entity_id, attribute, count(DISTINCT k) AS k FROM t GROUP BY 1, 2)
SELECT c.id, CASE WHEN v.k > 1 AND r.n > 1 THEN r.winner ELSE c.superseded_by END AS superseded_by, coalesce(v.k > 1 AND r.n = 1, false) AS contradicted,
 round(CASE WHEN v.k > 1 AND r.n = 1 AND c.id % 19 <> 0 THEN {_SCORE.format(base=_BASE, domains="(1 + c.id % 3)", age="(c.id % 100)", factor="0.6::DOUBLE")} ELSE 0.5 END::DOUBLE, 9) AS confidence
FROM c LEFT JOIN r USING (id) LEFT JOIN v ON r.id IS NOT NULL AND v.entity_id = c.entity_id AND v.attribute = c.attribute""",
    "confidence": f"""
SELECT id, round(age, 6) AS age_days, round(least(CASE grade WHEN 'A' THEN 0.9 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.55 ELSE 0.35 END::DOUBLE * (1 + 0.05::DOUBLE * least(entity_id % 7, 4)) * pow(0.98::DOUBLE, age / 30) * CASE WHEN id % 3 = 0 THEN 0.6::DOUBLE ELSE 1 END, 0.97), 9) AS confidence
FROM (SELECT *, greatest(0::DOUBLE, date_diff('day', day, DATE '2024-06-30')::DOUBLE) AS age FROM ({_CLAIM}))""",
    "grades": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN greatest(g, 'B') ELSE g END AS grade FROM (SELECT c_custkey, ['A', 'A', 'B', 'B', 'C', 'D'][c_custkey % 6 + 1] AS g FROM customer)",
    "maturity": """
WITH s AS (SELECT s_suppkey, s_suppkey::BIGINT AS n FROM supplier),
x AS (SELECT s_suppkey, CASE WHEN n % 4 <> 0 THEN n * 37 % 3000 END AS dom, CASE WHEN n % 3 <> 0 THEN n * 13 % 900 END AS days, CASE WHEN n % 5 <> 0 THEN n * 71 % 9000 END AS stars, n % 11 = 0 AS fund, n % 13 = 0 AS stage,
 CASE WHEN n % 2 <> 0 THEN n * 997 % 200000 END AS inst, CASE WHEN n % 3 <> 0 THEN n * 1009 % 150000 END AS down, n % 17 = 0 AS shared FROM s),
r AS (SELECT s_suppkey, CASE WHEN days / 30.44 > 18 AND coalesce(stars, 0) = 0 AND coalesce(inst, 0) = 0 AND coalesce(down, 0) = 0 THEN 'abandoned:stale_commit_no_liveness' WHEN fund OR stage THEN 'funded:funding_signal'
 WHEN dom / 365.25 > 3 AND (coalesce(inst, 0) > 100000 OR coalesce(down, 0) > 100000 OR coalesce(stars, 0) > 5000) THEN 'established:domain_age_and_scale' WHEN shared THEN 'hobby:paas_subdomain'
 WHEN (stars IS NOT NULL OR down IS NOT NULL) AND coalesce(stars, 0) < 100 AND coalesce(down, 0) < 1000 THEN 'hobby:low_scale'
 WHEN dom IS NULL AND days IS NULL AND stars IS NULL AND inst IS NULL AND down IS NULL THEN 'indie:insufficient_signal' ELSE 'indie:default' END AS rule FROM x)
SELECT s_suppkey, split_part(rule, ':', 1) AS tier, rule, rule = 'indie:insufficient_signal' AS insufficient FROM r""",
    "vocabulary_gate": _GATE,
    "drop_counts": f"SELECT outcome AS drop_reason, count(*) AS n FROM ({_GATE}) WHERE outcome <> 'kept' GROUP BY 1",
    "coverage": """
WITH t AS (SELECT event_type || '-' || user_id % 7 AS kind, CASE WHEN user_id % 7 = 3 THEN 'failed' WHEN user_id % 7 = 5 THEN 'skipped' WHEN event_id % 4 = 1 THEN 'failed' WHEN event_id % 9 = 1 THEN 'running' ELSE 'done' END AS status,
 CASE WHEN event_type IN ('click', 'view') THEN 'budget_weight' ELSE 'timeout' END AS reason, event_id % 4 + 1 AS weight FROM events),
k AS (SELECT kind, bool_or(status = 'failed') AS failed, bool_or(status = 'skipped' AND starts_with(reason, 'budget')) AS budget, bool_or(status = 'skipped') AS skipped FROM t GROUP BY 1 HAVING NOT bool_or(status = 'done'))
SELECT round(sum(weight) FILTER (WHERE status = 'done') / sum(weight) FILTER (WHERE status IN ('done', 'failed', 'skipped'))::DOUBLE, 9) AS coverage,
 (SELECT coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (WHERE failed), '') FROM k) AS failed_branches, (SELECT coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (WHERE NOT failed AND budget), '') FROM k) AS budget_skipped_branches,
 (SELECT coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (WHERE NOT failed AND skipped AND NOT budget), '') FROM k) AS other_skipped_branches FROM t""",
    "promotion": "SELECT event_type || '-' || (event_id % 40) AS theme, count(*) AS n_claims, count(DISTINCT user_id) AS n_threads FROM events GROUP BY 1 HAVING n_claims >= 5 AND n_threads >= 3",
    "reaction_promotion": "SELECT user_id AS theme, count(*) AS n_claims, count(DISTINCT event_id) AS n_threads, coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)), 0)::BIGINT AS reactions FROM events GROUP BY 1 HAVING reactions >= 20",
    "cosine_to_label": "SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], f.e::DOUBLE[]), 6) AS cosine FROM embeddings v JOIN (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1) f ON f.label = v.label",
    "clusters": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.86),
cc(id, comp) USING KEY (id) AS (SELECT vec_id, vec_id FROM v UNION (SELECT DISTINCT ON (u.id) u.id, w.comp FROM recurring.cc AS u, cc AS w, e WHERE e.a = u.id AND e.b = w.id AND w.comp < u.comp ORDER BY u.id ASC, w.comp ASC))
SELECT id AS vec_id, comp AS cluster FROM cc""",
    "cluster_labels": "SELECT cluster, arg_min(slug, (-n, f)) AS label FROM (SELECT user_id % 50 AS cluster, event_type AS slug, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1",
    "alias_graph": """
WITH RECURSIVE l AS (SELECT DISTINCT 'web:' || (l_suppkey + 1000000) AS a, 'gh:' || (l_partkey + 1000000) AS b FROM lineitem),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.cc AS u, cc AS v, e WHERE e.a = u.id AND e.b = v.id AND v.comp < u.comp ORDER BY u.id ASC, v.comp ASC))
SELECT id AS key, min(id) FILTER (WHERE starts_with(id, 'web:')) OVER (PARTITION BY comp) AS canonical FROM cc""",
    "theme_findings": """
WITH e AS (SELECT event_id, event_type || '-' || (user_id % 20) AS slug, (user_id % 20)::VARCHAR AS cluster, user_id, CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'C' END AS grade FROM events),
l AS (SELECT cluster, arg_min(slug, (-n, f)) AS label FROM (SELECT cluster, slug, count(*) AS n, min(event_id) AS f FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT cluster, label, min(grade) AS best_grade, count(*) AS n_claims, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS claim_ids FROM e JOIN l USING (cluster) WHERE label NOT IN ('click-1', 'view-2') GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT user_id) >= 3""",
    "pricing_pivot": "SELECT l_suppkey AS entity_id, " + ", ".join(f"arg_max(l_linestatus, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_returnflag = '{x}') AS \"{x}\"" for x in "ANR") + " FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1",
    "price_landscape": "SELECT p_brand, round(median(p_retailprice), 4) AS median, min(p_retailprice) AS low, max(p_retailprice) AS high, count(DISTINCT p_partkey % 300) AS n_entities, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS claim_ids FROM part GROUP BY 1 HAVING n_entities >= 2",
    "competitors": "SELECT r_name, n_name, array_to_string(list_sort(list(s_suppkey)), ',') AS ids, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "freshness": "SELECT CASE WHEN m - floor(m) = 0.5 AND floor(m) % 2 = 0 THEN floor(m) ELSE round(m) END::INT AS median_age_days, o AS oldest FROM (SELECT median(date_diff('day', o_orderdate::DATE, DATE '2024-06-30')) AS m, min(o_orderdate::DATE) AS o FROM orders)",
    "citation_markers": r"""
WITH m AS (SELECT conv_id, turn, text, [turn, conv_id % 9, 3, 12] AS l FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids, sha256(regexp_replace(text || ' and', '^\s+|\s+$', '', 'g')) AS plain_hash FROM m""",
    "bind_statements": """
SELECT p_partkey AS statement_id, 'It costs $5.50, e.g. here.' || CASE WHEN p_partkey % 7 IN (2, 4, 5) THEN ' Part is ' || p_brand || '. Good.' ELSE '' END AS statement,
 CASE p_partkey % 7 WHEN 2 THEN '10,11,12' WHEN 4 THEN '10,11,12' WHEN 5 THEN '10,11,12,14' ELSE '10,11' END AS claims FROM part""",
    "discover_hits": r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS value FROM pages)
SELECT 'web' AS scheme, value, count(*)::BIGINT AS hit_count, min(page_id % 10 + 1000 * (page_id % 2))::BIGINT AS best_rank, arg_min('s' || page_id, page_id) FILTER (WHERE page_id % 3 <> 0) AS snippet
FROM h WHERE value <> '' GROUP BY 1, 2 ORDER BY hit_count DESC, best_rank, min(page_id) LIMIT 24""",
    "keep_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "insert_ignore": "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 20 = 1 AND user_id IS NOT NULL) GROUP BY 1",
    "duplicate_pages": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1",
}
QUERIES = {name: globals()[name] for name in SQL}
