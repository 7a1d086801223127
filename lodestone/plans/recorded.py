"""Recorded responses of each source, written as JSON from the driver's tables to the shared folder and read back by the fixed schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.operators import tables as X
from lodestone.operators.work import shared_dir
from lodestone.plans._common import table
from lodestone.sources import replay as R


def _back(raw: DataFrame, source: str) -> DataFrame:
    path = f"{shared_dir(raw.sparkSession)}/recorded-{source}-{uuid.uuid4().hex}"
    raw.write.json(path)
    return R.read(raw.sparkSession, source, path)


def _in_order(rows: DataFrame, key: Column, order: str, item: Column, name: str, **more: Column) -> DataFrame:
    """A response per key with its items in order: what one answer holds."""
    made = rows.select(key.alias("_key"), F.col(order).alias("_o"), item.alias("_i")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_o", "_i"))).alias("_l"))
    return made.select("_key", F.transform("_l", lambda x: x["_i"]).alias(name), *(c.alias(k) for k, c in more.items()))


def _text(c: Column) -> Column:
    return c.cast("string")


def recorded_search(spark: SparkSession, d: str) -> DataFrame:
    """Pages as results of thirty queries, ten each at most, with their snippets."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    raw = _in_order(p, k % 30, "page_id", F.struct("url", F.concat(F.lit("Page "), _text(k)).alias("title"), F.col("html").alias("text")), "results", cost=F.lit(0.005)).withColumn("query", F.concat(F.lit("q"), _text(F.col("_key")))).drop("_key")
    return R.search_results(_back(raw, "search")).select("query", F.col("rank").cast("long").alias("rank"), "url", "title", F.sha2("snippet", 256).alias("snippet_hash"))


def recorded_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Search results about a domain that may not be crawled: only its own results count."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    url = F.concat(F.when(k % 3 == 0, "https://www.g2.com/products/").when(k % 3 == 1, "https://other.com/g2.com/").otherwise("https://g2.com.evil.net/"), _text(k))
    raw = _in_order(s, k % 20, "s_suppkey", F.struct(url.alias("url"), F.col("s_name").alias("title"), F.col("s_name").alias("text")), "results", cost=F.lit(0.005)).withColumn("query", _text(F.col("_key"))).drop("_key")
    return R.aggregator_snippets(_back(raw, "search"), "g2.com", limit=4).select("domain", "url", "title", "snippet", F.col("rank").cast("long").alias("rank"))


def recorded_stories(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    hit = F.struct(_text(k).alias("objectID"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("https://n.com/"), _text(k)).alias("url"), (k % 500).alias("points"), (k % 90).alias("num_comments"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return R.stories(_back(_in_order(o, k % 100, "o_orderkey", hit, "hits").drop("_key"), "stories")).select("objectID", "title", "url", "points", "num_comments", _text(F.col("created_at")).alias("created_at"))


def recorded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the quota that their answer reports."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    item = F.struct(k.alias("question_id"), F.concat(F.lit("Why "), _text(k)).alias("title"), F.concat(F.lit("https://a.com/q/"), _text(k)).alias("link"), (k % 40 - 5).alias("score"))
    return R.answers(_back(_in_order(c, k % 25, "c_custkey", item, "items", quota_remaining=300 - F.col("_key")).drop("_key"), "answers"))


def recorded_downloads(spark: SparkSession, d: str) -> DataFrame:
    """Of each package's weeks the last one."""
    li, k = table(spark, d, "lineitem"), F.col("l_partkey") % 200
    week = li.select(F.concat(F.lit("pkg-"), _text(k)).alias("package"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int")).alias("end"))
    raw = week.groupBy("package", "end").agg(F.max("n").alias("downloads")).withColumn("start", F.date_sub("end", 6))
    return R.weekly_downloads(_back(raw, "downloads"))


def recorded_launches(spark: SparkSession, d: str) -> DataFrame:
    """Each launch once, however often it was delivered; an empty website is none."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    launch = lambda rows: rows.select(F.concat(F.lit("launch-"), _text(k)).alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("tagline"), (k % 700).alias("votes_count"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://l"), _text(k), F.lit(".com"))).alias("website"), F.lit("2024-01-01").cast("timestamp").alias("launched_at"))
    return R.launch(_back(launch(p).unionByName(launch(p.filter("p_partkey % 2 = 0"))), "launch")).drop("launched_at")


def recorded_issues(spark: SparkSession, d: str) -> DataFrame:
    """The fifty issues of most reactions, with their repositories: a report of the top."""
    e, k = table(spark, d, "events"), F.col("event_id")
    row = e.select(k.alias("number"), F.col("event_type").alias("title"), F.concat(F.lit("https://github.com/own"), _text(k % 7), F.lit("/repo"), _text(k % 30), F.lit("/issues/"), _text(k)).alias("html_url"), F.when(k % 5 != 0, F.struct((k * 7919 % 1009).alias("total_count"))).alias("reactions"))
    return R.search_issues(_back(row, "github_issues"), 50)


def recorded_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories by their own answers: no license and no homepage are none."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    row = p.select(F.concat(F.lit("o/r"), _text(k)).alias("full_name"), (k * 3).alias("stargazers_count"), (k % 11).alias("open_issues_count"), F.when(k % 4 != 0, F.struct(F.when(k % 3 == 0, "").otherwise("MIT").alias("spdx_id"))).alias("license"), F.lit("2024-02-03 04:05:06").cast("timestamp").alias("pushed_at"), F.when(k % 2 == 0, "").otherwise("https://h.com").alias("homepage"))
    return R.repository(_back(row, "github_repo")).withColumn("last_commit_at", _text(F.col("last_commit_at")))


def exported_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables exported and read back."""
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    X.export({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}, folder)
    return spark.read.parquet(f"{folder}/nation").join(spark.read.parquet(f"{folder}/region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


def canonical_https(spark: SparkSession, d: str) -> DataFrame:
    """Canonical URLs of hosts that are known to answer by https."""
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url"), https=True).alias("canonical"))


SQL = {
    "recorded_search": "SELECT 'q' || (page_id % 30) AS query, r AS rank, url, 'Page ' || page_id AS title, sha256(substr(html, 1, 500)) AS snippet_hash FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 30 ORDER BY page_id) - 1 AS r FROM pages) WHERE r < 10",
    "recorded_snippets": "SELECT 'g2.com' AS domain, 'https://www.g2.com/products/' || s_suppkey AS url, s_name AS title, s_name AS snippet, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey % 20 ORDER BY s_suppkey) - 1 AS r FROM supplier) WHERE r < 4 AND s_suppkey % 3 = 0",
    "recorded_stories": "SELECT o_orderkey::VARCHAR AS \"objectID\", o_orderpriority AS title, 'https://n.com/' || o_orderkey AS url, o_orderkey % 500 AS points, o_orderkey % 90 AS num_comments, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders",
    "recorded_answers": "SELECT 300 - c_custkey % 25 AS quota_remaining, c_custkey AS question_id, 'Why ' || c_custkey AS title, 'https://a.com/q/' || c_custkey AS link, c_custkey % 40 - 5 AS score FROM customer",
    "recorded_downloads": "SELECT 'pkg-' || (l_partkey % 200) AS package, arg_max(l_orderkey * 10 + l_linenumber, (l_orderkey * 8 + l_linenumber, l_orderkey * 10 + l_linenumber)) AS downloads FROM lineitem GROUP BY 1",
    "recorded_launches": "SELECT 'launch-' || p_partkey AS slug, p_name AS name, p_brand AS tagline, p_partkey % 700 AS votes, CASE WHEN p_partkey % 3 <> 0 THEN 'https://l' || p_partkey || '.com' END AS website FROM part",
    "recorded_issues": "SELECT event_id AS number, event_type AS title, 'https://github.com/own' || (event_id % 7) || '/repo' || (event_id % 30) || '/issues/' || event_id AS html_url, CASE WHEN event_id % 5 <> 0 THEN event_id * 7919 % 1009 ELSE 0 END AS reactions_total, 'own' || (event_id % 7) || '/repo' || (event_id % 30) AS repo FROM events ORDER BY CASE WHEN event_id % 5 <> 0 THEN event_id * 7919 % 1009 END DESC NULLS LAST, event_id LIMIT 50",
    "recorded_repositories": "SELECT 'o/r' || p_partkey AS full_name, p_partkey * 3 AS stargazers_count, p_partkey % 11 AS open_issues_count, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN 'MIT' END AS license, '2024-02-03 04:05:06' AS last_commit_at, CASE WHEN p_partkey % 2 <> 0 THEN 'https://h.com' END AS homepage FROM part",
    "exported_tables": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "canonical_https": r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'ref', 'source', 'mc_cid', 'mc_eid'))) AS kept FROM p)
SELECT page_id, 'https://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k""",
}
QUERIES = {name: globals()[name] for name in SQL}
