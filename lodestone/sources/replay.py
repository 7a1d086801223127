"""Recorded vendor responses as tables: JSON files with fixed schemas, and the projections that each source applies."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators.folds import Fold, exact, folded

GROUND_TRUTH = "query_id string, query string, difficulty string, split string, role string, must_include array<string>, known_absent array<string>, facts array<struct<entity:string,attribute:string,value:string,verified_on:date,source:string>>"

#: Record schemas by source.
SCHEMAS = {
    "search": "query string, results array<struct<url:string,title:string,text:string>>, cost double",
    "github_repo": "full_name string, html_url string, description string, stargazers_count long, open_issues_count long, license struct<spdx_id:string>, pushed_at timestamp, homepage string",
    "github_issues": "number long, title string, html_url string, reactions struct<total_count:long>, repository_url string",
    "github_repositories": "items array<struct<full_name:string,html_url:string,description:string,stargazers_count:long>>",
    "stories": "hits array<struct<objectID:string,title:string,url:string,points:long,num_comments:long,created_at:timestamp>>",
    "answers": "items array<struct<question_id:long,title:string,link:string,score:long>>, quota_remaining long",
    "downloads": "package string, downloads long, start date, end date",
    "launch": "slug string, name string, tagline string, votes_count long, website string, launched_at timestamp",
    "pageviews": "article string, items array<struct<timestamp:string,views:long>>",
}


def read(spark: SparkSession, source: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[source]).json(path)


def search_results(raw: DataFrame, limit: int = 10) -> DataFrame:
    """Results with their rank from 0 and snippets of 500 characters at most."""
    return raw.select("query", F.posexplode("results").alias("rank", "r")).filter(F.col("rank") < limit).select("query", "rank", "r.url", "r.title", F.substring("r.text", 1, 500).alias("snippet"))


def top_issues(raw: DataFrame, n: int) -> DataFrame:
    return raw.orderBy(F.desc("reactions.total_count"), "number").limit(n)


def stories(raw: DataFrame) -> DataFrame:
    return raw.select(F.inline("hits"))


def header_rows(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """JSON arrays whose first row names the columns: one map `record` per further row."""
    rows = df.withColumn("_rows", F.from_json(body, "array<array<string>>")).filter(F.size("_rows") > 1)
    return rows.select(*keys, F.element_at("_rows", 1).alias("_head"), F.explode(F.slice("_rows", 2, F.size("_rows") - 1)).alias("_row")).select(*keys, F.map_from_arrays("_head", "_row").alias("record"))


def twelve_months(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Views per article over its items (article, items of timestamp yyyyMMdd.. and views), of the last twelve whole months if now is given; none at all is null."""
    rows = raw.select("article", F.explode_outer("items").alias("i"))
    counted = F.col("i.views")
    if now is not None:
        day = F.try_to_timestamp(F.substring("i.timestamp", 1, 8), F.lit("yyyyMMdd"))
        end = F.date_trunc("month", now)
        counted = F.when((day >= F.date_trunc("month", now - F.expr("interval 365 days"))) & (day < end), counted)
    return rows.groupBy("article").agg(F.nullif(F.sum(counted), F.lit(0).cast("long")).alias("views"))


def star_velocity(stars: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Stars of the last days per day of the span they lie in, one at least."""
    recent = stars.filter(F.col("starred_at") >= now - F.make_interval(days=F.lit(days)))
    span = (F.unix_micros(F.max(now).cast("timestamp")) - F.unix_micros(F.min("starred_at").cast("timestamp"))) / 86_400_000_000
    return recent.groupBy("repo").agg(F.count("*").alias("stars"), (F.count("*") / F.greatest(F.lit(1.0), span)).alias("velocity"))


class RollingAllowance(Fold):
    """State: what was spent in the hours before (microseconds, billionths), oldest first, and its sum."""

    columns = "charged double, degraded boolean, reason string"

    def __init__(self, allowance: float, hours: int):
        self.allowance, self.span = exact(allowance), hours * 3_600_000_000

    def start(self) -> list:
        return [deque(), 0]

    def step(self, state: list, row: dict) -> list:
        spent = state[0]
        while spent and spent[0][0] < row["_us"] - self.span:
            state[1] -= spent.popleft()[1]
        if row["hit"]:
            return [0.0, False, None]
        if state[1] >= self.allowance:
            return [0.0, True, "allowance"]
        if row["error"] is not None:
            return [0.0, True, row["error"]]
        spent.append((row["_us"], exact(row["cost"])))
        state[1] += spent[-1][1]
        return [float(row["cost"]), False, None]


def route(requests: DataFrame, cache: DataFrame, now: Column, allowance: float, *, hours: int = 24) -> DataFrame:
    """requests: provider, query, ord, at, cost, error (null where the provider answered); cache: query, expires_at. Adds hit, charged, degraded, reason.

    A fresh entry is a hit and costs nothing. Else the request is refused once what was spent in the hours before it
    reaches the allowance; a refused or failed one is degraded, never an error, and costs nothing.
    """
    fresh = cache.filter(F.col("expires_at") > now).select("query", F.lit(True).alias("hit")).dropDuplicates(["query"])
    r = requests.join(fresh, "query", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("_us", F.unix_micros(F.col("at").cast("timestamp")))

    return folded(r, ["provider"], ["_us", "ord"], RollingAllowance(allowance, hours)).drop("_us")


def search_repositories(raw: DataFrame) -> DataFrame:
    """Found repositories by stars: rank, full_name, html_url, description, stars."""
    rows = raw.select(F.posexplode("items").alias("rank", "i"))
    return rows.select("rank", "i.full_name", "i.html_url", "i.description", F.col("i.stargazers_count").alias("stars"))


def search_issues(raw: DataFrame, limit: int) -> DataFrame:
    """Found issues with the repository that their address names."""
    return top_issues(raw, limit).select("number", "title", "html_url", F.coalesce("reactions.total_count", F.lit(0)).alias("reactions_total"), T.issue_repo(F.col("html_url")).alias("repo"))


def repository(raw: DataFrame) -> DataFrame:
    return raw.select("full_name", "stargazers_count", "open_issues_count", F.nullif("license.spdx_id", F.lit("")).alias("license"), F.col("pushed_at").alias("last_commit_at"), F.nullif("homepage", F.lit("")).alias("homepage"))


def answers(raw: DataFrame) -> DataFrame:
    """Questions, and the quota that the answer itself reports."""
    return raw.select(F.col("quota_remaining"), F.inline("items"))


def weekly_downloads(raw: DataFrame) -> DataFrame:
    return raw.groupBy("package").agg(F.max_by("downloads", "end").alias("downloads"))


def launch(raw: DataFrame) -> DataFrame:
    return raw.dropDuplicates(["slug"]).select("slug", "name", "tagline", F.col("votes_count").alias("votes"), F.nullif("website", F.lit("")).alias("website"), "launched_at")


def aggregator_snippets(raw: DataFrame, domain: str, limit: int = 5) -> DataFrame:
    """Snippets of search results about a domain that may not be crawled; any other domain is refused."""
    if domain not in fixed.NO_CRAWL:
        raise ValueError(f"{domain} is not one of the aggregators that are read by snippets")
    return search_results(raw, limit).filter(U.in_domains(U.host(F.col("url")), [domain])).select(F.lit(domain).alias("domain"), "url", "title", "snippet", "rank")


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark queries from YAML files folder/q*.yaml, sorted by id. Files are read by Spark, so the folder may be in any store."""
    import yaml

    texts = spark.read.text(f"{folder}/q*.yaml", wholetext=True).collect()  # a file per benchmark query, ten or so
    rows = []
    for t in texts:
        q = yaml.safe_load(t.value)
        g = q.get("ground_truth") or {}
        facts = [(f["entity"], f["attribute"], str(f["value"]), f.get("verified_on"), f.get("source")) for f in g.get("facts") or []]
        rows.append((q["id"], q["query"], q.get("difficulty"), q["split"], q.get("role"), g.get("must_include") or [], g.get("known_absent") or [], facts))
    return spark.createDataFrame(sorted(rows), GROUND_TRUTH)


def latest_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Result files folder/<date>/<query>.json of the latest date."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/*.json").withColumn("_day", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1))
    return rows.join(F.broadcast(rows.agg(F.max("_day").alias("_day"))), "_day").drop("_day")
