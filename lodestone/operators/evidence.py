"""From recorded pages and answers to claims: synthetic sources, extraction, persisting, and the tasks that profile, price, mine and look up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import claims as C
from lodestone.operators import tables as X
from lodestone.operators.work import dealt

UNIQUE = ["run_id", "source_id", "attribute", "char_start"]
#: Repositories whose claims one task holds.
REPOS_EACH = 20_000


def synthetic_sources(old: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """docs: canonical_url, root_key, text, retrieval_reason. Sources for texts that were made from answers: a fresh one with the same content stays as it is, any other is replaced or added, for a week."""
    new = docs.select(
        "canonical_url", "root_key", F.col("text").alias("extracted_text"), F.sha2("text", 256).alias("content_hash"), F.lit(200).alias("http_status"), now.alias("fetched_at"),
        (now + F.make_interval(days=F.lit(fixed.SYNTHETIC_DAYS))).alias("ttl_expires_at"), "retrieval_reason",
    )
    fresh = old.filter(F.col("ttl_expires_at") > now).select("canonical_url", "content_hash")
    replaced = new.join(fresh, ["canonical_url", "content_hash"], "left_anti").select(*new.columns)
    return old.join(replaced.select("canonical_url"), "canonical_url", "left_anti").select(*new.columns).unionByName(replaced)


def extract(sources: DataFrame, cache: DataFrame, version: Column) -> DataFrame:
    """Raw claims of sources from the extraction cache (content_hash, extractor_version, claims: array of struct), gated anew each time: what is kept for good is raw, never trusted."""
    raw = sources.withColumn("extractor_version", version).join(cache, ["content_hash", "extractor_version"]).withColumn("_c", F.explode("claims"))
    rows = raw.select(*sources.columns, "extractor_version", "_c.attribute", "_c.value_text", "_c.value_num", "_c.unit", "_c.as_of", "_c.quote")
    return C.gate(rows, text="extracted_text")


def not_extracted(sources: DataFrame, cache: DataFrame, version: Column) -> DataFrame:
    """Sources that the cache has no claims of: what is to be asked for."""
    return sources.withColumn("extractor_version", version).join(cache.select("content_hash", "extractor_version"), ["content_hash", "extractor_version"], "left_anti").drop("extractor_version")


def persist(old: DataFrame, gated: DataFrame, grade: Column, now: Column) -> DataFrame:
    """The bound claims to insert: graded, scored by their own source alone, with the inputs of the score; a claim that stands at the same place already is left out. gated: run_id, entity_id, source_id, canonical_url, fetched_at, and what gate gives."""
    inputs = F.struct(grade.alias("best_grade"), F.lit(1).alias("n_distinct_domains"), S.age_days(F.col("as_of"), F.col("fetched_at"), now).alias("age_days"), F.lit(False).alias("contradicted"))
    kept = gated.filter("drop_reason is null").withColumn("grade", grade).withColumn("confidence_inputs", inputs)
    i = F.col("confidence_inputs")
    scored = kept.withColumn("confidence", S.confidence(i["best_grade"], i["n_distinct_domains"], i["age_days"], i["contradicted"]))
    return X.insert_ignore(old, scored, UNIQUE, [F.col("ord") if "ord" in gated.columns else F.col("quote")])


def persist_structured(old: DataFrame, rows: DataFrame, grade: Column, now: Column) -> DataFrame:
    """Claims that come with their source's text (as persist takes them, without gates): only the span is bound, and what has none is left out."""
    span = T.bind_span(F.col("extracted_text"), F.col("quote"))
    bound = rows.withColumn("_s", span).filter("_s is not null").withColumn("char_start", F.col("_s.start")).withColumn("char_end", F.col("_s.end"))
    window = T.context_window(F.col("extracted_text"), F.col("char_start"), F.col("char_end"))
    bound = bound.withColumn("_w", window).withColumn("quote_context", F.col("_w.context")).withColumn("context_offset", F.col("_w.offset")).drop("_s", "_w")
    return persist(old, bound.withColumn("drop_reason", F.lit(None).cast("string")), grade, now)


# ---- the tasks


def profile_pages(entities: DataFrame, attempts: DataFrame, pages: int = fixed.PAGES) -> DataFrame:
    """entities: entity_id, entity_key; attempts: root_key, path_kind, pos, path, ok. The pages that profiling reads of a web entity: its home, and the first path that worked of each kind, `pages` in all."""
    web = entities.filter(F.col("entity_key").startswith("web:")).withColumn("root_key", F.substring_index("entity_key", ":", -1))
    home = web.select("entity_id", "root_key", F.lit("/").alias("path"), F.concat(F.lit("https://"), "root_key").alias("url"))
    kinds = fixed.PAGE_KINDS[: max(pages - 1, 0)]
    found = attempts.filter(F.col("ok") & F.col("path_kind").isin(kinds) & (F.col("pos") < fixed.PATH_ATTEMPTS)).groupBy("root_key", "path_kind").agg(F.min_by("path", "pos").alias("path"))
    more = web.join(found, "root_key").select("entity_id", "root_key", "path", F.concat(F.lit("https://"), "root_key", "path").alias("url"))
    return home.unionByName(more)


def pricing_page(entities: DataFrame, attempts: DataFrame) -> DataFrame:
    """The one page that extract_pricing reads: the first pricing path that worked."""
    every = profile_pages(entities, attempts.filter("path_kind = 'pricing'"))
    return every.filter("path != '/'")


def page_claims(pages: DataFrame, sources: DataFrame, cache: DataFrame, version: Column) -> DataFrame:
    """Claims of pages that were fetched with a text, graded by what kind of page it is."""
    good = pages.join(sources.withColumnRenamed("canonical_url", "url"), "url").filter("http_status = 200 and length(extracted_text) > 0")
    return extract(good, cache, version).withColumn("grade", S.grade_for(S.own_domain_kind(F.col("path")), F.lit(None).cast("string")))


def snippet_docs(places: DataFrame) -> DataFrame:
    """root_key, snippet: search snippets as sources of their own, never to be taken for the page."""
    return places.filter(F.length(T.strip(F.col("snippet"))) > 0).select(F.concat(F.lit("https://"), "root_key", F.lit("#serp-snippet")).alias("canonical_url"), "root_key", F.col("snippet").alias("text"), F.lit("serp_snippet").alias("retrieval_reason"))


def without_prices(gated: DataFrame) -> DataFrame:
    """A snippet is too weak to state a price."""
    return gated.filter(~F.col("attribute").startswith("pricing."))


def funding_claims(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("attribute").isin(fixed.FUNDING_ATTRIBUTES))


def funding_query(display_name: Column, value: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(display_name, F.lit("")), value), F.lit(" funding round investors"))


def venue_line(venue: Column) -> Column:
    """A hit (title, url, points, n_comments, body, repo) as a line of a community document."""
    start = F.concat(F.lit('- "'), F.coalesce("title", F.lit("")), F.lit('" ('))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    hn = F.concat(start, F.coalesce("url", F.lit("no link")), F.lit(") — "), number("points"), F.lit(" points, "), number("n_comments"), F.lit(" comments"))
    se = F.substring(F.concat(start, F.coalesce("url", F.lit("")), F.lit(") — score "), number("points"), F.lit(". "), T.strip(F.coalesce("body", F.lit("")))), 1, 1000)
    gh = F.concat(start, F.coalesce("url", F.lit("")), F.lit(") — "), number("points"), F.lit(" reactions, repo "), F.coalesce("repo", F.lit("")))
    return F.when(venue == "hn", hn).when(venue == "stackexchange", se).when(venue == "github", gh)


def community_docs(hits: DataFrame, run_id: str, n_keywords: int, n_venues: int) -> DataFrame:
    """hits: venue, keyword, rank and what venue_line reads. A document per venue and keyword, of as many lines as its share of the threads allows."""
    share = max(fixed.THREADS // max(n_keywords * n_venues, 1), 1)
    lines = hits.filter(F.col("rank") < share).withColumn("line", venue_line(F.col("venue"))).filter("line is not null")
    docs = lines.groupBy("venue", "keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))  # `share` lines at most
    text = F.concat(F.lit('Community discussion mentioning "'), "keyword", F.lit('" on '), "venue", F.lit(":\n\n"), "lines", F.lit("\n"))
    return docs.select(F.concat(F.lit("community://"), "venue", F.lit(f"/{run_id}/"), "keyword").alias("canonical_url"), F.col("venue").alias("root_key"), text.alias("text"), F.lit("mine_community").alias("retrieval_reason"))


def category_entity(run_id: str, hint: Column) -> tuple[Column, Column]:
    """Key and name of the entity that community claims belong to."""
    return F.lit(f"category:{run_id}"), F.substring(F.concat(F.lit("Community signal: "), hint), 1, 200)


def _oss_text() -> Column:
    last = F.when(F.col("last_commit").isNotNull(), F.concat(F.lit("Last commit at "), F.date_format("last_commit", "yyyy-MM-dd"), F.lit(".\n"))).otherwise("")
    return F.concat(F.col("repo"), F.lit(": "), F.col("stars").cast("string"), F.lit(" stars.\nLicense: "), F.coalesce("license", F.lit("none declared")), F.lit(".\n"), last)


def _oss_url() -> Column:
    return F.concat(F.lit("github-api://"), "repo")


def oss_docs(repos: DataFrame) -> DataFrame:
    """repos: repo, stars, license, last_commit (date). What the source says of each."""
    return repos.select(_oss_url().alias("canonical_url"), F.lit("github.com").alias("root_key"), _oss_text().alias("text"), F.lit("oss_profile").alias("retrieval_reason"), "repo")


def oss_sourced(repos: DataFrame, *, each: int = REPOS_EACH) -> DataFrame:
    """repos as oss_claims takes them, with source_id: their claims, each with its own source's address and text. They lie by source, so that persisting them moves nothing again."""
    return oss_claims(dealt(repos, "source_id", each=each).withColumn("canonical_url", _oss_url()).withColumn("extracted_text", _oss_text()))


def oss_claims(repos: DataFrame) -> DataFrame:
    """Up to five claims of a repository (repo, stars, license, last_commit, velocity) with quotes out of oss_docs."""
    stars, day = F.concat(F.col("stars").cast("string"), F.lit(" stars")), F.date_format("last_commit", "yyyy-MM-dd")
    none, no_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = [
        ("oss.repo", F.lit(True), F.col("repo"), F.col("repo"), no_num),
        ("oss.stars", F.lit(True), stars, none, F.col("stars").cast("double")),
        ("oss.license", F.length("license") > 0, F.concat(F.lit("License: "), "license"), F.col("license"), no_num),
        ("oss.last_commit_at", F.col("last_commit").isNotNull(), F.concat(F.lit("Last commit at "), day), day, no_num),
        ("oss.stars_90d_delta", F.col("velocity").isNotNull(), stars, none, F.bround(F.col("velocity") * 90).cast("double")),
    ]
    each = [F.when(F.coalesce(there, F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(name).alias("attribute"), quote.alias("quote"), text.alias("value_text"), num.alias("value_num"))) for i, (name, there, quote, text, num) in enumerate(rows)]
    return repos.withColumn("_c", F.explode(F.array_compact(F.array(*each)))).select(*repos.columns, "_c.*")


def trends(hits: DataFrame, views: DataFrame, keywords: DataFrame) -> DataFrame:
    """keywords: keyword, pos; hits: keyword; views: article, views. Volume of recent posts and page views of the first keywords; a keyword nobody posted about has 0, unknown views are null."""
    few = keywords.filter(F.col("pos") < fixed.TREND_KEYWORDS).withColumn("article", T.capitalised_article(F.col("keyword")))
    counted = hits.groupBy("keyword").agg(F.count("*").alias("posts"))
    return few.join(counted, "keyword", "left").join(views, "article", "left").select("keyword", "article", F.coalesce("posts", F.lit(0)).alias("posts"), "views")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
