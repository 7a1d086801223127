"""The fetch chain against a plain loop over requests."""

import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from lodestone.operators import fetch as FE

NOW = dt.datetime(2024, 6, 30)
DAY = dt.timedelta(days=1)
LONG = "words and more words " * 20


def page(text):
    return f"<html><body><p>{text}</p></body></html>"


def extract(c):
    return F.trim(F.regexp_replace(c, "<[^>]*>", " "))


CACHE = "canonical_url string, root_key string, http_status int, extracted_text string, content_hash string, etag string, last_modified string, retrieval_reason string, fetched_at timestamp, ttl_expires_at timestamp"
RESPONSES = "canonical_url string, attempt int, status int, content_type string, etag string, last_modified string, final_url string, html string"
H = "text/html; charset=utf-8"


def entry(url, text, etag=None, modified=None, days=1, status=200):
    return (url, "a.com", status, text, None if text is None else hashlib.sha256(text.encode()).hexdigest(), etag, modified, "old", NOW - 9 * DAY, NOW + days * DAY)


def frames(spark):
    cache = spark.createDataFrame([entry("http://a.com/fresh", "kept"), entry("http://a.com/same", "as it was", "e1", days=-1), entry("http://a.com/changed", "before", "e1", days=-1), entry("http://a.com/since", "still", None, "Mon", days=-1), entry("http://a.com/gone", "there", "e1", days=-1)], CACHE)
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /private"), ("b.com", "User-agent: *\nDisallow: /")], "host string, body string")
    r = lambda url, status, attempt=0, kind=H, etag=None, modified=None, final=None, html=page(LONG): (url, attempt, status, kind, etag, modified, final or url, html)
    responses = spark.createDataFrame([
        r("http://a.com/fresh", 200), r("http://a.com/same", 200, etag="e1"), r("http://a.com/changed", 200, etag="e2"), r("http://a.com/since", 200, modified="Mon"), r("http://a.com/gone", 404), r("http://a.com/private/x", 200), r("http://b.com/", 200),
        r("http://a.com/retry", 503), r("http://a.com/retry", None, 1), r("http://a.com/retry", 200, 2), r("http://a.com/down", 503), r("http://a.com/down", 503, 1), r("http://a.com/down", 500, 2), r("http://a.com/down", 200, 3), r("http://a.com/slow", None), r("http://a.com/slow", 503, 1), r("http://a.com/slow", None, 2),
        r("http://a.com/pdf", 200, kind="application/pdf"), r("http://a.com/nokind", 200, kind=None), r("http://a.com/thin", 200, html="<p> </p>"), r("http://a.com/wall", 200, html=page("Please Accept Cookies")), r("http://a.com/tls", 200, final="https://a.com/tls"), r("http://g2.com/x", 200), r("http://www.capterra.com/x", 200),
    ], RESPONSES)
    return cache, robots, responses


WANT = {
    "http://a.com/fresh": ("hit", 200, "kept"), "http://a.com/same": ("conditional_304", 200, "as it was"), "http://a.com/changed": ("miss", 200, LONG.strip()), "http://a.com/since": ("conditional_304", 200, "still"), "http://a.com/gone": ("miss", 404, None), "http://a.com/private/x": ("robots", None, None), "http://b.com/": ("robots", None, None),
    "http://a.com/retry": ("miss", 200, LONG.strip()), "http://a.com/down": ("miss", 500, None), "http://a.com/slow": ("timeout", None, None), "http://a.com/pdf": ("content_type", None, None), "http://a.com/nokind": ("miss", 200, LONG.strip()), "http://a.com/thin": ("thin", None, None), "http://a.com/wall": ("thin", None, None), "http://a.com/tls": ("miss", 200, LONG.strip()),
    "http://g2.com/x": ("no_crawl", None, None), "http://www.capterra.com/x": ("no_crawl", None, None), "http://a.com/never": ("timeout", None, None), "no url": ("no_url", None, None),
}


def test_chain(spark):
    cache, robots, responses = frames(spark)
    requests = spark.createDataFrame([(k, u) for k, u in enumerate([*WANT, "HTTP://A.com:80/fresh?utm_x=1#top", "http://a.com/retry/"])], "k int, url string")
    now = F.lit(NOW)
    out, stored = FE.fetch(requests, cache, robots, responses, now, agent="bot", extract=extract, reason="test")
    got = {r.url: (r.outcome, r.http_status, r.extracted_text) for r in out.collect()}
    assert {u: got[u] for u in WANT} == WANT and out.count() == len(WANT) + 2
    assert got["HTTP://A.com:80/fresh?utm_x=1#top"][0] == "hit" and got["http://a.com/retry/"] == got["http://a.com/retry"]
    after = {r.canonical_url: r for r in FE.merged(cache, stored).collect()}
    assert set(after) == {"http://a.com/fresh", "http://a.com/same", "http://a.com/changed", "http://a.com/since", "http://a.com/gone", "http://a.com/retry", "http://a.com/down", "http://a.com/nokind", "https://a.com/tls"}
    assert after["http://a.com/fresh"].fetched_at == NOW - 9 * DAY and after["http://a.com/same"].ttl_expires_at == NOW + 7 * DAY and after["http://a.com/same"].etag == "e1"
    assert after["http://a.com/changed"].etag == "e2" and after["http://a.com/changed"].content_hash == hashlib.sha256(LONG.strip().encode()).hexdigest() and after["http://a.com/changed"].root_key == "a.com"
    assert after["http://a.com/gone"].extracted_text is None and after["http://a.com/gone"].ttl_expires_at == NOW + DAY and after["http://a.com/gone"].etag is None
    # a second run within the lifetime asks for nothing that is kept
    again, more = FE.fetch(requests, FE.merged(cache, stored), robots, responses, now, agent="bot", extract=extract)
    kept = {u for u, r in WANT.items() if r[0] in ("hit", "miss", "conditional_304")}
    assert {r.url for r in again.collect() if r.outcome == "hit" and r.url in WANT} == kept - {"http://a.com/tls"} and {r._asked for r in more.collect()} == {"http://a.com/tls"}
    forced, _ = FE.fetch(requests.withColumn("force", F.lit(True)), cache, robots, responses, now, agent="bot", extract=extract)
    assert {r.url: r.outcome for r in forced.collect()}["http://a.com/fresh"] == "miss"
    none, empty = FE.fetch(requests.limit(0), cache, robots, responses, now, agent="bot")
    assert none.count() == 0 and empty.count() == 0


def test_path_guesses(spark):
    cache, robots, _ = frames(spark)
    r = lambda host, path, text, status=200: (f"https://{host}{path}", 0, status, H, None, None, f"https://{host}{path}", page(text + LONG))
    responses = spark.createDataFrame([r("a.com", "/pricing", "no price here "), r("a.com", "/plans", "from $ 9 per month "), r("a.com", "/price", "free "), r("c.com", "/docs", "x", 404), r("c.com", "/developers", "the docs "), r("d.com", "/pricing", "free ")], RESPONSES)
    domains = spark.createDataFrame([("a.com", "pricing"), ("a.com", "pricing"), ("c.com", "docs"), ("d.com", "pricing"), ("e.com", "changelog"), ("b.com", "docs")], "root_key string, kind string")
    known = spark.createDataFrame([("d.com", "pricing", "/subscribe", NOW + DAY), ("a.com", "pricing", None, NOW - DAY)], "root_key string, kind string, found_path string, ttl_expires_at timestamp")
    found, attempts, entries, used = FE.guess_paths(domains, known, cache, robots, responses, F.lit(NOW), agent="bot", extract=extract)
    assert {(x.root_key, x.kind): (x.found_path, x.from_cache) for x in found.collect()} == {("a.com", "pricing"): ("/plans", False), ("c.com", "docs"): ("/developers", False), ("d.com", "pricing"): ("/subscribe", True), ("e.com", "changelog"): (None, False), ("b.com", "docs"): (None, False)}
    tries = {}
    for x in attempts.orderBy("root_key", "pos").collect():
        tries.setdefault(x.root_key, []).append((x.path, x.outcome))
    assert tries["a.com"] == [("/pricing", "miss"), ("/plans", "hit")] and tries["c.com"] == [("/docs", "miss"), ("/documentation", "miss"), ("/developers", "hit")] and len(tries["e.com"]) == len(tries["b.com"]) == 4 and "d.com" not in tries
    assert {(x.root_key, x.found_path): x.ttl_expires_at - NOW for x in entries.collect()} == {("a.com", "/plans"): 7 * DAY, ("c.com", "/developers"): 7 * DAY, ("e.com", None): DAY, ("b.com", None): DAY}
    assert {x.canonical_url for x in used.collect()} == {"https://a.com/pricing", "https://a.com/plans", "https://c.com/docs", "https://c.com/developers"}
    assert re.match("path_guess", used.first().retrieval_reason)
