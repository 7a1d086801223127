"""Fetched pages: text of HTML, robots rules, conditional refresh."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lodestone.functions import fixed

_HIDDEN, _BREAKS = {"script", "style", "nav", "footer", "noscript", "template", "head"}, {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr", "section", "article"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in _HIDDEN and self.hidden > 0
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def _text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Visible text, a line per block."""
    return s.map(_text)


def allowed(requests: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """requests: host, url; robots: host, body. Adds allowed; hosts without a file allow all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, RobotFileParser] = {}
        for f in frames:
            out = []
            for body, url in zip(f["body"], f["url"], strict=True):
                if not isinstance(body, str):
                    out.append(True)
                    continue
                if body not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[body] = RobotFileParser()
                    parsed[body].parse(body.splitlines())
                out.append(parsed[body].can_fetch(agent, url))
            yield f.assign(allowed=out)[["host", "url", "allowed"]]

    return requests.join(robots, "host", "left").select("host", "url", "body").mapInPandas(run, "host string, url string, allowed boolean")


def refresh(stale: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """304 keeps the content and renews the expiry; success replaces it; other states keep a negative entry for a day."""
    r = responses.select("canonical_url", F.col("status").alias("_status"), F.col("text").alias("_text"), F.col("etag").alias("_etag"))
    joined = stale.join(r, "canonical_url", "left")
    ok = F.col("_status").between(200, 299)
    lasting, short = now + F.make_interval(days=F.lit(fixed.POSITIVE_TTL_DAYS)), now + F.make_interval(hours=F.lit(fixed.NEGATIVE_TTL_HOURS))
    return (
        joined.withColumn("ttl_expires_at", F.when(ok | (F.col("_status") == 304), lasting).when(F.col("_status").isNotNull(), short).otherwise(F.col("ttl_expires_at")))
        .withColumn("extracted_text", F.when(ok, F.col("_text")).otherwise(F.col("extracted_text"))).withColumn("etag", F.when(ok, F.col("_etag")).otherwise(F.col("etag")))
        .withColumn("content_hash", F.when(ok, F.sha2("_text", 256)).otherwise(F.col("content_hash"))).select(*stale.columns)
    )
