"""Public suffix rules: plain, wildcard and exception rules, public and private ones apart.

A host's public suffix is that of the rule that matches most of its labels; an exception rule beats all others and leaves
out its first label; a host that no rule matches has its last label. A rule file in the usual format (a rule a line,
comments after //, private rules between their two marker lines) is read by `load`; RULES is a small set that is built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the public section.
PUBLIC = [
    "com", "org", "net", "io", "dev", "app", "ai", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "au", "com.au", "net.au", "org.au", "nz", "co.nz", "jp", "co.jp", "kr", "co.kr", "in", "co.in", "br", "com.br",
    "mx", "com.mx", "tr", "com.tr", "cn", "com.cn", "sg", "com.sg", "za", "co.za", "ar", "com.ar", "*.ck", "!www.ck", "*.bd", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg",
    "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp", "*.nagoya.jp", "!city.nagoya.jp", "*.sapporo.jp", "!city.sapporo.jp", "*.yokohama.jp", "!city.yokohama.jp",
]
#: Rules of the private section (shared hosts).
PRIVATE = [
    "github.io", "gitlab.io", "vercel.app", "netlify.app", "pages.dev", "workers.dev", "herokuapp.com", "web.app", "firebaseapp.com", "fly.dev", "onrender.com", "appspot.com", "azurewebsites.net", "blogspot.com",
    "wordpress.com", "substack.com", "notion.site", "webflow.io", "surge.sh", "glitch.me", "repl.co", "streamlit.app", "hf.space", "railway.app", "deno.dev", "*.compute.amazonaws.com", "*.elb.amazonaws.com",
]


def _labels(host: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")


def _sound(labels: Column) -> Column:
    """No empty label, and a last label that can be a name: no IP address, no port."""
    return F.forall(labels, lambda x: x != "") & F.element_at(labels, -1).rlike(r"^[^\x00-\x60\x7B-\x7F][^\x00-\x2C\x2E\x2F\x3A-\x60\x7B-\x7F]*$")


def _last(labels: Column, k: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")


def registrable(host: Column, rules: list[str]) -> Column:
    """Public suffix and one label more, by a few rules that are given; null for hosts that are a suffix, or no names."""
    plain, wild, but = ([r.lstrip("*!").lstrip(".") for r in rules if r[0] == c] if c else [r for r in rules if r[0] not in "*!"] for c in ("", "*", "!"))
    within = lambda c, among: c.isin(among) if among else F.lit(False)

    def of(labels: Column) -> Column:
        n = F.size(labels)
        ends = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), _last(labels, k).alias("s"), _last(labels, k - 1).alias("p")))
        left_out = F.filter(ends, lambda e: within(e["s"], but))
        matched = F.transform(F.filter(ends, lambda e: within(e["s"], plain) | ((e["k"] > 1) & within(e["p"], wild))), lambda e: e["k"])
        size = F.when(F.size(left_out) > 0, F.array_max(F.transform(left_out, lambda e: e["k"])) - 1).otherwise(F.coalesce(F.array_max(matched), F.lit(1)))
        return F.when(_sound(labels) & (n > size), _last(labels, size + 1))

    # the array of one makes the labels once
    return F.get(F.transform(F.array(_labels(host)), of), F.lit(0))


def load(spark: SparkSession, path: str) -> DataFrame:
    """rule, private: the rules of a file in the usual format."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    begin, end = (lines.filter(F.contains("line", F.lit(mark))).agg(F.min("at").alias(c)) for mark, c in (("===BEGIN PRIVATE DOMAINS===", "b"), ("===END PRIVATE DOMAINS===", "e")))
    rule = F.lower(F.regexp_extract("line", r"^\s*(\S+)", 1))
    kept = lines.filter((rule != "") & ~rule.startswith("//"))
    return kept.join(F.broadcast(begin)).join(F.broadcast(end)).select(rule.alias("rule"), F.coalesce((F.col("at") > F.col("b")) & (F.col("at") < F.coalesce("e", F.col("at") + 1)), F.lit(False)).alias("private"))


def built_in(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(p).alias("private")) for rules, p in ((PUBLIC, False), (PRIVATE, True)) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def resolved(hosts: DataFrame, rules: DataFrame, *, host: str = "host", most_sent: int = 200_000) -> DataFrame:
    """hosts with suffix, web_key, public_key and shared, by a rule table of any size: each host's ends are joined to the rules, which are broadcast if they are counted to be few.

    web_key goes by all rules, public_key by the public ones; shared: they differ, the host is a tenant of a shared one.
    """
    names = hosts.select(F.col(host).alias("_h")).distinct().withColumn("_l", _labels(F.col("_h"))).filter(_sound(F.col("_l")))
    ends = names.select("_h", F.explode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda k: F.struct(k.alias("k"), _last(F.col("_l"), k).alias("s"), (k == F.size("_l")).alias("whole")))).alias("e")).select("_h", "e.k", "e.s")
    kind = F.substring("rule", 1, 1)
    # a wildcard matches one label more than it names
    table = rules.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("s"), F.when(kind == "*", 1).otherwise(0).alias("more"), (kind == "!").alias("but"), "private").distinct()
    met = ends.join(F.broadcast(table) if table.count() <= most_sent else table, "s").join(names.select("_h", F.size("_l").alias("n")), "_h").filter(F.col("k") + F.col("more") <= F.col("n"))

    def size(public_only: bool) -> Column:
        of = ~F.col("private") if public_only else F.lit(True)
        return F.coalesce(F.max(F.when(of & F.col("but"), F.col("k") - 1)), F.max(F.when(of, F.col("k") + F.col("more"))), F.lit(1))

    sized = met.groupBy("_h").agg(size(False).alias("a"), size(True).alias("p"))
    every = names.join(sized, "_h", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("a", "p")})
    key = lambda k: F.when(F.size("_l") > F.col(k), _last(F.col("_l"), F.col(k) + 1))
    found = every.select("_h", _last(F.col("_l"), F.col("a")).alias("suffix"), key("a").alias("web_key"), key("p").alias("public_key"))
    out = hosts.join(found, F.col(host).eqNullSafe(F.col("_h")), "left").drop("_h")
    return out.withColumn("shared", ~F.col("web_key").eqNullSafe(F.col("public_key")))
