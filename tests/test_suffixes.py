"""Public suffix rules of all kinds, as expressions and as a join; white space; IPv6 hosts."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import suffixes as X
from lodestone.functions import text as T
from lodestone.functions import urls as U

HOSTS = [  # host, by all rules, by public rules
    ("a.b.example.com", "example.com", "example.com"), ("com", None, None), ("Example.CO.UK", "example.co.uk", "example.co.uk"), ("co.uk", None, None), ("x.github.io", "x.github.io", "github.io"), ("github.io", None, "github.io"),
    ("a.x.github.io.", "x.github.io", "github.io"), ("b.ck", None, None), ("a.b.ck", "a.b.ck", "a.b.ck"), ("ck", None, None), ("www.ck", "www.ck", "www.ck"), ("x.www.ck", "www.ck", "www.ck"), ("foo.kawasaki.jp", None, None), ("a.foo.kawasaki.jp", "a.foo.kawasaki.jp", "a.foo.kawasaki.jp"),
    ("city.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp"), ("a.city.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp"), ("kawasaki.jp", "kawasaki.jp", "kawasaki.jp"), ("h.us.compute.amazonaws.com", "h.us.compute.amazonaws.com", "amazonaws.com"), ("unknown.zz", "unknown.zz", "unknown.zz"),
    ("localhost", None, None), ("10.0.0.1", None, None), ("a..com", None, None), ("", None, None), ("münchen.de", "münchen.de", "münchen.de"), (None, None, None),
]


def test_rules(spark, tmp_path):
    df = spark.createDataFrame([h[:1] for h in HOSTS], "host string").repartition(3)
    want = {h: (w, p, w != p) for h, w, p in HOSTS}
    by_column = df.select("host", U.web_key(F.col("host")).alias("w"), U.public_key(F.col("host")).alias("p"), U.is_shared_host(F.col("host")).alias("s"))
    assert {r.host: (r.w, r.p, r.s) for r in by_column.collect()} == want
    path = tmp_path / "rules.dat"
    path.write_text("// a comment\n\n" + "\n".join(X.PUBLIC) + "\n// ===BEGIN PRIVATE DOMAINS===\n" + "  // note\n".join(X.PRIVATE) + "\n// ===END PRIVATE DOMAINS===\nlater\n")
    read = X.load(spark, str(path))
    assert {(r.rule, r.private) for r in read.collect()} == {(r, False) for r in [*X.PUBLIC, "later"]} | {(r, True) for r in X.PRIVATE}
    for most in (200_000, 0):
        got = X.resolved(df.withColumn("n", F.lit(1)), X.built_in(spark), most_sent=most).collect()
        assert {r.host: (r.web_key, r.public_key, r.shared) for r in got} == want and len(got) == len(HOSTS)


@pytest.mark.parametrize(("url", "want"), [
    ("http://[::1]:8080/a/", "http://::1:8080/a"), ("HTTPS://[2001:DB8::A]:443/?b=2&a=1#x", "https://2001:db8::a/?a=1&b=2"), ("http://u@[::1]", "http://u@::1/"), ("http://[::1", None), ("　http://A.com/%7ex ", "http://a.com/~x"), ("no url", None), ("http://a.com:99999/", None),
])
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.canonical_url(F.col("u"))).first()[0] == want


def test_strip(spark):
    texts = [" 　 a b \x85 ", "\x1f\x1ca\t", "​kept​", "", " \n "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.strip() for t in texts]
