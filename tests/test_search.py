"""Passages in texts against a plain search."""

import random

from pyspark.sql import functions as F

from lodestone.operators import search as Q


def test_against_plain_search(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "é", "日本", "x"]
    opening = "an opening that all of the texts share, word for word, "
    texts = [opening + " ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None, opening, opening * 3]
    texts += texts[:5]  # rows that are alike but for their number, and two that are alike in all
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    quotes = []
    for i in range(120):
        t = rng.choice([t for t in texts if t])
        a = rng.randrange(len(t))
        quotes.append((i, t[a : a + rng.choice((1, 3, 15, 16, 17, 40, 200))]))
    quotes += [(500, opening + "alpha"), (501, "not in any text at all, whatever the place"), (502, opening[:20]), (503, None), (504, "")]
    d = spark.createDataFrame(docs, "d int, text string").repartition(3)
    q = spark.createDataFrame(quotes, "q int, quote string").repartition(2)
    want = sorted((i, j) for i, t in docs for j, p in quotes if t and p and p in t)
    for options in ({}, {"looked_at": 1}, {"most_bits": 64}):
        got = Q.quotes_in(d, q, "text", "quote", **options)
        assert got.columns == ["d", "text", "q", "quote"] and sorted((r.d, r.q) for r in got.collect()) == want
    assert Q.quotes_in(d, q.filter(F.lit(False)), "text", "quote").count() == 0 and Q.quotes_in(d.limit(0), q, "text", "quote").count() == 0
