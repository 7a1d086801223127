"""Ranks in groups of any size against sorted lists."""

import random

from pyspark.sql import functions as F

from lodestone.operators import ledger as L


def test_ranks(spark):
    rng = random.Random(5)
    rows = [("big", rng.randrange(300) / 4) for _ in range(5000)] + [("one value", 7.0)] * 2000 + [(None, float(i)) for i in range(9)] + [("single", 3.5), ("none", None)]
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, "k string, v double").repartition(4)
        at = L.placed(df, ["k"], "v").cache()
        assert all((r.low, r.high) == ((s := sorted(groups[r.k])).index(r.v) + 1, len(s) - s[::-1].index(r.v)) and r.n == len(groups[r.k]) for r in at.collect())
        assert at.count() == sum(len(set(g)) for g in groups.values())
        got = {r.k: (r.a, r.b, r.c) for r in L.at_ranks(df, ["k"], "v", {"a": L.nearest(0.95), "b": L.nearest(0.5), "c": L.spike()}).collect()}
        want = {k: (s[round(0.95 * (len(s) - 1))], s[round(0.5 * (len(s) - 1))], s[min(len(s) - 1, int(0.95 * len(s)))]) for k, s in ((k, sorted(g)) for k, g in groups.items())}
        assert got == want
        cont = {r.k: r.p for r in L.continuous(df, ["k"], "v", {"p": 0.95}).collect()}
        exact = {r.k: r.p for r in df.filter("v is not null").groupBy("k").agg(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY v)").alias("p")).collect()}
        assert set(cont) == set(exact) and all(abs(cont[k] - exact[k]) < 1e-9 for k in cont)
        whole = L.at_ranks(df, [], "v", {"b": L.nearest(0.5)}).collect()
        every = sorted(v for _, v in rows if v is not None)
        assert [r.b for r in whole] == [every[round(0.5 * (len(every) - 1))]]
        assert L.at_ranks(df.limit(0), ["k"], "v", {"b": L.nearest(0.5)}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
