"""Components of edges that come out otherwise each time they are computed, as forests of unordered blocks do on a cluster."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators.graph import components


def test_edges_that_change(spark):
    def stars(batches):  # of each group of 20 a star around a member drawn anew each time
        for b in batches:
            for g in b.column(0).to_pylist():
                centre = random.SystemRandom().randrange(20)
                rest = [g * 20 + i for i in range(20) if i != centre]
                yield pa.RecordBatch.from_arrays([pa.array([g * 20 + centre] * 19, pa.int64()), pa.array(rest, pa.int64())], ["a", "b"])

    edges = spark.range(60).mapInArrow(stars, "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {n: n - n % 20 for n in range(1200)}


def test_few_edges_at_once(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(400)]
    zigzag = [(1000 + (i if i % 2 else 400 - i), 1000 + (i + 1 if i % 2 == 0 else 400 - i - 1)) for i in range(100)]
    star = [(2000 + i, 2999) for i in range(300)]
    some = [(rng.randrange(3000, 4000), rng.randrange(3000, 4000)) for _ in range(500)]
    edges = chain + zigzag + star + some + [(5000, 5000)]
    rng.shuffle(edges)
    root = {n: n for e in edges if e[0] != e[1] for n in e} | {7000: 7000}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    named = df.select(F.format_string("n%04d", "a").alias("a"), F.format_string("n%04d", "b").alias("b"))
    for at_once in (5, 100_000):
        got = components(df, spark.createDataFrame([(7000,)], "node long"), at_once=at_once).collect()
        assert sorted(map(tuple, got)) == sorted((n, find(n)) for n in root), at_once
    got = components(named, at_once=60).collect()
    assert sorted(map(tuple, got)) == sorted((f"n{n:04}", f"n{find(n):04}") for n in root if n != 7000)
