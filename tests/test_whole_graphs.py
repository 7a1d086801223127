"""Graph queries over whole tables, against brute force."""

import numpy as np

from lodestone.operators import vectors
from lodestone.plans import queries
from lodestone.plans._common import table

SF = "/root/testdata/sf0.001"


def components_of(edges, nodes=()):
    root = {n: n for e in edges for n in e} | {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def test_alias_graph_over_all_edges(spark):
    edges = [(f"web:{r.l_suppkey + 1_000_000}", f"gh:{r.l_partkey + 1_000_000}") for r in table(spark, SF, "lineitem").select("l_partkey", "l_suppkey").distinct().collect()]
    of, best = components_of(edges), {}
    for n, c in of.items():
        if n.startswith("web:"):
            best[c] = min(best.get(c, n), n)
    got = {r.key: r.canonical for r in queries()["alias_graph"](spark, SF).collect()}
    assert len(edges) > 1000 and got == {n: best[c] for n, c in of.items()}


def test_similar_vectors_across_labels(spark):
    v = {r.vec_id: r.embedding for r in table(spark, SF, "embeddings").collect() if r.embedding is not None}
    ids, x = sorted(v), np.array([v[i] for i in sorted(v)], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    pairs = lambda t: {(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(s >= t, 1)), strict=True)}
    got = {(r.a, r.b): r.score for r in queries()["similar_vectors"](spark, SF).collect()}
    assert set(got) == pairs(0.2) and all(abs(c - s[ids.index(a), ids.index(b)]) < 1e-5 for (a, b), c in got.items())
    df = spark.createDataFrame([(i, [float(c) for c in v[i]]) for i in ids], "id long, v array<double>")
    assert {(r.a, r.b) for r in vectors.similar_pairs(df, 0.2, block=16).collect()} == pairs(0.2)
    assert {r.vec_id: r.cluster for r in queries()["clusters"](spark, SF).collect()} == components_of(pairs(0.86), ids)
