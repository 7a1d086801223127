"""OR gates over graphs against a plain fixed point, and how many rounds long chains take."""

import random

from lodestone.operators import gates as GA
from lodestone.operators import graph as G


def by_hand(edges, known, loop):
    deps = {}
    for n, d in edges:
        deps.setdefault(n, set()).add(d)
    names = {x for e in edges for x in e} | set(known)
    value = {n: known.get(n, loop if n in deps else False) for n in names}
    while True:
        new = {n: known[n] if n in known else any(value[d] for d in deps.get(n, ())) for n in names}
        if new == value:
            return value
        value = new


def graphs():
    rng = random.Random(9)
    yield [], {}
    yield [(1, 1)], {}
    yield [(i + 1, i) for i in range(60)], {0: True}
    yield [((i + 1) % 7, i) for i in range(7)] + [(8, 3), (9, 8), (10, 9), (10, 11)], {11: True}
    yield [(f"{x}{i + 1}", f"{y}{i}") for i in range(40) for x in "uv" for y in "uv"], {"u0": True}
    for n, m in ((30, 25), (30, 45), (40, 120), (60, 70)):
        for acyclic in (True, False):
            pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
            yield [(max(p), min(p)) if acyclic else p for p in pairs if p[0] != p[1] or not acyclic], {k: rng.random() < 0.3 for k in rng.sample(range(n + 5), 6)}


def test_solve(spark):
    """All graphs side by side, each with its number in the names."""
    edges, known = [], {}
    for k, (e, v) in enumerate(graphs()):
        edges += [(f"{k}:{n}", f"{k}:{d}") for n, d in e]
        known |= {f"{k}:{n}": x for n, x in v.items()}
    e = spark.createDataFrame(edges, "node string, dep string")
    v = spark.createDataFrame(list(known.items()), "node string, value boolean")
    for loop in (False, True):
        rows = GA.solve(e, v, loop=loop).collect()
        assert len(rows) == len({r.node for r in rows}) and {r.node: r.value for r in rows} == by_hand(edges, known, loop), loop
    assert GA.solve(e.limit(0), v.limit(0), loop=True).count() == 0


def test_long_chain_in_few_rounds(spark):
    n = 100_000
    chain = spark.range(1, n).selectExpr("id as node", "id - 1 as dep")
    dead = spark.createDataFrame([(0, True)], "node long, value boolean")
    values, rounds = GA.solved(chain, dead, loop=False)
    assert rounds < 40 and values.filter("value").count() == n
    ring = chain.unionByName(spark.createDataFrame([(0, n - 1), (n, 5)], "node long, dep long"))
    values, rounds = GA.solved(ring, dead.limit(0), loop=True)
    assert rounds < 40 and values.filter("value").count() == n + 1


def test_tasks(spark):
    tasks = [(1, "a", [], "failed"), (1, "b", ["a"], "pending"), (1, "c", ["b", "x"], "pending"), (1, "d", ["gone"], "pending"), (1, "x", [], "pending"), (1, "y", ["x"], "pending"), (2, "a", [], "done"), (2, "b", ["a"], "pending"), (2, "p", ["q"], "pending"), (2, "q", ["p"], "pending"), (2, "r", ["q", "s"], "pending"), (2, "s", [], "skipped")]
    df = spark.createDataFrame(tasks, "run_id long, node_key string, depends_on array<string>, status string")
    assert {(r.run_id, r.node_key) for r in G.unreachable(df).collect()} == {(1, "b"), (1, "c"), (1, "d"), (2, "r")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "f")], "a string, b string")
    assert {r.node for r in G.cyclic_nodes(edges).collect()} == {"b", "c", "d"}
