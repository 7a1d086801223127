"""Values of OR gates over a graph: a node is true if a node that it depends on is. For what fails, hangs or loops along dependencies.

Layer by layer a chain of n nodes takes n rounds. Here a node with one open dependency is the same as that dependency,
and nodes with equal sets of them are the same as each other; such pointers are followed by doubling, so chains, trees
and ladders shrink to nothing in about log2(n) rounds. Pointers that lead round in a circle are cycles. What is left is
a smaller graph, which goes through the same again; each turn also settles at least one layer, so no graph takes more
turns than it has layers. Sets are compared by count and two sums of hashes, never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.work import Scratch


def _followed(ws: Scratch, pointers: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """pointers (node, to), one per node: (node, root) for those that end, (node) for those that never do, rounds."""
    total = pointers.count()
    now, rounds = pointers.withColumn("open", F.lit(True)), 0
    for _ in range(max(1, math.ceil(math.log2(total + 1)) + 1) if total else 0):
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("open").alias("more"))
        now = ws.keep("pointers", now.join(ahead, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("open")))
        rounds += 1
        if now.filter("open").isEmpty():
            break
    return now.filter("not open").select("node", F.col("to").alias("root")), now.filter("open").select("node"), rounds


def solve(edges: DataFrame, known: DataFrame, *, loop: bool) -> DataFrame:
    """edges (node, dep) and known (node, value): a value for every node of either. Nodes without dependencies are false. loop: what a cycle is of itself: False for the least solution, True for the greatest."""
    return solved(edges, known, loop=loop)[0]


def solved(edges: DataFrame, known: DataFrame, *, loop: bool) -> tuple[DataFrame, int]:
    """solve, and the number of rounds (written tables) that it took."""
    names = edges.select(F.col("node").alias("n")).unionByName(edges.select(F.col("dep").alias("n"))).unionByName(known.select(F.col("node").alias("n"))).distinct()
    ws = Scratch(edges.sparkSession, "gates")
    known = known.groupBy("node").agg(F.max("value").alias("value"))
    left = ws.keep("left", edges.select("node", "dep").distinct().join(known.select("node"), "node", "left_anti"))
    values = ws.keep("given", names.select(F.col("n").alias("node")).join(left.select("node").distinct(), "node", "left_anti").join(known, "node", "left").select("node", F.coalesce("value", F.lit(False)).alias("value")))
    same: DataFrame | None = None  # nodes that are another one, which is open or settled by now
    fresh, rounds, size, turn = values, 2, left.count(), 0
    while size:
        turn += 1
        # what is known goes in: a true dependency settles a node, a false one goes
        met = left.join(fresh.select(F.col("node").alias("dep"), "value"), "dep", "left")
        per = ws.keep("per", met.groupBy("node").agg(F.coalesce(F.max("value"), F.lit(False)).alias("hit"), F.count_if(F.col("value").isNull()).alias("open")))
        new = per.filter("hit or open = 0").select("node", F.col("hit").alias("value"))
        rest = ws.keep("rest", met.filter("value is null").select("node", "dep").join(new.select("node"), "node", "left_anti"))
        # one open dependency, or the same ones as another node
        h = lambda seed: F.sum(F.xxhash64("dep", F.lit(seed)).cast("decimal(20,0)"))
        sets = rest.groupBy("node").agg(F.count("*").alias("n"), F.min("dep").alias("dep"), h(1).alias("h"), h(2).alias("g"))
        single = sets.filter("n = 1").select("node", F.col("dep").alias("to"))
        many = ws.keep("many", sets.filter("n > 1"))
        first = many.groupBy("n", "h", "g").agg(F.min("node").alias("to"), F.count("*").alias("k")).filter("k > 1")
        alike = many.join(first.select("n", "h", "g", "to"), ["n", "h", "g"]).filter("node != to").select("node", "to")
        roots, circles, more = _followed(ws, ws.keep("first", single.unionByName(alike)))
        roots = ws.keep(f"roots-{turn}", roots)
        old = None if same is None else same.join(roots.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        same = roots if old is None else ws.keep("same", old.unionByName(roots))
        now = rest.join(roots.select("node"), "node", "left_anti").join(circles, "node", "left_anti").join(roots.select(F.col("node").alias("dep"), "root"), "dep", "left").select("node", F.coalesce("root", "dep").alias("dep")).distinct()
        now = ws.keep("now", now)
        own = now.filter("node = dep").select("node")
        ringed = circles.select("node", F.lit(loop).alias("value"))
        if loop:  # a node that depends on itself is true
            ringed = ringed.unionByName(own.select("node", F.lit(True).alias("value")))
            left_ = now.join(own, "node", "left_anti")
        else:  # it says nothing; where it is all there is, the node is false
            left_ = now.filter("node != dep")
            ringed = ringed.unionByName(own.join(left_.select("node").distinct(), "node", "left_anti").select("node", F.lit(False).alias("value")))
        fresh = ws.keep(f"fresh-{turn}", new.unionByName(ringed).distinct())
        values = values.unionByName(fresh)
        left = ws.keep("left", left_)
        rounds += 7 + more
        before, size = size, left.count()
        if size == before and fresh.isEmpty():
            values = values.unionByName(left.select("node").distinct().select("node", F.lit(loop).alias("value")))
            break
    if same is not None:
        values = ws.keep("values", values)
        values = values.unionByName(same.join(values.withColumnRenamed("node", "root"), "root").select("node", "value"))
    return values, rounds
