"""Graphs as edge tables: components, aliases, task plans."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.operators.gates import solve
from lodestone.operators.work import Scratch

#: Edges that one task joins at once.
AT_ONCE = 500_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the smallest that the edges connect it to."""
    root = np.arange(n)
    while True:
        low, x, y = root.copy(), root[a], root[b]
        np.minimum.at(low, x, y)
        np.minimum.at(low, y, x)
        while np.any((up := low[low]) != low):
            low = up
        if np.all(low[x] == low[y]):
            return low[root]
        root = low[root]


def _stars(batches: Iterable[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """Edges a, b as stars: b is the smallest node of a part that some `most` edges make up, so parts may come in pieces."""
    held, n = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        ends = pa.concat_arrays([t.column(c).combine_chunks() for c in ("a", "b")]).dictionary_encode()
        names = ends.dictionary
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[ends.indices.to_numpy()]
        root = _roots(code[: t.num_rows], code[t.num_rows :], len(order))
        leaves = np.nonzero(root != np.arange(len(root)))[0]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(order[leaves])), names.take(pa.array(order[root[leaves]]))], ["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def components(edges: DataFrame, nodes: DataFrame | None = None, *, at_once: int = AT_ONCE) -> DataFrame:
    """edges: a, b. Rows (node, component): the smallest node that can be reached.

    Tasks turn their edges into stars, `at_once` at a time. While more edges than that are left, each node goes to its
    smallest neighbour, on to where that goes until none moves (by doubling), and the edges between what remains go on:
    they get fewer with every round. The rest, bounded, is one task's. Where nodes went is put together from the last round to the first.
    """
    ws = Scratch(edges.sparkSession, "components")
    of = edges.schema["a"].dataType.simpleString()
    stars = lambda df: df.filter("a != b").mapInArrow(lambda batches: _stars(batches, at_once), f"a {of}, b {of}")
    left = ws.keep("left0", stars(edges.select("a", "b")).distinct())
    every = left.select(F.explode(F.array("a", "b")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select("node"))
    went, k = [], 0
    while left.count() > at_once:
        k += 1
        # both directions come from one table: edges may be others when they are computed again
        both = left.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        to = ws.keep("to", both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("low")))
        while True:
            ahead = to.select(F.col("node").alias("low"), F.col("low").alias("far"))
            to = ws.keep("to", to.join(ahead, "low").select("node", F.col("low").alias("before"), F.col("far").alias("low")))
            moved = not to.filter("before != low").isEmpty()
            to = to.select("node", "low")
            if not moved:
                break
        went.append(ws.keep(f"went{k}", to.filter("node != low")))
        at = lambda c: went[-1].select(F.col("node").alias(c), F.col("low").alias(f"_{c}"))
        moved = left.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        left = ws.keep(f"left{k}", stars(moved).distinct())
    found = ws.keep("found", left.coalesce(1).mapInArrow(lambda batches: _stars(batches, math.inf), f"a {of}, b {of}").toDF("node", "low"))
    while went:
        last = went.pop()
        on = found.select(F.col("node").alias("low"), F.col("low").alias("far"))
        found = ws.keep("found", last.join(on, "low", "left").select("node", F.coalesce("far", "low").alias("low")).unionByName(found.join(last.select("node"), "node", "left_anti")))
    return every.distinct().join(found, "node", "left").select("node", F.coalesce("low", "node").alias("component"))


def alias_edges(evidence: DataFrame) -> DataFrame:
    """evidence: scheme, value, homepage_key, backlink_repo, repository (as keys). Edges (a, b, trigger) between scheme:value keys."""
    key = F.concat_ws(":", "scheme", "value")
    part = lambda cond, scheme, col, trigger: evidence.filter(cond & F.col(col).isNotNull()).select(key.alias("a"), F.concat(F.lit(scheme + ":"), F.col(col)).alias("b"), F.lit(trigger).alias("trigger"))
    return part(F.col("scheme") == "gh", "web", "homepage_key", "gh_homepage").unionByName(part(F.col("scheme") == "web", "gh", "backlink_repo", "web_backlink")).unionByName(part(F.col("scheme").isin("npm", "pypi"), "gh", "repository", "package_repository"))


def canonical_keys(edges: DataFrame) -> DataFrame:
    """(key, canonical): of each component the key of best scheme, then smallest value."""
    found = components(edges)
    rank = F.struct(F.array_position(F.array(*map(F.lit, fixed.SCHEMES)), F.substring_index("node", ":", 1)).alias("r"), F.expr("substring(node, instr(node, ':') + 1)").alias("v"))
    best = found.groupBy("component").agg(F.min_by("node", rank).alias("canonical"))
    return found.join(best, "component").select(F.col("node").alias("key"), "canonical")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes (node) that are on or behind a cycle of a -> b, in about log2(n) rounds for chains of n."""
    none = edges.select(F.col("a").alias("node"), F.lit(False).alias("value")).limit(0)
    return solve(edges.select(F.col("b").alias("node"), F.col("a").alias("dep")), none, loop=True).filter("value").select("node")


def plan_errors(tasks: DataFrame, edges: DataFrame, budget: int, *, needs: dict[str, str] | None = None) -> DataFrame:
    """All faults of a plan, not the first only: duplicate keys, undeclared edges, too much weight, cycles; with needs (kind -> required argument; tasks then have kind and args, a map), kinds that may not stand in a plan and missing arguments."""
    known = tasks.select(F.col("node_key").alias("k")).distinct()
    ends = edges.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    fault = lambda df, name, col: df.select(F.lit(name).alias("fault"), col.cast("string").alias("detail"))
    twice = fault(tasks.groupBy("node_key").count().filter("count > 1"), "duplicate_key", F.col("node_key"))
    unknown = fault(ends.join(known, "k", "left_anti"), "undeclared_node", F.col("k"))
    heavy = fault(tasks.agg(F.sum("weight").alias("w")).filter(F.col("w") > budget), "over_budget", F.col("w"))
    out = twice.unionByName(unknown).unionByName(heavy).unionByName(fault(cyclic_nodes(edges), "cycle", F.col("node")))
    if needs is None:
        return out
    asked = F.create_map(*(F.lit(x) for kv in needs.items() for x in kv))[F.col("kind")]
    return out.unionByName(fault(tasks.filter(asked.isNull()), "bad_kind", F.col("node_key"))).unionByName(fault(tasks.filter(asked.isNotNull() & ~F.map_contains_key("args", F.coalesce(asked, F.lit("")))), "bad_args", F.col("node_key")))


def depends_on(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("b").alias("node_key")).agg(F.sort_array(F.collect_set("a")).alias("depends_on"))


def lowered(tasks: DataFrame, edges: DataFrame, *, charged: dict[str, int]) -> DataFrame:
    """A plan as tasks: depends_on from the edges, and the weight that the registry charges for some kinds."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in charged.items() for x in kv))[F.col("kind")], F.col("weight"))
    return tasks.join(depends_on(edges), "node_key", "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))).withColumn("weight", weight)


def ready(tasks: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies are there and done. tasks: run_id, node_key, depends_on, status."""
    needs = tasks.filter("status = 'pending'").select("run_id", "node_key", F.explode("depends_on").alias("dep"))
    open_ = needs.join(tasks.select("run_id", F.col("node_key").alias("dep"), "status"), ["run_id", "dep"], "left").filter("status is null or status != 'done'")
    return tasks.filter("status = 'pending'").join(open_.select("run_id", "node_key").distinct(), ["run_id", "node_key"], "left_anti")


def unreachable(tasks: DataFrame) -> DataFrame:
    """(run_id, node_key) of pending tasks that can never run: a dependency is missing, failed, skipped or itself unreachable. Chains of any length take few rounds."""
    key = lambda c: F.struct("run_id", F.col(c).alias("node_key"))
    needs = tasks.filter("status = 'pending'").select("run_id", "node_key", F.explode("depends_on").alias("_dep")).select(key("node_key").alias("node"), key("_dep").alias("dep"))
    there = tasks.select(key("node_key").alias("node"), "status")
    missing = needs.select(F.col("dep").alias("node")).distinct().join(there, "node", "left_anti").select("node", F.lit(True).alias("value"))
    over = there.filter("status != 'pending'").select("node", F.col("status").isin("failed", "skipped").alias("value"))
    dead = solve(needs, missing.unionByName(over), loop=False).filter("value")
    return dead.join(there.filter("status = 'pending'").select("node"), "node", "left_semi").select("node.run_id", "node.node_key").distinct()
