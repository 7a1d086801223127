"""Connected components of an edge table by alternating large and small stars.

Each half round is one aggregation for the smallest neighbour of a vertex, written to the shared folder, and one join
back to the edges whose both sides are plain exchanges, so that adaptive execution can split a vertex with very many
edges. Rounds go on until the edge set stays as it is; a star per component is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace


def _star(ws: Workspace, edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ws.keep("least", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    found = both.join(least, "u")
    new = found.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else found.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return ws.keep("edges", new.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """edges: columns u, v of one orderable type. Rows (u, v): each vertex but the smallest of its component, and that smallest."""
    state = None
    edges = ws.keep("edges", edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())  # the same whatever the order
        if now == state or not now[0]:
            ws.free("least")
            return edges
        state = now
        edges = _star(ws, _star(ws, edges, True), False)
