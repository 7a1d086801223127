"""Tasks in batches: what runs next, claims with leases, sweeps, timeouts, throttles and dispatch waves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.operators import graph as G
from lodestone.operators.work import Scratch, dealt

#: Tasks that are sorted and joined in one part.
TASKS_EACH = 500_000


def next_tasks(tasks: DataFrame) -> DataFrame:
    """Of each run the ready task of least priority number, ties to the smaller id."""
    one = G.ready(tasks).groupBy("run_id").agg(F.min(F.struct("priority", "id")).alias("_n"))
    return one.select("run_id", F.col("_n.id").alias("id"))


def claim(tasks: DataFrame, token: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """The tasks with each run's next one running under a lease, and an event for each that was claimed. One writer per table takes the place of row locks."""
    chosen = next_tasks(tasks).withColumn("_mine", F.lit(True))
    both = tasks.join(chosen, ["run_id", "id"], "left").withColumn("_mine", F.coalesce("_mine", F.lit(False)))
    until = now + F.make_interval(mins=F.lit(fixed.LEASE_MINUTES))
    new = both.withColumn("status", F.when(F.col("_mine"), "running").otherwise(F.col("status"))).withColumn("lease_token", F.when(F.col("_mine"), token).otherwise(F.col("lease_token"))).withColumn("lease_expires_at", F.when(F.col("_mine"), until).otherwise(F.col("lease_expires_at"))).withColumn("attempts", F.col("attempts") + F.col("_mine").cast("int"))
    events = both.filter("_mine").select("run_id", F.col("id").alias("task_id"), F.lit("claimed").alias("event_type"), now.alias("created_at"))
    return new.select(*tasks.columns), events


def _freed(tasks: DataFrame, when: Column, status: str, error: Column) -> DataFrame:
    free = {"status": F.lit(status), "lease_token": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast(tasks.schema["lease_expires_at"].dataType), "error": error}
    hit = F.coalesce(when, F.lit(False))
    return tasks.select(*(F.when(hit, free[c]).otherwise(F.col(c)).alias(c) if c in free else F.col(c) for c in tasks.columns))


def sweep(tasks: DataFrame, now: Column) -> DataFrame:
    """Running tasks whose lease is over are pending again."""
    return _freed(tasks, (F.col("status") == "running") & (F.col("lease_expires_at") < now), "pending", F.col("error"))


def skip_rest(tasks: DataFrame, runs: DataFrame, reason: str = "timeout") -> DataFrame:
    """All tasks of these runs that aren't over are skipped; a worker that still holds one finds its lease gone."""
    late = runs.select("run_id", F.lit(True).alias("_late")).distinct()
    both = tasks.join(late, "run_id", "left")
    return _freed(both, F.col("_late") & F.col("status").isin("pending", "running"), "skipped", F.lit(reason)).select(*tasks.columns)


def skip_unreachable(tasks: DataFrame) -> DataFrame:
    """Pending tasks that can never run are skipped, at any depth."""
    dead = G.unreachable(tasks).withColumn("_dead", F.lit(True))
    both = tasks.join(dead, ["run_id", "node_key"], "left")
    return _freed(both, F.col("_dead"), "skipped", F.lit("unreachable: dependency did not complete")).select(*tasks.columns)


def throttled(requests: DataFrame, host: str, at: str, order: str, gap: float = fixed.HOST_GAP_S) -> DataFrame:
    """Adds starts: when each request may go, in order, `gap` seconds apart at each host and never before its own time (seconds). The k-th start is the latest of own times plus the gaps since."""
    w = Window.partitionBy(host).orderBy(at, order)
    k = F.row_number().over(w)
    lead = requests.withColumn("_k", k).withColumn("_a", F.col(at) - F.col("_k") * gap)
    return lead.withColumn("starts", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_k") * gap).drop("_k", "_a")


def dispatch_waves(tasks: DataFrame, slots: dict[str, int]) -> DataFrame:
    """tasks: run_id, node_key, depends_on, service, priority. When each task runs if all that is ready runs at once, `slots` of a service at most: depth (longest chain before it) and wave within the depth. Tasks on or behind a cycle have none.

    Behind a chain of k + 1 is what depends on a task behind one of k: each turn looks only at the edges that come from
    what the turn before found, so it reads less each time, and a task's depth is the number of turns that found it.
    Where a turn finds as many as the one before, these are on or behind cycles.
    """
    ws = Scratch(tasks.sparkSession, "waves")
    tasks = ws.keep("tasks", tasks.select("run_id", "node_key", "depends_on", "service", "priority"))
    edges = tasks.filter(F.size("depends_on") > 0).select("run_id", "node_key", F.explode("depends_on").alias("dep"))
    there, found, n, cyclic = tasks.select("run_id", "node_key"), [], -1, None
    parts = {"each": TASKS_EACH, "rows": tasks.count()}
    while True:
        edges = ws.keep("edges", edges.join(there.withColumnRenamed("node_key", "dep"), ["run_id", "dep"], "left_semi"))
        there = ws.keep(f"behind{len(found)}", edges.select("run_id", "node_key").distinct())
        before, n = n, there.count()
        if n == before:
            cyclic = found.pop() if n else None
        if n in (0, before):
            break
        found.append(there)
    most = F.create_map(*(F.lit(x) for kv in slots.items() for x in kv))[F.col("service")]
    place = F.row_number().over(Window.partitionBy("run_id", "depth", "service").orderBy("priority", "node_key"))
    rows = dealt(tasks.drop("depends_on"), "run_id", "node_key", **parts)
    if cyclic is not None:
        rows = rows.join(cyclic, ["run_id", "node_key"], "left_anti")
    if found:
        depth = reduce(DataFrame.unionByName, found).groupBy("run_id", "node_key").agg(F.count("*").cast("int").alias("depth"))
        rows = rows.join(depth, ["run_id", "node_key"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    else:
        rows = rows.withColumn("depth", F.lit(0))
    rows = dealt(rows, "run_id", "depth", "service", **parts)
    return rows.withColumn("wave", F.ceil(place / most).cast("int")).select("run_id", "node_key", "depth", "wave")
