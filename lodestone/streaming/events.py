"""Event logs: replay by cursor, public vocabulary, task checklists and lease folds, as batch functions and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def replay(events: DataFrame, cursor: Column, *, key: str = "id", kinds: list[str] | None = None) -> DataFrame:
    """What comes after the cursor, in order of id; only the kinds that are public."""
    out = events.filter(F.col(key) > cursor)
    return (out.filter(F.col("event_type").isin(kinds)) if kinds else out).orderBy(key)


def follow(spark: SparkSession, path: str, schema: StructType, *, at: str = "ts", key: str = "id", kinds: list[str] | None = None, delay: str = "10 minutes", files: int = 100) -> DataFrame:
    """The log as a stream; the checkpoint is the cursor. Repeated deliveries of an id within the delay are dropped."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    if dict(raw.dtypes)[at] == "timestamp_ntz":
        raw = raw.withColumn(at, F.col(at).cast("timestamp"))
    out = raw.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return out.filter(F.col("event_type").isin(kinds)) if kinds else out


def windowed_counts(stream: DataFrame, *, at: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def checklist(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """nodes: run_id, node_id, kind, pos; events: run_id, id, event_type (task.started, task.completed, task.failed), task_id, kind. A status per node.

    A task that starts takes the first node of its kind that is still pending, once, however often its start is
    delivered; its later events set that node's status. A node never is pending again, so the k-th task of a kind to
    start has the k-th node of that kind. Tasks beyond the nodes of their kind, and events before a start, count for nothing.
    """
    started = events.filter("event_type = 'task.started'").groupBy("run_id", "task_id").agg(F.min("id").alias("since"), F.min_by("kind", "id").alias("kind"))
    place = lambda order: F.row_number().over(Window.partitionBy("run_id", "kind").orderBy(order)).alias("k")
    taken = nodes.select("run_id", "node_id", "kind", "pos", place("pos")).join(started.select("run_id", "task_id", "kind", "since", place("since")), ["run_id", "kind", "k"], "left")
    ended = events.filter("event_type in ('task.completed', 'task.failed')").select("run_id", "task_id", "id", "event_type")
    last = taken.filter("task_id is not null").select("run_id", "task_id", "since").join(ended, ["run_id", "task_id"]).filter("id > since").groupBy("run_id", "task_id").agg(F.max_by("event_type", "id").alias("end"))
    status = F.when(F.col("end") == "task.completed", "done").when(F.col("end") == "task.failed", "failed").when(F.col("since").isNotNull(), "running").otherwise("pending")
    return taken.join(last, ["run_id", "task_id"], "left").select("run_id", "node_id", "kind", "pos", status.alias("status"))


def until_end(events: DataFrame, *, key: str = "id") -> DataFrame:
    """Of each run the events up to the first that ends it: a report, or a failed run."""
    ends = (F.col("event_type") == "report.ready") | (F.col("event_type") == "run.failed")
    end = events.filter(ends).groupBy("run_id").agg(F.min(key).alias("_end"))
    return events.join(end, "run_id", "left").filter(F.col("_end").isNull() | (F.col(key) <= F.col("_end"))).drop("_end")


def periodic(spark: SparkSession, seconds: float, job: Callable[[int], None], checkpoint: str):
    """A streaming query that calls the job with the batch number every so many seconds."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: job(n)).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()


_TASK = "task_id long, status string, token long, attempts int"


def step(status: str, token: int, attempts: int, command: str, given: int, *, retries: int = 3) -> tuple[str, int, int]:
    """One lease command. Only the holder of the token may renew, complete or fail; failing retries until the attempts are used up; a sweep frees a lease."""
    if command == "claim" and status == "pending":
        return "running", given, attempts + 1
    if status == "running" and command == "complete" and given == token:
        return "done", token, attempts
    if status == "running" and command == "fail" and given == token:
        return ("failed" if attempts >= retries else "pending"), -1, attempts
    if status == "running" and command == "sweep":
        return "pending", -1, attempts
    return status, token, attempts


def fold_leases(events: DataFrame) -> DataFrame:
    """events: task_id, ord, command, token. The state of every task after all its commands, in order, as one column expression."""
    seq = F.array_sort(F.collect_list(F.struct("ord", "command", "token")))
    start = F.struct(F.lit("pending").alias("status"), F.lit(-1).cast("long").alias("token"), F.lit(0).alias("attempts"))

    def after(s: Column, e: Column) -> Column:
        made = lambda status, token, attempts: F.struct(status.alias("status"), token.cast("long").alias("token"), attempts.alias("attempts"))
        running, mine, none = s["status"] == "running", s["token"] == e["token"], F.lit(-1)
        return (
            F.when((e["command"] == "claim") & (s["status"] == "pending"), made(F.lit("running"), e["token"], s["attempts"] + 1))
            .when(running & mine & (e["command"] == "complete"), made(F.lit("done"), s["token"], s["attempts"]))
            .when(running & mine & (e["command"] == "fail"), made(F.when(s["attempts"] >= 3, "failed").otherwise("pending"), none, s["attempts"]))
            .when(running & (e["command"] == "sweep"), made(F.lit("pending"), none, s["attempts"]))
            .otherwise(s)
        )

    return events.groupBy("task_id").agg(F.aggregate(seq, start, after).alias("s")).select("task_id", "s.status", "s.token", "s.attempts")


def lease_stream(stream: DataFrame) -> DataFrame:
    """The same state machine over a stream of (task_id, ord, command, token): state per task, a row per task and batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("pending", -1, 0)
        for frame in frames:
            for r in frame.sort_values("ord").itertuples():
                now = step(*now, r.command, r.token)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["task_id", "status", "token", "attempts"])

    return stream.groupBy("task_id").applyInPandasWithState(run, _TASK, "status string, token long, attempts int", "update", GroupStateTimeout.NoTimeout)


def sse_blocks(text: Column) -> Column:
    """Whole event blocks of a text stream; what follows the last blank line is the rest."""
    parts = F.split(text, "\n\n")
    return F.struct(F.slice(parts, 1, F.size(parts) - 1).alias("blocks"), F.element_at(parts, -1).alias("rest"))
