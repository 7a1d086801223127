"""The stream of runs gives the batch fold's changes, however events arrive, over restarts."""

import datetime as dt
import random

import pytest

from lodestone.operators import claims as _claims  # noqa: F401  the package imports as a whole
from lodestone.streaming import events as E
from lodestone.streaming import runs as R

SCHEMA = "run_id long, id long, ts timestamp, event_type string, task_id long, token long, kind string, node_id string"
T0 = dt.datetime(2024, 1, 1)
MINUTE = 60_000


def log(seed: int, runs: int = 6, n: int = 120):
    rng, rows = random.Random(seed), []
    for run in range(runs):
        at, ident = 0, run * 10_000
        for k in range(6):
            ident += 1
            rows.append((run, ident, 0, "plan.node", None, None, "abc"[k % 3], f"n{k}"))
        tokens: dict[int, int] = {}
        for _ in range(n):
            ident, at = ident + 1, at + rng.randrange(5 * MINUTE)
            task, kind = rng.randrange(7), rng.choice(["task.claimed"] * 3 + ["task.started", "task.started", "task.completed", "task.failed", "task.renewed", "task.skipped"])
            if kind == "task.claimed":
                tokens[task] = ident
            rows.append((run, ident, at, kind, task, tokens.get(task, -5) - (rng.random() < 0.1), "abc"[task % 3], None))
        if run % 3:
            rows.append((run, ident + 1, at + 1, "report.ready" if run % 3 == 1 else "run.failed", None, None, None, None))
            rows.append((run, ident + 2, at + 2, "task.claimed", 0, 1, "a", None))
    rows.append((99, 1, 10**9, "task.claimed", 1, 1, "a", None))  # far ahead: the watermark passes all others
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], T0 + dt.timedelta(milliseconds=r[2]), *r[3:]) for r in rows], SCHEMA)


def by_hand(rows, now, lease=10 * MINUTE, retries=3):
    """Tasks and nodes of each run by a loop that knows nothing of the machine."""
    tasks, nodes, ended = {}, {}, {}
    runs = sorted({r[0] for r in rows})
    for run in runs:
        plan, mine = [], {}
        events = sorted((r[2], r[1], *r[3:]) for r in rows if r[0] == run and r[2] <= now)
        for ms, _, kind, task, token, what, node in events:
            if run in ended:
                break
            for t in [t for t in tasks if t[0] == run]:
                if tasks[t][0] == "running" and tasks[t][3] < ms:
                    tasks[t] = ("pending", -1, tasks[t][2], None)
            if kind in ("report.ready", "run.failed"):
                ended[run] = "ready" if kind == "report.ready" else "failed"
                break
            if kind == "plan.node":
                plan.append(node)
                nodes[run, node] = ("pending", what)
                continue
            if kind == "task.started" and task not in mine and (free := [x for x in plan if nodes[run, x] == ("pending", what)]):
                mine[task] = free[0]
                nodes[run, free[0]] = ("running", what)
            if kind in ("task.completed", "task.failed") and task in mine:
                nodes[run, mine[task]] = ("done" if kind == "task.completed" else "failed", nodes[run, mine[task]][1])
            status, held, attempts, until = tasks.get((run, task), ("pending", -1, 0, None))
            if kind == "task.claimed" and status == "pending":
                tasks[run, task] = ("running", token, attempts + 1, ms + lease)
            elif status == "running" and held == token:
                tasks[run, task] = {"task.renewed": ("running", token, attempts, ms + lease), "task.completed": ("done", -1, attempts, None), "task.skipped": ("skipped", -1, attempts, None), "task.failed": ("failed" if attempts >= retries else "pending", -1, attempts, None), "task.claimed": (status, held, attempts, until), "task.started": (status, held, attempts, until)}[kind]
        if run not in ended:
            for t in [t for t in tasks if t[0] == run and tasks[t][0] == "running" and tasks[t][3] < now]:
                tasks[t] = ("pending", -1, tasks[t][2], None)
    return {k: v[:3] for k, v in tasks.items()}, {k: v[0] for k, v in nodes.items()}, ended


def shown(changes):
    return sorted(map(tuple, changes.collect()), key=repr)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, R.STORE)
    yield
    spark.conf.set(name, before)


def test_fold_against_a_plain_loop(spark):
    from pyspark.sql import functions as F

    rows, now = log(1), 10**9 - 600_000
    changes = R.fold_runs(frame(spark, rows + rows[:300]).repartition(5), F.lit(now) + F.unix_millis(F.lit("2024-01-01").cast("timestamp")), lease_ms=10 * MINUTE).cache()
    tasks, nodes, ended = by_hand(rows, now)
    assert {(r.run_id, int(r.item)): (r.status, r.token, r.attempts) for r in R.states(changes, "task").collect()} == tasks
    assert {(r.run_id, r.item): r.status for r in R.states(changes, "node").collect()} == nodes
    assert {r.run_id: r.status for r in R.states(changes, "run").collect()} == ended == {1: "ready", 2: "failed", 4: "ready", 5: "failed"}
    # what the relational checklist and the cut at a run's end say of the same log
    df = frame(spark, rows)
    until = E.until_end(df)
    plan = until.filter("event_type = 'plan.node'").selectExpr("run_id", "node_id", "kind", "id as pos")
    assert {(r.run_id, r.node_id): r.status for r in E.checklist(plan, until).collect()} == nodes
    assert {(r.run_id, int(r.item)) for r in changes.filter("what = 'event'").collect()} == {(r.run_id, r.id) for r in until.filter("run_id < 99").collect()}


def test_stream_equals_batch(spark, rocks, tmp_path):
    from pyspark.sql import functions as F

    rows = log(2, runs=4, n=60)
    body, last = rows[:-1], rows[-1:]
    rng = random.Random(3)
    body.sort(key=lambda r: r[2] + rng.randrange(25 * MINUTE))  # shuffled within the delay
    third = len(body) // 3
    pieces = [body[:third], body[third : 2 * third] + body[third - 20 : third], body[2 * third :] + body[:40], last, [(0, 77_777, 5, "task.claimed", 3, 1, "a", None)]]
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i, piece in enumerate(pieces):
        frame(spark, piece).coalesce(1).write.mode("append").parquet(source)
        if i in (0, 2, 3, 4):  # each start goes on from the checkpoint
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            q = R.run_stream(stream, delay="30 minutes", lease_ms=10 * MINUTE).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start()
            q.awaitTermination()
            assert q.exception() is None
    now = F.unix_millis(F.lit("2024-01-01").cast("timestamp")) + 10**9 - 30 * MINUTE
    want = R.fold_runs(frame(spark, rows), now, lease_ms=10 * MINUTE)
    got = spark.read.parquet(sink)
    assert shown(got.select(*want.columns)) == shown(want) and got.count() > 200
