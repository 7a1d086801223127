"""The event log of runs as one state machine: leases of tasks, checklist of the plan, public events, end of the run.

`Machine` applies one run's events in order of (ms, id). `fold_runs` drives it over a table, `run_stream` over a stream,
with state per run in Spark's state store: events wait there, sorted and ENTRY to an entry, until the watermark has passed
them, timers wake a run for its next event or the end of a lease, and the event that ends a run clears all of its state
but the mark that it is over. The store is asked once for what a run's turn needs and told once what it changed, not by
every event. So the order of arrival within the watermark's delay, repeated deliveries and restarts change nothing.

Events: run_id, id, ts, event_type, and as the type needs them task_id, token, kind, node_id (all may be null).

- plan.node declares a node (node_id) of a kind; the k-th task of a kind to start takes the k-th node of that kind
- task.claimed: a pending task runs under the token until LEASE later; task.renewed, by the token's holder, until LEASE later
- task.started takes a node, once; task.completed and task.failed set that node's status
- task.completed, task.failed, task.skipped, by the token's holder: done; pending again, or failed after `retries`; skipped
- a lease that ends before the next event frees its task
- report.ready and run.failed end the run; what follows counts for nothing

Changes come as rows: run_id, seq (1, 2, ... in each run), ms, what (event, task, node, run), item (id of the event, task
or node; empty for the run), status, token, attempts. The last row of an item is its state.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import fixed

CHANGES = "run_id long, seq long, ms long, what string, item string, status string, token long, attempts int"
_ARROW = {"run_id": pa.int64(), "seq": pa.int64(), "ms": pa.int64(), "what": pa.string(), "item": pa.string(), "status": pa.string(), "token": pa.int64(), "attempts": pa.int32()}
ENDS = {"report.ready": "ready", "run.failed": "failed"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ["event_type", "task_id", "token", "kind", "node_id"]
_IDLE = ("pending", -1, 0)
#: Events of a run that wait in one entry of the state store, and that are sorted at once as they come.
ENTRY, AT_ONCE = 256, 1 << 16


class Tables:
    """A run's state in plain dictionaries, by the calls that map states of a stream answer too."""

    def __init__(self):
        self.maps: dict[str, dict] = {"task": {}, "lease": {}, "node": {}, "taken": {}, "kind": {}}

    def get(self, name: str, key: tuple) -> tuple | None:
        return self.maps[name].get(key)

    def put(self, name: str, key: tuple, value: tuple) -> None:
        self.maps[name][key] = value

    def drop(self, name: str, key: tuple) -> None:
        self.maps[name].pop(key, None)

    def items(self, name: str) -> list[tuple]:
        return list(self.maps[name].items())

    def clear(self) -> None:
        for m in self.maps.values():
            m.clear()


class Machine:
    def __init__(self, tables, *, lease_ms: int, retries: int, public: frozenset | None, seq: int = 0):
        self.tables, self.lease_ms, self.retries, self.public, self.seq, self.out = tables, lease_ms, retries, public, seq, []
        self.soon = -math.inf  # no lease ends before

    def _say(self, ms: int, what: str, item, status: str, token: int | None = None, attempts: int | None = None) -> None:
        self.seq += 1
        self.out.append((self.seq, ms, what, str(item), status, token, attempts))

    def _task(self, ms: int, task: int, status: str, token: int, attempts: int, until: int | None) -> None:
        self.tables.put("task", (task,), (status, token, attempts))
        if until is None:
            self.tables.drop("lease", (task,))
        else:
            self.tables.put("lease", (task,), (until,))
            self.soon = min(self.soon, until)
        self._say(ms, "task", task, status, token, attempts)

    def expire(self, now: int) -> None:
        """Leases that ended before now, in order of their ends."""
        if now <= self.soon:
            return
        for until, task in sorted((v[0], k[0]) for k, v in self.tables.items("lease") if v[0] < now):
            _, _, attempts = self.tables.get("task", (task,))
            self._task(until, task, "pending", -1, attempts, None)
        end = self.next_end()
        self.soon = math.inf if end is None else end

    def next_end(self) -> int | None:
        return min((v[0] for _, v in self.tables.items("lease")), default=None)

    def apply(self, ms: int, ident: int, event: str, task: int | None, token: int | None, kind: str | None, node: str | None) -> bool:
        """True if this event ends the run."""
        self.expire(ms)
        if self.public is None or event in self.public:
            self._say(ms, "event", ident, event)
        if event in ENDS:
            self._say(ms, "run", "", ENDS[event])
            self.tables.clear()
            return True
        if event == "plan.node":
            declared, taken = self.tables.get("kind", (kind,)) or (0, 0)
            self.tables.put("kind", (kind,), (declared + 1, taken))
            self.tables.put("node", (kind, declared), (node,))
            self._say(ms, "node", node, "pending")
        elif task is not None:
            self._of_task(ms, event, task, token, kind)
        return False

    def _of_task(self, ms: int, event: str, task: int, token: int | None, kind: str | None) -> None:
        status, held, attempts = self.tables.get("task", (task,)) or _IDLE
        if event == "task.started" and self.tables.get("taken", (task,)) is None:
            declared, taken = self.tables.get("kind", (kind,)) or (0, 0)
            if taken < declared:
                node = self.tables.get("node", (kind, taken))[0]
                self.tables.put("kind", (kind,), (declared, taken + 1))
                self.tables.put("taken", (task,), (node,))
                self._say(ms, "node", node, "running")
        if event in ("task.completed", "task.failed") and (node := self.tables.get("taken", (task,))):
            self._say(ms, "node", node[0], "done" if event == "task.completed" else "failed")
        mine = status == "running" and held == token
        if event == "task.claimed" and status == "pending":
            self._task(ms, task, "running", -1 if token is None else token, attempts + 1, ms + self.lease_ms)
        elif event == "task.renewed" and mine:
            self.tables.put("lease", (task,), (ms + self.lease_ms,))
        elif event == "task.completed" and mine:
            self._task(ms, task, "done", -1, attempts, None)
        elif event == "task.skipped" and mine:
            self._task(ms, task, "skipped", -1, attempts, None)
        elif event == "task.failed" and mine:
            self._task(ms, task, "failed" if attempts >= self.retries else "pending", -1, attempts, None)


_CHANGE = Row(*_ARROW)


def _rows(run: int, changes: list[tuple]) -> Iterator[Row]:
    return (_CHANGE(run, *c) for c in changes)


def _shaped(events: DataFrame, *more: Column) -> DataFrame:
    of = dict(events.dtypes)
    get = lambda c, t: (F.col(c) if c in of else F.lit(None)).cast(t).alias(c)
    return events.select(F.col("run_id").cast("long"), F.col("id").cast("long"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), get("event_type", "string"), get("task_id", "long"), get("token", "long"), get("kind", "string"), get("node_id", "string"), *([F.col("ts")] if events.isStreaming else []), *more)


def fold_runs(events: DataFrame, as_of: Column | None = None, *, lease_ms: int = fixed.LEASE_MINUTES * 60_000, retries: int = 3, public: list[str] | None = None) -> DataFrame:
    """All changes of all runs, as of a time (ms; null: after all events, leases left as they are). Rows stream through sorted partitions; of a run its state is held, not its events."""
    public_ = None if public is None else frozenset(public)
    rows = _shaped(events, (F.lit(None) if as_of is None else as_of).cast("long").alias("now"))
    kept = rows.filter(F.col("now").isNull() | (F.col("ms") <= F.col("now")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = machine = last = now = None
        over, out = False, []

        def close() -> None:
            if machine is not None:
                if not over and now is not None:
                    machine.expire(now)
                out.extend((at, *c) for c in machine.out)
                machine.out = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.values(), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, [*_ARROW])

        for b in batches:
            for run_id, ident, ms, event, task, token, kind, node, till in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if machine is None or run_id != at:
                    close()
                    at, machine, over, last = run_id, Machine(Tables(), lease_ms=lease_ms, retries=retries, public=public_), False, None
                now = till
                if not over and (ms, ident) != last:
                    over = machine.apply(ms, ident, event, task, token, kind, node)
                last = ms, ident
            if machine is not None:
                out.extend((at, *c) for c in machine.out)
                machine.out = []
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    return kept.select("run_id", "id", "ms", *_FIELDS, "now").repartition("run_id").sortWithinPartitions("run_id", "ms", "id").mapInArrow(run, CHANGES)


class _MapStates:
    """The same calls as Tables, on a stream's map states: what was read is kept for a turn, what changed is written by save()."""

    _KINDS = {"task": ("task long", "status string, token long, attempts int"), "lease": ("task long", "until long"), "node": ("kind string, at long", "node string"), "taken": ("task long", "node string"), "kind": ("kind string", "declared long, taken long")}

    def __init__(self, handle: StatefulProcessorHandle):
        self.maps = {name: handle.getMapState(name, *kinds) for name, kinds in self._KINDS.items()}

    def open(self, fresh: bool) -> None:
        """A run's turn begins; of a fresh run nothing is stored."""
        self.held, self.changed = {name: {} for name in self.maps}, set()
        self.stored = not fresh
        self.whole = set(self.maps) if fresh else set()

    def get(self, name: str, key: tuple) -> tuple | None:
        held = self.held[name]
        if key not in held and name not in self.whole:
            m = self.maps[name]
            held[key] = tuple(m.getValue(key)) if m.containsKey(key) else None
        return held.get(key)

    def put(self, name: str, key: tuple, value: tuple) -> None:
        self.held[name][key] = value
        self.changed.add((name, key))

    def drop(self, name: str, key: tuple) -> None:
        self.put(name, key, None)

    def items(self, name: str) -> list[tuple]:
        held = self.held[name]
        if name not in self.whole:
            for k, v in self.maps[name].iterator():
                held.setdefault(tuple(k), tuple(v))
            self.whole.add(name)
        return [(k, v) for k, v in held.items() if v is not None]

    def clear(self) -> None:
        if self.stored:
            for m in self.maps.values():
                m.clear()
        self.open(True)

    def save(self) -> None:
        for name, key in self.changed:
            m, value = self.maps[name], self.held[name][key]
            if value is not None:
                m.updateValue(key, value)
            elif self.stored and m.containsKey(key):
                m.removeKey(key)


class RunProcessor(StatefulProcessor):
    def __init__(self, lease_ms: int, retries: int, public: frozenset | None):
        self.options = {"lease_ms": lease_ms, "retries": retries, "public": public}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.tables = handle, _MapStates(handle)
        self.waiting = handle.getMapState("waiting", "first long, part long", "events string")
        self.run = handle.getValueState("run", "over boolean, seq long, applied long, part long")

    def _state(self) -> tuple:
        return tuple(self.run.get()) if self.run.exists() else (False, 0, -1, 0)

    def _wait(self, events: dict, part: int) -> int:
        """Events by (ms, id) go to the store in order; the number of the next part."""
        order = sorted(events)
        for i in range(0, len(order), ENTRY):
            some = order[i : i + ENTRY]
            self.waiting.updateValue((some[0][0], part), (json.dumps([(*at, *events[at]) for at in some]),))
            part += 1
        return part

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        over, seq, applied, part = self._state()
        passed, first, events, before = max(applied, timerValues.getCurrentWatermarkInMs()), None, {}, part
        for r in rows:
            _, ident, ms, *fields = r[: 3 + len(_FIELDS)]
            if not over and ms > passed:  # else it is late, or a repeat of what was applied
                events[ms, ident] = fields
                first = ms if first is None else min(first, ms)
                if len(events) >= AT_ONCE:
                    part, events = self._wait(events, part), {}
        part = self._wait(events, part)
        if first is not None:
            self.handle.registerTimer(first)
        if part > before:
            self.run.update((over, seq, applied, part))
        return iter([])

    def _due(self, now: int, later: dict) -> Iterator[tuple]:
        """Waiting events up to now in order, each once, the one that came last; those of their entries that have to wait on go to `later`. An entry is read when its first event is next."""
        entries, k, heap, last = sorted(tuple(x) for x in self.waiting.keys()), 0, [], None
        while True:
            while k < len(entries) and entries[k][0] <= (min(now, heap[0][0]) if heap else now):
                text = self.waiting.getValue(entries[k])[0]
                self.waiting.removeKey(entries[k])
                for ms, ident, *fields in json.loads(text):
                    heapq.heappush(heap, (ms, ident, -entries[k][1], fields))
                k += 1
            if not heap or heap[0][0] > now:
                break
            ms, ident, _, fields = heapq.heappop(heap)
            if (ms, ident) != last:
                yield ms, ident, *fields
            last = ms, ident
        while heap:
            ms, ident, _, fields = heapq.heappop(heap)
            later.setdefault((ms, ident), fields)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over, seq, applied, part = self._state()
        now = timerValues.getCurrentWatermarkInMs()
        if over or now <= applied:
            return
        self.tables.open(fresh=applied < 0)
        machine, later = Machine(self.tables, seq=seq, **self.options), {}
        for event in self._due(now, later):
            over = machine.apply(*event)
            if len(machine.out) >= AT_ONCE:
                yield from _rows(key[0], machine.out)
                machine.out = []
            if over:
                self.waiting.clear()
                break
        if not over:
            machine.expire(now)
            part = self._wait(later, part)
            wake = [k[0] for k in self.waiting.keys()] + [end + 1 for end in [machine.next_end()] if end is not None]
            if wake:
                self.handle.registerTimer(min(wake))
        self.tables.save()
        self.run.update((over, machine.seq, now, part))
        yield from _rows(key[0], machine.out)

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, *, delay: str = "10 minutes", lease_ms: int = fixed.LEASE_MINUTES * 60_000, retries: int = 3, public: list[str] | None = None) -> DataFrame:
    """The same changes over a stream, each once, as the watermark passes; the session's state store must be STORE."""
    rows = _shaped(events).withWatermark("ts", delay)
    return rows.groupBy("run_id").transformWithState(RunProcessor(lease_ms, retries, None if public is None else frozenset(public)), CHANGES, "Append", "EventTime")


def states(changes: DataFrame, what: str) -> DataFrame:
    """The last row of each item."""
    last = changes.filter(F.col("what") == what).groupBy("run_id", "item").agg(F.max_by(F.struct("status", "token", "attempts", "ms"), "seq").alias("s"))
    return last.select("run_id", "item", "s.status", "s.token", "s.attempts", "s.ms")
