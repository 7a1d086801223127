"""What a run's turn asks of the state store: by entries and items, not by every event."""

import random

import pytest
from pyspark.sql import Row

from lodestone.operators import claims as _claims  # noqa: F401  the package imports as a whole
from lodestone.streaming import runs as R

EVENT = Row("run_id", "id", "ms", "event_type", "task_id", "token", "kind", "node_id", "ts")
KINDS = ["task.claimed", "task.claimed", "task.started", "task.completed", "task.failed", "task.renewed", "task.skipped"]


class Store:
    """Map and value states in a dictionary, and how often they were called."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getMapState(self, name, *kinds):
        return Map(self)

    def getValueState(self, name, kind):
        return Value(self)

    def registerTimer(self, ms):
        self.timers.append(ms)


class Map:
    def __init__(self, store):
        self.store, self.rows = store, {}

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue", "removeKey", "keys", "iterator", "clear"):
            self.store.calls += 1
        return object.__getattribute__(self, name)

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        self.rows.pop(key)

    def keys(self):
        return iter(list(self.rows))

    def iterator(self):
        return iter(list(self.rows.items()))

    def clear(self):
        self.rows.clear()


class Value:
    def __init__(self, store):
        self.store, self.row = store, None

    def exists(self):
        self.store.calls += 1
        return self.row is not None

    def get(self):
        self.store.calls += 1
        return self.row

    def update(self, row):
        self.store.calls += 1
        self.row = row


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def events(n, seed=5):
    rng, out = random.Random(seed), [EVENT(1, k, 1, "plan.node", None, None, "abc"[k % 3], f"n{k}", None) for k in range(6)]
    for k in range(n):
        task = rng.randrange(5)
        out.append(EVENT(1, 100 + k, 2 + k * 7 // 3, rng.choice(KINDS), task, task, "abc"[task % 3], None, None))
    return out


def whole(rows, now):
    machine = R.Machine(R.Tables(), lease_ms=40, retries=3, public=None)
    for r in sorted(rows, key=lambda r: (r.ms, r.id)):
        if r.ms <= now and machine.apply(r.ms, r.id, *r[3:8]):
            return machine.out
    machine.expire(now)
    return machine.out


def fed(rows, steps):
    """The changes of a run whose rows come in pieces, each before its watermark."""
    store, out = Store(), []
    p = R.RunProcessor(40, 3, None)
    p.init(store)
    for piece, now in steps:
        list(p.handleInputRows((1,), iter(piece), Now(0 if now is None else min(r.ms for r in rows) - 1)))
        if now is not None:
            out += [tuple(r[1:]) for r in p.handleExpiredTimer((1,), Now(now), None)]
    return out, store


def test_few_calls_for_many_events():
    rows = events(1000)
    out, store = fed(rows, [(rows, 5000)])
    assert out == whole(rows, 5000)
    assert store.calls < len(rows) / 5  # several an event before


@pytest.mark.parametrize("end", [None, "report.ready"])
def test_entries_that_overlap_and_wait(monkeypatch, end):
    monkeypatch.setattr(R, "ENTRY", 8, raising=False)
    monkeypatch.setattr(R, "AT_ONCE", 50, raising=False)
    rows = events(400)
    if end:
        rows.append(EVENT(1, 9999, 700, end, None, None, None, None, None))
    mixed = rows + rows[::7]
    random.Random(1).shuffle(mixed)
    out, store = fed(rows, [(mixed[:200], None), (mixed[200:], 300), ([], 301), ([], 600), ([], 2000)])
    assert out == whole(rows, 2000)
    assert store.timers
