"""Folds over ordered groups of any size: what depends on all decisions before, spread over all tasks.

Rows are range partitioned by group and order and checkpointed, so a group may span many parts and a part hold many
groups. Only the first group of a part needs a state from before it, and only a part that is one group altogether passes
on a state that depends on it. Such a part either becomes a map from entry to exit state (`Fold.summary`), so that the
states at all borders follow from one pass; or it is run with the entry state known so far, again and again while that
changes: a fold that forgets (a rolling window) settles in a few rounds, and one that never does takes the parts one by
one, each once its entry is right. A last pass over all parts gives the rows. A state per part meets on the driver.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.work import keep

_TYPES = {"boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
_SUMMARY = "part int, first binary, last binary, exit binary, map binary"


class Fold:
    """start: a group's first state (picklable, comparable); step: changes it and gives the row's values, in order of `columns`."""

    columns = ""

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, row: dict) -> list:
        raise NotImplementedError

    def summary(self) -> Any:
        """An object with add(row) and after(state), which stands for the rows added; None if there is no such map."""
        return None


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[tuple, dict]]]]:
    for b in batches:
        if b.num_rows:
            yield b, [(tuple(row[k] for k in keys), row) for row in b.to_pylist()]


def _summaries(parts: DataFrame, fold: Fold, keys: list[str], entries: dict[int, bytes]) -> list:
    """Per part that has rows: its first and last group, the state after the last, and for a part of one group its map."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = group = state = None
        whole, told = True, fold.summary()
        for _, rows in _groups(batches, keys):
            part = rows[0][1]["_part"]
            for at, row in rows:
                if first is None:
                    first = group = at
                    state = pickle.loads(entries[part]) if part in entries else fold.start()
                elif at != group:
                    group, state, whole = at, fold.start(), False
                fold.step(state, row)
                if whole and told is not None:
                    told.add(row)
        if part is not None:
            told_ = pickle.dumps(told) if whole and told is not None else None
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (pickle.dumps(first), pickle.dumps(group), pickle.dumps(state), told_))], ["part", "first", "last", "exit", "map"])

    return parts.mapInArrow(run, _SUMMARY).collect()


def _entries(parts: DataFrame, fold: Fold, keys: list[str]) -> dict[int, bytes]:
    """The state at the start of each part whose first group goes on from the part before."""
    known = {r.part: [pickle.loads(r.first), pickle.loads(r.last), r.exit, r.map] for r in _summaries(parts, fold, keys, {})}
    used: dict[int, Any] = {}
    while True:
        entries, again, before = {}, [], None
        for part in sorted(known):
            first, last, out, told = known[part]
            if before is not None and known[before][1] == first:
                entries[part] = known[before][2]
                state = pickle.loads(entries[part])
                if first == last and used.get(part, fold.start()) != state:
                    if told is not None:
                        known[part][2], used[part] = pickle.dumps(pickle.loads(told).after(state)), pickle.loads(entries[part])
                    else:
                        again.append(part)
            before = part
        if not again:
            return entries
        for part in again:
            used[part] = pickle.loads(entries[part])
        for r in _summaries(parts.filter(F.col("_part").isin(again)), fold, keys, {p: entries[p] for p in again}):
            known[r.part][2] = r.exit


def folded(df: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """df with the fold's columns. Rows that tie in keys and order are taken in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keep(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order))
    parts = rows.withColumn("_part", F.spark_partition_id())
    entries = _entries(parts, fold, keys)
    more = StructType.fromDDL(fold.columns)
    names, kinds = [*df.columns, *more.names], [_TYPES[f.dataType.simpleString()] for f in more]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = state = None
        begun = False
        for b, rows in _groups(batches, keys):
            out = []
            for at, row in rows:
                if not begun:
                    begun, group = True, at
                    state = pickle.loads(entries[row["_part"]]) if row["_part"] in entries else fold.start()
                elif at != group:
                    group, state = at, fold.start()
                out.append(fold.step(state, row))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names)

    return parts.mapInArrow(run, StructType([*df.schema, *more]))


def exact(x: Any) -> int:
    """A sum of money as whole billionths, so that sums don't depend on where they are cut."""
    return 0 if x is None else round(float(x) * 1_000_000_000)


class BudgetMap:
    """What a range of tasks does to a budget: from what is left before it to what is left after it, and what it pays.

    A step function of what is left: between two neighbouring `starts` the same tasks fit, so the same weight (`shift`)
    and the same money go. There are as many steps as there are different outcomes, the budget's units at most.
    """

    def __init__(self, weight: str, cap: int, usd: str | None, usd_cap: int | None):
        self.weight, self.usd, self.usd_cap = weight, usd, usd_cap
        self.starts, self.shift, self.paid, self.end = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), cap + 1

    def add(self, row: dict) -> None:
        w, pay = int(row[self.weight]), exact(row[self.usd]) if self.usd else 0
        fits = self.shift + w  # from here on the task fits
        ends = np.append(self.starts[1:], self.end)
        full, split = fits <= self.starts, (fits > self.starts) & (fits < ends)
        starts, shift, paid = fits[split], self.shift[split] + w, self.paid[split] + pay
        self.shift[full] += w
        self.paid[full] += pay
        if len(starts):
            order = np.argsort(np.concatenate([self.starts, starts]), kind="stable")
            self.starts, self.shift, self.paid = (np.concatenate(x)[order] for x in ((self.starts, starts), (self.shift, shift), (self.paid, paid)))

    def after(self, state: list) -> list:
        left, spent = state
        if self.usd_cap is not None and spent >= self.usd_cap:
            return [left, self.usd_cap]
        k = bisect_right(self.starts.tolist(), left) - 1
        paid = spent + int(self.paid[k])
        # once the money is gone nothing else is taken, so what is left after that doesn't matter
        return [left - int(self.shift[k]), paid if self.usd_cap is None else min(paid, self.usd_cap)]


class GreedyBudget(Fold):
    """State: weight left, money spent (billionths, usd_cap at most). Weights are whole numbers from 0, money is not negative."""

    columns = "admitted boolean, reason string"

    def __init__(self, weight: str, cap: int, usd: str | None, usd_cap: float | None):
        self.weight, self.cap, self.usd, self.usd_cap = weight, cap, usd, None if usd_cap is None else exact(usd_cap)

    def start(self) -> list:
        return [self.cap, 0]

    def step(self, state: list, row: dict) -> list:
        reason = "budget_usd" if self.usd_cap is not None and state[1] >= self.usd_cap else "budget_weight" if int(row[self.weight]) > state[0] else None
        if reason is None:
            state[0] -= int(row[self.weight])
            state[1] += exact(row[self.usd]) if self.usd else 0
            if self.usd_cap is not None:
                state[1] = min(state[1], self.usd_cap)
        return [reason is None, reason]

    def summary(self) -> BudgetMap:
        return BudgetMap(self.weight, self.cap, self.usd, self.usd_cap)
