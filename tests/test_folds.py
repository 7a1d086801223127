"""Folds cut into parts give what one pass in order gives."""

import datetime as dt
import random
from collections import deque

import pytest

from lodestone.operators import folds as FO
from lodestone.operators import ledger as L
from lodestone.sources import replay as R


def by_hand(rows, cap, usd_cap):
    """rows: (run, o, weight, usd), each run in order."""
    out, state = {}, {}
    for run, o, w, usd in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        used, paid = state.get(run, (0, 0.0))
        reason = "budget_usd" if usd_cap is not None and paid >= usd_cap else "budget_weight" if used + w > cap else None
        state[run] = (used, paid) if reason else (used + w, paid + (usd or 0))
        out[run, o] = reason
    return out


@pytest.mark.parametrize(("cap", "usd_cap", "most"), [(11, 4.0, 6), (500, None, 9), (40_000, 900.0, 9), (0, None, 3), (7, 0.0, 3)])
def test_one_run_over_many_parts(spark, cap, usd_cap, most):
    rng = random.Random(cap)
    rows = [(1, i, rng.randrange(most), rng.choice((0.0, 0.125, 0.5, None))) for i in range(4000)] + [(r, i, rng.randrange(most), 0.25) for r in (0, 2, 3, None) for i in range(rng.randrange(60))]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, "run long, o long, w long, usd double").repartition(5)
        got = L.admit_greedy(df, "run", ["o"], "w", cap, usd="usd", usd_cap=usd_cap)
        assert {(r.run, r.o): r.reason for r in got.collect()} == by_hand(rows, cap, usd_cap)
        per_part = got.rdd.mapPartitions(lambda rs: [sum(1 for r in rs if r.run == 1)]).collect()
        assert sum(n > 0 for n in per_part) > 8  # the long run is no one task's
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_maps_stay_small():
    told, rng = FO.BudgetMap("w", 1000, None, None), random.Random(1)
    rows = [{"w": rng.randrange(1, 40)} for _ in range(3000)]
    for row in rows:
        told.add(row)
    assert len(told.starts) <= 1001
    for left in (0, 1, 7, 500, 1000):
        state = [left, 0]
        for row in rows:
            if row["w"] <= state[0]:
                state[0] -= row["w"]
        assert told.after([left, 0]) == state


def test_rolling_allowance_over_parts(spark):
    rng, t0 = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(p, f"q{rng.randrange(9)}", i, t0 + dt.timedelta(minutes=37 * i + rng.randrange(30)), rng.choice((0.1, 0.2, 0.25)), "Down" if rng.random() < 0.1 else None) for p, n in (("a", 1500), ("b", 40), ("c", 3)) for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        from pyspark.sql import functions as F

        requests = spark.createDataFrame(rows, "provider string, query string, ord long, at timestamp, cost double, error string")
        cache = spark.createDataFrame([("q1", t0 + dt.timedelta(days=900))], "query string, expires_at timestamp")
        got = {(r.provider, r.ord): (r.charged, r.degraded, r.reason) for r in R.route(requests, cache, F.lit("2024-02-01").cast("timestamp"), 1.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, spent = {}, {}
    for p, q, o, at, cost, error in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
        queue = spent.setdefault(p, deque())
        while queue and queue[0][0] < at - dt.timedelta(hours=24):
            queue.popleft()
        if q == "q1":
            want[p, o] = (0.0, False, None)
        elif sum(FO.exact(c) for _, c in queue) >= FO.exact(1.0):
            want[p, o] = (0.0, True, "allowance")
        elif error:
            want[p, o] = (0.0, True, error)
        else:
            queue.append((at, cost))
            want[p, o] = (cost, False, None)
    assert got == want and sum(x[2] == "allowance" for x in want.values()) > 100
