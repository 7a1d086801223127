"""Stored tables: what upserts and retention rewrite, and what they leave alone."""

import datetime as dt
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import stored as ST

T0 = dt.datetime(2024, 1, 1)


def files(folder):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(folder).rglob("*.parquet")}


@pytest.fixture()
def keyed(spark, tmp_path):
    t = ST.Keyed(spark, f"k{uuid.uuid4().hex}", ["url"], parts=16, buckets=4)
    rows = [(f"u{i}", i, f"e{i}" if i % 2 else None, T0 + dt.timedelta(days=i % 9)) for i in range(400)]
    t.create(spark.createDataFrame(rows, "url string, n long, etag string, at timestamp"), str(tmp_path / "t"))
    yield t, {r[0]: r[1:] for r in rows}, tmp_path / "t"
    spark.sql(f"DROP TABLE {t.name}")


def shown(t):
    rows = [tuple(r) for r in t.read().collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_upserts_touch_few_directories(spark, keyed):
    t, want, folder = keyed
    before = files(folder)
    new = [("u3", 1000, None, T0 + dt.timedelta(days=30)), ("fresh", 7, "e", T0)]
    df = spark.createDataFrame(new, "url string, n long, etag string, at timestamp")
    assert t.upsert(df) <= 2
    want |= {r[0]: r[1:] for r in new}
    assert shown(t) == want
    after = files(folder)
    same = {p for p in before if after.get(p) == before[p]}
    assert len({p.split("_part=")[1].split("/")[0] for p in same}) >= 14 and all(p in same or f"_part={p.split('_part=')[1].split('/')[0]}" not in {x.split("/")[-2] for x in same} for p in before)
    assert t.upsert(df.limit(0)) == 0 and shown(t) == want


def test_newest_and_sticky(spark, keyed):
    t, want, _ = keyed
    later = [("u1", -1, None, T0 + dt.timedelta(days=60)), ("u2", -2, None, T0 - dt.timedelta(days=60)), ("u4", -4, "x", want["u4"][2])]
    t.upsert(spark.createDataFrame(later, "url string, n long, etag string, at timestamp"), ST.keep_newest("at"))
    want["u1"] = later[0][1:]
    assert shown(t) == want
    t.upsert(spark.createDataFrame([("u5", 50, None, T0)], "url string, n long, etag string, at timestamp"), ST.sticky(["etag"]))
    want["u5"] = (50, "e5", T0)
    assert shown(t) == want


def test_old_side_is_not_shuffled(spark, keyed):
    t, want, _ = keyed
    new = spark.createDataFrame([(f"u{i}", -i, None, T0) for i in range(50)], "url string, n long, etag string, at timestamp")
    merged = t.merged(new, lambda c: F.coalesce(f"new.{c}", f"old.{c}"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert merged.count() >= 50


def test_retention_drops_days(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS dated LOCATION '{tmp_path / 'dated'}'")
    t = ST.Dated(spark, f"dated.d{uuid.uuid4().hex}", "ts")
    rows = [(i, T0 + dt.timedelta(hours=i)) for i in range(24 * 10)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    t.append(df.filter("id < 100"))
    t.append(df.filter("id >= 100"))
    assert sorted(map(tuple, t.read().collect())) == rows
    before = files(tmp_path)
    assert t.retain("2024-01-04") == ["2024-01-01", "2024-01-02", "2024-01-03"] and t.retain("2024-01-04") == []
    assert sorted(map(tuple, t.read().collect())) == rows[72:]
    after = files(tmp_path)
    assert all(before[p] == x for p, x in after.items()) and {p.split("day=")[1][:10] for p in after} == {f"2024-01-{d:02}" for d in range(4, 11)}
    spark.sql(f"DROP TABLE {t.name}")
