"""The kept table equals a full run, and a change opens only what it reaches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stormcell.operators.windows import series_features
from stormcell.plans import window_store as store
from stormcell.schema import OBS_SCHEMA
from stormcell.session import scratch_path
from stormcell.sources import publish

START = dt.datetime(2024, 1, 1)


def rows_of(r, cities, hours, share):
    return {(c, START + dt.timedelta(hours=h)): (r.randrange(640, 1600) / 16, r.randrange(320, 640) / 16,
                                                 r.randrange(0, 480) / 16, r.randrange(320, 800) / 16,
                                                 r.randrange(0, 960) / 16, r.randrange(0, 5))
            for c in cities for h in range(hours) if r.random() < share[c]}


def frame(spark, rows):
    return spark.createDataFrame([(c, t, *v) for (c, t), v in rows.items()], OBS_SCHEMA)


def sheet(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


def check(spark, path, rows):
    assert sheet(store.read(spark, path)) == sheet(series_features(frame(spark, rows)))


def test_changes_equal_a_full_run(spark):
    r = random.Random(5)
    share = {"dense": 1.0, "half": 0.4, "rare": 0.02, "new": 0.3}
    every = rows_of(r, share, 24 * 40, share)
    old = {k: v for k, v in every.items() if k[0] != "new" and k[1] < START + dt.timedelta(days=36)}
    late = dict(r.sample(sorted(old.items()), 5))
    kept = {k: v for k, v in old.items() if k not in late}
    path = scratch_path(spark, "series")
    store.build(frame(spark, kept), path)
    check(spark, path, kept)
    # late hours in the middle, a corrected one, then days at the end with a series of their own
    fixed = {k: (50.0, 30.0, 99.0, 33.0, 99.0, 1) for k in r.sample(sorted(kept), 3)}
    kept |= late | fixed
    assert store.apply(frame(spark, late | fixed), path) == 2
    check(spark, path, kept)
    more = {k: v for k, v in every.items() if k not in old}
    kept |= more
    assert store.apply(frame(spark, more), path) == 3
    check(spark, path, kept)
    assert store.apply(frame(spark, more), path) is None           # again: nothing to do
    assert store.apply(frame(spark, {}), path) is None
    assert publish.versions(spark, path)[-1] == 3


def test_a_series_with_long_gaps(spark):
    share = {"dense": 1.0}
    rows = rows_of(random.Random(1), share, 24 * 30, share)
    value = (50.0, 30.0, 1.0, 33.0, 2.0, 0)
    for d in (0, 3, 9, 14, 29):
        rows[("gaps", START + dt.timedelta(days=d, hours=d))] = (50.0, 30.0, float(d), 33.0, 2.0, 0)
    path = scratch_path(spark, "series")
    store.build(frame(spark, rows), path)
    late = {("gaps", START + dt.timedelta(days=8)): value}
    store.apply(frame(spark, late), path)
    check(spark, path, rows | late)


def test_work_follows_the_change(spark):
    """A late hour rewrites its day and the next one, however long the table is."""
    for days in (10, 40):
        share = {"a": 1.0, "b": 1.0}
        rows = rows_of(random.Random(2), share, 24 * days, share)
        gone = ("a", START + dt.timedelta(days=5, hours=20))
        path = scratch_path(spark, "series")
        store.build(frame(spark, {k: v for k, v in rows.items() if k != gone}), path)
        touched = spark.createDataFrame([("a", gone[1].date())], "city string, day date")
        plan = store._plan(spark, path, 1, touched, store.HALO)
        assert sorted((r["day"].day, r["redo"]) for r in plan.collect()) == [(5, False), (6, True), (7, True)]
        store.apply(frame(spark, {gone: rows[gone]}), path)
        runs = publish.manifest(spark, path).where("day IS NOT NULL")
        assert {r["day"].day for r in runs.where(F.col("run").startswith("2-")).collect()} == {6, 7}


def test_refusals(spark):
    share = {"a": 1.0}
    rows = rows_of(random.Random(3), share, 48, share)
    path = scratch_path(spark, "series")
    store.build(frame(spark, rows), path)
    one = frame(spark, dict(list(rows.items())[:1]))
    with pytest.raises(ValueError):
        store.apply(one.union(one), path)
    with pytest.raises(ValueError):
        store.apply(one.withColumn("city", F.lit(None).cast("string")), path)
    with pytest.raises(publish.Conflict):
        publish.publish(store.read(spark, path).withColumn("day", F.to_date("date")), path, whole=False, expect=0)
