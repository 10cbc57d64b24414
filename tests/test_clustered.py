"""The bucketed copy: same results as the plain layout, and no exchange."""

import datetime as dt
import random

from stormcell.operators.windows import series_features
from stormcell.schema import OBS_SCHEMA
from stormcell.session import scratch_path
from stormcell.sources import clustered


def sheet(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_and_days_without_an_exchange(spark):
    r = random.Random(4)
    rows = [(c, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), r.randrange(640, 1600) / 16,
             r.randrange(320, 640) / 16, r.randrange(0, 480) / 16, r.randrange(320, 800) / 16,
             r.randrange(0, 960) / 16, 0)
            for c, share in (("hot", 1.0), ("a", 0.2), ("b", 0.1)) for h in range(24 * 60) if r.random() < share]
    obs = spark.createDataFrame(rows, OBS_SCHEMA)
    path = scratch_path(spark, "clustered")
    # "hot" is split into weekly blocks with copies of the rows before
    name = clustered.land(spark, path, lambda: obs, max_series_rows=1000, buckets=4)
    assert spark.table(name).where("_halo").count() > 0
    feats = clustered.series_features(spark, name)
    assert sheet(feats) == sheet(series_features(obs, layout="plain"))
    days = clustered.city_days(spark, name)
    assert sum(r["n_hours"] for r in days.collect()) == len(rows)
    assert days.count() == len({(c, t.date()) for c, t, *_ in rows})
    for df in (feats, days):
        assert "Exchange" not in plan_of(df), plan_of(df)
    # a session that does not know the table declares it over the same files
    spark.sql(f"DROP TABLE {name}")
    again = clustered.land(spark, path, lambda: None)
    assert sheet(clustered.series_features(spark, again)) == sheet(series_features(obs, layout="plain"))
    assert "Exchange" not in plan_of(clustered.series_features(spark, again))
