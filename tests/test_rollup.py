"""Stored partials answer like a scan of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stormcell.operators import aggregates as agg
from stormcell.operators import filters
from stormcell.plans import rollup
from stormcell.schema import OBS_SCHEMA
from stormcell.session import scratch_path
from tests.conftest import obs_frame

CITIES = ["A", "B", "C", "D"]
RANGES = [(None, None, None), ("2024-01-03", "2024-01-20", ["A", "C"]), ("2024-01-09", "2024-01-09", ["B"]),
          ("2023-12-30", "2024-01-02", CITIES), ("2024-01-05", "2024-01-06", ["nowhere"])]


@pytest.fixture(scope="module")
def obs(spark):
    r = random.Random(2)
    eighth = lambda lo, hi: None if r.random() < 0.2 else r.randrange(lo * 8, hi * 8) / 8
    rows = [(c, (dt.datetime(2023, 12, 28) + dt.timedelta(hours=h)).strftime("%Y-%m-%d %H"), eighth(40, 100),
             eighth(20, 40), eighth(0, 30), eighth(22, 50), eighth(0, 120),
             None if r.random() < 0.05 else r.choice([0, 0, 0, 1, 2, 3, 4, 5]))
            for c in CITIES for h in range(24 * 30) if r.random() < 0.6]
    return spark.createDataFrame(obs_frame(spark, rows).collect(), OBS_SCHEMA)


@pytest.fixture(scope="module")
def path(spark, obs):
    p = scratch_path(spark, "rollup")
    rollup.store(obs, p)
    return p


def same(got, want, digits=9):
    def rows(df):
        cols = sorted(df.columns)
        return sorted(tuple(round(v, digits) if isinstance(v, float) else str(v) for v in (r[c] for c in cols))
                      for r in df.collect())
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=10.0 ** -digits) if all(
            isinstance(v, float) for v in (*x, *y)) else x == y


@pytest.mark.parametrize("start, end, cities", RANGES)
def test_answers_equal_the_row_scan(spark, obs, path, start, end, cities):
    rows = obs
    if start:
        rows = filters.range_city_filter(obs, start, end, cities)
    u = rollup.Rollup(spark, path, start, end, cities)
    same(u.kpis(), agg.range_kpis(rows))
    same(u.city_ranking(), agg.city_ranking(rows))
    same(u.daily_trend(), agg.daily_trend(rows))
    same(u.day_extremes(), agg.day_extremes(rows))
    for v in ("temperature_2m", "windspeed_10m"):
        same(u.hour_weekday(v), agg.hour_weekday_long(rows, v))
    same(u.days_per_level(start, end), agg.days_per_level(rows))
    got = {(r["var_x"], r["var_y"]): r["r"] for r in u.correlations().collect()}
    for r in agg.corr_matrix(rows).collect():
        if r["var_x"] != r["var_y"]:
            assert got[r["var_x"], r["var_y"]] == (pytest.approx(r["r"], abs=1e-9) if r["r"] is not None else None)
    assert len(got) == 25


def test_distinct_days_of_all_city_sets(spark, obs, path):
    for mask in range(1, 16):
        some = [c for i, c in enumerate(CITIES) if mask >> i & 1]
        same(rollup.Rollup(spark, path, cities=some).days_per_level(),
             agg.days_per_level(obs.where(F.col("city").isin(some))))


def test_plans_read_no_hourly_row(spark, path):
    u = rollup.Rollup(spark, path, "2024-01-03", "2024-01-20", ["A"])
    for df in (u.kpis(), u.daily_trend(), u.correlations(), u.hour_weekday()):
        assert df.inputFiles() and all(f"/{rollup.DAYS}/data/day=2024-01-" in f for f in df.inputFiles())
        assert len(df.inputFiles()) <= 18  # the range's folders
    assert all(f"/{rollup.BITMAPS}/" in f for f in u.days_per_level().inputFiles())
