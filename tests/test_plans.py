"""Composed plans and helpers: request bounds, analytics slice, scaler stage."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stormcell.operators import filters, scaling
from stormcell.plans.analytics import HistoricalAnalytics
from stormcell.plans.training import scaler_stage
from stormcell.sources.fixture import load_obs
from tests.conftest import SF001


def test_request_bounds_and_routing(spark):
    req = spark.createDataFrame([(dt.date(2020, 9, 19),), (dt.date(2020, 9, 20),),
                                 (dt.date(2024, 1, 5),), (dt.date(2024, 3, 8),),
                                 (dt.date(2024, 3, 9),)], "request_date DATE")
    kept = filters.request_bounds(req, dt.date(2020, 9, 20), dt.date(2024, 3, 1), 7)
    assert [r[0] for r in kept.orderBy("request_date").collect()] == [
        dt.date(2020, 9, 20), dt.date(2024, 1, 5), dt.date(2024, 3, 8)]
    routed = {r["request_date"]: r["mode"] for r in
              filters.route_mode(kept, (dt.date(2024, 1, 1), dt.date(2024, 1, 30))).collect()}
    assert routed[dt.date(2024, 1, 5)] == "historical"
    assert routed[dt.date(2020, 9, 20)] == "forecast"  # before the data: forecast too


def test_sample_pair_validates(spark):
    obs = load_obs(spark, SF001)
    with pytest.raises(ValueError):
        filters.sample_pair(obs, "precipitation", "precipitation")
    assert filters.sample_pair(obs, "temperature_2m", "precipitation").count() == min(obs.count(), 1000)


def test_historical_analytics_shares_one_slice(spark):
    obs = load_obs(spark, SF001)
    with HistoricalAnalytics(obs, "2024-01-01", "2024-01-30") as ha:
        assert ha.filtered.storageLevel.useMemory
        res = ha.results()
        assert res["kpis"].first()["total_records"] == obs.count()
        assert set(res) == {"kpis", "days_per_level", "city_ranking", "box_stats",
                            "daily_trend", "hour_weekday"}
        assert res["daily_trend"].count() == 30
    assert not ha.filtered.storageLevel.useMemory


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x DOUBLE")
    params = scaling.fit_scaler(df, ["x"])
    assert params["x"] == (2.0, pytest.approx((2 / 3) ** 0.5))
    out = scaler_stage(params).transform(df).agg(F.avg("x__z"), F.stddev_pop("x__z")).first()
    assert out[0] == pytest.approx(0.0) and out[1] == pytest.approx(1.0)
    same = scaling.apply_scaler(df, params).agg(F.stddev_pop("x")).first()[0]
    assert same == pytest.approx(1.0)


def test_zero_spread_scales_by_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x DOUBLE")
    assert scaling.fit_scaler(df, ["x"])["x"] == (5.0, 1.0)


def test_registered_slice_reaches_the_scan(spark):
    """P1 on the ingested table: both the time range and the city are parquet
    pushed filters (row groups skip)."""
    from stormcell.queries import q_city_day_slice
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = q_city_day_slice(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(date" in pushed and "LessThan(date" in pushed
    assert "EqualTo(city,NATION_3)" in pushed
    parts = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "year" in parts and "month" in parts
