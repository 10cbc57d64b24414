"""Scalar helpers: bins, calendar, labels, probability padding, alerts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stormcell.functions import bins, labels
from stormcell.functions import calendar as cal


@pytest.mark.parametrize("p,expected", [(-3.0, 0), (0.0, 0), (0.001, 1), (5.0, 1), (5.01, 2),
                                        (15.0, 2), (15.5, 3), (50.0, 3), (50.1, 4), (250.0, 4),
                                        (None, None)])
def test_precip_bins_right_closed(spark, p, expected):
    df = spark.createDataFrame([(p,)], "precipitation DOUBLE")
    assert df.select(bins.precip_intensity()).first()[0] == expected


@pytest.mark.parametrize("w,expected", [(0.0, 0), (20.0, 0), (20.5, 1), (40.0, 1), (40.1, 2),
                                        (60.0, 2), (60.1, 3), (500.0, 3)])
def test_wind_bins_right_closed(spark, w, expected):
    df = spark.createDataFrame([(w,)], "windspeed_10m DOUBLE")
    assert df.select(bins.wind_category()).first()[0] == expected


def test_calendar_monday_zero(spark):
    # 2024-01-01 is a Monday, 2024-01-06 a Saturday
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 8),), (dt.datetime(2024, 1, 6, 12),)],
                               "date TIMESTAMP_NTZ")
    out = df.select(*[e.alias(n) for n, e in cal.temporal_columns().items()],
                    cal.day_name("date").alias("dn"), cal.long_date("date").alias("ld"),
                    cal.compact_date("date").alias("cd")).collect()
    assert (out[0]["day_of_week"], out[0]["is_weekend"], out[0]["is_rush_hour"]) == (0, 0, 1)
    assert (out[1]["day_of_week"], out[1]["is_weekend"], out[1]["is_rush_hour"]) == (5, 1, 0)
    assert out[0]["dn"] == "Monday" and out[0]["ld"] == "January 01, 2024"
    assert out[0]["cd"] == "20240101"


def test_risk_label_clamps_level(spark):
    df = spark.createDataFrame([(0,), (3,), (4,), (5,)], "level INT")
    got = [r[0] for r in df.select(labels.risk_label("level")).collect()]
    assert got == ["None", "High", "Critical", "Critical"]


def test_decision(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (4, 2), (2, 2)], "m INT, r INT")
    out = df.select(labels.final_level("m", "r").alias("f"),
                    labels.decision_source("m", "r").alias("s")).collect()
    assert [(r["f"], r["s"]) for r in out] == [(0, "none"), (3, "rules"), (4, "model"), (2, "model")]


def test_pad_probabilities(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.1, 0.2, 0.3, 0.1, 0.2, 0.1],)], "p ARRAY<DOUBLE>")
    got = [r[0] for r in df.select(labels.pad_probabilities("p", 5)).collect()]
    assert got == [[0.5, 0.5, 0.0, 0.0, 0.0], [0.1, 0.2, 0.3, 0.1, 0.2]]


def test_correlation_label(spark):
    df = spark.createDataFrame([(0.1,), (-0.3,), (0.5,), (0.9,), (-0.8,)], "r DOUBLE")
    got = [r[0] for r in df.select(labels.correlation_label("r")).collect()]
    assert got == ["No correlation", "Weak correlation", "Moderate correlation",
                   "Strong correlation", "Strong negative correlation"]


def test_alerts(spark):
    df = spark.createDataFrame([(120.0, 40.0, 41.0, 85.0), (10.0, 0.0, 30.0, 50.0),
                                (70.0, 20.0, 36.0, 50.0)],
                               "max_wind DOUBLE, total_precip DOUBLE, max_temp DOUBLE, avg_humidity DOUBLE")
    got = [r[0] for r in df.select(labels.weather_alerts()).collect()]
    assert got[0] == ["HIGH WIND", "HEAVY RAINFALL", "EXTREME HEAT", "HIGH HUMIDITY"]
    assert got[1] == ["FAVORABLE CONDITIONS"]
    assert got[2] == ["MODERATE WIND", "MODERATE RAINFALL", "HIGH TEMPERATURE"]


def test_day_range_is_pushed_as_range(spark, tmp_path):
    from stormcell.operators import filters
    from stormcell.sources import csv_source
    from tests.conftest import obs_frame
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    obs = obs_frame(spark, [("A", "2024-01-05 03", 50.0, 25.0, 1.0, 27.0, 10.0, 0)])
    path = str(tmp_path / "landed")
    csv_source.land_obs_parquet(obs, path)
    df = filters.range_city_filter(csv_source.read_obs_parquet(spark, path),
                                   "2024-01-05", "2024-01-05", ["A"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(date" in pushed and "LessThan(date" in pushed
    assert "In(city" in pushed or "EqualTo(city" in pushed
    assert df.select(F.count(F.lit(1))).first()[0] == 1


def test_every_pair_sentence_is_reachable(spark):
    from stormcell.queries import q_corr_label
    from tests.conftest import SF001
    got = {(r["var1"], r["var2"]): r["sentence"] for r in q_corr_label(spark, SF001).collect()}
    for a, b, text in labels.PAIR_SENTENCES:
        assert got[(a, b)] == text and got[(b, a)] == text
    assert sum(v == labels.NO_PATTERN for v in got.values()) == 20 - 12


def test_null_levels(spark):
    from pyspark.sql import functions as F

    from stormcell.functions import labels
    rows = [(None, 0), (None, 2), (None, None), (1, None), (1, 3), (3, 1), (0, 0), (5, 0)]
    got = spark.createDataFrame(rows, "m INT, r INT").select(
        labels.risk_label("m").alias("risk"), labels.decision_source(F.col("m"), F.col("r")).alias("src"),
        labels.final_level("m", "r").alias("lvl")).collect()
    assert [tuple(r) for r in got] == [
        (None, "none", 0), (None, "rules", 2), (None, "none", None), ("Low", "model", 1),
        ("Low", "rules", 3), ("High", "model", 3), ("None", "none", 0), ("Critical", "model", 5)]
