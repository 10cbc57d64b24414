"""Rule boundaries, hand-computed from the band and threshold tables."""

import pytest
from pyspark.sql import functions as F

from stormcell.operators import rules

WIND = [  # wind, signal, level
    (29.9, None, 0), (30.0, 1, 1), (45.0, 1, 1), (60.0, 1, 1), (60.1, 2, 2),
    (100.0, 2, 2), (100.5, 3, 3), (150.0, 3, 3), (150.1, 4, 4), (300.0, 4, 4),
    (301.0, None, 0), (None, None, 0),
]
RAIN = [(7.4, 0, 0), (7.5, 1, 1), (14.9, 1, 1), (15.0, 3, 2), (29.9, 3, 2), (30.0, 4, 3),
        (None, 0, None)]
HEAT = [(40.9, 0, 0), (41.0, 3, 1), (50.9, 3, 1), (51.0, 4, 2)]


@pytest.mark.parametrize("wind,signal,level", WIND)
def test_wind_band(spark, wind, signal, level):
    df = spark.createDataFrame([(wind,)], "w DOUBLE")
    r = df.select(rules.wind_signal("w").alias("s"), rules.wind_level("w").alias("l")).first()
    assert r["s"] == signal and r["l"] == level


@pytest.mark.parametrize("precip,level,matches", RAIN)
def test_rain(spark, precip, level, matches):
    df = spark.createDataFrame([(precip,)], "p DOUBLE")
    r = df.select(rules.rain_level("p").alias("l"), rules.rain_matches("p").alias("m")).first()
    assert r["l"] == level and r["m"] == matches


@pytest.mark.parametrize("apparent,level,matches", HEAT)
def test_heat(spark, apparent, level, matches):
    df = spark.createDataFrame([(apparent,)], "a DOUBLE")
    r = df.select(rules.heat_level("a").alias("l"), rules.heat_matches("a").alias("m")).first()
    assert r["l"] == level and r["m"] == matches


def test_rule_level_and_reasons_order(spark):
    df = spark.createDataFrame([(65.0, 31.0, 52.0), (10.0, 0.0, 30.0), (None, None, None)],
                               "windspeed_10m DOUBLE, precipitation DOUBLE, apparent_temperature DOUBLE")
    out = rules.apply_rules(df).collect()
    assert out[0]["rule_level"] == 4
    reasons = out[0]["rule_reasons"]
    assert reasons[0].startswith("TCWS 2")
    assert [r.split(":")[0] for r in reasons[1:]] == [
        "Light Rainfall Warning", "Moderate Rainfall Warning", "Heavy Rainfall Warning",
        "Heat Index 41°C", "Heat Index 51°C"]
    assert out[1]["rule_level"] == 0 and out[1]["rule_reasons"] == []
    assert out[2]["rule_level"] == 0 and out[2]["rule_reasons"] == []


def test_rules_compile_to_expressions(spark):
    """No join and no shuffle: the rule tables are evaluated inline."""
    df = spark.range(10).select(F.col("id").cast("double").alias("windspeed_10m"),
                                F.lit(1.0).alias("precipitation"),
                                F.lit(30.0).alias("apparent_temperature"))
    plan = rules.apply_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_open_top_band_flag(spark):
    df = spark.createDataFrame([(301.0,), (300.0,)], "w DOUBLE")
    got = df.select(rules.wind_level("w").alias("p"), rules.wind_level("w", open_top=True).alias("o")).collect()
    assert (got[0]["p"], got[0]["o"]) == (0, 4) and (got[1]["p"], got[1]["o"]) == (4, 4)
