"""Rules from a table: today's table gives today's rows, a changed one others."""

import datetime as dt
import random

import pytest

from stormcell.operators import band_rules, rules

EDGES = [None, 0.0, 7.4999, 7.5, 15.0, 29.999, 30.0, 41.0, 51.0, 60.0, 60.5, 100.0, 150.0, 300.0, 300.1,
         1e9, -5.0, -1e9]


def days(spark, n=400):
    r = random.Random(3)
    rows = [(i, dt.date(2024, 1, 1 + i % 28), r.choice(EDGES), r.choice(EDGES), r.choice(EDGES)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, day date, windspeed_10m double, precipitation double,"
                                       " apparent_temperature double")


def answers(df):
    return {r["id"]: (r["rule_level"], r["rule_reasons"]) for r in df.collect()}


def test_standard_bands_equal_the_compiled_rules(spark):
    df = days(spark)
    assert answers(band_rules.apply_bands(df, band_rules.standard_bands(spark))) == answers(rules.apply_rules(df))


def test_changed_band_and_validity(spark):
    bands = [tuple(r) for r in band_rules.standard_bands(spark).collect()]
    change = dt.date(2024, 1, 15)
    old = ("rain", 0, 7.5, None, 1, "old", False, None, change)
    new = ("rain", 0, 5.0, None, 2, "new", False, change, None)
    table = spark.createDataFrame([b for b in bands if b[:2] != ("rain", 0)] + [old, new], band_rules.BANDS)
    df = spark.createDataFrame(
        [(1, dt.date(2024, 1, 14), 6.0), (2, change, 6.0), (3, dt.date(2024, 1, 14), 8.0), (4, change, 8.0),
         (5, change, 20.0), (6, None, 8.0)],
        "id int, day date, precipitation double").selectExpr(
        "*", "CAST(NULL AS DOUBLE) AS windspeed_10m", "0.0D AS apparent_temperature")
    got = answers(band_rules.apply_bands(df, table))
    assert got[1] == (0, []) and got[2] == (2, ["new"]) and got[3] == (1, ["old"]) and got[4] == (2, ["new"])
    assert got[5][0] == 3 and got[5][1][0] == "new"
    assert got[6] == (0, [])  # without a day no dated band holds


@pytest.mark.parametrize("shuffled", [False, True])
def test_many_bands_match_brute_force_without_nested_loop(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(band_rules, "broadcast_checked", lambda df, **_: df)
    r = random.Random(5)
    bands = []
    for i in range(600):
        low = r.choice([None, r.uniform(-50, 500)])
        high = r.choice([None, (low or 0) + r.uniform(-1, 40)])
        bands.append((r.choice(band_rules.RULES), i, low, high, r.randrange(6), f"b{i}", False, None,
                      r.choice([None, dt.date(2024, 1, 10)])))
    bands += [("wind", 1000 + i, 10.0 * i, 10.0 * i + 20, i % 5, f"f{i}", True, None, None) for i in range(40)]
    df = days(spark, 120)
    out = band_rules.apply_bands(df, spark.createDataFrame(bands, band_rules.BANDS))
    want = {}
    for row in df.collect():
        hits = []
        for rule, x in zip(band_rules.RULES, row[2:], strict=True):
            mine = [b for b in bands if b[0] == rule and x is not None and (b[2] is None or x >= b[2])
                    and (b[3] is None or x <= b[3]) and (b[8] is None or row["day"] < b[8])]
            hits += [b for b in mine if b[6]][:1] + [b for b in mine if not b[6]]
        want[row["id"]] = (max([0, *(b[4] for b in hits)]), [b[5] for b in hits])
    assert answers(out) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_table_and_unknown_rule(spark):
    df = days(spark, 5)
    empty = spark.createDataFrame([], band_rules.BANDS)
    assert set(r for r, _ in answers(band_rules.apply_bands(df, empty)).values()) == {0}
    with pytest.raises(ValueError):
        band_rules.apply_bands(df, spark.createDataFrame(
            [("snow", 0, 1.0, None, 1, "x", False, None, None)], band_rules.BANDS))
