"""Aggregate semantics: empty sums, mode ties, pivots, box statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormcell.operators import aggregates as agg
from stormcell.operators import impute
from tests.conftest import obs_frame


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [
        ("A", "2024-01-01 00", 60.0, 25.0, None, 27.0, 10.0, 1),
        ("A", "2024-01-01 01", 70.0, 27.0, None, 29.0, 20.0, 2),
        ("A", "2024-01-01 02", None, 26.0, None, 28.0, 30.0, 2),
        ("A", "2024-01-01 03", 80.0, 24.0, None, 26.0, 40.0, 1),
        ("B", "2024-01-02 10", 50.0, 30.0, 5.0, 32.0, 5.0, 5),
        ("B", "2024-01-02 11", 55.0, 31.0, 7.0, 33.0, 6.0, 0),
    ]
    return obs_frame(spark, rows)


def test_city_day_summary_empty_rain_sum_is_zero(tiny):
    got = {r["city"]: r for r in agg.city_day_summary(tiny).collect()}
    assert got["A"]["precipitation"] == 0.0 and got["B"]["precipitation"] == 12.0
    assert got["A"]["relativehumidity_2m"] == 70.0 and got["A"]["n_hours"] == 4


def test_mode_ties_to_smallest(tiny):
    got = {r["city"]: r["level"] for r in agg.day_level_mode(tiny).collect()}
    assert got == {"A": 1, "B": 0}


def test_level_thresholds_one_pass(tiny):
    got = {r["level"]: r for r in agg.level_thresholds(tiny).collect()}
    assert set(got) == {0, 1, 2, 5} and got[2]["count"] == 2
    assert got[2]["windspeed_max"] == 30.0


def test_kpis_and_distinct_days(tiny):
    k = agg.range_kpis(tiny).first()
    assert k["total_records"] == 6 and k["suspension_rate_pct"] == pytest.approx(500 / 6)
    days = {r["level"]: r["days"] for r in agg.days_per_level(tiny).collect()}
    assert days == {0: 1, 1: 1, 2: 1}  # level 5 excluded


def test_ranking_and_pivot(tiny):
    rank = [(r["city"], r["rank"]) for r in agg.city_ranking(tiny).orderBy("rank").collect()]
    assert rank == [("B", 1), ("A", 2)]
    wide = agg.hour_weekday_pivot(tiny, "temperature_2m").collect()
    assert [r["day_name"] for r in wide] == ["Monday", "Tuesday"]
    assert wide[0]["0"] == 25.0 and wide[1]["10"] == 30.0 and wide[0]["10"] is None
    assert set(wide[0].asDict()) == {"weekday", "day_name", "0", "1", "2", "3", "10", "11"}
    full = agg.hour_weekday_pivot(tiny, "temperature_2m", drop_empty=False)
    assert len(full.columns) == 26


def test_box_stats_linear_quartiles(spark):
    vals = [1.0, 2.0, 4.0, 7.0, 11.0, 100.0]
    rows = [("A", f"2024-01-01 {i:02d}", 50.0, 20.0, v, 22.0, 1.0, 3) for i, v in enumerate(vals)]
    got = {r["variable"]: r for r in agg.box_stats(obs_frame(spark, rows)).collect()}
    p = got["precipitation"]
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert (p["q1"], p["median"], p["q3"]) == (q1, med, q3)
    assert p["n_outliers"] == 1 and p["whisker_high"] == 11.0 and p["whisker_low"] == 1.0


def test_corr_matrix_pairwise_complete(tiny):
    m = {(r["var_x"], r["var_y"]): r["r"] for r in agg.corr_matrix(tiny).collect()}
    assert len(m) == 25
    assert m[("temperature_2m", "apparent_temperature")] == pytest.approx(1.0)
    assert m[("precipitation", "temperature_2m")] == m[("temperature_2m", "precipitation")]


def test_medians_and_imputation(tiny):
    med = impute.fit_medians(tiny)
    assert med["relativehumidity_2m"] == 60.0
    filled = impute.impute(tiny, med)
    assert filled.filter(F.col("precipitation").isNull()).count() == 0
    assert filled.filter(F.col("relativehumidity_2m").isNull()).count() == 0


def test_profile(tiny):
    r = agg.dataset_profile(tiny).first()
    assert r["n_rows"] == 6 and r["n_cities"] == 2 and r["cities"] == "A,B"


def test_box_stats_approx_close_to_exact(spark):
    from stormcell.sources.fixture import load_obs
    from tests.conftest import SF001
    obs = load_obs(spark, SF001)
    exact = {(r["level"], r["variable"]): r for r in agg.box_stats(obs).collect()}
    approx = {(r["level"], r["variable"]): r for r in agg.box_stats(obs, approx_accuracy=10_000).collect()}
    assert set(exact) == set(approx)
    for k, e in exact.items():
        a = approx[k]
        assert (a["n"], a["min"], a["max"]) == (e["n"], e["min"], e["max"])
        assert a["n_outliers"] >= 0 and a["whisker_low"] >= e["min"]
    # brute force: with this accuracy the sketch's median is one of the two
    # order statistics the exact (interpolated) median lies between
    from stormcell.operators.aggregates import BOX_VARS
    vals = {}
    for r in obs.select("suspension", *BOX_VARS).collect():
        for v in BOX_VARS:
            if r[v] is not None and r["suspension"] is not None:
                vals.setdefault((r["suspension"], v), []).append(r[v])
    for k, xs in vals.items():
        xs.sort()
        pos = (len(xs) - 1) * 0.5
        i = int(pos)
        below, above = xs[i], xs[min(len(xs) - 1, i + 1)]
        assert approx[k]["median"] in (below, above)
        assert exact[k]["median"] == ((below + above) / 2 if pos % 1 else below)
