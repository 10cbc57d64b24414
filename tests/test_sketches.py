"""Merged sketches against exact quantiles."""

import random

import pytest
from pyspark.sql import functions as F

from stormcell.operators import aggregates as agg
from stormcell.operators import sketches as sk
from stormcell.queries import q_scenario_grid, q_scenario_table
from stormcell.plans import serving
from tests.conftest import SF001, obs_frame


@pytest.fixture(scope="module")
def obs(spark):
    r = random.Random(9)
    rows = [(f"C{i % 7}", f"2024-01-{1 + i % 28:02d} {i % 24:02d}", r.uniform(0, 100), r.gauss(28, 4),
             r.expovariate(0.2) if r.random() < 0.4 else 0.0, None, r.choice([5.0, 10.0, 80.0]),
             r.choice([0, 0, 0, 1, 2, None])) for i in range(12_000)]
    return obs_frame(spark, rows).repartition(6).cache()


def test_rank_error_is_within_the_bound(spark, obs):
    stored = sk.day_sketches(obs)
    found = sk.quantiles(stored, ["level", "variable"])
    rows = sk.long_rows(obs).where("level IS NOT NULL")
    errors = sk.rank_errors(rows, found.where("level IS NOT NULL"), ["level", "variable"]).collect()
    assert len(errors) == 12 and max(r["error"] for r in errors) <= 1.5 * sk.rank_error()
    exact = {(r["level"], r["variable"]): r for r in agg.exact_quantiles(
        rows, ["level", "variable"], "value", sk.QUARTILES).collect()}
    for r in found.where("level IS NOT NULL").collect():
        e = exact[r["level"], r["variable"]]
        assert (r["n"], r["min"], r["max"]) == (e["n"], e["min"], e["max"])


def test_any_selection_can_be_merged(spark, obs):
    stored = sk.day_sketches(obs).where("city IN ('C1', 'C4') AND day BETWEEN '2024-01-05' AND '2024-01-11'")
    rows = sk.long_rows(obs).where("city IN ('C1', 'C4') AND day BETWEEN '2024-01-05' AND '2024-01-11'")
    errors = sk.rank_errors(rows, sk.quantiles(stored, ["variable"]), ["variable"]).collect()
    assert len(errors) == 4 and max(r["error"] for r in errors) <= 1.5 * sk.rank_error()
    assert {r["variable"] for r in sk.medians(stored).collect()} == set(agg.BOX_VARS)
    assert sk.box_stats(stored.where("false")).count() == 0


def _set(df):
    return sorted(map(repr, df.collect()))


def test_scenario_table_equals_the_literal_grid(spark):
    assert _set(q_scenario_table(spark, SF001)) == _set(q_scenario_grid(spark, SF001))


def test_plan_does_not_grow_with_the_sets(spark, obs):
    base = agg.city_day_summary(obs)

    def plan(n):
        sets = spark.range(n).select(
            F.col("id").cast("int").alias("scenario"), (F.col("id") % 7).cast("double").alias("d_temp"),
            F.lit(0.0).alias("d_precip"), F.lit(0.0).alias("d_wind"), F.lit(0.0).alias("d_humidity"),
            F.lit(8).alias("s_hour"), F.lit(0).alias("d_days"))
        out = serving.scenario_table(base, sets)
        return out, out._jdf.queryExecution().optimizedPlan().toString()

    few, small = plan(50)
    many, large = plan(100_000)
    assert len(large) < 1.2 * len(small) and "Cartesian" not in large
    assert few.count() == 50 * base.count()
    assert many.where("city = 'C1' AND day = DATE'2024-01-02'").count() == 100_000
