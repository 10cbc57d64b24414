"""Every registered query with an oracle matches DuckDB on the smallest data set;
the others run and return rows."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from stormcell.oracle import ORACLE
from stormcell.queries import QUERIES
from tests.conftest import SF001

SLOW = {"train_eval", "top_features", "split_importances", "score_city_days", "score_serving_days",
        "cv_accuracy", "artifacts_roundtrip", "request_answers", "scenario_scores",
        "model_bulletin"}
TABLES = ["events", "nation", "orders", "customer"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(ocols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs_without_oracle(spark, name):
    assert E.queries()[name](spark, SF001).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "final_level" in df.columns
