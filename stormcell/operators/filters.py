"""Row selection: point and range filters, mode routing, first-N sample."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..schema import WEATHER_COLS


def city_day_slice(obs: DataFrame, day, city: str) -> DataFrame:
    """Hourly rows of one city on one calendar day, in time order."""
    return (obs.filter(cal.day_range("date", day, day) & (F.col("city") == city))
            .orderBy("date"))


def range_city_filter(obs: DataFrame, start, end, cities=None) -> DataFrame:
    """Calendar dates in [start, end] (both inclusive); city filter only when
    the list is non-empty.  Both predicates reach the parquet scan."""
    cond = cal.day_range("date", start, end)
    if cities:
        cond = cond & F.col("city").isin(list(cities))
    return obs.filter(cond)


def data_bounds(obs: DataFrame) -> tuple[dt.date, dt.date]:
    row = obs.agg(F.min(F.to_date("date")).alias("lo"),
                  F.max(F.to_date("date")).alias("hi")).first()
    return row["lo"], row["hi"]


def route_mode(requests: DataFrame, bounds: tuple, date_col: str = "request_date") -> DataFrame:
    """'historical' when the requested day lies within the data's first and last
    day (inclusive), else 'forecast' -- days before the start included."""
    lo, hi = bounds
    d = F.col(date_col)
    return requests.withColumn(
        "mode", F.when(d.between(F.lit(lo), F.lit(hi)), F.lit("historical"))
        .otherwise(F.lit("forecast")))


def request_bounds(requests: DataFrame, earliest, today, horizon_days: int = 7,
                   date_col: str = "request_date") -> DataFrame:
    """Only days a user may pick: from ``earliest`` to today + horizon."""
    last = today + dt.timedelta(days=horizon_days)
    return requests.filter(F.col(date_col).between(F.lit(earliest), F.lit(last)))


def sample_pair(obs: DataFrame, var1: str, var2: str, n: int = 1000) -> DataFrame:
    """First ``n`` rows (by time, then city) of two different variables."""
    if var1 == var2:
        raise ValueError("choose two different variables")
    for v in (var1, var2):
        if v not in WEATHER_COLS:
            raise ValueError(f"unknown variable {v!r}")
    return obs.select("date", "city", var1, var2).orderBy("date", "city").limit(n)
