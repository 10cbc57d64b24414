"""Adapter from the driver's generated tables to ``weather_obs``.

The generated data has no weather, so hourly readings are derived from
``events``: a site is ``user_id % n_sites``, the hour is the event's wall-clock
hour, and each weather variable is the largest reading of one event type in
that (site, hour).  ``n_sites = max(17, ceil(users / 9))``: 17 sites (the
reference's city count) on the small data sets, and more sites as the user
base grows, so the hourly table keeps growing with the data instead of
filling a fixed 17 x hours grid.  Site k takes the name of nation k % 25,
suffixed with ``#(k div 25)`` beyond the first 25.

Readings are kept as integers until the last step and then divided by 1024, a
power of two: every value is then a dyadic rational, sums of them are exact in
IEEE doubles, and means computed by Spark and by an SQL engine agree bit for
bit whatever the summation order.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_SITES = 17          # the reference's number of cities
USERS_PER_SITE = 9
NATIONS = 25            # names before the first suffix
UNIT = 1024.0  # readings are integers in units of 1/1024

# event type -> weather variable
_TYPE_OF = {
    "precipitation": "error",
    "windspeed_10m": "purchase",
    "temperature_2m": "view",
    "apparent_temperature": "click",
    "relativehumidity_2m": "signup",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _hour_ntz(ts: Column) -> Column:
    # time-zone independent truncation of a timestamp_ntz to its hour
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts),
                                F.hour(ts), F.lit(0), F.lit(0))


def site_count(events: DataFrame) -> int:
    """max(17, ceil(distinct users / 9)) -- a fitted scalar (one aggregate)."""
    users = events.agg(F.countDistinct("user_id")).first()[0] or 0
    return max(MIN_SITES, -(-users // USERS_PER_SITE))


def weather_obs_from_events(events: DataFrame, nation: DataFrame) -> DataFrame:
    n_sites = site_count(events)
    v = F.round(F.col("value") * 100).cast("bigint")
    ev = events.select(
        (F.col("user_id") % n_sites).alias("site_id"),
        _hour_ntz(F.col("ts")).alias("date"),
        F.col("event_type"),
        v.alias("v"),
    )

    def pick(var: str) -> Column:
        return F.max(F.when(F.col("event_type") == _TYPE_OF[var], F.col("v")))

    g = ev.groupBy("site_id", "date").agg(
        pick("precipitation").alias("p_v"),
        pick("windspeed_10m").alias("w_v"),
        pick("temperature_2m").alias("t_v"),
        pick("apparent_temperature").alias("a_v"),
        pick("relativehumidity_2m").alias("h_v"),
        F.max("v").alias("all_v"),
    )

    def scaled(c: Column) -> Column:
        return c.cast("double") / F.lit(UNIT)

    return _named(g, nation).select(
        "city",
        F.col("date"),
        F.when(F.col("h_v").isNull(), F.lit(None).cast("double"))
         .otherwise(scaled(F.least(F.lit(102400), F.lit(40960) + 2 * F.col("h_v"))))
         .alias("relativehumidity_2m"),
        scaled(F.lit(20480) + F.col("t_v")).alias("temperature_2m"),
        scaled(F.col("p_v")).alias("precipitation"),
        scaled(F.lit(22528) + F.col("a_v")).alias("apparent_temperature"),
        scaled(5 * F.col("w_v")).alias("windspeed_10m"),
        F.least(F.lit(5), F.expr("all_v div 6000")).cast("int").alias("suspension"),
    )


def _named(sites: DataFrame, nation: DataFrame) -> DataFrame:
    """``sites`` (site_id, ...) with the site's ``city``."""
    names = nation.select(F.col("n_nationkey").cast("bigint").alias("_nk"), "n_name")
    city = F.when(F.col("site_id") < NATIONS, F.col("n_name")).otherwise(F.concat(
        F.col("n_name"), F.lit("#"), F.expr(f"site_id div {NATIONS}").cast("string")))
    return (sites.join(names, F.col("site_id") % NATIONS == F.col("_nk"))
            .withColumn("city", city).drop("_nk", "n_name"))


def derive_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly table computed from ``events`` and ``nation``.

    Landed copies are reused across runs: bump ``session.LANDING_VERSION``
    whenever this derivation (or a landing layout) changes."""
    return weather_obs_from_events(read_table(spark, sf_dir, "events"),
                                   read_table(spark, sf_dir, "nation"))


def load_obs(spark: SparkSession, sf_dir: str, start=None, end=None,
             refresh: bool = False) -> DataFrame:
    """The hourly table as every query reads it: derived once per data folder,
    landed as parquet (year/month partitions, rows sorted by city and time so
    row-group statistics skip on date filters) in the shared folder, and read
    back with its schema -- the ingest-once, query-many shape.  ``start`` /
    ``end`` (days) prune the year/month partitions that cannot match;
    ``refresh`` lands the table again even when a copy exists."""
    from ..session import land_once, landed_path
    from .csv_source import land_obs_parquet, read_obs_parquet
    path = land_once(spark, landed_path(spark, "weather-obs", sf_dir),
                     lambda p: land_obs_parquet(derive_obs(spark, sf_dir), p), refresh)
    return read_obs_parquet(spark, path, start, end)


def city_dim_from_sites(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Stand-in coordinates (integer functions of the site) for every site the
    events give, and for every nation."""
    sites = nation.sparkSession.range(max(NATIONS, site_count(events))).select(
        F.col("id").alias("site_id"))
    k = F.col("site_id")
    return _named(sites, nation).select(
        "city",
        (F.lit(14.0) + (k % 1024).cast("double") / F.lit(64.0)).alias("lat"),
        (F.lit(120.5) + (k % 512).cast("double") / F.lit(32.0)).alias("lon"),
    )


# The same derivation as DuckDB SQL (a CTE named ``obs``), used by the oracle.
OBS_CTE = """
obs_n AS (
  SELECT greatest(17, (count(DISTINCT user_id) + 8) // 9) AS n_sites FROM events
),
obs_ev AS (
  SELECT user_id % (SELECT n_sites FROM obs_n) AS site_id,
         date_trunc('hour', ts) AS date,
         event_type,
         CAST(round(value * 100) AS BIGINT) AS v
  FROM events
),
obs_g AS (
  SELECT site_id, date,
         max(CASE WHEN event_type = 'error' THEN v END) AS p_v,
         max(CASE WHEN event_type = 'purchase' THEN v END) AS w_v,
         max(CASE WHEN event_type = 'view' THEN v END) AS t_v,
         max(CASE WHEN event_type = 'click' THEN v END) AS a_v,
         max(CASE WHEN event_type = 'signup' THEN v END) AS h_v,
         max(v) AS all_v
  FROM obs_ev GROUP BY site_id, date
),
obs AS (
  SELECT CASE WHEN g.site_id < 25 THEN n.n_name
              ELSE n.n_name || '#' || CAST(g.site_id // 25 AS VARCHAR) END AS city,
         g.date,
         CASE WHEN g.h_v IS NULL THEN NULL
              ELSE CAST(least(102400, 40960 + 2 * g.h_v) AS DOUBLE) / 1024.0 END
           AS relativehumidity_2m,
         CAST(20480 + g.t_v AS DOUBLE) / 1024.0 AS temperature_2m,
         CAST(g.p_v AS DOUBLE) / 1024.0 AS precipitation,
         CAST(22528 + g.a_v AS DOUBLE) / 1024.0 AS apparent_temperature,
         CAST(5 * g.w_v AS DOUBLE) / 1024.0 AS windspeed_10m,
         CAST(least(5, g.all_v // 6000) AS INTEGER) AS suspension
  FROM obs_g g JOIN nation n ON n.n_nationkey = g.site_id % 25
)"""

CITY_DIM_CTE = """
city_sites AS (
  SELECT unnest(range(greatest(25, (count(DISTINCT user_id) + 8) // 9))) AS k FROM events
),
city_dim AS (
  SELECT CASE WHEN k < 25 THEN n_name ELSE n_name || '#' || CAST(k // 25 AS VARCHAR) END AS city,
         14.0 + CAST(k % 1024 AS DOUBLE) / 64.0 AS lat,
         120.5 + CAST(k % 512 AS DOUBLE) / 32.0 AS lon
  FROM city_sites JOIN nation ON n_nationkey = k % 25
)"""
