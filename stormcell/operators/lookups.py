"""Equi lookups against dimensions (J1, J2, J5) and a size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

# Largest side we are willing to ship to every executor.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 128 << 20


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      materialize: bool = False) -> DataFrame:
    """Broadcast hint only when the side is proven small.

    The check counts the rows and the bytes of their text (a partial aggregate
    per task); a larger side is returned unchanged and the join falls back to a
    shuffle join chosen by Catalyst / AQE.  With ``materialize`` the side is first
    written to the shared checkpoint folder, so a side that is expensive to
    derive (it scans the big table) is computed once, not once for the check
    and again for the join.
    """
    if materialize:
        df = checkpoint(df)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(
        F.struct("*")))), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= max_rows and size["bytes"] <= BROADCAST_MAX_BYTES
    return F.broadcast(df) if small else df


def enrich_city(requests: DataFrame, cities: DataFrame, city_col: str = "city") -> DataFrame:
    """city -> lat/lon; unknown cities keep null coordinates and ``known = false``."""
    dim = cities.select(F.col("city").alias(city_col), "lat", "lon",
                        F.lit(True).alias("_known"))
    return (requests.join(broadcast_checked(dim), city_col, "left")
            .withColumn("known", F.coalesce(F.col("_known"), F.lit(False)))
            .drop("_known"))


def unknown_cities(requests: DataFrame, cities: DataFrame, city_col: str = "city") -> DataFrame:
    """The reject output of ``enrich_city``: requests whose city is null or has no
    row in the dimension, with the reason."""
    dim = cities.select(F.col("city").alias(city_col)).distinct()
    return (requests.join(broadcast_checked(dim), city_col, "left_anti")
            .withColumn("reason", F.when(F.col(city_col).isNull(), "no city").otherwise("unknown city")))


def enrich_level(df: DataFrame, levels: DataFrame, level_col: str = "level") -> DataFrame:
    """level -> name/color/risk.  Level 5 has no row: it is kept as 'Unmapped'."""
    dim = levels.select(F.col("level").alias(level_col), "level_name", "color", "risk")
    return (df.join(broadcast_checked(dim), level_col, "left")
            .withColumn("level_name", F.coalesce(F.col("level_name"), F.lit("Unmapped")))
            .withColumn("risk", F.coalesce(F.col("risk"), F.lit("Unmapped"))))


def suspension_map(city_days: DataFrame, cities: DataFrame, levels: DataFrame,
                   level_col: str = "level") -> DataFrame:
    """One row per (city, day) with coordinates and level colour/name.

    A city without coordinates keeps its row with nulls, and level 5 is kept as
    'Unmapped': no city-day is lost.
    """
    with_city = city_days.join(broadcast_checked(cities.select("city", "lat", "lon")),
                               "city", "left")
    return enrich_level(with_city, levels, level_col)
