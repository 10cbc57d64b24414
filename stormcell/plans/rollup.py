"""Range and city analytics from stored partial aggregates.

A row per (city, day) holds what every historical question needs and can be added
up: counts, sums and extremes per variable, sums of squares and products of each
pair (over the rows where both are there), counts per level, sums per hour.  A
second table has a bitmap of days per (city, level).  KPIs, ranking, trend, pivot,
extremes, correlations and distinct days of any range and any city set are then sums
over at most one row per city-day; the hourly rows are not read again.

Sums of products are kept about an origin near the data's mean (``ORIGIN``), which
keeps correlations from cancelling; it is a constant, so that rows of different runs
can be added.
"""

from __future__ import annotations

import os
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.aggregates import CORR_VARS
from ..operators.ordering import rank
from ..schema import WEATHER_COLS
from ..sources import publish

#: A middle value of each variable, exact in binary.
ORIGIN = {"relativehumidity_2m": 64.0, "temperature_2m": 28.0, "precipitation": 0.0,
          "apparent_temperature": 32.0, "windspeed_10m": 16.0}
PAIRS = list(combinations(CORR_VARS, 2))
DAYS, BITMAPS = "city_days", "level_days"


def _centred(c: str) -> Column:
    return F.col(c) - ORIGIN[c]


def _additive(obs_columns: list[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n"),
           F.count("suspension").alias("n_level"), F.sum("suspension").cast("long").alias("s_level"),
           F.count_if(F.col("suspension") > 0).alias("n_suspended")]
    for c in obs_columns:
        out += [F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"),
                F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    for a, b in PAIRS:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, _centred(a)), F.when(both, _centred(b))
        for name, value in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y)):
            out.append(F.sum(value).alias(f"{name}_{a}_{b}"))
        out.append(F.count_if(both).alias(f"n_{a}_{b}"))
    hour = cal.hour("date")
    for c in obs_columns:
        out.append(F.array(*[F.struct(
            F.count(F.when(hour == h, F.col(c))).alias("n"), F.sum(F.when(hour == h, F.col(c))).alias("s"))
            for h in range(24)]).alias(f"hours_{c}"))
    return out


def partials(obs: DataFrame) -> DataFrame:
    """A row per (city, day); one aggregate over the hourly rows."""
    return obs.groupBy("city", cal.calendar_day("date").alias("day")).agg(*_additive(WEATHER_COLS))


def level_bitmaps(obs: DataFrame) -> DataFrame:
    """(city, level, bucket, days): bitmaps of the days (numbered from 1970-01-01) on
    which a city had a level; a bucket has 32,768 days."""
    number = F.datediff(cal.calendar_day("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (obs.where(F.col("suspension").isNotNull() & F.col("date").isNotNull())
            .groupBy("city", F.col("suspension").alias("level"), F.bitmap_bucket_number(number).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("days")))


def store(obs: DataFrame, path: str) -> None:
    """Publish both tables; of the partials only the days that changed are written."""
    publish.publish(partials(obs).where("day IS NOT NULL"), os.path.join(path, DAYS))
    level_bitmaps(obs).write.mode("overwrite").parquet(os.path.join(path, BITMAPS))


class Rollup:
    """The stored partials of a range of days (both included) and a set of cities."""

    def __init__(self, spark: SparkSession, path: str, start=None, end=None, cities=None):
        self.rows = publish.read(spark, os.path.join(path, DAYS), start, end)
        self.bitmaps = spark.read.parquet(os.path.join(path, BITMAPS))
        if cities is not None:
            self.rows = self.rows.where(F.col("city").isin(list(cities)))
            self.bitmaps = self.bitmaps.where(F.col("city").isin(list(cities)))

    def kpis(self) -> DataFrame:
        n = F.sum("n")
        return self.rows.agg(
            F.coalesce(n, F.lit(0)).alias("total_records"),
            (F.sum("n_suspended") / n * 100).alias("suspension_rate_pct"),
            self._mean("precipitation").alias("avg_precipitation"),
            self._mean("temperature_2m").alias("avg_temperature"))

    @staticmethod
    def _mean(c: str) -> Column:
        return F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}"))

    def city_ranking(self) -> DataFrame:
        found = self.rows.where("city IS NOT NULL").groupBy("city").agg(
            F.try_divide(F.sum("s_level"), F.sum("n_level")).alias("mean_level"),
            F.sum("n_level").alias("n_records"))
        ranked = rank(found, [F.desc_nulls_last("mean_level"), F.asc("city")])
        return ranked.withColumn("rank", F.col("rank").cast("int"))

    def daily_trend(self) -> DataFrame:
        return self.rows.groupBy("day").agg(
            F.try_divide(F.sum("s_level"), F.sum("n_level")).alias("avg_suspension"))

    def hour_weekday(self, variable: str = "temperature_2m") -> DataFrame:
        if variable not in WEATHER_COLS:
            raise ValueError(f"unknown variable {variable!r}")
        hours = self.rows.select("day", F.posexplode(f"hours_{variable}").alias("hour", "h"))
        return (hours.groupBy(cal.day_of_week("day").alias("weekday"), cal.day_name("day").alias("day_name"),
                              "hour")
                .agg(F.try_divide(F.sum("h.s"), F.sum("h.n")).alias("mean_value"))
                .where("mean_value IS NOT NULL"))

    def day_extremes(self) -> DataFrame:
        mean = {c: F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}")) for c in WEATHER_COLS}
        return self.rows.select(
            "city", "day", F.col("lo_temperature_2m").alias("min_temp"),
            F.col("hi_temperature_2m").alias("max_temp"), mean["temperature_2m"].alias("avg_temp"),
            F.col("hi_windspeed_10m").alias("max_wind"), mean["windspeed_10m"].alias("avg_wind"),
            F.coalesce("s_precipitation", F.lit(0.0)).alias("total_precip"),
            F.col("hi_precipitation").alias("max_precip_hour"),
            mean["relativehumidity_2m"].alias("avg_humidity"))

    def correlations(self) -> DataFrame:
        """Pearson r of every ordered pair, over the rows where both are there."""
        sums = self.rows.agg(*[F.sum(f"{k}_{a}_{b}").alias(f"{k}_{a}_{b}")
                               for a, b in PAIRS for k in ("n", "x", "y", "xx", "yy", "xy")])
        entries = [F.struct(F.lit(a).alias("var_x"), F.lit(a).alias("var_y"), F.lit(1.0).alias("r"))
                   for a in CORR_VARS]
        for a, b in PAIRS:
            n, x, y, xx, yy, xy = (F.col(f"{k}_{a}_{b}") for k in ("n", "x", "y", "xx", "yy", "xy"))
            r = F.try_divide(n * xy - x * y, F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y))
            for p, q in ((a, b), (b, a)):
                entries.append(F.struct(F.lit(p).alias("var_x"), F.lit(q).alias("var_y"), r.alias("r")))
        return sums.select(F.inline(F.array(*entries)))

    def days_per_level(self, start=None, end=None) -> DataFrame:
        """Distinct days per level over the cities, levels < 5: bitmaps are united, so
        a day on which several cities had a level counts once.  A range is cut out of
        the united bitmaps, which are as many as levels and buckets."""
        united = (self.bitmaps.where("level < 5").groupBy("level", "bucket")
                  .agg(F.bitmap_or_agg("days").alias("days")))
        if start is None and end is None:
            return united.groupBy("level").agg(F.sum(F.bitmap_count("days")).alias("days"))
        lo, hi = (F.datediff(F.lit(str(d)).cast("date"), F.lit("1970-01-01").cast("date"))
                  if d is not None else None for d in (start, end))
        # the days of a bitmap: its bytes, and the bits of each
        bits = (united.select("level", "bucket", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.octet_length("days")),
            lambda i: F.conv(F.hex(F.substring(F.col("days"), i, F.lit(1))), 16, 10).cast("int")))
            .alias("byte", "b")).where("b <> 0")
            .select("level", "bucket", "byte", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
            .where(F.expr("shiftright(b, bit) & 1 = 1")))
        # bucket and position count from the number 1
        number = (F.col("bucket") - 1) * 32768 + F.col("byte") * 8 + F.col("bit") + 1
        for bound, keep in ((lo, lambda: number >= lo), (hi, lambda: number <= hi)):
            if bound is not None:
                bits = bits.where(keep())
        return bits.groupBy("level").agg(F.count(F.lit(1)).alias("days"))
