"""The hourly table bucketed and sorted by series, so that windows over a series and
aggregates of its days read it without an exchange.

Rows are clustered by (city, block).  The block is null for an ordinary series, which
then lies whole in one bucket.  A series longer than ``max_series_rows`` is split into
calendar blocks that lie in buckets of their own, each with copies of the rows before it
that its windows reach back to (``operators.windows.halo_layout``): a city that holds a
third of all rows is spread over many buckets, and its windows are exact.

The files are an ordinary external table.  A session that does not know it yet declares
it again over the same files; the number of buckets is kept beside them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.lookups import broadcast_checked
from ..operators.windows import (_BLK, _HALO, halo_layout, hot_series, peak_columns,
                                 rolling_lag_columns)
from ..schema import LAGS, ROLL_WINDOWS
from ..session import checkpoint, land_once

BUCKET_ROWS = 500_000   # rows aimed at in a bucket
MAX_BUCKETS = 20_000


def laid_out(obs: DataFrame, max_series_rows: int = 2_000_000, block_unit: str = "week") -> DataFrame:
    """``obs`` with the block column, and the copied rows of hot series."""
    hot = checkpoint(hot_series(obs, "city", max_series_rows))
    if hot.limit(1).count() == 0:
        return obs.withColumns({_BLK: F.lit(None).cast("date"), _HALO: F.lit(False)})
    tagged = (obs.join(broadcast_checked(hot), "city", "left")
              .withColumn("_hot", F.coalesce(F.col("_hot"), F.lit(False))))
    halo = max(max(ROLL_WINDOWS) - 1, max(LAGS))
    return halo_layout(tagged, ["city"], "date", halo, block_unit, hot_col="_hot").drop("_hot")


def write(obs: DataFrame, path: str, buckets: int | None = None, **layout) -> None:
    """Write the files under ``path``: one per bucket, sorted by (city, block, date)."""
    spark = obs.sparkSession
    rows = checkpoint(laid_out(obs, **layout))
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(8, -(-rows.count() // BUCKET_ROWS)))
    name = table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (rows.repartition(buckets, "city", _BLK).write.mode("overwrite").option("path", os.path.join(path, "rows"))
     .bucketBy(buckets, "city", _BLK).sortBy("city", _BLK, "date").format("parquet").saveAsTable(name))
    (spark.createDataFrame([(buckets,)], "buckets int").coalesce(1)
     .write.mode("overwrite").parquet(os.path.join(path, "layout")))


def table_name(path: str) -> str:
    return "series_" + hashlib.md5(path.encode()).hexdigest()[:16]


def declare(spark: SparkSession, path: str) -> str:
    """The table over the files under ``path``, declared if this session lacks it."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        found = spark.read.parquet(os.path.join(path, "layout")).first()
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in
                         spark.read.parquet(os.path.join(path, "rows")).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet "
                  f"CLUSTERED BY (city, {_BLK}) SORTED BY (city, {_BLK}, date) INTO {found['buckets']} BUCKETS "
                  f"LOCATION '{os.path.join(path, 'rows')}'")
    return name


def land(spark: SparkSession, path: str, obs: Callable[[], DataFrame], **layout) -> str:
    """Name of the table over the copy at ``path``, written once per state of its source."""
    land_once(spark, path, lambda p: write(obs(), p, **layout), marker=os.path.join("layout", "_SUCCESS"))
    return declare(spark, path)


def series_features(spark: SparkSession, name: str, temp_fill=None) -> DataFrame:
    """W1 - W3 of the table: its buckets are the windows' partitions."""
    w = Window.partitionBy("city", _BLK).orderBy("date")
    return (spark.table(name).withColumns(rolling_lag_columns(w, temp_fill=temp_fill))
            .where(f"NOT {_HALO}").drop(_BLK, _HALO).withColumns(peak_columns()))


def city_days(spark: SparkSession, name: str) -> DataFrame:
    """A row per (city, day).  A day lies in one block, so it is in one bucket."""
    return (spark.table(name).where(f"NOT {_HALO}")
            .groupBy("city", _BLK, cal.calendar_day("date").alias("day")).agg(
                F.count(F.lit(1)).alias("n_hours"), F.min("date").alias("first_ts"),
                F.avg("temperature_2m").alias("temperature_2m"),
                F.sum("precipitation").alias("precipitation"),
                F.max("windspeed_10m").alias("windspeed_10m")).drop(_BLK))
