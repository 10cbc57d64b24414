"""Landed forecast documents: parallel hourly arrays -> one row per hour.

Fetching over HTTP is out of scope; documents are landed as JSON lines (one
per city and day) and read with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FORECAST_SCHEMA, WEATHER_COLS
from . import rejects

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"


def hourly_rows(docs: DataFrame) -> DataFrame:
    """``inline(arrays_zip(...))``: the i-th elements of the arrays form hour i."""
    h = "hourly"
    zipped = F.arrays_zip(F.col(f"{h}.time").alias("time"),
                          *[F.col(f"{h}.{c}").alias(c) for c in WEATHER_COLS])
    return (docs.select("city", F.inline(zipped))
            .select("city",
                    F.to_timestamp_ntz(F.col("time"), F.lit(TIME_FORMAT)).alias("date"),
                    *WEATHER_COLS))


def read_forecast_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORECAST_SCHEMA).json(path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    return hourly_rows(read_forecast_docs(spark, path))


_WHEN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"
_CORRUPT = "_corrupt"


def check_documents(lines: DataFrame) -> DataFrame:
    """(line, source, city, date, hourly, reason) of JSON lines, one document each.

    A document is rejected as a whole when it is no JSON object of the schema's
    types, has no city, lacks one of the hourly arrays, has arrays of different
    lengths, or a time that is null or no wall clock.  Missing readings inside the
    arrays are nulls.  Blank lines are no documents."""
    schema = T.StructType([*FORECAST_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    doc = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = lines.where(F.trim("line") != "").withColumn("_d", doc)
    arrays = FORECAST_SCHEMA["hourly"].dataType.names
    n = F.size("_d.hourly.time")
    reason = (F.when(F.col("_d").isNull() | F.col(f"_d.{_CORRUPT}").isNotNull(), "not JSON of the schema")
              .when(F.coalesce("_d.city", F.lit("")) == "", "no city"))
    for name in arrays:
        reason = reason.when(F.col(f"_d.hourly.{name}").isNull(), f"no {name}")
    for name in arrays:
        reason = reason.when(F.size(f"_d.hourly.{name}") != n, f"{name}: other length than time")
    reason = reason.when(F.exists("_d.hourly.time", lambda t: t.isNull() | ~t.rlike(_WHEN)
                                  | t.try_cast("timestamp_ntz").isNull()), "time: no time")
    return (rows.withColumn("reason", reason)
            .select("line", "source", *[F.when(F.col("reason").isNull(), F.col(f"_d.{f.name}")).alias(f.name)
                                        for f in FORECAST_SCHEMA.fields], "reason"))


def checked_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents with a reason for each that can't be used; the hours of the
    others are ``hourly_rows(rejects.good(...))``."""
    return check_documents(rejects.read_lines(spark, path))


def parse_forecast_text(text_df: DataFrame, col: str = "value") -> DataFrame:
    """Documents held as JSON text in a column (e.g. a message payload)."""
    docs = text_df.select(F.from_json(F.col(col), FORECAST_SCHEMA).alias("d")).select("d.*")
    return hourly_rows(docs)


def _field(name):
    return lambda x: x[name]


def docs_from_hourly(hourly: DataFrame) -> DataFrame:
    """The inverse: one document per (city, day) holding its hours in order.

    Readings are first reduced to one per (city, hour) -- the mean of repeated
    deliveries, combined map-side -- so each collected group holds at most 24
    entries however many copies arrive."""
    per_hour = hourly.groupBy("city", "date").agg(*[F.avg(c).alias(c) for c in WEATHER_COLS])
    items = F.array_sort(F.collect_list(F.struct(
        F.col("date").alias("ts"), *[F.col(c) for c in WEATHER_COLS])))
    g = per_hour.groupBy("city", F.to_date("date").alias("_day")).agg(items.alias("_items"))
    hourly_struct = F.struct(
        F.transform("_items", lambda x: F.date_format(x["ts"], TIME_FORMAT)).alias("time"),
        *[F.transform("_items", _field(c)).alias(c) for c in
          ["temperature_2m", "relativehumidity_2m", "precipitation",
           "apparent_temperature", "windspeed_10m"]])
    return g.select("city", F.date_format("_day", "yyyy-MM-dd").alias("date"),
                    hourly_struct.alias("hourly"))


def land_forecast_docs(docs: DataFrame, path: str) -> None:
    docs.select(F.to_json(F.struct("city", "date", "hourly")).alias("value")) \
        .write.mode("overwrite").text(path)
