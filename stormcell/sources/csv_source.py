"""Hourly observation CSV: read with the explicit schema, land as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OBS_SCHEMA
from ..session import checkpoint
from . import rejects

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_obs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with ``date`` as wall-clock text; the schema is never inferred."""
    return (spark.read.schema(OBS_SCHEMA)
            .option("header", True)
            .option("timestampNTZFormat", TS_FORMAT)
            .option("mode", "FAILFAST")
            .csv(path))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_WHEN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
_CORRUPT = "_corrupt"


def check_obs_lines(lines: DataFrame) -> DataFrame:
    """(line, source, <the columns of OBS_SCHEMA>, reason) of CSV lines.

    A line is rejected when its number of fields is wrong, city or time is missing,
    the time is no wall clock of the format, or a field is no (finite) number; the
    first reason from the left is given.  Empty readings are nulls, as ever.  The
    header line of each file and blank lines are no data and left out."""
    names = [f.name for f in OBS_SCHEMA.fields]
    fields = F.from_csv("line", ", ".join(f"{n} string" for n in [*names, _CORRUPT]),
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = (lines.where((F.trim("line") != "") & (F.col("line") != ",".join(names)))
            .withColumn("_f", fields))
    reason = F.when(F.col("_f").isNull() | F.col(f"_f.{_CORRUPT}").isNotNull(), "wrong number of fields")
    typed = {}
    for f in OBS_SCHEMA.fields:
        raw = F.col(f"_f.{f.name}")
        value = raw.try_cast(f.dataType)
        if f.name == "city":
            reason = reason.when(F.coalesce(raw, F.lit("")) == "", "no city")
        elif f.name == "date":
            reason = (reason.when(F.coalesce(raw, F.lit("")) == "", "no date")
                      .when(~raw.rlike(_WHEN) | value.isNull(), "date: no time"))
        else:
            reason = reason.when(~raw.rlike(_NUMBER) | (raw.isNotNull() & value.isNull()),
                                 f"{f.name}: no number")
        typed[f.name] = value
    return (rows.withColumn("reason", reason)
            .select("line", "source", *[F.when(F.col("reason").isNull(), v).alias(n) for n, v in typed.items()],
                    "reason"))


def checked_obs_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw CSV folder with a reason for every line that can't be used, instead of
    failing at the first one."""
    return check_obs_lines(rejects.read_lines(spark, path))


def write_obs_csv(obs: DataFrame, path: str) -> None:
    (obs.write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", TS_FORMAT).csv(path))


def land_obs_parquet(obs: DataFrame, path: str) -> None:
    """Columnar copy partitioned by year/month, rows clustered by (city, time)
    so parquet row-group statistics skip on filters.  Range partitioning
    samples the keys, so a month or a hot city is split over many evenly
    sized tasks instead of landing in one.  The rows are checkpointed first, or
    the sampling would compute them a second time."""
    (checkpoint(obs).withColumn("year", F.year("date")).withColumn("month", F.month("date"))
     .repartitionByRange("year", "month", "city", "date")
     .sortWithinPartitions("year", "month", "city", "date")
     .write.mode("overwrite").partitionBy("year", "month").parquet(path))


def read_obs_parquet(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The landed table; with a day range, only the year/month folders that
    overlap it are listed and opened (partition pruning) -- the exact date
    predicate is still applied by the caller."""
    df = spark.read.parquet(path)
    if start is not None or end is not None:
        ym = F.col("year") * 100 + F.col("month")
        if start is not None:
            s = _as_date(start)
            df = df.filter(ym >= s.year * 100 + s.month)
        if end is not None:
            e = _as_date(end)
            df = df.filter(ym <= e.year * 100 + e.month)
    return df.select(*[f.name for f in OBS_SCHEMA.fields])


def _as_date(value):
    import datetime as dt
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])
