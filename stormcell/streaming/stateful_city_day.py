"""City-day summaries with operator state: one streaming query, bounded by its watermark.

readStream -> withWatermark -> dropDuplicatesWithinWatermark(city, hour) -> daily
window, in append mode.  State holds the hours of the days that are still open and
nothing else.  A micro-batch reads nothing back, whatever has come before it.

The query's rows are of three kinds, split by ``foreachBatch``:

* ``raw``       every delivery of the micro-batch;
* ``accepted``  the first delivery of each (city, hour);
* ``closed``    the summary of each city-day whose end the watermark has passed.

What is raw and not accepted was a repeat, or later than the watermark: it goes to
``dropped``, so accepted + dropped (+ repeats inside the batch) = raw.  ``repair``
merges the dropped readings of hours that were never accepted, and summarises
their days anew.  With it the answer is that of one batch over all deliveries,
however files are cut.

Folders under the sink: accepted/day/batch_id, dropped/batch_id/day, closed/day,
repaired/day.  Partitions are overwritten as a whole, so a replayed micro-batch or
repair leaves the same files.  A day closes in one micro-batch, as the watermark is
one for all cities.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.aggregates import city_day_summary, summary_aggregates
from ..schema import OBS_SCHEMA
from ..session import path_exists
from .city_day_stream import first_deliveries

ACCEPTED, DROPPED, CLOSED, REPAIRED = "accepted", "dropped", "closed", "repaired"
REPAIRED_UPTO = "repaired_upto"
_READING = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OBS_SCHEMA.fields)
_METRICS = ["temperature_2m", "relativehumidity_2m", "precipitation", "apparent_temperature",
            "windspeed_10m"]
_COLUMNS = ["city", *_METRICS, "n_hours", "rule_level", "rule_reasons", "day"]
_SUMMARY = ", ".join(["city string", *[f"{c} double" for c in _METRICS], "n_hours long",
                      "rule_level int", "rule_reasons array<string>", "day date"])


def event_time(date: Column) -> Column:
    """The wall clock as an instant, without the session's zone: watermarks need an
    instant, and windows of instants are cut at midnight of this clock."""
    return F.timestamp_seconds(F.timestamp_diff(
        "SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), date))


def _day(window: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"),
                      F.floor(F.unix_seconds(window["start"]) / 86400).cast("int"))


def tagged(readings: DataFrame, watermark: str) -> DataFrame:
    """The three kinds of rows, as one stream."""
    events = (readings.withColumn("event", event_time(F.col("date")))
              .withWatermark("event", watermark))
    known = events.where(F.col("city").isNotNull() & F.col("date").isNotNull())
    accepted = known.dropDuplicatesWithinWatermark(["city", "date"])
    closed = (accepted.groupBy("city", F.window("event", "1 day").alias("window"))
              .agg(*summary_aggregates())
              .select("city", _day(F.col("window")).alias("day"), *_METRICS, "n_hours"))
    reading = [f.name for f in OBS_SCHEMA.fields]
    raw = events.select(F.lit("raw").alias("kind"), F.to_date("date").alias("day"), *reading)
    first = accepted.select(F.lit("accepted").alias("kind"), F.to_date("date").alias("day"), *reading)
    return (raw.unionByName(first)
            .unionByName(closed.withColumn("kind", F.lit("closed")), allowMissingColumns=True))


def _write(df: DataFrame, path: str, *by: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def write_batch(batch: DataFrame, batch_id: int, sink_dir: str) -> None:
    """Splits a micro-batch; reads nothing but the micro-batch."""
    batch = batch.persist()
    try:
        reading = [f.name for f in OBS_SCHEMA.fields]
        accepted = batch.where("kind = 'accepted'").select("day", *reading)
        hours = accepted.select("city", "date").distinct()
        dropped = (batch.where("kind = 'raw'").select("day", *reading)
                   .join(hours, ["city", "date"], "left_anti"))
        number = F.lit(batch_id).cast("long").alias("batch_id")
        _write(accepted.select("*", number), os.path.join(sink_dir, ACCEPTED), "day", "batch_id")
        _write(dropped.select("*", number), os.path.join(sink_dir, DROPPED), "batch_id", "day")
        closed = batch.where("kind = 'closed'").drop("kind", "date", "suspension")
        _write(rules.apply_rules(closed).select(*_COLUMNS), os.path.join(sink_dir, CLOSED), "day")
    finally:
        batch.unpersist()


def start(readings: DataFrame, sink_dir: str, checkpoint_dir: str, watermark: str = "6 hours",
          available_now: bool = True):
    """Start the query.  ``spark.sql.streaming.stateStore.providerClass`` decides where
    the state lies (RocksDB for many open city-hours)."""
    w = (tagged(readings, watermark).writeStream.outputMode("append")
         .option("checkpointLocation", checkpoint_dir)
         .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, sink_dir)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)


def accepted_readings(spark: SparkSession, sink_dir: str) -> DataFrame:
    return _read(spark, os.path.join(sink_dir, ACCEPTED), f"{_READING}, day date, batch_id long")


def dropped_readings(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Deliveries that were not accepted: repeats of earlier ones, readings later
    than the watermark, and rows without city or time."""
    return _read(spark, os.path.join(sink_dir, DROPPED), f"{_READING}, batch_id long, day date")


def _repaired_upto(spark: SparkSession, sink_dir: str) -> int:
    path = os.path.join(sink_dir, REPAIRED_UPTO)
    if not path_exists(spark, path):
        return -1
    return spark.read.schema("batch_id long").json(path).agg(F.max("batch_id")).first()[0]


def repair(spark: SparkSession, sink_dir: str) -> None:
    """Merge what was dropped since the last repair.

    Readings of hours that were never accepted join the accepted ones (under a
    negative batch number, so that a first delivery still counts before them), and
    every day with a dropped reading is summarised anew from its folders.  A repair
    that was broken off is simply run again."""
    upto = _repaired_upto(spark, sink_dir)
    pending = dropped_readings(spark, sink_dir).where(F.col("batch_id") > upto)
    days = [r["day"] for r in pending.where("day IS NOT NULL AND city IS NOT NULL")
            .select("day").distinct().collect()]  # the folders to read
    last = pending.agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    if days:
        ours = -(last + 1)
        before = accepted_readings(spark, sink_dir).where(
            F.col("day").isin(days) & (F.col("batch_id") != ours))
        late = (first_deliveries(pending.where(F.col("day").isin(days) & F.col("city").isNotNull()))
                .join(before.select("city", "date"), ["city", "date"], "left_anti")
                .select(*[f.name for f in OBS_SCHEMA.fields], F.to_date("date").alias("day"),
                        F.lit(ours).cast("long").alias("batch_id")))
        _write(late, os.path.join(sink_dir, ACCEPTED), "day", "batch_id")
        whole = accepted_readings(spark, sink_dir).where(F.col("day").isin(days))
        again = rules.apply_rules(city_day_summary(whole.drop("day")))
        _write(again.select(*_COLUMNS), os.path.join(sink_dir, REPAIRED), "day")
    (spark.createDataFrame([(last,)], "batch_id long").coalesce(1)
     .write.mode("overwrite").json(os.path.join(sink_dir, REPAIRED_UPTO)))


def late_readings(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The readings that repairs have merged."""
    return accepted_readings(spark, sink_dir).where("batch_id < 0").drop("batch_id")


def city_days(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Every (city, day) once: repaired days, closed days, and the days that are
    still open (later than all closed ones) from their accepted readings."""
    closed = _read(spark, os.path.join(sink_dir, CLOSED), _SUMMARY)
    repaired = _read(spark, os.path.join(sink_dir, REPAIRED), _SUMMARY)
    newest = closed.agg(F.max("day")).first()[0]
    open_days = accepted_readings(spark, sink_dir)
    if newest is not None:
        open_days = open_days.where(F.col("day") > F.lit(newest))
    done = repaired.select("day").distinct()
    rest = closed.unionByName(rules.apply_rules(city_day_summary(open_days.drop("day")))
                              .select(*_COLUMNS))
    return rest.join(F.broadcast(done), "day", "left_anti").select(*_COLUMNS).unionByName(repaired)
