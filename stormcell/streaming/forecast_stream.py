"""Revised forecasts as a stream with keyed state and timers.

A (city, day) is a key.  Its state maps each hour to the latest issue's values, so
it holds at most a day's hours however often a forecast is revised.  An event-time
timer at the day's end emits the hours and clears the state: event time is the issue
time, and once the watermark has passed a day nobody forecasts it any more.

A revision that comes for a day already closed is not dropped: it is emitted as it
is.  The latest issue per hour is a maximum, so closed hours, late revisions and the
state of open days are merged by ``latest_forecast`` again, and the answer is that of
one batch over all revisions, however files are cut.  The query's watermark column
ends before the grouping, or Spark would drop late rows unseen; open days are read
from the state store of the checkpoint.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.serving import latest_forecast
from ..schema import WEATHER_COLS
from ..session import path_exists
from .stateful_city_day import event_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000
HOUR = "hour bigint"
VALUES = "issued bigint, " + ", ".join(f"{c} double" for c in WEATHER_COLS)
OUTPUT = f"kind string, city string, {HOUR}, {VALUES}"
ISSUED = "city string, date timestamp_ntz, issued_at timestamp_ntz, " + ", ".join(
    f"{c} double" for c in WEATHER_COLS)


class LatestIssue(StatefulProcessor):
    """Keeps the latest issue of each hour of an open day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", HOUR, VALUES)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        city, day = key
        end = (day + 1) * DAY_MS
        if timerValues.getCurrentWatermarkInMs() >= end:
            for r in rows:
                yield Row(kind="late", city=city, hour=r.hour, **_values(r))
            return
        first = not self.hours.exists()
        for r in rows:
            at = (r.hour,)
            if not self.hours.containsKey(at) or self.hours.getValue(at)[0] < r.issued:
                self.hours.updateValue(at, (r.issued, *(r[c] for c in WEATHER_COLS)))
        if first:
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for (hour,), value in self.hours.iterator():
            yield Row(kind="closed", city=key[0], hour=hour,
                      **dict(zip(["issued", *WEATHER_COLS], value, strict=True)))
        self.hours.clear()

    def close(self) -> None:
        pass


def _values(r: Row) -> dict:
    return {c: r[c] for c in ("issued", *WEATHER_COLS)}


def _seconds(column: str):
    return F.unix_seconds(event_time(F.col(column)))


def forecast_stream(spark: SparkSession, source_dir: str,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """(city, date, issued_at, readings) as the revisions land."""
    reader = spark.readStream.schema(ISSUED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def revised(issues: DataFrame, watermark: str) -> DataFrame:
    """Closed hours and late revisions.  Rows without city, hour or issue time say
    nothing about any hour and are left out."""
    rows = (issues.where("city IS NOT NULL AND date IS NOT NULL AND issued_at IS NOT NULL")
            .withColumn("event", event_time(F.col("issued_at"))).withWatermark("event", watermark)
            .select("city", F.floor(_seconds("date") / 86400).cast("int").alias("day"),
                    _seconds("date").alias("hour"),
                    # micros as a number: carries no watermark
                    F.unix_micros(event_time(F.col("issued_at"))).alias("issued"), *WEATHER_COLS))
    return rows.groupBy("city", "day").transformWithState(
        LatestIssue(), OUTPUT, "append", "EventTime")


def start(issues: DataFrame, sink_dir: str, checkpoint_dir: str, watermark: str = "6 hours",
          available_now: bool = True):
    """Start the query; state variables need the RocksDB store."""
    conf = issues.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        w = (revised(issues, watermark).writeStream.outputMode("append")
             .option("checkpointLocation", checkpoint_dir)
             .foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(
                 os.path.join(sink_dir, f"batch_id={batch_id}"))))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
        return w.start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def _hourly(rows: DataFrame) -> DataFrame:
    """Numbers back to wall clocks."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return rows.select(
        "city", F.timestamp_add("SECOND", F.col("hour"), epoch).alias("date"), *WEATHER_COLS,
        F.timestamp_add("SECOND", F.floor(F.col("issued") / 1_000_000), epoch).alias("issued_at"))


def emitted(spark: SparkSession, sink_dir: str, kind: str) -> DataFrame:
    """The query's ``closed`` hours or ``late`` revisions."""
    if not path_exists(spark, sink_dir):
        return _hourly(spark.createDataFrame([], OUTPUT))
    return _hourly(spark.read.schema(f"{OUTPUT}, batch_id long").parquet(sink_dir)
                   .where(F.col("kind") == kind))


def open_hours(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """The latest issues of the days that are not closed, from the state store."""
    state = (spark.read.format("statestore").option("stateVarName", "hours")
             .option("flattenCollectionTypes", True).load(checkpoint_dir))
    return _hourly(state.select(F.col("key.city").alias("city"), "user_map_key.hour", "user_map_value.*"))


def latest(spark: SparkSession, sink_dir: str, checkpoint_dir: str) -> DataFrame:
    """(city, date, readings, issued_at): the latest issue of every hour."""
    closed, late = (emitted(spark, sink_dir, kind) for kind in ("closed", "late"))
    return latest_forecast(closed.union(late).union(open_hours(spark, checkpoint_dir)))
