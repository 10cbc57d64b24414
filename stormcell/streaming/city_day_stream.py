"""Incremental city-day summary and rules over landed hourly readings.

readStream (files) -> foreachBatch.  Every micro-batch
1. lands its readings by day and batch id (an idempotent overwrite),
2. reads the readings of the days it touches back, keeps the first delivery of
   each (city, hour), and summarises the city-days it touches anew,
3. writes them as versions under its batch id, and the number of readings that
   came later than ``watermark`` behind the newest one.

Nothing is dropped, so the result does not depend on how files are cut into
micro-batches; a late reading only makes its day be summarised again.  There is
no operator state: what a batch needs is on disk, in the days' folders.
``trigger(availableNow=True)`` drains what has landed and stops; the same code
runs continuously with a processing-time trigger.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.aggregates import city_day_summary
from ..schema import OBS_SCHEMA
from ..session import path_exists

READINGS, VERSIONS, LATE = "readings", "versions", "late"


def city_day_stream(spark: SparkSession, source_dir: str,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """The readings as they land; ``max_files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(OBS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def first_deliveries(readings: DataFrame) -> DataFrame:
    """One row per (city, hour): that of the smallest batch, then the smallest
    values, so that a run over other batches of the same files differs only
    where deliveries contradict each other."""
    values = [f.name for f in OBS_SCHEMA.fields if f.name not in ("city", "date")]
    first = F.min(F.struct("batch_id", *values)).alias("_f")
    return readings.groupBy("city", "date").agg(first).select(
        "city", "date", *[F.col(f"_f.{c}").alias(c) for c in values])


def write_batch(batch: DataFrame, batch_id: int, sink_dir: str, watermark: str) -> None:
    spark = batch.sparkSession
    readings = os.path.join(sink_dir, READINGS, f"batch_id={batch_id}")
    day = F.to_date("date")
    (batch.withColumn("day", day).repartition("day", "city")
     .write.mode("overwrite").partitionBy("day").parquet(readings))
    mine = spark.read.schema(f"{_ddl()}, day DATE").parquet(readings)
    newest = _newest(spark, sink_dir, batch_id)
    late = F.lit(0) if newest is None else F.count(F.when(
        F.col("date") < F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {watermark}"), 1))
    (mine.agg(F.count(F.lit(1)).alias("readings"), late.cast("long").alias("late"),
              F.max("date").alias("newest"))
     .write.mode("overwrite").parquet(os.path.join(sink_dir, LATE, f"batch_id={batch_id}")))
    touched = mine.select("city", "day").distinct()
    days = [r["day"] for r in touched.select("day").distinct().collect()]  # folders of one batch
    known = (spark.read.schema(f"{_ddl()}, day DATE, batch_id LONG")
             .parquet(os.path.join(sink_dir, READINGS))
             .filter(F.col("day").isin(days) & (F.col("batch_id") <= batch_id))
             .join(touched, ["city", "day"], "left_semi"))
    out = rules.apply_rules(city_day_summary(first_deliveries(known)))
    out.write.mode("overwrite").parquet(os.path.join(sink_dir, VERSIONS, f"batch_id={batch_id}"))


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OBS_SCHEMA.fields)


def _newest(spark: SparkSession, sink_dir: str, batch_id: int):
    """Time of the newest reading before this batch (one row per batch)."""
    path = os.path.join(sink_dir, LATE)
    if not path_exists(spark, path):
        return None
    seen = spark.read.schema("readings LONG, late LONG, newest timestamp_ntz, batch_id LONG").parquet(path)
    newest = seen.filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
    return None if newest is None else newest.isoformat(sep=" ")


def run_to_sink(stream: DataFrame, sink_dir: str, checkpoint_dir: str,
                available_now: bool = True, watermark: str = "6 hours"):
    w = (stream.writeStream.outputMode("append")
         .option("checkpointLocation", checkpoint_dir)
         .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, sink_dir, watermark)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def latest_city_days(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Last version of every (city, day)."""
    out = spark.read.parquet(os.path.join(sink_dir, VERSIONS))
    cols = [c for c in out.columns if c not in ("city", "day", "batch_id")]
    return out.groupBy("city", "day").agg(
        *[F.max_by(c, "batch_id").alias(c) for c in cols])


def late_readings(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Per batch: readings, and how many came later than the watermark allows."""
    return spark.read.parquet(os.path.join(sink_dir, LATE)).select("batch_id", "readings", "late")
