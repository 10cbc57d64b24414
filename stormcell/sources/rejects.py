"""Checked ingest: every line read ends up as a good row or in quarantine.

A checked frame has the raw ``line``, the parsed columns and a ``reason`` (null for
a good row).  ``land`` writes it in one pass, split by ``ok``, so that
good + rejects = lines read holds for any table it leaves behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, source): the text lines of all files, and the file of each."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"))


def good(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NULL").drop("line", "source", "reason")


def rejected(checked: DataFrame) -> DataFrame:
    """(line, source, reason) of what can't be used."""
    return checked.where("reason IS NOT NULL").select("line", "source", "reason")


def land(checked: DataFrame, path: str) -> None:
    """One table, split into ok=true and ok=false; a raw line is kept only where it
    was rejected."""
    bad = F.col("reason").isNotNull()
    (checked.withColumn("line", F.when(bad, F.col("line"))).withColumn("ok", ~bad)
     .write.mode("overwrite").partitionBy("ok").parquet(path))


def read_landed(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of a landed table; ``schema`` is that of the checked frame."""
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("ok", T.BooleanType())])).parquet(path)
    return good(table.where("ok").drop("ok")), rejected(table.where("NOT ok").drop("ok"))


def tally(checked: DataFrame) -> DataFrame:
    """(reason, n): how many lines went where; the good ones under 'ok'."""
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
