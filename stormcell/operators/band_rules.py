"""The rules as data: readings looked up in a table of bands.

A band (rule, position, low, high, suspension, description, first_only, valid_from,
valid_to) covers low <= reading <= high; a null end is open.  It holds on the days
valid_from <= day < valid_to (nulls: always).  Of a rule with ``first_only`` the band
with the least position counts, of the others every match.

A reading is equi-joined on its bucket, one of ``BUCKETS`` slices between the rule's
outermost ends (and one beyond each of them), with the bands that reach into it; the
bands of a bucket are one row, so that the join neither multiplies the readings nor
needs a grouping after it.  The table may hold any number of bands and versions:
small ones are broadcast after a size check, larger ones shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dims import CRITERIA_HEAT, CRITERIA_RAIN, CRITERIA_WIND
from .lookups import broadcast_checked

BUCKETS = 256
RULES = ["wind", "rain", "heat"]  # the order of the reasons
BANDS = ("rule string, position int, low double, high double, suspension int, description string,"
         " first_only boolean, valid_from date, valid_to date")


def standard_bands(spark: SparkSession) -> DataFrame:
    """The fixed tables of ``sources.dims`` as bands that always hold."""
    rows = [("wind", i, low, high, s, text, True, None, None)
            for i, (_, low, high, s, text) in enumerate(CRITERIA_WIND)]
    for rule, table in (("rain", CRITERIA_RAIN), ("heat", CRITERIA_HEAT)):
        rows += [(rule, i, low, None, s, text, False, None, None) for i, (_, low, s, text) in enumerate(table)]
    return spark.createDataFrame(rows, BANDS)


def _bucket(x: Column, low: float, width: float) -> Column:
    """-1 below ``low``, BUCKETS above the last end, the same rule for readings and ends;
    null for a null."""
    at = F.greatest(F.lit(-1.0), F.least(F.lit(float(BUCKETS)), (x - low) / width))
    return F.when(x.isNotNull(), F.floor(at).cast("int"))


def _lookup(bands: DataFrame, rule: str, low: float, width: float) -> DataFrame:
    """(bucket, bands): the bands that reach into a bucket, by position."""
    first = F.coalesce(_bucket(F.col("low"), low, width), F.lit(-1))
    last = F.coalesce(_bucket(F.col("high"), low, width), F.lit(BUCKETS))
    band = F.struct("position", "low", "high", "suspension", "description", "first_only",
                    "valid_from", "valid_to")
    return (bands.where((F.col("rule") == rule) & (F.col("low").isNull() | F.col("high").isNull()
                                                  | (F.col("low") <= F.col("high"))))
            .select(F.explode(F.sequence(first, last)).alias("_bucket"), band.alias("b"))
            .groupBy("_bucket").agg(F.sort_array(F.collect_list("b")).alias("_bands")))


def apply_bands(df: DataFrame, bands: DataFrame, wind: str = "windspeed_10m",
                precip: str = "precipitation", apparent: str = "apparent_temperature",
                day: str = "day") -> DataFrame:
    """Adds ``rule_level`` and ``rule_reasons`` as ``rules.apply_rules`` does, by the
    bands of the table that hold on each row's ``day``."""
    columns = dict(zip(RULES, (wind, precip, apparent), strict=True))
    unknown = bands.where(~F.col("rule").isin(RULES) | F.col("rule").isNull()).first()
    if unknown is not None:
        raise ValueError(f"unknown rule {unknown['rule']!r}")
    ends = {r["rule"]: r for r in bands.groupBy("rule").agg(
        F.least(F.min("low"), F.min("high")).alias("lo"),
        F.greatest(F.max("low"), F.max("high")).alias("hi")).collect()}  # a row per rule
    out, matches = df, []
    for rule, column in columns.items():
        found = ends.get(rule)
        low, high = (found["lo"], found["hi"]) if found and found["lo"] is not None else (0.0, 1.0)
        width = (high - low) / BUCKETS or 1.0
        name = f"_{rule}"
        lookup = _lookup(bands, rule, low, width).select(
            F.col("_bucket").alias(f"{name}_b"), F.col("_bands").alias(name))
        x = F.col(column)
        out = out.join(broadcast_checked(lookup, materialize=True),
                       _bucket(x, low, width) == F.col(f"{name}_b"), "left").drop(f"{name}_b")
        out = out.withColumn(name, _holding(name, x, F.col(day)))
        matches.append(F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    out = out.withColumn("_all", F.concat(*matches))
    return (out.withColumn("rule_level", F.coalesce(F.array_max(F.transform(
                "_all", lambda b: b["suspension"])), F.lit(0)))
            .withColumn("rule_level", F.greatest(F.lit(0), F.col("rule_level")))
            .withColumn("rule_reasons", F.transform("_all", lambda b: b["description"]))
            .drop("_all", *[f"_{r}" for r in RULES]))


def _holding(name: str, x: Column, day: Column) -> Column:
    """The bands that hold for a reading; of first-only ones the first."""
    hit = F.filter(name, lambda b: (
        (b["low"].isNull() | (x >= b["low"])) & (b["high"].isNull() | (x <= b["high"]))
        & (b["valid_from"].isNull() | (day >= b["valid_from"]))
        & (b["valid_to"].isNull() | (day < b["valid_to"]))))
    single = F.filter(hit, lambda b: b["first_only"])
    return F.concat(F.slice(single, 1, 1), F.filter(hit, lambda b: ~b["first_only"]))
