"""Mergeable quantiles: KLL sketches per (city, day, level, variable).

A sketch of a day is a few hundred bytes; those of any range, city set and level are
merged when a question comes, without the hourly rows.  The normalised rank error of
a merged sketch is at most ``rank_error(k)`` with 99 % confidence, whatever was merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from .aggregates import BOX_VARS

K = 400
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def rank_error(k: int = K) -> float:
    """The sketch library's own bound for one quantile."""
    return 2.296 / k ** 0.9723


def long_rows(obs: DataFrame, variables=BOX_VARS) -> DataFrame:
    """(city, day, level, variable, value) of the readings that are there."""
    values = F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"))
                                for v in variables]))
    return (obs.select("city", cal.calendar_day("date").alias("day"), F.col("suspension").alias("level"), values)
            .where("value IS NOT NULL"))


def day_sketches(obs: DataFrame, variables=BOX_VARS, k: int = K) -> DataFrame:
    """(city, day, level, variable, n, low, high, sketch): store this by day."""
    return long_rows(obs, variables).groupBy("city", "day", "level", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", k).alias("sketch"))


def quantiles(sketches: DataFrame, groups: list[str], probs: dict[str, float] = QUARTILES,
              k: int = K) -> DataFrame:
    """(groups, n, min, max, <probs>) of merged sketches; the ends are exact."""
    merged = sketches.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.kll_merge_agg_double("sketch", k).alias("_sketch"))
    return merged.select(*groups, "n", "min", "max", *[
        F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(name) for name, p in probs.items()])


def medians(sketches: DataFrame, k: int = K) -> DataFrame:
    """(variable, median): A22 / P7 for any selection of the stored sketches."""
    return quantiles(sketches, ["variable"], {"median": 0.5}, k).select("variable", "median")


def box_stats(sketches: DataFrame, k: int = K) -> DataFrame:
    """Five numbers and fences per (level, variable)."""
    out = quantiles(sketches.where("level IS NOT NULL"), ["level", "variable"], QUARTILES, k)
    return (out.withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("fence_low", F.col("q1") - 1.5 * F.col("iqr"))
            .withColumn("fence_high", F.col("q3") + 1.5 * F.col("iqr")))


def rank_errors(rows: DataFrame, found: DataFrame, groups: list[str],
                probs: dict[str, float] = QUARTILES) -> DataFrame:
    """(groups, n, error): the largest distance of a quantile's asked rank from the
    ranks that its value has among ``rows`` (groups, value)."""
    both = rows.join(found.select(*groups, *probs), groups)
    n = F.count(F.lit(1))
    aggregates = [n.alias("n")]
    for name in probs:
        aggregates += [(F.count_if(F.col("value") < F.col(name)) / n).alias(f"_{name}_a"),
                       (F.count_if(F.col("value") <= F.col(name)) / n).alias(f"_{name}_b")]
    ranks = both.groupBy(*groups).agg(*aggregates)
    return ranks.select(*groups, "n", F.greatest(F.lit(0.0), *[
        x for name, p in probs.items() for x in (F.col(f"_{name}_a") - p, p - F.col(f"_{name}_b"))])
        .alias("error"))
