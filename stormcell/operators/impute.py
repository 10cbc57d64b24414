"""Null handling: global medians for continuous readings, zero for rain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import exact_quantiles

# Columns filled with their global median.
MEDIAN_COLS = ["relativehumidity_2m", "temperature_2m",
               "apparent_temperature", "windspeed_10m"]


def fit_medians(obs: DataFrame, cols=MEDIAN_COLS,
                approx_accuracy: int | None = None) -> dict[str, float | None]:
    """Fitted scalars.

    Exact medians come from a distributed value histogram (cost grows with
    distinct values, fine for readings quantised to sensor resolution);
    ``approx_accuracy`` switches to the bounded-memory quantile sketch.
    """
    if approx_accuracy:
        row = obs.agg(*[F.percentile_approx(c, 0.5, approx_accuracy).alias(c)
                        for c in cols]).first()
        return {c: row[c] for c in cols}
    long = obs.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in cols])))
    got = {r["column"]: r["median"] for r in
           exact_quantiles(long, ["column"], "value", {"median": 0.5}).collect()}
    return {c: got.get(c) for c in cols}


def impute(obs: DataFrame, medians: dict[str, float | None],
           zero_cols=("precipitation",)) -> DataFrame:
    fills = {c: F.coalesce(F.col(c), F.lit(v).cast("double")) for c, v in medians.items()}
    fills.update({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero_cols})
    return obs.withColumns(fills)


def impute_obs(obs: DataFrame, approx_accuracy: int | None = None) -> DataFrame:
    return impute(obs, fit_medians(obs, approx_accuracy=approx_accuracy))
