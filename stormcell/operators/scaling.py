"""Standardisation with the population standard deviation, fitted on train rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SCALED_COLS


def fit_scaler(train: DataFrame, cols=SCALED_COLS) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column -- fitted scalars, one aggregate job.
    A zero spread scales by 1, as the usual scaler does."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = {}
    for c in cols:
        s = row[f"s_{c}"]
        out[c] = (row[f"m_{c}"], s if s else 1.0)
    return out


def scaler_table(spark, params: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(c, m, s) for c, (m, s) in params.items()],
                                 "column STRING, mean DOUBLE, std DOUBLE")


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})
