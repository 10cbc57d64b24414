"""The 28-feature training table, built in one lazy plan.

impute -> calendar -> rolling/lag/peak (one window pass) -> bins -> city code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bins
from ..functions import calendar as cal
from ..operators.impute import fit_medians, impute
from ..operators.lookups import broadcast_checked
from ..operators.ordering import rank
from ..operators.windows import series_features
from ..schema import FEATURES


def city_codes(obs: DataFrame, city_col: str = "city") -> DataFrame:
    """Sorted distinct cities -> 0..n-1 (alphabetical, like a label encoder)."""
    d = obs.select(city_col).distinct().filter(F.col(city_col).isNotNull())
    return rank(d, [city_col], "_rank").select(
        city_col, (F.col("_rank") - 1).cast("int").alias("city_encoded"))


UNSEEN = -1  # code of a city the encoder was not fitted on


def encode_city(df: DataFrame, codes: DataFrame, city_col: str = "city",
                policy: str = "keep") -> DataFrame:
    """Adds ``city_encoded``.  A city without a code (null, or not seen when the
    codes were fitted) gets ``UNSEEN`` under ``keep`` and raises under
    ``error``; no row is lost.  ``unseen_cities`` lists them."""
    if policy == "error":
        bad = [r[0] for r in unseen_cities(df, codes, city_col).limit(10).collect()]
        if bad:
            raise ValueError(f"cities without a code: {bad}")
    elif policy != "keep":
        raise ValueError(f"unknown policy {policy!r}")
    out = df.join(broadcast_checked(codes, materialize=True), city_col, "left")
    return out.withColumn("city_encoded", F.coalesce("city_encoded", F.lit(UNSEEN)))


def decode_city(df: DataFrame, codes: DataFrame, city_col: str = "city") -> DataFrame:
    """The inverse: ``city_encoded`` -> city (null for ``UNSEEN``)."""
    return df.join(broadcast_checked(codes.select("city_encoded", city_col), materialize=True),
                   "city_encoded", "left")


def unseen_cities(df: DataFrame, codes: DataFrame, city_col: str = "city") -> DataFrame:
    """(city, rows) of ``df`` that have no code."""
    return (df.groupBy(city_col).agg(F.count(F.lit(1)).alias("rows"))
            .join(codes, city_col, "left_anti"))


def training_features(obs: DataFrame, layout: str = "auto", block_unit: str = "week",
                      medians: dict | None = None, codes: DataFrame | None = None) -> DataFrame:
    med = medians if medians is not None else fit_medians(obs)
    filled = impute(obs, med)
    temp_fill = F.lit(med["temperature_2m"]).cast("double")
    feats = series_features(filled.withColumns(cal.temporal_columns("date")),
                            temp_fill=temp_fill, layout=layout, block_unit=block_unit)
    feats = feats.withColumns({
        "apparent_temp_delta": bins.apparent_temp_delta(),
        "precip_intensity": bins.precip_intensity(),
        "wind_category": bins.wind_category(),
    })
    codes = codes if codes is not None else city_codes(obs)
    feats = encode_city(feats, codes)
    return feats.select("city", "date", *[F.col(c).cast("double").alias(c) for c in FEATURES],
                        "suspension")
