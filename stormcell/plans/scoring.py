"""Batch scoring of every (city, day), and a persisted model per data folder.

Primary path: score every hour with the training features, then take the
day's level as the most frequent hourly prediction (ties to the lower level),
its probabilities as the mean hourly probabilities.  The reference scores one
synthetic row per day built from daily means and head/tail rows; that row is
available as ``serving_day_features`` for comparison.
"""

from __future__ import annotations

import hashlib
import os
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.impute import fit_medians
from ..session import checkpoint, checkpoint_root, path_exists
from . import training
from .features import city_codes, training_features

class Fitted(NamedTuple):
    """What scoring needs: the model, the city codes and the medians it was
    trained with, and the split feature table."""
    model: PipelineModel
    split: DataFrame
    codes: DataFrame
    medians: dict


_FITTED: dict[str, Fitted] = {}


def model_path(spark: SparkSession, tag: str, cfg: training.TrainConfig) -> str:
    key = f"{tag}|{cfg!r}"
    return os.path.join(checkpoint_root(spark), "models",
                        hashlib.md5(key.encode()).hexdigest()[:16])


def save_fitted(path: str, model: PipelineModel, codes: DataFrame, medians: dict) -> None:
    """The whole artefact.  The medians go last: with them it is complete."""
    model.write().overwrite().save(f"{path}/model")
    codes.write.mode("overwrite").parquet(f"{path}/codes")
    rows = [(c, None if v is None else float(v)) for c, v in medians.items()]
    (codes.sparkSession.createDataFrame(rows, "column STRING, median DOUBLE").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/medians"))


def load_fitted(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, dict]:
    codes = spark.read.parquet(f"{path}/codes")
    medians = {r["column"]: r["median"] for r in spark.read.parquet(f"{path}/medians").collect()}
    return PipelineModel.load(f"{path}/model"), codes, medians


def fitted_model(spark: SparkSession, obs: DataFrame, tag: str,
                 cfg: training.TrainConfig = training.TrainConfig()) -> Fitted:
    """Model, codes, medians and split feature table for ``tag`` and ``cfg``,
    built once per session.

    The split is checkpointed into the shared folder (fit, evaluation and
    scoring all read it); model, codes and medians are saved there, and a saved
    artefact is used with its own codes and medians, so a city that is new in
    ``obs`` shifts no other city's code."""
    key = f"{spark.sparkContext.applicationId}:{tag}|{cfg!r}"
    if key in _FITTED:
        return _FITTED[key]
    path = model_path(spark, tag, cfg)
    saved = path_exists(spark, f"{path}/medians/_SUCCESS")
    if saved:
        model, codes, medians = load_fitted(spark, path)
    else:
        codes, medians = checkpoint(city_codes(obs)), fit_medians(obs)
    split = checkpoint(training.split(
        training_features(obs, medians=medians, codes=codes), cfg))
    if not saved:
        model = training.fit(split.filter(~F.col("is_test")), cfg)
        save_fitted(path, model, codes, medians)
    _FITTED[key] = Fitted(model, split, codes, medians)
    return _FITTED[key]


def score_city_days(model: PipelineModel, features: DataFrame, n_classes: int | None = None) -> DataFrame:
    pred = training.predict(model, features)
    clf = model.stages[-1]
    k = n_classes or (clf.numClasses if hasattr(clf, "numClasses") else len(clf.models))
    per_day = pred.groupBy("city", F.to_date("date").alias("day")).agg(
        F.mode("predicted", deterministic=True).alias("predicted_level"),
        *[F.avg(F.col("probabilities")[i]).alias(f"_p{i}") for i in range(k)],
    )
    probs = F.array(*[F.col(f"_p{i}") for i in range(k)])
    return per_day.select(
        "city", "day", "predicted_level",
        probs.alias("probabilities"),
        F.array_max(probs).alias("confidence"),
        labels.risk_label("predicted_level").alias("risk_level"),
        labels.pad_probabilities(probs, 5).alias("probabilities_5"),
    )


def serving_feature_rows(obs: DataFrame, codes: DataFrame, medians: dict) -> DataFrame:
    """The scoring-time row per (city, day), in the training feature order:
    daily means (rain: daily total), head means / tail values of the day,
    calendar fields of its first hour, peaks, bins and the city code.
    Missing readings take the training medians (trees here have no NaN rule).
    """
    from ..functions import bins
    from ..functions import calendar as cal
    from ..operators import windows
    from ..operators.impute import impute
    from ..schema import FEATURES
    from .features import encode_city

    # day means and head/tail features from one pass over the rows
    rows = windows.serving_day_features(obs, with_summary=True)
    rows = impute(rows, medians).withColumns(cal.temporal_columns("first_ts"))
    rows = rows.withColumns(windows.peak_columns()).withColumns({
        "apparent_temp_delta": bins.apparent_temp_delta(),
        "precip_intensity": bins.precip_intensity(),
        "wind_category": bins.wind_category(),
    })
    rows = encode_city(rows, codes)
    return rows.select("city", "day", F.col("first_ts").alias("date"),
                       *[F.col(c).cast("double").alias(c) for c in FEATURES])


def score_serving_days(model: PipelineModel, rows: DataFrame) -> DataFrame:
    pred = training.predict(model, rows)
    return pred.select("city", "day", F.col("predicted").alias("predicted_level"),
                       "probabilities",
                       F.array_max("probabilities").alias("confidence"),
                       labels.risk_label("predicted").alias("risk_level"))


def scenario_feature_rows(grid: DataFrame, codes: DataFrame) -> DataFrame:
    """Feature rows for what-if scenarios, each read as a one-hour day at the
    scenario's date and hour: the head means are the values themselves, the lags
    fall back to 0 rain and the scenario temperature, and no peak can fire."""
    from ..functions import bins
    from ..functions import calendar as cal
    from ..operators import windows
    from ..schema import FEATURES, ROLL_WINDOWS, LAGS
    from .features import encode_city

    ts = F.make_timestamp_ntz(F.year("s_day"), F.month("s_day"), F.dayofmonth("s_day"),
                              F.col("s_hour"), F.lit(0), F.lit(0))
    rows = grid.select(
        "city", "day", "scenario", ts.alias("date"),
        F.col("s_humidity").alias("relativehumidity_2m"),
        F.col("s_temperature").alias("temperature_2m"),
        F.col("s_precipitation").alias("precipitation"),
        F.col("s_apparent").alias("apparent_temperature"),
        F.col("s_windspeed").alias("windspeed_10m"),
        "rule_level")
    cols = dict(cal.temporal_columns("date"))
    for n in ROLL_WINDOWS:
        cols[f"precip_roll_{n}h"] = F.col("precipitation")
        cols[f"wind_roll_{n}h"] = F.col("windspeed_10m")
    for k in LAGS:
        cols[f"precip_lag_{k}h"] = F.lit(0.0)
        cols[f"temp_lag_{k}h"] = F.col("temperature_2m")
    rows = rows.withColumns(cols).withColumns(windows.peak_columns()).withColumns({
        "apparent_temp_delta": bins.apparent_temp_delta(),
        "precip_intensity": bins.precip_intensity(),
        "wind_category": bins.wind_category(),
    })
    rows = encode_city(rows, codes)
    return rows.select("city", "day", "scenario", "date", "rule_level",
                       *[F.col(c).cast("double").alias(c) for c in FEATURES])


def score_scenarios(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Model level, confidence and the final level max(model, rules)."""
    pred = training.predict(model, rows)
    return pred.select("city", "day", "scenario", "rule_level",
                       F.col("predicted").alias("model_level"),
                       F.array_max("probabilities").alias("confidence"),
                       labels.final_level(F.col("predicted"), F.col("rule_level")).alias("final_level"),
                       labels.decision_source(F.col("predicted"), F.col("rule_level"))
                       .alias("decision_source"))
