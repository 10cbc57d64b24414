"""Explicit schemas and fixed column lists (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# The hourly readings, in the order of the data.
WEATHER_COLS = [
    "relativehumidity_2m",
    "temperature_2m",
    "precipitation",
    "apparent_temperature",
    "windspeed_10m",
]

# hourly fact table: one row per (city, wall-clock hour)
OBS_SCHEMA = T.StructType([
    T.StructField("city", T.StringType(), False),
    T.StructField("date", T.TimestampNTZType(), False),
    T.StructField("relativehumidity_2m", T.DoubleType(), True),
    T.StructField("temperature_2m", T.DoubleType(), True),
    T.StructField("precipitation", T.DoubleType(), True),
    T.StructField("apparent_temperature", T.DoubleType(), True),
    T.StructField("windspeed_10m", T.DoubleType(), True),
    T.StructField("suspension", T.IntegerType(), True),
])

# landed forecast document: parallel hourly arrays, one document per (city, day)
FORECAST_SCHEMA = T.StructType([
    T.StructField("city", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("hourly", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType()), True),
        T.StructField("temperature_2m", T.ArrayType(T.DoubleType()), True),
        T.StructField("relativehumidity_2m", T.ArrayType(T.DoubleType()), True),
        T.StructField("precipitation", T.ArrayType(T.DoubleType()), True),
        T.StructField("apparent_temperature", T.ArrayType(T.DoubleType()), True),
        T.StructField("windspeed_10m", T.ArrayType(T.DoubleType()), True),
    ]), True),
])

# The model's 28 input features, in this exact order.
FEATURES = [
    "relativehumidity_2m", "temperature_2m", "precipitation",
    "apparent_temperature", "windspeed_10m",
    "hour", "day_of_week", "month", "is_weekend", "is_rush_hour",
    "precip_roll_3h", "precip_roll_6h", "precip_roll_12h",
    "wind_roll_3h", "wind_roll_6h", "wind_roll_12h",
    "precip_lag_1h", "precip_lag_2h", "precip_lag_3h",
    "temp_lag_1h", "temp_lag_2h", "temp_lag_3h",
    "is_precip_peak", "is_wind_peak", "apparent_temp_delta",
    "precip_intensity", "wind_category", "city_encoded",
]

# The columns standardised before training.
SCALED_COLS = [
    "relativehumidity_2m", "temperature_2m", "precipitation",
    "apparent_temperature", "windspeed_10m", "apparent_temp_delta",
]

ROLL_WINDOWS = (3, 6, 12)
LAGS = (1, 2, 3)
