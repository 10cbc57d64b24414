"""Dimension and rule tables.

They are fixed, literal tables (17 cities, 5 levels, 4+3+2 rule rows), so their
size is bounded by construction and broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# City coordinates (name, latitude, longitude).
CITY_COORDINATES = [
    ("Manila", 14.5995, 120.9842),
    ("Quezon City", 14.6760, 121.0437),
    ("Caloocan", 14.6488, 120.9830),
    ("Las Piñas", 14.4453, 120.9842),
    ("Makati", 14.5547, 121.0244),
    ("Malabon", 14.6630, 120.9573),
    ("Mandaluyong", 14.5794, 121.0359),
    ("Marikina", 14.6507, 121.1029),
    ("Muntinlupa", 14.4086, 121.0390),
    ("Navotas", 14.6685, 120.9409),
    ("Parañaque", 14.4793, 121.0198),
    ("Pasay", 14.5378, 121.0014),
    ("Pasig", 14.5764, 121.0851),
    ("Pateros", 14.5438, 121.0685),
    ("San Juan", 14.6019, 121.0355),
    ("Taguig", 14.5176, 121.0509),
    ("Valenzuela", 14.7006, 120.9830),
]

# Suspension levels 0-4 (level, name, color, emoji, risk).
# Level 5 occurs in the data but has no row here on purpose.
SUSPENSION_LEVELS = [
    (0, "No Suspension", "#10b981", "✅", "None"),
    (1, "Preschool Only", "#fbbf24", "⚠️", "Low"),
    (2, "Preschool + Elementary", "#f97316", "🟠", "Medium"),
    (3, "All Levels (Public)", "#ef4444", "🔴", "High"),
    (4, "All Levels + Work", "#991b1b", "🚨", "Critical"),
]

# What each level means.
LEVEL_DESCRIPTIONS = [
    (0, "Normal school and work operations. Weather conditions are safe."),
    (1, "Only preschool classes are suspended due to weather conditions."),
    (2, "Preschool and elementary classes are suspended."),
    (3, "All school levels (public schools) are suspended."),
    (4, "All school levels and government work are suspended."),
]

# Scope of the suspension, as the bulletin states it per level.
SCOPE_TEXTS = [
    (0, "School and work operations continue normally. No weather-related suspensions."),
    (1, "Only preschool classes and outdoor activities are suspended due to hazardous weather conditions."),
    (2, "Preschool and elementary classes are suspended. Higher education and offices remain open."),
    (3, "All public school levels (preschool through senior high school) are suspended. Government offices may remain open."),
    (4, "All school levels and all government offices remain closed. Private sector advised to cease outdoor activities."),
]
NO_SCOPE = "N/A"

# The bulletin's recommendation for levels 0 to 3, and above.
RECOMMENDATIONS = [
    (0, "RECOMMENDATION: No suspension. Proceed with normal operations."),
    (1, "RECOMMENDATION: Preschool suspension advised. All other institutions operate normally."),
    (2, "RECOMMENDATION: Preschool and Elementary suspension advised."),
    (3, "RECOMMENDATION: All public school levels suspended. Government offices operate with caution."),
]
RECOMMENDATION_ABOVE = "RECOMMENDATION: CRITICAL - All schools and government offices CLOSED."

# Risk names indexed by min(level, 4).
RISK_LEVELS = ["None", "Low", "Medium", "High", "Critical"]

# Wind signal bands (signal, wind_min, wind_max, suspension,
# description); both ends inclusive, the first matching band wins.
CRITERIA_WIND = [
    (1, 30.0, 60.0, 1, "TCWS 1: Winds 30-60 km/h"),
    (2, 60.0, 100.0, 2, "TCWS 2: Winds 60-100 km/h"),
    (3, 100.0, 150.0, 3, "TCWS 3: Winds 100-150 km/h"),
    (4, 150.0, 300.0, 4, "TCWS 4: Winds 150-250 km/h"),
]

# Rainfall thresholds (level, precip >=, suspension, description);
# every matching row counts.
CRITERIA_RAIN = [
    (1, 7.5, 1, "Light Rainfall Warning: >=7.5 mm/hour"),
    (2, 15.0, 3, "Moderate Rainfall Warning: >=15 mm/hour"),
    (3, 30.0, 4, "Heavy Rainfall Warning: >=30 mm/hour"),
]

# Heat thresholds on apparent temperature (level, temp >=,
# suspension, description); every matching row counts.
CRITERIA_HEAT = [
    (1, 41.0, 3, "Heat Index 41°C: Outdoor activities suspended"),
    (2, 51.0, 4, "Heat Index 51°C: All outdoor work suspended"),
]

CITY_SCHEMA = T.StructType([
    T.StructField("city", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
])

LEVEL_SCHEMA = T.StructType([
    T.StructField("level", T.IntegerType(), False),
    T.StructField("level_name", T.StringType(), False),
    T.StructField("color", T.StringType(), False),
    T.StructField("emoji", T.StringType(), False),
    T.StructField("risk", T.StringType(), False),
])


def city_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CITY_COORDINATES, CITY_SCHEMA)


def level_dim(spark: SparkSession) -> DataFrame:
    desc = dict(LEVEL_DESCRIPTIONS)
    rows = [r + (desc[r[0]],) for r in SUSPENSION_LEVELS]
    schema = T.StructType(LEVEL_SCHEMA.fields + [
        T.StructField("description", T.StringType(), False)])
    return spark.createDataFrame(rows, schema)


def criteria_wind(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CRITERIA_WIND,
        "signal INT, wind_min DOUBLE, wind_max DOUBLE, suspension INT, description STRING")


def criteria_rain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CRITERIA_RAIN, "level INT, precip DOUBLE, suspension INT, description STRING")


def criteria_heat(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CRITERIA_HEAT, "level INT, temp DOUBLE, suspension INT, description STRING")
