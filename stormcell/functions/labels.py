"""Label-shaped expressions: risk names, correlation labels, alert tags,
probability padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import (NO_SCOPE, RECOMMENDATION_ABOVE, RECOMMENDATIONS, RISK_LEVELS,
                            SCOPE_TEXTS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_label(level) -> Column:
    """names[min(level, 4)]; null without a level (``least`` would skip the null)"""
    names = F.array(*[F.lit(n) for n in RISK_LEVELS])
    lv = _c(level)
    return F.when(lv.isNotNull(), F.element_at(
        names, F.least(lv, F.lit(len(RISK_LEVELS) - 1)) + 1))


def _text(level, texts, other: str) -> Column:
    lv = _c(level)
    expr = None
    for k, text in texts:
        expr = F.when(lv == k, F.lit(text)) if expr is None else expr.when(lv == k, F.lit(text))
    return expr.when(lv.isNotNull(), F.lit(other))


def scope_text(level) -> Column:
    return _text(level, SCOPE_TEXTS, NO_SCOPE)


def recommendation(level) -> Column:
    return _text(level, RECOMMENDATIONS, RECOMMENDATION_ABOVE)


def final_level(model_level, rule_level) -> Column:
    return F.greatest(_c(model_level), _c(rule_level))


def decision_source(model_level, rule_level) -> Column:
    """Which side the final level is justified by; none at level 0.  A missing
    level counts as 0, so it never takes the credit."""
    m, r = (F.coalesce(_c(x), F.lit(0)) for x in (model_level, rule_level))
    return (F.when(F.greatest(m, r) <= 0, F.lit("none"))
            .when(r > m, F.lit("rules"))
            .otherwise(F.lit("model")))


# Correlation bands on |r| (upper bound, label); at or above
# the last bound the sign decides.
CORRELATION_BANDS = [
    (0.2, "No correlation"),
    (0.4, "Weak correlation"),
    (0.7, "Moderate correlation"),
]
STRONG_POSITIVE = "Strong correlation"
STRONG_NEGATIVE = "Strong negative correlation"


def correlation_label(r) -> Column:
    a = F.abs(_c(r))
    expr = None
    for bound, text in CORRELATION_BANDS:
        expr = (F.when(a < bound, F.lit(text)) if expr is None
                else expr.when(a < bound, F.lit(text)))
    return (expr.when(_c(r) > 0, F.lit(STRONG_POSITIVE))
            .otherwise(F.lit(STRONG_NEGATIVE)))


# Plain-language sentence for a pair of variables.  Lookups
# sort both the pair asked for and each key below, so every entry is reachable
# whichever order the two variables come in.
PAIR_SENTENCES = [
    ("temperature_2m", "precipitation", "Rainfall often cools the air."),
    ("temperature_2m", "windspeed_10m", "Stronger winds usually make it feel cooler."),
    ("precipitation", "windspeed_10m", "Wind and rain together are typical of storms."),
    ("relativehumidity_2m", "temperature_2m", "Hot and humid days feel especially muggy."),
    ("relativehumidity_2m", "precipitation", "Humid air makes rain more likely."),
    ("apparent_temperature", "windspeed_10m", "The wind can change the temperature you feel."),
]
NO_PATTERN = "No clear pattern between these variables."


def pad_probabilities(p, n: int = 5) -> Column:
    """First ``n`` probabilities, zero-padded when fewer."""
    arr = _c(p)
    return F.slice(F.concat(arr, F.array_repeat(F.lit(0.0), n)), 1, n)


# Day alert tags, strongest first within a group
# (group, tag, day metric, strictly greater than).
ALERT_TAGS = [
    ("wind", "HIGH WIND", "max_wind", 100.0),
    ("wind", "MODERATE WIND", "max_wind", 60.0),
    ("rain", "HEAVY RAINFALL", "total_precip", 30.0),
    ("rain", "MODERATE RAINFALL", "total_precip", 15.0),
    ("heat", "EXTREME HEAT", "max_temp", 40.0),
    ("heat", "HIGH TEMPERATURE", "max_temp", 35.0),
    ("humidity", "HIGH HUMIDITY", "avg_humidity", 80.0),
]
# Fixed values: "favourable" = no rain, max wind below 30, max temp below 35.
FAVORABLE = ("FAVORABLE CONDITIONS", 0.0, 30.0, 35.0)


def weather_alerts(max_wind="max_wind", total_precip="total_precip",
                   max_temp="max_temp", avg_humidity="avg_humidity") -> Column:
    """Alert tags for one day: within a group only the strongest tag, plus
    the favourable tag when there is no rain and wind and heat stay low."""
    cols = {"max_wind": _c(max_wind), "total_precip": _c(total_precip),
            "max_temp": _c(max_temp), "avg_humidity": _c(avg_humidity)}
    groups: dict[str, Column] = {}
    for group, tag, metric, bound in ALERT_TAGS:
        cond = cols[metric] > bound
        groups[group] = (F.when(cond, F.lit(tag)) if group not in groups
                         else groups[group].when(cond, F.lit(tag)))
    tag, rain, wind, temp = FAVORABLE
    favorable = F.when((cols["total_precip"] == rain) & (cols["max_wind"] < wind)
                       & (cols["max_temp"] < temp), F.lit(tag))
    return F.filter(F.array(*groups.values(), favorable), lambda x: x.isNotNull())
