"""Threshold rule engine: wind bands, rainfall and heat thresholds.

The rule tables are fixed literal tables of at most four rows, so each rule is
compiled into one ``CASE`` / array expression evaluated inside whole-stage
codegen: no join, no shuffle, one pass over the rows, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import CRITERIA_HEAT, CRITERIA_RAIN, CRITERIA_WIND


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wind_band(wind, field: int, open_top: bool = False) -> Column:
    """Value of ``field`` of the first band with min <= wind <= max (inclusive).
    Winds above the last band match nothing (as published); ``open_top``
    lets the last band run on without an upper end."""
    w = _c(wind)
    expr = None
    last = len(CRITERIA_WIND) - 1
    for i, band in enumerate(CRITERIA_WIND):
        cond = (w >= band[1]) if (open_top and i == last) else (w >= band[1]) & (w <= band[2])
        val = F.lit(band[field])
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def wind_signal(wind="windspeed_10m", open_top: bool = False) -> Column:
    return wind_band(wind, 0, open_top)


def wind_level(wind="windspeed_10m", open_top: bool = False) -> Column:
    return F.coalesce(wind_band(wind, 3, open_top), F.lit(0))


def wind_reason(wind="windspeed_10m") -> Column:
    return wind_band(wind, 4)


def _threshold_level(x, table) -> Column:
    col = _c(x)
    # every matching row counts; the level is the largest suspension matched
    return F.greatest(F.lit(0), *[F.when(col >= t[1], F.lit(t[2])).otherwise(0)
                                  for t in table])


def rain_level(precip="precipitation") -> Column:
    return _threshold_level(precip, CRITERIA_RAIN)


def heat_level(apparent="apparent_temperature") -> Column:
    return _threshold_level(apparent, CRITERIA_HEAT)


def rain_matches(precip="precipitation") -> Column:
    col = _c(precip)
    return sum((col >= t[1]).cast("int") for t in CRITERIA_RAIN)


def heat_matches(apparent="apparent_temperature") -> Column:
    col = _c(apparent)
    return sum((col >= t[1]).cast("int") for t in CRITERIA_HEAT)


def rule_level(wind="windspeed_10m", precip="precipitation",
               apparent="apparent_temperature") -> Column:
    """max of all matched suspensions, 0 when nothing matches (nulls match nothing)."""
    return F.greatest(wind_level(wind),
                      F.coalesce(rain_level(precip), F.lit(0)),
                      F.coalesce(heat_level(apparent), F.lit(0)))


def rule_reasons(wind="windspeed_10m", precip="precipitation",
                 apparent="apparent_temperature") -> Column:
    """Matched descriptions, wind first, then rain and heat in ascending order."""
    p, a = _c(precip), _c(apparent)
    items = [wind_reason(wind)]
    items += [F.when(p >= t[1], F.lit(t[3])) for t in CRITERIA_RAIN]
    items += [F.when(a >= t[1], F.lit(t[3])) for t in CRITERIA_HEAT]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, wind="windspeed_10m", precip="precipitation",
                apparent="apparent_temperature") -> DataFrame:
    """Adds ``rule_level`` and ``rule_reasons`` (works on hourly or daily rows)."""
    return df.withColumns({
        "rule_level": rule_level(wind, precip, apparent),
        "rule_reasons": rule_reasons(wind, precip, apparent),
    })


def rule_agreement(df: DataFrame, rule_col: str = "rule_level",
                   actual_col: str = "level") -> DataFrame:
    """How often the rule level equals, exceeds or undercuts the recorded one."""
    return (df.groupBy(F.col(rule_col).alias("rule_level"),
                       F.col(actual_col).alias("actual_level"))
            .agg(F.count(F.lit(1)).alias("n")))
