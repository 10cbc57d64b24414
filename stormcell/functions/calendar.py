"""Calendar features (hour, Monday-based weekday, month, weekend, rush hour)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rush hours.
RUSH_HOURS = [7, 8, 9, 17, 18, 19]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour(ts) -> Column:
    return F.hour(_c(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``; ``dayofweek`` is Sunday = 1)."""
    return F.weekday(_c(ts))


def month(ts) -> Column:
    return F.month(_c(ts))


def is_weekend(ts) -> Column:
    return (day_of_week(ts) >= 5).cast("int")


def is_rush_hour(ts) -> Column:
    return hour(ts).isin(RUSH_HOURS).cast("int")


def temporal_columns(ts="date") -> dict[str, Column]:
    return {
        "hour": hour(ts),
        "day_of_week": day_of_week(ts),
        "month": month(ts),
        "is_weekend": is_weekend(ts),
        "is_rush_hour": is_rush_hour(ts),
    }


def calendar_day(ts) -> Column:
    return F.to_date(_c(ts))


def day_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def long_date(ts) -> Column:
    return F.date_format(_c(ts), "MMMM dd, yyyy")


def compact_date(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd")


def day_range(ts, start, end) -> Column:
    """Calendar day of ``ts`` in [start, end], both ends inclusive, written as a
    half-open timestamp range so the predicate reaches the parquet scan."""
    lo = F.to_timestamp_ntz(F.lit(str(start)))
    hi = F.to_timestamp_ntz(F.lit(str(end))) + F.expr("INTERVAL 1 DAY")
    col = _c(ts)
    return (col >= lo) & (col < hi)
