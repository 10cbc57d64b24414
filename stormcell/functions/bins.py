"""Derived weather columns: apparent delta and right-closed intensity bins.

Bins are right-closed, ``(a, b]``; ``Bucketizer`` is left-closed and is not used.
Values outside the training bins are clamped to the end bins (serving rule).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Right-closed bin edges, rain intensity 0..4 and wind category 0..3.
PRECIP_BINS = [-1, 0, 5, 15, 50, 200]
WIND_BINS = [-1, 20, 40, 60, 100]

# The inner edges decide; values beyond the outer edges are clamped into the
# first / last bin (the scoring-time rule) instead of failing.
PRECIP_EDGES = [float(e) for e in PRECIP_BINS[1:-1]]
WIND_EDGES = [float(e) for e in WIND_BINS[1:-1]]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def right_closed_bin(x, edges) -> Column:
    col = _c(x)
    expr = None
    for i, e in enumerate(edges):
        expr = (F.when(col <= e, F.lit(i)) if expr is None
                else expr.when(col <= e, F.lit(i)))
    return expr.when(col.isNotNull(), F.lit(len(edges))).cast("int")


def precip_intensity(x="precipitation") -> Column:
    return right_closed_bin(x, PRECIP_EDGES)


def wind_category(x="windspeed_10m") -> Column:
    return right_closed_bin(x, WIND_EDGES)


def apparent_temp_delta(apparent="apparent_temperature", temp="temperature_2m") -> Column:
    return _c(apparent) - _c(temp)
