"""Historical analytics over (date range x city set): one filtered frame,
persisted once, feeding the independent aggregates (KPIs, distinct days per
level, city ranking, box statistics, daily trend, hour x weekday means)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import aggregates as agg
from ..operators import filters


class HistoricalAnalytics:
    """Use as a context manager so the persisted slice is released."""

    def __init__(self, obs: DataFrame, start, end, cities=None,
                 pivot_variable: str = "temperature_2m"):
        self.filtered = filters.range_city_filter(obs, start, end, cities)
        self.pivot_variable = pivot_variable

    def __enter__(self) -> "HistoricalAnalytics":
        self.filtered.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *exc) -> None:
        self.filtered.unpersist()

    def results(self) -> dict[str, DataFrame]:
        f = self.filtered
        return {
            "kpis": agg.range_kpis(f),
            "days_per_level": agg.days_per_level(f),
            "city_ranking": agg.city_ranking(f),
            "box_stats": agg.box_stats(f),
            "daily_trend": agg.daily_trend(f),
            "hour_weekday": agg.hour_weekday_long(f, self.pivot_variable),
        }
