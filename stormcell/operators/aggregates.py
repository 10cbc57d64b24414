"""Aggregations: city-day summaries, historical analytics, distributions.

All of them are plain ``groupBy().agg()`` jobs, so Spark runs a partial
(map-side) aggregate before the shuffle: a hot city or label only sends one
partial row per task across the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..schema import WEATHER_COLS
from .lookups import broadcast_checked
from .ordering import rank, running_total

# The variables compared in the correlation matrix, in display order.
CORR_VARS = ["temperature_2m", "relativehumidity_2m", "precipitation",
             "windspeed_10m", "apparent_temperature"]

# Box-plot variables.
BOX_VARS = ["precipitation", "windspeed_10m", "temperature_2m", "relativehumidity_2m"]


def summary_aggregates() -> list[Column]:
    """Mean temp/humidity/apparent/wind, total rain (0 when all null), hours."""
    return [
        F.avg("temperature_2m").alias("temperature_2m"),
        F.avg("relativehumidity_2m").alias("relativehumidity_2m"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.avg("apparent_temperature").alias("apparent_temperature"),
        F.avg("windspeed_10m").alias("windspeed_10m"),
        F.count(F.lit(1)).alias("n_hours"),
    ]


def city_day_summary(obs: DataFrame) -> DataFrame:
    """(city, day): mean temp/humidity/apparent/wind, total rain (0 when all null)."""
    return obs.groupBy("city", cal.calendar_day("date").alias("day")).agg(*summary_aggregates())


def day_level_mode(obs: DataFrame, label: str = "suspension") -> DataFrame:
    """(city, day): most frequent label, ties to the smallest."""
    return obs.groupBy("city", cal.calendar_day("date").alias("day")).agg(
        F.mode(label, deterministic=True).alias("level"))


def city_day_records(obs: DataFrame, label: str = "suspension") -> DataFrame:
    """Summary and day level in one aggregate (one shuffle)."""
    return obs.groupBy("city", cal.calendar_day("date").alias("day")).agg(
        F.avg("temperature_2m").alias("temperature_2m"),
        F.avg("relativehumidity_2m").alias("relativehumidity_2m"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.avg("apparent_temperature").alias("apparent_temperature"),
        F.avg("windspeed_10m").alias("windspeed_10m"),
        F.count(F.lit(1)).alias("n_hours"),
        F.mode(label, deterministic=True).alias("level"),
    )


def city_day_full(obs: DataFrame, label: str = "suspension") -> DataFrame:
    """Summary, day level and day extremes in one aggregate (one shuffle)."""
    return obs.groupBy("city", cal.calendar_day("date").alias("day")).agg(
        F.avg("temperature_2m").alias("temperature_2m"),
        F.avg("relativehumidity_2m").alias("relativehumidity_2m"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.avg("apparent_temperature").alias("apparent_temperature"),
        F.avg("windspeed_10m").alias("windspeed_10m"),
        F.count(F.lit(1)).alias("n_hours"),
        F.mode(label, deterministic=True).alias("level"),
        F.min("temperature_2m").alias("min_temp"),
        F.max("temperature_2m").alias("max_temp"),
        F.avg("temperature_2m").alias("avg_temp"),
        F.max("windspeed_10m").alias("max_wind"),
        F.avg("windspeed_10m").alias("avg_wind"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("total_precip"),
        F.max("precipitation").alias("max_precip_hour"),
    )


def level_thresholds(obs: DataFrame, label: str = "suspension") -> DataFrame:
    """Per level: rain mean/max, wind mean/max, humidity mean, count (one pass)."""
    return obs.groupBy(F.col(label).alias("level")).agg(
        F.avg("precipitation").alias("precipitation_mean"),
        F.max("precipitation").alias("precipitation_max"),
        F.avg("windspeed_10m").alias("windspeed_mean"),
        F.max("windspeed_10m").alias("windspeed_max"),
        F.avg("relativehumidity_2m").alias("humidity_mean"),
        F.count(F.lit(1)).alias("count"),
    ).filter(F.col("level").isNotNull())


def range_kpis(filtered: DataFrame) -> DataFrame:
    """Record count, share of suspended hours (%), mean rain, mean temperature."""
    suspended = F.coalesce((F.col("suspension") > 0).cast("int"), F.lit(0))
    return filtered.agg(
        F.count(F.lit(1)).alias("total_records"),
        (F.avg(suspended) * 100).alias("suspension_rate_pct"),
        F.avg("precipitation").alias("avg_precipitation"),
        F.avg("temperature_2m").alias("avg_temperature"),
    )


def days_per_level(filtered: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct calendar days per level over all chosen cities, levels < 5."""
    day = cal.calendar_day("date")
    n = F.approx_count_distinct(day) if approx else F.countDistinct(day)
    return (filtered.filter(F.col("suspension").isNotNull() & (F.col("suspension") < 5))
            .groupBy(F.col("suspension").alias("level")).agg(n.alias("days")))


def city_ranking(filtered: DataFrame) -> DataFrame:
    """Per city mean level and non-null count, ranked by mean (desc), then name."""
    agg = (filtered.filter(F.col("city").isNotNull()).groupBy("city")
           .agg(F.avg("suspension").alias("mean_level"),
                F.count("suspension").alias("n_records")))
    ranked = rank(agg, [F.desc_nulls_last("mean_level"), F.asc("city")])
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def daily_trend(filtered: DataFrame) -> DataFrame:
    return (filtered.groupBy(cal.calendar_day("date").alias("day"))
            .agg(F.avg("suspension").alias("avg_suspension")))


def hour_weekday_long(filtered: DataFrame, variable: str = "temperature_2m") -> DataFrame:
    """Mean of ``variable`` per (weekday, hour); empty cells are absent."""
    if variable not in WEATHER_COLS:
        raise ValueError(f"unknown variable {variable!r}")
    return (filtered.groupBy(cal.day_of_week("date").alias("weekday"),
                             cal.day_name("date").alias("day_name"),
                             cal.hour("date").alias("hour"))
            .agg(F.avg(variable).alias("mean_value"))
            .filter(F.col("mean_value").isNotNull()))


def hour_weekday_pivot(filtered: DataFrame, variable: str = "temperature_2m",
                       drop_empty: bool = True) -> DataFrame:
    """Wide form: one row per weekday (calendar order), one column per hour.

    With ``drop_empty`` (the pivot-table rule) only hours holding a value are
    columns; finding them is one small job (at most 24 values).  Otherwise
    all 24 hours are given explicitly and no job runs before the pivot.
    """
    if variable not in WEATHER_COLS:
        raise ValueError(f"unknown variable {variable!r}")
    with_hour = filtered.withColumn("hour", cal.hour("date"))
    if drop_empty:
        hours = sorted(r[0] for r in with_hour.filter(F.col(variable).isNotNull())
                       .select("hour").distinct().collect())
    else:
        hours = list(range(24))
    return (with_hour
            .groupBy(cal.day_of_week("date").alias("weekday"),
                     cal.day_name("date").alias("day_name"))
            .pivot("hour", hours)
            .agg(F.avg(variable))
            .orderBy("weekday"))


def corr_matrix(obs: DataFrame, variables=CORR_VARS) -> DataFrame:
    """Pearson r for every ordered pair, pairwise-complete, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i:]]
    row = obs.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    entries = []
    for a, b in pairs:
        entries.append(F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                                F.col(f"{a}__{b}").alias("r")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("var_x"), F.lit(a).alias("var_y"),
                                    F.col(f"{a}__{b}").alias("r")))
    return row.select(F.inline(F.array(*entries)))


def day_extremes(obs: DataFrame) -> DataFrame:
    return obs.groupBy("city", cal.calendar_day("date").alias("day")).agg(
        F.min("temperature_2m").alias("min_temp"),
        F.max("temperature_2m").alias("max_temp"),
        F.avg("temperature_2m").alias("avg_temp"),
        F.max("windspeed_10m").alias("max_wind"),
        F.avg("windspeed_10m").alias("avg_wind"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("total_precip"),
        F.max("precipitation").alias("max_precip_hour"),
        F.avg("relativehumidity_2m").alias("avg_humidity"),
    )


def value_histogram(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value) -> count of rows: a partial-aggregated shuffle, so a
    group holding most rows contributes one row per distinct value."""
    return (df.filter(F.col(value).isNotNull())
            .groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c")))


def quantiles_from_histogram(hist: DataFrame, groups: list[str], value: str,
                             probs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics) plus
    n, min and max per group, from a value histogram.  The running counts go
    over (group, value) as one line in range partitions, so a group of very
    many distinct values is spread over many tasks."""
    h = running_total(hist, [*groups, value], F.col("_c"), "_hi")
    h = h.withColumn("_lo", F.col("_hi") - F.col("_c"))
    per_group = h.groupBy(*groups).agg(
        F.min("_lo").alias("_base"), F.sum("_c").alias("_n"))
    # one row per group; the running counts then start at 0 in each of them
    h = (h.join(broadcast_checked(per_group, materialize=True), groups)
         .withColumn("_hi", F.col("_hi") - F.col("_base"))
         .withColumn("_lo", F.col("_lo") - F.col("_base")))
    aggs = [F.max("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")]
    for name, p in probs.items():
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo_i, hi_i = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(F.when((F.col("_lo") <= lo_i) & (lo_i < F.col("_hi")), F.col(value)))
                    .alias(f"_{name}_a"))
        aggs.append(F.max(F.when((F.col("_lo") <= hi_i) & (hi_i < F.col("_hi")), F.col(value)))
                    .alias(f"_{name}_b"))
        aggs.append(F.max(pos - lo_i).alias(f"_{name}_f"))
    out = h.groupBy(*groups).agg(*aggs)
    for name in probs:
        a, b, f = F.col(f"_{name}_a"), F.col(f"_{name}_b"), F.col(f"_{name}_f")
        out = out.withColumn(name, F.when(f == 0, a).otherwise(a + (b - a) * f))
    return out.drop(*[f"_{n}_{x}" for n in probs for x in "abf"])


def exact_quantiles(df: DataFrame, groups: list[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, from a value histogram.

    Cost grows with the number of distinct values per group (readings
    quantised to sensor resolution keep it small), not with the row count.
    """
    return quantiles_from_histogram(value_histogram(df, groups, value), groups, value, probs)


def _long_by_level(obs: DataFrame, variables) -> DataFrame:
    stack = F.inline(F.array(*[F.struct(F.lit(v).alias("variable"),
                                        F.col(v).cast("double").alias("value"))
                               for v in variables]))
    return (obs.select(F.col("suspension").alias("level"), stack)
            .filter(F.col("value").isNotNull() & F.col("level").isNotNull()))


def _with_fences(stats: DataFrame) -> DataFrame:
    return (stats.withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("fence_low", F.col("q1") - 1.5 * F.col("iqr"))
            .withColumn("fence_high", F.col("q3") + 1.5 * F.col("iqr")))


def _tail_aggs(weight):
    outside = (F.col("value") < F.col("fence_low")) | (F.col("value") > F.col("fence_high"))
    return [F.sum(F.when(outside, weight).otherwise(0)).cast("long").alias("n_outliers"),
            F.min(F.when(F.col("value") >= F.col("fence_low"), F.col("value"))).alias("whisker_low"),
            F.max(F.when(F.col("value") <= F.col("fence_high"), F.col("value"))).alias("whisker_high")]


BOX_COLS = ["level", "variable", "n", "min", "q1", "median", "q3", "max", "iqr",
            "fence_low", "fence_high", "n_outliers", "whisker_low", "whisker_high"]


def box_stats(obs: DataFrame, variables=BOX_VARS, approx_accuracy: int | None = None) -> DataFrame:
    """Five-number summary per (level, variable) with 1.5*IQR fences, whiskers
    and the outlier count.

    Exact path: one pass over the rows builds the value histogram; quartiles
    (linear interpolation), extremes, fences, whiskers and outliers all come
    from it.  ``approx_accuracy`` uses the bounded-memory quantile sketch and a
    second pass over the rows for the tails, for unbounded value cardinality.
    """
    keys = ["level", "variable"]
    long = _long_by_level(obs, variables)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if approx_accuracy:
        arr = F.array(*[F.lit(p) for p in probs.values()])
        stats = (long.groupBy(*keys)
                 .agg(F.percentile_approx("value", arr, approx_accuracy).alias("_q"),
                      F.count(F.lit(1)).alias("n"), F.min("value").alias("min"),
                      F.max("value").alias("max"))
                 .select(*keys, "n", "min", "max", *[F.col("_q")[i].alias(k)
                                                     for i, k in enumerate(probs)]))
        base, weight = long, F.lit(1)
    else:
        # used twice below; the identical exchange is reused within the query
        hist = value_histogram(long, keys, "value")
        stats = quantiles_from_histogram(hist, keys, "value", probs)
        base, weight = hist, F.col("_c")
    stats = _with_fences(stats)
    # one row per (level, variable): materialised once, broadcast after the size check
    fences = broadcast_checked(stats.select(*keys, "fence_low", "fence_high"), materialize=True)
    tails = base.join(fences, keys).groupBy(*keys).agg(*_tail_aggs(weight))
    return stats.join(tails, keys).select(*BOX_COLS)


def class_distribution(df: DataFrame, label: str = "suspension") -> DataFrame:
    """Count and percentage per label; the share is taken over the aggregated rows."""
    counts = df.groupBy(F.col(label).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def dataset_profile(obs: DataFrame) -> DataFrame:
    """Rows, first/last timestamp and the sorted distinct cities."""
    return obs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.array_sort(F.collect_set("city")).alias("_cities"),
    ).select("n_rows", "min_date", "max_date",
             F.size("_cities").cast("bigint").alias("n_cities"),
             F.array_join("_cities", ",").alias("cities"))
