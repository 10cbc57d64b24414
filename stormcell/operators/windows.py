"""Per-series window features: rolling means, lags, peak flags (training path)
and the day-bounded head/tail features used when scoring one (city, day).

Layout.  A plain ``Window.partitionBy(city)`` gives at most one task per city;
a city holding a third of all rows would become one task holding a third of
the data.  The halo layout splits a series into calendar blocks (week by
default) and copies the last ``H`` rows before each block into it, so
row-based frames of up to ``H + 1`` rows and lags up to ``H`` are exact while
every (city, block) is its own window partition.  The copied rows are chosen by
exact row counts, so gaps and short blocks are handled: a block with fewer
than ``H`` rows passes rows on from the blocks before it.  The default
``auto`` layout applies it only to series above a size bound (the hot keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LAGS, ROLL_WINDOWS
from ..session import checkpoint

_BLK, _HALO, _N, _J = "_blk", "_halo", "_n", "_j"


def _block(ts: Column, unit: str) -> Column:
    d = F.to_date(ts)
    return d if unit == "day" else F.trunc(d, unit)


def halo_layout(df: DataFrame, keys: list[str], order: str, halo: int,
                unit: str = "week", hot_col: str | None = None) -> DataFrame:
    """Rows of ``df`` tagged with a block column, plus copies of the ``halo``
    rows that precede each block (``_halo = true``).  Window over
    ``keys + [_blk]`` ordered by ``order`` and drop the halo rows afterwards.

    Each block's last ``halo`` rows are found with ``row_number() <= halo``:
    Spark evaluates that top-k map-side (WindowGroupLimit), so at most
    ``halo`` rows per block and task are shuffled, whole.  They are joined with
    the small (block -> later block) table, whose size is proportional to the
    number of blocks, never to the rows: the full table is not joined at all.
    Order keys are assumed unique within a series (the hourly grid); tied keys
    would make any row frame order-dependent anyway.

    With ``hot_col`` only rows flagged hot are split into blocks; the other
    series keep one window partition each (null block) and need no copies.
    """
    from .lookups import broadcast_checked

    blk = _block(F.col(order), unit)
    if hot_col:
        blk = F.when(F.col(hot_col), blk).otherwise(F.lit(None).cast("date"))
    base = df.withColumn(_BLK, blk)
    hot_rows = base.filter(F.col(hot_col)) if hot_col else base
    # rows per (series, block): partial aggregate, one row per block and task
    counts = hot_rows.groupBy(*keys, _BLK).agg(F.count(F.lit(1)).alias(_N))
    wk = Window.partitionBy(*keys).orderBy(_BLK)
    lead_cols = {}
    for k in range(1, halo + 1):
        lead_cols[f"_d{k}"] = F.lead(_BLK, k).over(wk)
        lead_cols[f"_c{k}"] = F.lead(_N, k).over(wk)
    led = counts.select(*keys, F.col(_BLK).alias("_src"), *[e.alias(n) for n, e in lead_cols.items()])
    entries = []
    between = F.lit(0).cast("long")
    for k in range(1, halo + 1):
        entries.append(F.struct(F.col(f"_d{k}").alias("dst"), between.alias("between")))
        between = between + F.coalesce(F.col(f"_c{k}"), F.lit(0)).cast("long")
    # (src block, dst block, rows strictly between them) for every later block
    # that still needs rows from src
    pairs = (led.select(*keys, "_src", F.inline(F.array(*entries)))
             .filter(F.col("dst").isNotNull() & (F.col("between") < halo)))
    w = Window.partitionBy(*keys, _BLK).orderBy(F.desc(order))
    tails = (hot_rows.withColumn(_J, F.row_number().over(w))
             .filter(F.col(_J) <= halo)
             .withColumnRenamed(_BLK, "_src"))
    copies = (tails.join(broadcast_checked(pairs, materialize=True), [*keys, "_src"])
              .filter(F.col(_J) + F.col("between") <= halo)
              .withColumn(_BLK, F.col("dst"))
              .drop("_src", "dst", "between", _J))
    core = base.withColumn(_HALO, F.lit(False))
    return core.unionByName(copies.withColumn(_HALO, F.lit(True)))


def rolling_lag_columns(w: Window, windows=ROLL_WINDOWS, lags=LAGS,
                        temp_fill: Column | None = None) -> dict[str, Column]:
    """Rolling means (``w`` rows incl. the current one, at least one row) of rain
    and wind, lags of rain (fill 0) and temperature (fill ``temp_fill``)."""
    cols: dict[str, Column] = {}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), Window.currentRow)
        cols[f"precip_roll_{n}h"] = F.avg("precipitation").over(frame)
        cols[f"wind_roll_{n}h"] = F.avg("windspeed_10m").over(frame)
    tf = F.lit(None).cast("double") if temp_fill is None else temp_fill
    for k in lags:
        # coalesce, not lag's default: interior nulls are filled too
        cols[f"precip_lag_{k}h"] = F.coalesce(F.lag("precipitation", k).over(w), F.lit(0.0))
        cols[f"temp_lag_{k}h"] = F.coalesce(F.lag("temperature_2m", k).over(w), tf)
    return cols


# Peak flags -- the reading exceeds this multiple of its
# 6-row mean (flag, reading, mean, factor).
PEAKS = [
    ("is_precip_peak", "precipitation", "precip_roll_6h", 1.5),
    ("is_wind_peak", "windspeed_10m", "wind_roll_6h", 1.3),
]


def peak_columns() -> dict[str, Column]:
    """Sudden-change flags against the 6-row mean (strict)."""
    return {flag: F.coalesce((F.col(x) > F.col(mean) * factor).cast("int"), F.lit(0))
            for flag, x, mean, factor in PEAKS}


def hot_series(df: DataFrame, key: str, max_series_rows: int) -> DataFrame:
    """Series with more than ``max_series_rows`` rows (partial aggregate; the
    result has at most total_rows / max_series_rows rows)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
            .filter(F.col("_rows") > max_series_rows)
            .select(key, F.lit(True).alias("_hot")))


def series_features(df: DataFrame, key: str = "city", order: str = "date",
                    windows=ROLL_WINDOWS, lags=LAGS, temp_fill: Column | None = None,
                    layout: str = "auto", block_unit: str = "week",
                    max_series_rows: int = 2_000_000) -> DataFrame:
    """W1 + W2 + W3 in one window pass (one sort per partition).

    ``auto`` splits only series longer than ``max_series_rows`` into halo
    blocks (salting the hot keys) and keeps every other series whole;
    ``halo`` blocks every series; ``plain`` partitions by the key alone.
    """
    from .lookups import broadcast_checked

    hot = None
    if layout == "auto":
        hot = checkpoint(hot_series(df, key, max_series_rows))
        if hot.limit(1).count() == 0:
            layout = "plain"  # no series needs splitting: one exchange, no halo
    if layout == "plain":
        w = Window.partitionBy(key).orderBy(order)
        out = df.withColumns(rolling_lag_columns(w, windows, lags, temp_fill))
        return out.withColumns(peak_columns())
    halo = max(max(windows) - 1, max(lags))
    if layout == "auto":
        hot = broadcast_checked(hot)
        tagged = (df.join(hot, key, "left")
                  .withColumn("_hot", F.coalesce(F.col("_hot"), F.lit(False))))
        laid = halo_layout(tagged, [key], order, halo, block_unit, hot_col="_hot").drop("_hot")
    elif layout == "halo":
        laid = halo_layout(df, [key], order, halo, block_unit)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    w = Window.partitionBy(key, _BLK).orderBy(order)
    out = (laid.withColumns(rolling_lag_columns(w, windows, lags, temp_fill))
           .filter(~F.col(_HALO)).drop(_HALO, _BLK))
    return out.withColumns(peak_columns())


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def serving_day_features(obs: DataFrame, windows=ROLL_WINDOWS, lags=LAGS,
                         with_summary: bool = False) -> DataFrame:
    """Per (city, day), the scoring-time stand-ins for the series features:

    * ``*_roll_{w}h``: mean of the first min(n, w) rows of the day,
    * ``*_lag_{k}h``: the k-th row from the end when k < n, else 0 for rain and
      the day's mean temperature,
    * ``first_ts``: the day's first timestamp (drives hour / weekday / month).

    Rows are first reduced to one per timestamp (map-side combine), so a day
    with many duplicate readings never becomes one huge window partition; the
    window then runs over at most one row per distinct timestamp.  With
    unique timestamps this equals ranking the raw rows; tied duplicates at a
    cut are counted pro rata (their mean), and a tied k-th row takes the
    largest of the tied values.  ``with_summary`` also returns the day's
    means (rain: total) from the same pass.
    """
    per_ts = obs.groupBy("city", F.to_date("date").alias("day"), "date").agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum("precipitation").alias("_sp"), F.count("precipitation").alias("_np"),
        F.sum("windspeed_10m").alias("_sw"), F.count("windspeed_10m").alias("_nw"),
        F.sum("temperature_2m").alias("_st"), F.count("temperature_2m").alias("_nt"),
        F.sum("relativehumidity_2m").alias("_sh"), F.count("relativehumidity_2m").alias("_nh"),
        F.sum("apparent_temperature").alias("_sa"), F.count("apparent_temperature").alias("_na"),
        F.max("precipitation").alias("_mp"), F.max("temperature_2m").alias("_mt"))
    w = Window.partitionBy("city", "day").orderBy("date")
    per_ts = (per_ts
              .withColumn("_hi", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn(_N, F.sum("_c").over(Window.partitionBy("city", "day")))
              .withColumn("_lo", F.col("_hi") - F.col("_c")))
    aggs = [F.min("date").alias("first_ts"), F.max(_N).alias("n_hours"),
            _safe_div(F.sum("_st"), F.sum("_nt")).alias("_temp_mean")]
    if with_summary:
        aggs += [_safe_div(F.sum("_st"), F.sum("_nt")).alias("temperature_2m"),
                 _safe_div(F.sum("_sh"), F.sum("_nh")).alias("relativehumidity_2m"),
                 F.coalesce(F.sum("_sp"), F.lit(0.0)).alias("precipitation"),
                 _safe_div(F.sum("_sa"), F.sum("_na")).alias("apparent_temperature"),
                 _safe_div(F.sum("_sw"), F.sum("_nw")).alias("windspeed_10m")]
    for n in windows:
        frac = (F.greatest(F.lit(0), F.least(F.col("_c"), F.lit(n) - F.col("_lo")))
                .cast("double") / F.col("_c").cast("double"))
        for name, sm, cnt in (("precip", "_sp", "_np"), ("wind", "_sw", "_nw")):
            aggs.append(_safe_div(F.sum(F.when(frac > 0, F.col(sm) * frac)),
                                  F.sum(F.col(cnt) * frac)).alias(f"{name}_roll_{n}h"))
    for k in lags:
        at_k = (F.col("_lo") <= F.col(_N) - k) & (F.col(_N) - k < F.col("_hi"))
        aggs.append(F.max(F.when(at_k, F.col("_mp"))).alias(f"_p{k}"))
        aggs.append(F.max(F.when(at_k, F.col("_mt"))).alias(f"_t{k}"))
    # the window already partitions by (city, day): this aggregate needs no new shuffle
    g = per_ts.groupBy("city", "day").agg(*aggs)
    lag_cols = {}
    for k in lags:
        has = F.col("n_hours") > k
        lag_cols[f"precip_lag_{k}h"] = F.when(has, F.col(f"_p{k}")).otherwise(F.lit(0.0))
        lag_cols[f"temp_lag_{k}h"] = F.when(has, F.col(f"_t{k}")).otherwise(F.col("_temp_mean"))
    return g.withColumns(lag_cols).drop(*[f"_p{k}" for k in lags],
                                        *[f"_t{k}" for k in lags], "_temp_mean")
