"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (``weather_obs`` is derived from
``events`` and ``nation``) and runs over all of them; parameters such as the
slice day or the city list are fixed below so the SQL oracle can repeat them.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import bins, labels
from .functions import calendar as cal
from .operators import aggregates as agg
from .operators import (band_rules, filters, impute, lookups, rules, sampling, scaling, scores,
                        sketches, windows)
from .plans import features as feat
from .plans import rollup, scoring, serving, training, trees, window_store
from .schema import FEATURES, OBS_SCHEMA, SCALED_COLS, WEATHER_COLS
from .session import checkpoint, land_once, landed_path, scratch_path, source_state
from .sources import clustered, csv_source, dims, forecast, publish, rejects
from .sources.fixture import city_dim_from_sites, load_obs, read_table
from .streaming import city_day_stream as stream
from .streaming import forecast_stream
from .streaming import stateful_city_day as stateful

# Fixed query parameters (repeated in the oracle SQL).
SLICE_DAY = "2024-01-15"
SLICE_CITY = "NATION_3"
RANGE_START = "2024-01-05"
RANGE_END = "2024-01-12"
RANGE_CITIES = ["NATION_1", "NATION_4", "NATION_9"]
PIVOT_VARIABLE = "temperature_2m"
SCATTER_PAIR = ("temperature_2m", "precipitation")
SCENARIO_TEMP = [0.0, 5.0, 10.0]
SCENARIO_PRECIP = [0.0, 10.0, 25.0]
SCENARIO_WIND = [0.0, 40.0, 100.0]
SCENARIO_HUMIDITY = [0.0, 15.0]
SCENARIO_HOURS = [8, 17]
SCENARIO_DAYS = [0, 45]   # shifts of the date: weekday and month change with it
FORECAST_DAYS = 7


def _obs(spark, sf_dir) -> DataFrame:
    return load_obs(spark, sf_dir)


def _medians(spark, sf_dir) -> dict[str, float | None]:
    """The fitted medians, landed once per state of the data."""
    schema = ", ".join(f"{c} double" for c in impute.MEDIAN_COLS)

    def write(path):
        found = impute.fit_medians(_obs(spark, sf_dir))
        (spark.createDataFrame([tuple(found[c] for c in impute.MEDIAN_COLS)], schema).coalesce(1)
         .write.mode("overwrite").parquet(path))

    path = land_once(spark, landed_path(spark, "medians", sf_dir), write)
    return spark.read.schema(schema).parquet(path).first().asDict()


def _imputed(spark, sf_dir) -> DataFrame:
    return impute.impute(_obs(spark, sf_dir), _medians(spark, sf_dir))


def _filtered(spark, sf_dir) -> DataFrame:
    obs = load_obs(spark, sf_dir, RANGE_START, RANGE_END)  # month folders pruned
    return filters.range_city_filter(obs, RANGE_START, RANGE_END, RANGE_CITIES)


def _ntz(value) -> F.Column:
    """A wall-clock literal: parsed from text, so no time zone is applied."""
    return F.to_timestamp_ntz(F.lit(str(value)))


def _reasons_text(col="rule_reasons"):
    return F.array_join(F.col(col), "; ")


# ---- sources -------------------------------------------------------------

def q_scan_obs(spark, sf_dir):
    """The hourly table landed as CSV (once per data folder) and read back
    with the explicit schema."""
    path = land_once(spark, landed_path(spark, "obs-csv", sf_dir),
                     lambda p: csv_source.write_obs_csv(_obs(spark, sf_dir), p))
    return csv_source.read_obs_csv(spark, path)


def q_forecast_explode(spark, sf_dir):
    """One JSON document of parallel hourly arrays per (city, day) is landed,
    read with its schema and exploded back to one row per hour."""
    path = land_once(spark, landed_path(spark, "forecast-json", sf_dir),
                     lambda p: forecast.land_forecast_docs(
                         forecast.docs_from_hourly(_obs(spark, sf_dir)), p))
    return forecast.read_forecast(spark, path)


def _broken_obs_csv(spark, sf_dir):
    """The hourly table as CSV lines, of which some hours are broken in one of five
    ways; landed once per data folder, split over files with a header each."""
    def line(*parts):
        return F.concat_ws(",", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, F.Column)
                                  else F.lit(p) for p in parts])

    when, hour, city = F.date_format("date", csv_source.TS_FORMAT), F.hour("date"), F.col("city")
    text = (F.when(hour == 3, line(city, when))
            .when(hour == 7, line(city, "someday", "1,2,3,4,5,0"))
            .when(hour == 11, line("", when, "1,2,3,4,5,0"))
            .when(hour == 13, line(city, when, "1,2,x,4,5,0"))
            .when(hour == 17, line(city, when, "1,2,3,4,5,6,7,8"))
            .otherwise(line(city, when, *[F.col(c) for c in [*WEATHER_COLS, "suspension"]])))

    def write(path):
        header = ",".join(f.name for f in OBS_SCHEMA.fields)
        rows = _obs(spark, sf_dir).select(text.alias("value"))
        rows.unionAll(spark.createDataFrame([(header,)] * 3, "value string")).write.mode("overwrite").text(path)

    return land_once(spark, landed_path(spark, "obs-csv-broken", sf_dir), write)


def _checked_obs(spark, sf_dir):
    """Good rows and rejects of the broken CSV, landed in one pass."""
    source = _broken_obs_csv(spark, sf_dir)
    checked = csv_source.checked_obs_csv(spark, source)
    path = land_once(spark, landed_path(spark, "obs-checked", sf_dir), lambda p: rejects.land(checked, p))
    return rejects.read_landed(spark, path, checked.schema)


def q_scan_obs_checked(spark, sf_dir):
    """S1 with broken lines in the files: the good rows."""
    return _checked_obs(spark, sf_dir)[0]


def q_scan_obs_rejects(spark, sf_dir):
    """S1's quarantine: every broken line with its reason."""
    return _checked_obs(spark, sf_dir)[1].select("line", "reason")


def _checked_forecast(spark, sf_dir):
    """Forecast documents of every recorded (city, day), some days broken in one of
    five ways, checked and landed in one pass."""
    city, day = F.col("city"), F.col("date")
    which = F.dayofmonth(day.cast("date")) % 9

    def text(*parts):
        return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])

    head = ('{"city":"', city, '","date":"', day, '","hourly":{"time":[')
    empty = '"],"temperature_2m":[],"relativehumidity_2m":[],"precipitation":[],' \
            '"apparent_temperature":[],"windspeed_10m":[]}}'
    one = '"],"temperature_2m":[1],"relativehumidity_2m":[1],"precipitation":[1],' \
          '"apparent_temperature":[1],"windspeed_10m":[1]}}'
    line = (F.when(which == 2, text(*head))
            .when(which == 4, text('{"date":"', day, '"}'))
            .when(which == 6, text(*head, '"', day, "T00:00", empty))
            .when(which == 8, text(*head, '"', day, 'T00:00"]}}'))
            .when(which == 0, text(*head, '"soon', one))
            .otherwise(F.to_json(F.struct("city", "date", "hourly"))))

    def write(path):
        (forecast.docs_from_hourly(_obs(spark, sf_dir)).select(line.alias("value"))
         .write.mode("overwrite").text(path))

    source = land_once(spark, landed_path(spark, "forecast-broken", sf_dir), write)
    checked = forecast.checked_forecast(spark, source)
    path = land_once(spark, landed_path(spark, "forecast-checked", sf_dir), lambda p: rejects.land(checked, p))
    return rejects.read_landed(spark, path, checked.schema)


def q_forecast_checked(spark, sf_dir):
    """S2 / F25 with broken documents in the files: the hours of the sound ones."""
    return forecast.hourly_rows(_checked_forecast(spark, sf_dir)[0])


def q_forecast_rejects(spark, sf_dir):
    """S2's quarantine: every broken document with its reason."""
    return _checked_forecast(spark, sf_dir)[1].select("line", "reason")


def q_dataset_profile(spark, sf_dir):
    return agg.dataset_profile(_obs(spark, sf_dir))


# ---- filters / imputation -------------------------------------------------

def q_city_day_slice(spark, sf_dir):
    obs = load_obs(spark, sf_dir, SLICE_DAY, SLICE_DAY)  # one month folder
    return filters.city_day_slice(obs, SLICE_DAY, SLICE_CITY)


def q_range_city_filter(spark, sf_dir):
    return _filtered(spark, sf_dir)


def q_impute_obs(spark, sf_dir):
    return _imputed(spark, sf_dir)


def q_route_mode(spark, sf_dir):
    """Requested days (order dates, recorded days, the week after the data)
    routed to history or forecast."""
    obs = _obs(spark, sf_dir)
    lo, hi = filters.data_bounds(obs)
    orders = read_table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("request_date"))
    recorded = obs.select(F.to_date("date").alias("request_date"))
    ahead = spark.range(1, FORECAST_DAYS + 1).select(
        F.date_add(F.lit(hi), F.col("id").cast("int")).alias("request_date"))
    req = orders.union(recorded).union(ahead).distinct()
    return filters.route_mode(req, (lo, hi))


# ---- lookups --------------------------------------------------------------

def _cities(spark, sf_dir) -> DataFrame:
    """The city dimension, landed once per state of the data: making it scans the
    events, looking it up does not."""
    path = land_once(spark, landed_path(spark, "city-dim", sf_dir), lambda p: city_dim_from_sites(
        read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "nation"))
        .write.mode("overwrite").parquet(p))
    return spark.read.schema(dims.CITY_SCHEMA).parquet(path)


def q_enrich_city(spark, sf_dir):
    """One coordinate lookup per customer's home city (grows with the
    customer table); cities without coordinates keep ``known = false``."""
    nation = read_table(spark, sf_dir, "nation")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    names = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    req = customers.join(names, "c_nationkey").select("c_custkey", "city")
    return lookups.enrich_city(req, _cities(spark, sf_dir))


def q_city_rejects(spark, sf_dir):
    """J1's reject output: requests for a site of each customer's nation that the
    dimension does not hold."""
    names = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    site = F.col("c_custkey") % 12
    req = (read_table(spark, sf_dir, "customer").join(names, "c_nationkey")
           .select("c_custkey", F.when(site == 0, F.col("n_name")).otherwise(
               F.concat("n_name", F.lit("#"), site.cast("string"))).alias("city")))
    return lookups.unknown_cities(req, _cities(spark, sf_dir))


def q_enrich_level(spark, sf_dir):
    days = agg.day_level_mode(_obs(spark, sf_dir))
    return lookups.enrich_level(days, dims.level_dim(spark)).select(
        "city", "day", "level", "level_name", "color", "risk")


def q_suspension_map(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    days = agg.day_level_mode(obs)
    return lookups.suspension_map(days, _cities(spark, sf_dir), dims.level_dim(spark)).select(
        "city", "day", "lat", "lon", "level", "level_name", "color", "risk")


# ---- rules ----------------------------------------------------------------

def q_rule_wind(spark, sf_dir):
    return _obs(spark, sf_dir).select(
        "city", "date", rules.wind_signal().alias("wind_signal"),
        rules.wind_level().alias("wind_level"))


def q_rule_rain(spark, sf_dir):
    return _obs(spark, sf_dir).select(
        "city", "date", rules.rain_level().alias("rain_level"),
        rules.rain_matches().alias("rain_matches"))


def q_rule_heat(spark, sf_dir):
    return _obs(spark, sf_dir).select(
        "city", "date", rules.heat_level().alias("heat_level"),
        rules.heat_matches().alias("heat_matches"))


def q_rule_engine(spark, sf_dir):
    """R1 on each day's metrics (mean wind, total rain, mean apparent temp)."""
    days = rules.apply_rules(agg.city_day_summary(_obs(spark, sf_dir)))
    return days.select("city", "day", "rule_level",
                       F.size("rule_reasons").alias("n_reasons"),
                       _reasons_text().alias("reasons"))


BANDS_CHANGE = "2024-01-15"


def _band_rules(spark, sf_dir, bands):
    days = band_rules.apply_bands(agg.city_day_summary(_obs(spark, sf_dir)), bands)
    return days.select("city", "day", "rule_level", F.size("rule_reasons").alias("n_reasons"),
                       _reasons_text().alias("reasons"))


def q_rule_bands(spark, sf_dir):
    """S5 / R1 from the band table: the rows of ``rule_engine``."""
    return _band_rules(spark, sf_dir, band_rules.standard_bands(spark))


def q_rule_bands_changed(spark, sf_dir):
    """The first rain band has another threshold and level from a day on."""
    bands = band_rules.standard_bands(spark)
    changed = F.to_date(F.lit(BANDS_CHANGE))
    first = (F.col("rule") == "rain") & (F.col("position") == 0)
    old = bands.where(first).withColumn("valid_to", changed)
    new = bands.where(first).withColumns({
        "low": F.lit(2.5), "suspension": F.lit(2), "description": F.lit("Rain from 2.5 mm"),
        "valid_from": changed})
    return _band_rules(spark, sf_dir, bands.where(~first).unionByName(old).unionByName(new))


def q_rule_reasons(spark, sf_dir):
    """F13 on hourly rows."""
    hours = rules.apply_rules(_obs(spark, sf_dir))
    return hours.select("city", "date", "rule_level", _reasons_text().alias("reasons"))


def q_rule_agreement(spark, sf_dir):
    days = rules.apply_rules(agg.city_day_records(_obs(spark, sf_dir)))
    return rules.rule_agreement(days, "rule_level", "level")


def q_final_decision(spark, sf_dir):
    days = agg.city_day_records(_obs(spark, sf_dir))
    d = serving.decide(days, dims.level_dim(spark))
    return d.select("city", "day", "level", "rule_level", "final_level",
                    "decision_source", "level_name", "risk")


# ---- aggregates -----------------------------------------------------------

def q_city_day_summary(spark, sf_dir):
    return agg.city_day_summary(_obs(spark, sf_dir))


def q_day_level_mode(spark, sf_dir):
    return agg.day_level_mode(_obs(spark, sf_dir))


def q_level_thresholds(spark, sf_dir):
    return agg.level_thresholds(_imputed(spark, sf_dir))


def q_range_kpis(spark, sf_dir):
    return agg.range_kpis(_obs(spark, sf_dir))


def q_days_per_level(spark, sf_dir):
    return agg.days_per_level(_obs(spark, sf_dir))


def q_city_ranking(spark, sf_dir):
    return agg.city_ranking(_obs(spark, sf_dir))


def q_daily_trend(spark, sf_dir):
    return agg.daily_trend(_obs(spark, sf_dir))


def q_hour_weekday_pivot(spark, sf_dir):
    return agg.hour_weekday_long(_obs(spark, sf_dir), PIVOT_VARIABLE)


def q_hour_weekday_wide(spark, sf_dir):
    """A8 as a fixed-width report: all 24 hour columns (empty hours are null).
    The pivot-table rule that drops empty hours (``drop_empty=True``, the
    library default) yields data-dependent columns; it is unit-tested, and the
    long form above carries the same cells with an oracle."""
    wide = agg.hour_weekday_pivot(_obs(spark, sf_dir), PIVOT_VARIABLE, drop_empty=False)
    return wide.select("weekday", "day_name",
                       *[F.col(c).alias(f"h{int(c):02d}") for c in wide.columns[2:]])


def q_corr_matrix(spark, sf_dir):
    m = agg.corr_matrix(_obs(spark, sf_dir))
    return m.select("var_x", "var_y", F.round("r", 9).alias("r"))


def q_corr_label(spark, sf_dir):
    m = agg.corr_matrix(_obs(spark, sf_dir)).filter(F.col("var_x") != F.col("var_y"))
    lo = F.least("var_x", "var_y")
    hi = F.greatest("var_x", "var_y")
    sentence = None
    for a, b, text in labels.PAIR_SENTENCES:
        k1, k2 = sorted((a, b))
        cond = (lo == k1) & (hi == k2)
        sentence = F.when(cond, F.lit(text)) if sentence is None else sentence.when(cond, F.lit(text))
    sentence = sentence.otherwise(F.lit(labels.NO_PATTERN))
    return m.select(F.col("var_x").alias("var1"), F.col("var_y").alias("var2"),
                    F.round("r", 9).alias("r"), labels.correlation_label("r").alias("label"),
                    sentence.alias("sentence"))


def _rollup(spark, sf_dir):
    """The stored partials of the hourly table, landed once per state of the data."""
    path = land_once(spark, landed_path(spark, "rollup", sf_dir),
                     lambda p: rollup.store(_obs(spark, sf_dir), p), marker=f"{rollup.BITMAPS}/_SUCCESS")
    return rollup.Rollup(spark, path)


def q_rollup_kpis(spark, sf_dir):
    """A4 from the partials."""
    return _rollup(spark, sf_dir).kpis()


def q_rollup_ranking(spark, sf_dir):
    return _rollup(spark, sf_dir).city_ranking()


def q_rollup_trend(spark, sf_dir):
    return _rollup(spark, sf_dir).daily_trend()


def q_rollup_hour_weekday(spark, sf_dir):
    return _rollup(spark, sf_dir).hour_weekday(PIVOT_VARIABLE)


def q_rollup_extremes(spark, sf_dir):
    return _rollup(spark, sf_dir).day_extremes()


def q_rollup_correlations(spark, sf_dir):
    """A9 from sums of products; without the diagonal, which is 1."""
    m = _rollup(spark, sf_dir).correlations().where("var_x <> var_y")
    return m.select("var_x", "var_y", F.round("r", 9).alias("r"))


def q_rollup_days_per_level(spark, sf_dir):
    """A5 from the bitmaps."""
    return _rollup(spark, sf_dir).days_per_level()


def q_day_extremes(spark, sf_dir):
    return agg.day_extremes(_obs(spark, sf_dir))


def q_box_stats(spark, sf_dir):
    return agg.box_stats(_obs(spark, sf_dir))


def q_box_stats_approx(spark, sf_dir):
    """A12 with the bounded-memory quantile sketch (for unbounded value
    cardinality at scale); rows-only, as a sketch is not an exact oracle."""
    return agg.box_stats(_obs(spark, sf_dir), approx_accuracy=10_000)


def q_sketch_quartiles(spark, sf_dir):
    """A12 from merged day sketches: per (level, variable) the exact ends, and whether
    the quartiles' rank error is within twice the sketch's stated bound."""
    obs = _obs(spark, sf_dir)
    found = sketches.box_stats(sketches.day_sketches(obs))
    rows = sketches.long_rows(obs).where("level IS NOT NULL")
    errors = sketches.rank_errors(rows, found, ["level", "variable"])
    return errors.join(found.select("level", "variable", "min", "max"), ["level", "variable"]).select(
        "level", "variable", "n", "min", "max",
        (F.col("error") <= 2 * sketches.rank_error()).alias("within"))


def q_class_distribution(spark, sf_dir):
    return agg.class_distribution(_obs(spark, sf_dir))


def q_sample_pair(spark, sf_dir):
    return filters.sample_pair(_obs(spark, sf_dir), *SCATTER_PAIR)


# ---- scores (rule level vs recorded level, per hour) ----------------------

def _rule_predictions(spark, sf_dir):
    return _obs(spark, sf_dir).select(F.col("suspension").alias("actual"),
                                      rules.rule_level().alias("predicted"))


def q_confusion_matrix(spark, sf_dir):
    return scores.confusion_counts(_rule_predictions(spark, sf_dir))


def q_per_class_scores(spark, sf_dir):
    return scores.per_class_scores(scores.confusion_counts(_rule_predictions(spark, sf_dir)))


def q_aggregate_scores(spark, sf_dir):
    conf = scores.confusion_counts(_rule_predictions(spark, sf_dir))
    return scores.aggregate_scores(scores.per_class_scores(conf))


def q_confusion_rates(spark, sf_dir):
    return scores.confusion_rates(scores.confusion_counts(_rule_predictions(spark, sf_dir)))


# ---- windows --------------------------------------------------------------

def _series(spark, sf_dir, **layout):
    obs = _obs(spark, sf_dir)
    med = _medians(spark, sf_dir)
    filled = impute.impute(obs, med)
    return windows.series_features(filled, temp_fill=F.lit(med["temperature_2m"]), **layout)


def q_rolling_means(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.select("city", "date", *[f"{v}_roll_{n}h" for v in ("precip", "wind")
                                      for n in (3, 6, 12)])


def q_rolling_means_halo(spark, sf_dir):
    """W1 with every series split into daily blocks plus an 11-row halo -- the
    layout used for hot series -- checked against the same SQL."""
    s = _series(spark, sf_dir, layout="halo", block_unit="day")
    return s.select("city", "date", *[f"{v}_roll_{n}h" for v in ("precip", "wind")
                                      for n in (3, 6, 12)])


def q_lag_features(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.select("city", "date", *[f"{v}_lag_{k}h" for v in ("precip", "temp")
                                      for k in (1, 2, 3)])


def q_peak_flags(spark, sf_dir):
    return _series(spark, sf_dir).select("city", "date", "is_precip_peak", "is_wind_peak")


def q_series_upkeep(spark, sf_dir):
    """W1 - W3 from the table that is kept up to date: built without the last day, without
    an hour of some cities and with another hour read wrongly; the late hour, then the
    corrected one with the last day come as change sets."""
    obs, med = _imputed(spark, sf_dir), _medians(spark, sf_dir)
    day = F.to_date("date")
    last = obs.agg(F.max(day)).first()[0]
    at = (day == F.lit(SLICE_DAY).cast("date"))
    late = at & (F.hour("date") == 5) & (F.pmod(F.crc32("city"), F.lit(3)) == 0)
    wrong = at & (F.hour("date") == 7)
    path = scratch_path(spark, "series")
    window_store.build(obs.where(~late & (day < F.lit(last))).withColumn(
        "precipitation", F.when(wrong, F.col("precipitation") + 1).otherwise(F.col("precipitation"))), path)
    window_store.apply(obs.where(late), path)
    window_store.apply(obs.where(wrong | (day == F.lit(last))), path)
    s = window_store.read(spark, path)
    lags = {f"temp_lag_{k}h": F.coalesce(f"temp_lag_{k}h", F.lit(med["temperature_2m"])) for k in (1, 2, 3)}
    return s.withColumns(lags).select(
        "city", "date", *[f"{v}_roll_{n}h" for v in ("precip", "wind") for n in (3, 6, 12)],
        *[f"{v}_lag_{k}h" for v in ("precip", "temp") for k in (1, 2, 3)],
        "is_precip_peak", "is_wind_peak")


def q_rolling_means_clustered(spark, sf_dir):
    """W1 from the copy that is bucketed and sorted by series: no exchange."""
    path = landed_path(spark, "series-clustered", sf_dir)
    name = clustered.land(spark, path, lambda: _imputed(spark, sf_dir))
    return clustered.series_features(spark, name).select(
        "city", "date", *[f"{v}_roll_{n}h" for v in ("precip", "wind") for n in (3, 6, 12)])


def q_city_day_clustered(spark, sf_dir):
    """A1 from the same copy: days are inside the buckets."""
    path = landed_path(spark, "series-clustered", sf_dir)
    name = clustered.land(spark, path, lambda: _imputed(spark, sf_dir))
    return clustered.city_days(spark, name)


def q_serving_head_means(spark, sf_dir):
    s = windows.serving_day_features(_obs(spark, sf_dir))
    return s.select("city", "day", "first_ts", "n_hours",
                    *[f"{v}_roll_{n}h" for v in ("precip", "wind") for n in (3, 6, 12)])


def q_serving_tail_values(spark, sf_dir):
    s = windows.serving_day_features(_obs(spark, sf_dir))
    return s.select("city", "day", *[f"{v}_lag_{k}h" for v in ("precip", "temp")
                                     for k in (1, 2, 3)])


# ---- scalar functions -------------------------------------------------------

def q_temporal_features(spark, sf_dir):
    return _obs(spark, sf_dir).select("city", "date", *[
        e.alias(n) for n, e in cal.temporal_columns("date").items()])


def q_date_labels(spark, sf_dir):
    days = _obs(spark, sf_dir).select("city", F.to_date("date").alias("day")).distinct()
    return days.select("city", "day", cal.day_name("day").alias("day_name"),
                       cal.long_date("day").alias("long_date"),
                       cal.compact_date("day").alias("compact_date"))


def q_weather_bins(spark, sf_dir):
    return _imputed(spark, sf_dir).select(
        "city", "date", bins.apparent_temp_delta().alias("apparent_temp_delta"),
        bins.precip_intensity().alias("precip_intensity"),
        bins.wind_category().alias("wind_category"))


def q_encode_city(spark, sf_dir):
    return feat.city_codes(_obs(spark, sf_dir))


def q_risk_label(spark, sf_dir):
    days = agg.day_level_mode(_obs(spark, sf_dir))
    return days.withColumn("risk_level", labels.risk_label("level"))


def q_prob_pad(spark, sf_dir):
    """F17/F18 on each day's hourly level shares: padded/truncated to five
    levels and exploded to (level, pct)."""
    obs = _obs(spark, sf_dir)
    shares = obs.groupBy("city", F.to_date("date").alias("day")).agg(
        *[F.avg((F.col("suspension") == i).cast("double")).alias(f"p{i}") for i in range(6)])
    probs = F.array(*[F.col(f"p{i}") for i in range(6)])
    padded = shares.select("city", "day", labels.pad_probabilities(probs, 5).alias("p"))
    return padded.select("city", "day", F.posexplode("p").alias("level", "share")).select(
        "city", "day", "level", (F.col("share") * 100).alias("pct"))


def q_weather_alerts(spark, sf_dir):
    ext = agg.day_extremes(_obs(spark, sf_dir))
    a = ext.withColumn("a", labels.weather_alerts())
    return a.select("city", "day", F.size("a").alias("n_alerts"),
                    F.array_join("a", ", ").alias("alerts"))


# ---- split / sampling -------------------------------------------------------

def _train(spark, sf_dir):
    """The training rows, split once and kept: oversampling and folds read them
    several times."""
    return checkpoint(_split(spark, sf_dir).filter(~F.col("is_test")))


def _split(spark, sf_dir):
    return sampling.stratified_split(_obs(spark, sf_dir), "suspension",
                                     training.row_key_col(), 0.2)


def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("city", "date", "suspension", "is_test")


def q_time_split(spark, sf_dir):
    """Q7: the leak-free alternative -- the latest ~20 % of rows by time are test."""
    return sampling.time_split(_obs(spark, sf_dir), "date", 0.2).select(
        "city", "date", "suspension", "is_test")


def q_standardize(spark, sf_dir):
    train = (impute.impute_obs(_obs(spark, sf_dir))
             .withColumn("apparent_temp_delta", bins.apparent_temp_delta()))
    split = sampling.stratified_split(train, "suspension", training.row_key_col(), 0.2)
    params = scaling.fit_scaler(split.filter(~F.col("is_test")), SCALED_COLS)
    t = scaling.scaler_table(spark, params)
    return t.select("column", "mean", F.round("std", 9).alias("std"))


def q_class_weights(spark, sf_dir):
    train = _split(spark, sf_dir).filter(~F.col("is_test"))
    return sampling.class_weights(train, "suspension")


def q_oversample_counts(spark, sf_dir):
    train = _train(spark, sf_dir)
    over = sampling.oversample(train, "suspension", training.row_key_col(), 0.8,
                               noise_cols=WEATHER_COLS, noise_sd=0.02)
    return over.groupBy("suspension").agg(
        F.count(F.lit(1)).alias("n_after"),
        F.sum(F.col("is_synthetic").cast("long")).alias("n_synthetic"))


def q_oversample_copies(spark, sf_dir):
    """M4 per row: how many synthetic copies each training row received."""
    train = _train(spark, sf_dir)
    over = sampling.oversample(train, "suspension", training.row_key_col(), 0.8)
    return over.groupBy("city", "date", "suspension").agg(
        F.sum(F.col("is_synthetic").cast("int")).alias("n_copies"))


def q_oversample_noise(spark, sf_dir):
    train = _train(spark, sf_dir)
    return sampling.oversample(train, "suspension", training.row_key_col(), 0.8,
                               noise_cols=WEATHER_COLS, noise_sd=0.02)


def q_cv_folds(spark, sf_dir):
    train = _train(spark, sf_dir)
    return sampling.cv_folds(train, "suspension", training.row_key_col(), 5).select(
        "city", "date", "suspension", "fold")


# ---- model ------------------------------------------------------------------

def _model(spark, sf_dir):
    return scoring.fitted_model(spark, _obs(spark, sf_dir), "rf:" + ":".join(
        source_state(spark, sf_dir)))


def q_train_eval(spark, sf_dir):
    model, split, *_ = _model(spark, sf_dir)
    return training.evaluate(model, split.filter(F.col("is_test")))["per_class"]


def q_top_features(spark, sf_dir):
    model = _model(spark, sf_dir).model
    return (training.feature_importances(spark, model)
            .orderBy(F.desc("importance"), "feature").limit(10))


def q_split_importances(spark, sf_dir):
    """M9 as the reference counts it: splits per feature over all trees."""
    model = _model(spark, sf_dir).model
    return trees.split_counts(trees.node_table(spark, model), FEATURES)


def q_score_city_days(spark, sf_dir):
    model, split, *_ = _model(spark, sf_dir)
    return scoring.score_city_days(model, split.drop("is_test"))


def q_cv_accuracy(spark, sf_dir):
    """M8 + A21: 5-fold accuracy on the train split (folds fixed before
    oversampling), with mean and population std."""
    split = _model(spark, sf_dir).split
    cfg = training.TrainConfig(num_trees=5, max_depth=5)
    folds = training.cross_validate(split.filter(~F.col("is_test")).drop("is_test"), 5, cfg)
    return scores.with_fold_summary(folds)


def q_training_features(spark, sf_dir):
    """The assembled table, 28 features in their order."""
    return feat.training_features(_obs(spark, sf_dir))


def q_class_accuracy(spark, sf_dir):
    """A19 on the rules' levels."""
    return scores.per_class_accuracy(scores.confusion_counts(_rule_predictions(spark, sf_dir)))


def q_fold_accuracy(spark, sf_dir):
    """A21 on the rules: accuracy per fold, mean and population std over them."""
    folds = sampling.cv_folds(_train(spark, sf_dir), "suspension", training.row_key_col(), 5)
    hit = (F.col("suspension") == rules.rule_level()).cast("long")
    per = folds.groupBy("fold").agg(
        (F.sum(hit).cast("double") / F.count(F.lit(1)).cast("double")).alias("accuracy"))
    out = scores.with_fold_summary(per)
    return out.select("fold", "accuracy", F.round("accuracy_mean", 9).alias("accuracy_mean"),
                      F.round("accuracy_std", 9).alias("accuracy_std"))


def q_weighted_rows(spark, sf_dir):
    """The class weights joined to the training rows, summed per class."""
    train = _train(spark, sf_dir)
    weights = sampling.class_weights(train, "suspension").select("suspension", "weight")
    return (train.join(lookups.broadcast_checked(weights, materialize=True), "suspension")
            .groupBy("suspension").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.sum("weight"), 6).alias("weight")))


def q_sinks_roundtrip(spark, sf_dir):
    """S7-S11 without the model: the rules' scores, confusion table and level
    thresholds written through the sinks and read back."""
    from .sources.sinks import write_metrics
    conf = scores.confusion_counts(_rule_predictions(spark, sf_dir))
    per = scores.per_class_scores(conf)
    out = scratch_path(spark, "sinks")
    write_metrics(out, aggregate=scores.aggregate_scores(per), per_class=per, confusion=conf,
                  thresholds=agg.level_thresholds(_imputed(spark, sf_dir)))
    read = spark.read
    per = read.json(f"{out}/metrics_per_class").select(
        F.col("level").cast("int"), "precision", "recall", "f1", "support")
    limits = read.json(f"{out}/thresholds").select(
        F.col("level").cast("int"), "precipitation_mean", "windspeed_max", "humidity_mean", "count")
    wrong = (read.parquet(f"{out}/confusion_matrix").filter("actual <> predicted")
             .groupBy(F.col("actual").alias("level")).agg(F.sum("n").alias("n_wrong")))
    accuracy = read.json(f"{out}/metrics_aggregate").first()["accuracy"]
    return (per.join(limits, "level", "left").join(wrong, "level", "left")
            .withColumn("accuracy", F.lit(accuracy)))


def q_score_serving_days(spark, sf_dir):
    """M10, the reference's path: one feature row per (city, day) built from
    the day's aggregates, scored by the hourly-trained model."""
    obs = _obs(spark, sf_dir)
    model, _, codes, medians = _model(spark, sf_dir)
    rows = scoring.serving_feature_rows(obs, codes, medians)
    return scoring.score_serving_days(model, rows)


def q_artifacts_roundtrip(spark, sf_dir):
    """Evaluation, importances, thresholds and summary written through
    the sinks, then loaded back; returns the per-class metrics as read."""
    model, split, *_ = _model(spark, sf_dir)
    ev = training.evaluate(model, split.filter(F.col("is_test")))
    out = scratch_path(spark, "artifacts")
    training.save_artifacts(
        out, model, ev, training.feature_importances(spark, model),
        agg.level_thresholds(_imputed(spark, sf_dir)),
        training.training_summary(spark, split, ev["aggregate"]))
    return training.load_artifacts(spark, out)["metrics_per_class"]


# ---- serving ----------------------------------------------------------------

def _forecast_feed(spark, sf_dir, obs):
    """Stand-in for the forecast feed: the last week of readings landed as
    forecast documents one week later (once per data folder), read back."""
    _, hi = filters.data_bounds(obs)
    start = hi - dt.timedelta(days=FORECAST_DAYS - 1)
    ahead = (obs.filter(F.col("date") >= _ntz(dt.datetime.combine(start, dt.time())))
             .withColumn("date", F.col("date") + F.expr(f"INTERVAL {FORECAST_DAYS} DAYS")))
    path = land_once(spark, landed_path(spark, "forecast-feed", sf_dir),
                     lambda p: forecast.land_forecast_docs(forecast.docs_from_hourly(ahead), p))
    return forecast.read_forecast(spark, path)


def q_unified_city_day(spark, sf_dir):
    """Recorded days plus the forecast feed under one schema."""
    obs = _obs(spark, sf_dir)
    fc = serving.forecast_city_days(_forecast_feed(spark, sf_dir, obs))
    hist = serving.historical_city_days(obs)
    u = serving.unified_city_days(hist, fc)
    return u.select("mode", "city", "day", *WEATHER_COLS, "n_hours", "level",
                    "is_prediction", "confidence")


def _requests(obs):
    """Every recorded (city, day) and the same days two weeks later, within the
    days a user may pick (P10): the first recorded day to "today" + 7, with
    today = the last recorded day."""
    days = obs.select("city", F.to_date("date").alias("day")).distinct()
    wanted = days.union(days.select("city", F.date_add("day", 14).alias("day"))).distinct()
    lo, hi = filters.data_bounds(obs)
    return filters.request_bounds(wanted, lo, hi, FORECAST_DAYS, date_col="day")


def q_request_answers(spark, sf_dir):
    """E2 / J3 in batch: requested (city, day) pairs answered from history, or
    from the forecast summary joined with the model's prediction."""
    obs = _obs(spark, sf_dir)
    model, _, codes, medians = _model(spark, sf_dir)
    feed = _forecast_feed(spark, sf_dir, obs)
    fc_feats = feat.training_features(
        feed.withColumn("suspension", F.lit(None).cast("int")), medians=medians, codes=codes)
    preds = scoring.score_city_days(model, fc_feats)
    ans = serving.answer_requests(_requests(obs),
                                  serving.historical_city_days(obs).drop("probabilities"),
                                  serving.forecast_city_days(feed), preds)
    return ans.select("mode", "city", "day", *WEATHER_COLS, "level", "is_prediction",
                      "confidence", "risk_level")


def q_request_routing(spark, sf_dir):
    """P10 / J3 without the model's columns."""
    obs = _obs(spark, sf_dir)
    feed = _forecast_feed(spark, sf_dir, obs)
    ans = serving.answer_requests(_requests(obs), serving.historical_city_days(obs),
                                  serving.forecast_city_days(feed))
    return ans.select("mode", "city", "day", *WEATHER_COLS, "level", "is_prediction")


def q_unanswered_requests(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    feed = _forecast_feed(spark, sf_dir, obs)
    return serving.unanswered_requests(_requests(obs), serving.historical_city_days(obs),
                                       serving.forecast_city_days(feed)).select("city", "day")


BULLETIN = ["city", "day", "lat", "lon", "level", "rule_level", "final_level", "decision_source",
            "level_name", "risk", "scope", "recommendation"]
DAY_METRICS = ["min_temp", "max_temp", "avg_temp", "max_wind", "avg_wind", "total_precip",
               "max_precip_hour", "relativehumidity_2m"]


def q_advisory_bulletin(spark, sf_dir):
    b = serving.advisory_bulletin(_obs(spark, sf_dir), dims.level_dim(spark), _cities(spark, sf_dir))
    return b.select(*BULLETIN, _reasons_text().alias("reasons"),
                    F.array_join("alerts", ", ").alias("alerts"), *DAY_METRICS)


def _published(spark, sf_dir):
    """The bulletin published twice: without the afternoons of every fifth day, then
    whole."""
    obs, path = _obs(spark, sf_dir), scratch_path(spark, "bulletin")
    missing = (F.dayofmonth("date") % 5 == 0) & (F.hour("date") >= 12)
    for part in (obs.where(~missing), obs):
        b = serving.advisory_bulletin(part, dims.level_dim(spark), _cities(spark, sf_dir))
        serving.publish_bulletin(b.select(
            *BULLETIN, _reasons_text().alias("reasons"), F.array_join("alerts", ", ").alias("alerts"),
            *DAY_METRICS), path)
    return path


def q_published_bulletin(spark, sf_dir):
    """The published table after both runs."""
    return publish.read(spark, _published(spark, sf_dir))


def q_published_days(spark, sf_dir):
    """Which run wrote each day; the second one only those that had changed."""
    days = publish.manifest(spark, _published(spark, sf_dir)).where("day IS NOT NULL")
    return days.select("day", F.split("run", "-")[0].cast("int").alias("version"), "n")


def q_model_bulletin(spark, sf_dir):
    """S15 with the model: its level, confidence and five probabilities beside
    the rules, for every city-day."""
    model, split, *_ = _model(spark, sf_dir)
    scores_ = scoring.score_city_days(model, split.drop("is_test"))
    b = serving.advisory_bulletin(_obs(spark, sf_dir), dims.level_dim(spark),
                                  _cities(spark, sf_dir), scores_)
    return b.select(*BULLETIN, "model_level", "confidence", "probabilities",
                    _reasons_text().alias("reasons"), F.array_join("alerts", ", ").alias("alerts"),
                    *DAY_METRICS)


def _scenarios(spark, sf_dir):
    return serving.scenario_grid(
        agg.city_day_summary(_obs(spark, sf_dir)), SCENARIO_TEMP, SCENARIO_PRECIP, SCENARIO_WIND,
        humidity_offsets=SCENARIO_HUMIDITY, hours=SCENARIO_HOURS, day_shifts=SCENARIO_DAYS)


def q_scenario_grid(spark, sf_dir):
    return _scenarios(spark, sf_dir).select(
        "city", "day", "scenario", "s_humidity", "s_hour", "s_weekday", "s_month", "rule_level",
        _reasons_text().alias("reasons"))


def q_scenario_table(spark, sf_dir):
    """M11 with the combinations in a table."""
    combos = serving.scenario_combinations(
        SCENARIO_TEMP, SCENARIO_PRECIP, SCENARIO_WIND, SCENARIO_HUMIDITY, SCENARIO_HOURS, SCENARIO_DAYS)
    sets = spark.createDataFrame(
        [(i, float(t), float(p), float(w), float(h), hour, days) for i, t, p, w, h, hour, days in combos],
        "scenario int, d_temp double, d_precip double, d_wind double, d_humidity double, s_hour int, d_days int")
    rows = serving.scenario_table(agg.city_day_summary(_obs(spark, sf_dir)), sets)
    return rows.select("city", "day", "scenario", "s_humidity", "s_hour", "s_weekday", "s_month",
                       "rule_level", _reasons_text().alias("reasons"))


def q_scenario_scores(spark, sf_dir):
    """M11 scored: every scenario row through the model and the rules; the
    final level is the larger of the two."""
    model, _, codes, _ = _model(spark, sf_dir)
    rows = scoring.scenario_feature_rows(_scenarios(spark, sf_dir), codes)
    return scoring.score_scenarios(model, rows)


# ---- streaming ----------------------------------------------------------------

def q_stream_city_day(spark, sf_dir):
    """Readings arrive in files that hold a few cities each (so event times
    start anew with every file), and again the last day of the first half; they
    are landed once per state of the data folder.  Each call drains them with
    availableNow, one file per micro-batch, into a fresh sink, and the latest
    version per (city, day) is read back."""
    obs = _obs(spark, sf_dir)
    src = landed_path(spark, "stream-drops", sf_dir)

    def land(path):
        lo, hi = filters.data_bounds(obs)
        cut = dt.datetime.combine(lo + (hi - lo) // 2, dt.time())
        again = cut - dt.timedelta(days=1)
        (obs.repartition(3, "city").write.mode("overwrite").parquet(os.path.join(path, "drop=0")))
        (obs.filter((F.col("date") >= _ntz(again)) & (F.col("date") < _ntz(cut))).coalesce(1)
         .write.mode("overwrite").parquet(os.path.join(path, "drop=1")))

    land_once(spark, src, land, marker="drop=1/_SUCCESS")  # drop 1 is written last
    sink = scratch_path(spark, "stream-sink")
    ckpt = scratch_path(spark, "stream-ckpt")
    stream.run_to_sink(stream.city_day_stream(spark, src, max_files_per_trigger=1),
                       sink, ckpt).awaitTermination()
    out = stream.latest_city_days(spark, sink)
    return out.select("city", "day", *WEATHER_COLS, "n_hours", "rule_level",
                      _reasons_text().alias("reasons"))


LATE_HOURS = (2, 8, 14, 20)


def _stateful_sink(spark, sf_dir):
    """Two drops: every hour but ``LATE_HOURS``, then those and the first drop's first
    five days again.  Drained one after the other, then repaired."""
    obs = _obs(spark, sf_dir)
    src = landed_path(spark, "stream-late", sf_dir)
    late = F.hour("date").isin(*LATE_HOURS)

    def land(path):
        lo, _ = filters.data_bounds(obs)
        again = F.col("date") < _ntz(dt.datetime.combine(lo + dt.timedelta(days=5), dt.time()))
        obs.where(~late).write.mode("overwrite").parquet(os.path.join(path, "drop=0"))
        obs.where(late | again).write.mode("overwrite").parquet(os.path.join(path, "drop=1"))

    land_once(spark, src, land, marker="drop=1/_SUCCESS")
    sink, ckpt = scratch_path(spark, "stateful-sink"), scratch_path(spark, "stateful-ckpt")
    for drop in ("drop=0", "drop=[01]"):
        stateful.start(stream.city_day_stream(spark, os.path.join(src, drop)), sink, ckpt).awaitTermination()
    stateful.repair(spark, sink)
    return sink


def q_stream_state_city_day(spark, sf_dir):
    """T1 with operator state: closed days, repaired by what came late, and open ones."""
    return stateful.city_days(spark, _stateful_sink(spark, sf_dir)).select(
        "city", "day", *WEATHER_COLS, "n_hours", "rule_level", _reasons_text().alias("reasons"))


def q_stream_late_readings(spark, sf_dir):
    """T1's late table: the readings that came behind the watermark."""
    return stateful.late_readings(spark, _stateful_sink(spark, sf_dir)).select(
        "city", "date", *WEATHER_COLS, "suspension")


def q_stream_forecast_latest(spark, sf_dir):
    """Every hour is forecast up to three times, at midnight 0, 1 and 2 days
    before; the stream keeps the latest issue.  Files hold a few cities each, so issue
    times start anew with every file and many revisions come late."""
    obs = _obs(spark, sf_dir)
    src = landed_path(spark, "forecast-issues", sf_dir)
    ahead = F.col("ahead")
    issues = obs.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("ahead")).where(
        F.hour("date") % 3 != ahead).select(
        "city", "date", (F.date_trunc("day", F.col("date")).cast("timestamp_ntz")
                         - F.make_dt_interval(ahead)).alias("issued_at"),
        *[(F.col(c) + ahead).alias(c) for c in WEATHER_COLS])
    land_once(spark, src, lambda p: issues.repartition(3, "city").write.mode("overwrite").parquet(p))
    sink, ckpt = scratch_path(spark, "forecast-sink"), scratch_path(spark, "forecast-ckpt")
    forecast_stream.start(forecast_stream.forecast_stream(spark, src, max_files_per_trigger=1),
                          sink, ckpt).awaitTermination()
    return forecast_stream.latest(spark, sink, ckpt)


QUERIES = {
    "scan_obs": q_scan_obs,
    "forecast_explode": q_forecast_explode,
    "scan_obs_checked": q_scan_obs_checked,
    "scan_obs_rejects": q_scan_obs_rejects,
    "forecast_checked": q_forecast_checked,
    "forecast_rejects": q_forecast_rejects,
    "dataset_profile": q_dataset_profile,
    "city_day_slice": q_city_day_slice,
    "range_city_filter": q_range_city_filter,
    "impute_obs": q_impute_obs,
    "route_mode": q_route_mode,
    "enrich_city": q_enrich_city,
    "city_rejects": q_city_rejects,
    "enrich_level": q_enrich_level,
    "suspension_map": q_suspension_map,
    "rule_wind": q_rule_wind,
    "rule_rain": q_rule_rain,
    "rule_heat": q_rule_heat,
    "rule_engine": q_rule_engine,
    "rule_bands": q_rule_bands,
    "rule_bands_changed": q_rule_bands_changed,
    "rule_reasons": q_rule_reasons,
    "rule_agreement": q_rule_agreement,
    "final_decision": q_final_decision,
    "city_day_summary": q_city_day_summary,
    "day_level_mode": q_day_level_mode,
    "level_thresholds": q_level_thresholds,
    "range_kpis": q_range_kpis,
    "days_per_level": q_days_per_level,
    "city_ranking": q_city_ranking,
    "daily_trend": q_daily_trend,
    "hour_weekday_pivot": q_hour_weekday_pivot,
    "hour_weekday_wide": q_hour_weekday_wide,
    "corr_matrix": q_corr_matrix,
    "corr_label": q_corr_label,
    "day_extremes": q_day_extremes,
    "rollup_kpis": q_rollup_kpis,
    "rollup_ranking": q_rollup_ranking,
    "rollup_trend": q_rollup_trend,
    "rollup_hour_weekday": q_rollup_hour_weekday,
    "rollup_extremes": q_rollup_extremes,
    "rollup_correlations": q_rollup_correlations,
    "rollup_days_per_level": q_rollup_days_per_level,
    "box_stats": q_box_stats,
    "box_stats_approx": q_box_stats_approx,
    "sketch_quartiles": q_sketch_quartiles,
    "class_distribution": q_class_distribution,
    "sample_pair": q_sample_pair,
    "confusion_matrix": q_confusion_matrix,
    "per_class_scores": q_per_class_scores,
    "aggregate_scores": q_aggregate_scores,
    "confusion_rates": q_confusion_rates,
    "rolling_means": q_rolling_means,
    "rolling_means_halo": q_rolling_means_halo,
    "lag_features": q_lag_features,
    "peak_flags": q_peak_flags,
    "series_upkeep": q_series_upkeep,
    "rolling_means_clustered": q_rolling_means_clustered,
    "city_day_clustered": q_city_day_clustered,
    "serving_head_means": q_serving_head_means,
    "serving_tail_values": q_serving_tail_values,
    "temporal_features": q_temporal_features,
    "date_labels": q_date_labels,
    "weather_bins": q_weather_bins,
    "encode_city": q_encode_city,
    "risk_label": q_risk_label,
    "prob_pad": q_prob_pad,
    "weather_alerts": q_weather_alerts,
    "stratified_split": q_stratified_split,
    "time_split": q_time_split,
    "standardize": q_standardize,
    "class_weights": q_class_weights,
    "oversample_counts": q_oversample_counts,
    "oversample_copies": q_oversample_copies,
    "oversample_noise": q_oversample_noise,
    "cv_folds": q_cv_folds,
    "train_eval": q_train_eval,
    "top_features": q_top_features,
    "split_importances": q_split_importances,
    "score_city_days": q_score_city_days,
    "score_serving_days": q_score_serving_days,
    "cv_accuracy": q_cv_accuracy,
    "artifacts_roundtrip": q_artifacts_roundtrip,
    "training_features": q_training_features,
    "class_accuracy": q_class_accuracy,
    "fold_accuracy": q_fold_accuracy,
    "weighted_rows": q_weighted_rows,
    "sinks_roundtrip": q_sinks_roundtrip,
    "request_routing": q_request_routing,
    "unanswered_requests": q_unanswered_requests,
    "model_bulletin": q_model_bulletin,
    "unified_city_day": q_unified_city_day,
    "request_answers": q_request_answers,
    "advisory_bulletin": q_advisory_bulletin,
    "published_bulletin": q_published_bulletin,
    "published_days": q_published_days,
    "scenario_grid": q_scenario_grid,
    "scenario_table": q_scenario_table,
    "scenario_scores": q_scenario_scores,
    "stream_city_day": q_stream_city_day,
    "stream_state_city_day": q_stream_state_city_day,
    "stream_late_readings": q_stream_late_readings,
    "stream_forecast_latest": q_stream_forecast_latest,
}
