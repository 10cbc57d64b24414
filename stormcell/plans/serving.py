"""City-day decisions: history or forecast -> summary -> rules -> final level.

The reference answers one (city, day) per request; here one batch job answers
every (city, day) at once and the lookup becomes a pushed-down filter on the
written result.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import labels
from ..operators import aggregates as agg
from ..operators import rules
from ..operators.lookups import broadcast_checked, enrich_city, enrich_level
from ..sources import publish

N_LEVEL_PROBS = 5


def historical_city_days(obs: DataFrame) -> DataFrame:
    """Recorded days: summary + mode level, confidence 1 and zero probabilities."""
    return (agg.city_day_records(obs)
            .withColumn("mode", F.lit("historical"))
            .withColumn("is_prediction", F.lit(False))
            .withColumn("confidence", F.lit(1.0))
            .withColumn("probabilities", F.array_repeat(F.lit(0.0), N_LEVEL_PROBS)))


def forecast_city_days(hourly: DataFrame) -> DataFrame:
    """Forecast days: the same summary; the level comes from scoring later."""
    return (agg.city_day_summary(hourly)
            .withColumn("mode", F.lit("forecast"))
            .withColumn("is_prediction", F.lit(True)))


def unified_city_days(historical: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast rows under one schema (missing columns are null)."""
    return historical.unionByName(forecast, allowMissingColumns=True)


def decide(city_days: DataFrame, levels: DataFrame, model_col: str = "level") -> DataFrame:
    """Rules on the day's metrics (mean wind, total rain, mean apparent
    temperature), final level = max(model or record, rules), its source, and the
    level's name and risk (level 5 -> 'Unmapped')."""
    ruled = rules.apply_rules(city_days)
    out = ruled.withColumns({
        "final_level": labels.final_level(F.col(model_col), F.col("rule_level")),
        "decision_source": labels.decision_source(F.col(model_col), F.col("rule_level")),
    })
    return enrich_level(out, levels, "final_level")


def advisory_bulletin(obs: DataFrame, levels: DataFrame, cities: DataFrame,
                      scores: DataFrame | None = None) -> DataFrame:
    """What the memo holds for each (city, day): final level and its reasons,
    scope and recommendation, the day's extremes and alert tags, coordinates.

    The level beside the rules is the recorded one, or with ``scores`` (city,
    day, predicted_level, confidence, probabilities_5) the model's, which then
    comes with its confidence and five probabilities; a day without a score
    rests on the rules.  Write with ``partitionBy('day')``."""
    days = agg.city_day_full(obs)
    if scores is not None:
        days = days.join(scores.select(
            "city", "day", F.col("predicted_level").alias("model_level"), "confidence",
            F.col("probabilities_5").alias("probabilities")), ["city", "day"], "left")
    decided = decide(days, levels, "level" if scores is None else "model_level")
    return enrich_city(decided, cities).withColumns({
        "alerts": labels.weather_alerts("max_wind", "total_precip", "max_temp",
                                        "relativehumidity_2m"),
        "scope": labels.scope_text("final_level"),
        "recommendation": labels.recommendation("final_level"),
    }).drop("known")


def write_bulletin(bulletin: DataFrame, path: str) -> None:
    """One folder per day, so a (city, day) lookup reads a single partition."""
    bulletin.write.mode("overwrite").partitionBy("day").parquet(path)


def publish_bulletin(bulletin: DataFrame, path: str) -> int | None:
    """Publish the days whose content has changed, all at once (``sources.publish``);
    read them with ``publish.read``."""
    return publish.publish(bulletin, path)


def scenario_combinations(temp_offsets, precip_offsets, wind_offsets, humidity_offsets=(0.0,),
                          hours=(12,), day_shifts=(0,)) -> list[tuple]:
    """(scenario, temp, precip, wind, humidity, hour, days) in a fixed order."""
    return [(i, *c) for i, c in enumerate(product(
        temp_offsets, precip_offsets, wind_offsets, humidity_offsets, hours, day_shifts))]


def scenario_grid(base: DataFrame, temp_offsets, precip_offsets, wind_offsets,
                  apparent_offset: float = -2.0, humidity_offsets=(0.0,), hours=(12,),
                  day_shifts=(0,)) -> DataFrame:
    """What-if batch: every base row under every combination of offsets, hours
    of the day and shifts of the date (which carry weekday and month).

    Apparent temperature follows the scenario temperature (temp - 2), humidity
    stays within 0 to 100.  The combinations are a literal array exploded per
    row (no join)."""
    combos = scenario_combinations(temp_offsets, precip_offsets, wind_offsets, humidity_offsets,
                                   hours, day_shifts)
    arr = F.array(*[F.struct(
        F.lit(i).alias("scenario"), F.lit(float(t)).alias("d_temp"),
        F.lit(float(p)).alias("d_precip"), F.lit(float(w)).alias("d_wind"),
        F.lit(float(h)).alias("d_humidity"), F.lit(int(hour)).alias("s_hour"),
        F.lit(int(days)).alias("d_days")) for i, t, p, w, h, hour, days in combos])
    return _scenario_days(base.select("*", F.inline(arr)), apparent_offset)


def scenario_table(base: DataFrame, sets: DataFrame, apparent_offset: float = -2.0,
                   block: int = 1024) -> DataFrame:
    """``scenario_grid`` with the combinations in a table: (scenario, d_temp, d_precip,
    d_wind, d_humidity, s_hour, d_days).

    The sets are dealt into blocks of about ``block``, an array each; every base row
    meets every block by an equi-join and unfolds its array.  The plan is the same for
    any number of sets; the side with the blocks is broadcast if it is small."""
    columns = ["scenario", "d_temp", "d_precip", "d_wind", "d_humidity", "s_hour", "d_days"]
    blocks = max(1, -(-sets.count() // block))
    dealt = (sets.select(F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int").alias("_block"),
                         F.struct(*columns).alias("s"))
             .groupBy("_block").agg(F.collect_list("s").alias("_sets")))
    rows = base.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = rows.join(broadcast_checked(dealt, materialize=True), "_block")
    return _scenario_days(met.select(*base.columns, F.inline("_sets")), apparent_offset)


def _scenario_days(g: DataFrame, apparent_offset: float) -> DataFrame:
    """Base rows with their offsets: the scenario's readings, date and rule level."""
    humidity = F.col("relativehumidity_2m")
    g = g.withColumns({
        "s_day": F.date_add("day", F.col("d_days")),
        "s_humidity": F.when(humidity.isNotNull(), F.least(F.lit(100.0), F.greatest(
            F.lit(0.0), humidity + F.col("d_humidity")))),
        "s_temperature": F.col("temperature_2m") + F.col("d_temp"),
        "s_precipitation": F.greatest(F.col("precipitation") + F.col("d_precip"), F.lit(0.0)),
        "s_windspeed": F.greatest(F.col("windspeed_10m") + F.col("d_wind"), F.lit(0.0)),
    })
    g = g.withColumn("s_apparent", F.col("s_temperature") + F.lit(apparent_offset))
    return g.withColumns({
        "s_weekday": cal.day_of_week("s_day"),
        "s_month": cal.month("s_day"),
        "rule_level": rules.rule_level("s_windspeed", "s_precipitation", "s_apparent"),
        "rule_reasons": rules.rule_reasons("s_windspeed", "s_precipitation", "s_apparent"),
    })


def latest_forecast(hourly: DataFrame, issued_col: str = "issued_at") -> DataFrame:
    """Revised forecasts: per (city, hour) keep the values of the latest issue
    (``max_by``; a partial aggregate, no sort of the revisions)."""
    from ..schema import WEATHER_COLS
    return hourly.groupBy("city", "date").agg(
        *[F.max_by(c, issued_col).alias(c) for c in WEATHER_COLS],
        F.max(issued_col).alias(issued_col))


def answer_requests(requests: DataFrame, historical: DataFrame,
                    forecast_days: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Batch form of the per-request lookup: every requested (city, day) is
    answered from history when the day is recorded, else from the forecast
    summary joined with its prediction on the same key (J3).  Requests with
    neither have no answer, as failed lookups; ``unanswered_requests`` lists them."""
    hist = historical.select("city", "day", *[c for c in historical.columns
                                              if c not in ("city", "day")])
    fc = forecast_days
    if predictions is not None:
        fc = fc.join(predictions.select("city", "day", F.col("predicted_level").alias("level"),
                                        "confidence", "probabilities", "risk_level"),
                     ["city", "day"], "left")
    from_hist = requests.join(hist, ["city", "day"], "inner")
    unrecorded = requests.join(hist.select("city", "day"), ["city", "day"], "left_anti")
    from_fc = unrecorded.join(fc, ["city", "day"], "inner")
    return from_hist.unionByName(from_fc, allowMissingColumns=True)


def unanswered_requests(requests: DataFrame, historical: DataFrame,
                        forecast_days: DataFrame) -> DataFrame:
    """The requests that neither history nor forecast answers."""
    known = historical.select("city", "day").union(forecast_days.select("city", "day"))
    return requests.join(known, ["city", "day"], "left_anti")
