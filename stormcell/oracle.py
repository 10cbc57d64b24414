"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement starts from the same ``obs`` derivation as the Spark fixture
adapter and repeats the query parameters of ``stormcell.queries``.  Queries
without an entry here (model training/scoring, noisy oversampling) are checked
by row count only.
"""

from __future__ import annotations

from .functions.labels import (ALERT_TAGS, CORRELATION_BANDS, FAVORABLE, NO_PATTERN,
                               PAIR_SENTENCES, STRONG_NEGATIVE, STRONG_POSITIVE)
from .operators.aggregates import BOX_VARS, CORR_VARS
from .operators.windows import PEAKS
from .plans.serving import scenario_combinations
from .queries import (FORECAST_DAYS, PIVOT_VARIABLE, RANGE_CITIES, RANGE_END, RANGE_START,
                      SCATTER_PAIR, SCENARIO_DAYS, SCENARIO_HOURS, SCENARIO_HUMIDITY, SCENARIO_PRECIP, SCENARIO_TEMP, SCENARIO_WIND, SLICE_CITY,
                      SLICE_DAY)
from .schema import FEATURES
from .sources.dims import (CRITERIA_HEAT, CRITERIA_RAIN, CRITERIA_WIND, NO_SCOPE,
                           RECOMMENDATION_ABOVE, RECOMMENDATIONS, SCOPE_TEXTS, SUSPENSION_LEVELS)
from .sources.fixture import CITY_DIM_CTE, OBS_CTE

W = ["relativehumidity_2m", "temperature_2m", "precipitation",
     "apparent_temperature", "windspeed_10m"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join([OBS_CTE, *ctes]) + "\n"


CITIES_IN = ", ".join(_q(c) for c in RANGE_CITIES)
FILTERED = f"""filtered AS (
  SELECT * FROM obs
  WHERE date >= TIMESTAMP '{RANGE_START} 00:00:00'
    AND date < CAST(DATE '{RANGE_END}' + 1 AS TIMESTAMP)
    AND city IN ({CITIES_IN})
)"""

MEDIANS = """med AS (
  SELECT median(relativehumidity_2m) AS h, median(temperature_2m) AS t,
         median(apparent_temperature) AS a, median(windspeed_10m) AS w FROM obs
)"""

IMPUTED = MEDIANS + """,
imputed AS (
  SELECT city, date,
         coalesce(relativehumidity_2m, med.h) AS relativehumidity_2m,
         coalesce(temperature_2m, med.t) AS temperature_2m,
         coalesce(precipitation, 0.0) AS precipitation,
         coalesce(apparent_temperature, med.a) AS apparent_temperature,
         coalesce(windspeed_10m, med.w) AS windspeed_10m,
         suspension
  FROM obs, med
)"""

SUMMARY = """cd AS (
  SELECT city, CAST(date AS DATE) AS day,
         avg(temperature_2m) AS temperature_2m,
         avg(relativehumidity_2m) AS relativehumidity_2m,
         coalesce(sum(precipitation), 0.0) AS precipitation,
         avg(apparent_temperature) AS apparent_temperature,
         avg(windspeed_10m) AS windspeed_10m,
         count(*) AS n_hours
  FROM obs GROUP BY city, CAST(date AS DATE)
)"""

MODE = """lvl_cnt AS (
  SELECT city, CAST(date AS DATE) AS day, suspension, count(*) AS n
  FROM obs WHERE suspension IS NOT NULL GROUP BY ALL
),
mode_lvl AS (
  SELECT city, day, suspension AS level FROM (
    SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY n DESC, suspension) AS rn
    FROM lvl_cnt) WHERE rn = 1
)"""

LEVELS = "lv(level, level_name, color, risk) AS (VALUES " + ", ".join(
    f"({lv}, {_q(name)}, {_q(color)}, {_q(risk)})"
    for lv, name, color, _emoji, risk in SUSPENSION_LEVELS) + ")"


def wind_signal_sql(w: str) -> str:
    parts = " ".join(f"WHEN {w} >= {lo} AND {w} <= {hi} THEN {sig}"
                     for sig, lo, hi, _s, _d in CRITERIA_WIND)
    return f"(CASE {parts} END)"


def wind_level_sql(w: str) -> str:
    parts = " ".join(f"WHEN {w} >= {lo} AND {w} <= {hi} THEN {s}"
                     for _sig, lo, hi, s, _d in CRITERIA_WIND)
    return f"coalesce(CASE {parts} END, 0)"


def wind_reason_sql(w: str) -> str:
    parts = " ".join(f"WHEN {w} >= {lo} AND {w} <= {hi} THEN {_q(d)}"
                     for _sig, lo, hi, _s, d in CRITERIA_WIND)
    return f"(CASE {parts} END)"


def threshold_level_sql(x: str, table) -> str:
    parts = ", ".join(f"CASE WHEN {x} >= {t[1]} THEN {t[2]} ELSE 0 END" for t in table)
    return f"greatest(0, {parts})"


def threshold_matches_sql(x: str, table) -> str:
    return "(" + " + ".join(f"CAST({x} >= {t[1]} AS INTEGER)" for t in table) + ")"


def rule_level_sql(w="windspeed_10m", p="precipitation", a="apparent_temperature") -> str:
    return (f"greatest({wind_level_sql(w)}, {threshold_level_sql(p, CRITERIA_RAIN)}, "
            f"{threshold_level_sql(a, CRITERIA_HEAT)})")


def _reason_items(w, p, a) -> list[str]:
    items = [wind_reason_sql(w)]
    items += [f"CASE WHEN {p} >= {t[1]} THEN {_q(t[3])} END" for t in CRITERIA_RAIN]
    items += [f"CASE WHEN {a} >= {t[1]} THEN {_q(t[3])} END" for t in CRITERIA_HEAT]
    return items


def reasons_sql(w="windspeed_10m", p="precipitation", a="apparent_temperature") -> str:
    return "concat_ws('; ', " + ", ".join(_reason_items(w, p, a)) + ")"


def n_reasons_sql(w="windspeed_10m", p="precipitation", a="apparent_temperature") -> str:
    return "(" + " + ".join(f"CAST(({i}) IS NOT NULL AS INTEGER)"
                            for i in _reason_items(w, p, a)) + ")"


RULE_PRED = f"""pred AS (
  SELECT suspension AS actual, {rule_level_sql()} AS predicted FROM obs
  WHERE suspension IS NOT NULL
),
pair_cnt AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY ALL),
lbl AS (SELECT DISTINCT x AS l FROM (SELECT actual AS x FROM pair_cnt
                                     UNION SELECT predicted FROM pair_cnt)),
conf AS (
  SELECT a.l AS actual, p.l AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM lbl a CROSS JOIN lbl p
  LEFT JOIN pair_cnt c ON c.actual = a.l AND c.predicted = p.l
),
pc AS (
  SELECT s.level,
         CASE WHEN t.n_pred > 0 THEN CAST(s.tp AS DOUBLE) / CAST(t.n_pred AS DOUBLE) ELSE 0.0 END AS precision,
         CASE WHEN s.support > 0 THEN CAST(s.tp AS DOUBLE) / CAST(s.support AS DOUBLE) ELSE 0.0 END AS recall,
         CASE WHEN s.support + t.n_pred > 0
              THEN CAST(2 * s.tp AS DOUBLE) / CAST(s.support + t.n_pred AS DOUBLE) ELSE 0.0 END AS f1,
         CAST(s.support AS BIGINT) AS support, CAST(s.tp AS BIGINT) AS tp,
         CAST(t.n_pred AS BIGINT) AS n_pred
  FROM (SELECT actual AS level, sum(n) AS support,
               sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
        FROM conf GROUP BY actual) s
  JOIN (SELECT predicted AS level, sum(n) AS n_pred FROM conf GROUP BY predicted) t
    ON s.level = t.level
)"""

KEY = "md5(city || '|' || strftime(date, '%Y-%m-%d %H:%M:%S'))"
KEY_TXT = "(city || '|' || strftime(date, '%Y-%m-%d %H:%M:%S'))"
SPLIT = f"""split AS (
  SELECT *, row_number() OVER (PARTITION BY suspension ORDER BY {KEY}, {KEY_TXT})
              <= (2 * count(*) OVER (PARTITION BY suspension) + 5) // 10 AS is_test
  FROM obs
),
train AS (SELECT * FROM split WHERE NOT is_test)"""


def _series_sql() -> str:
    w = "(PARTITION BY city ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
    cols = []
    for v, src in (("precip", "precipitation"), ("wind", "windspeed_10m")):
        for n in (3, 6, 12):
            cols.append(f"avg({src}) OVER {w.format(n=n - 1)} AS {v}_roll_{n}h")
    for k in (1, 2, 3):
        cols.append(f"coalesce(lag(precipitation, {k}) OVER (PARTITION BY city ORDER BY date), 0.0)"
                    f" AS precip_lag_{k}h")
        cols.append(f"coalesce(lag(temperature_2m, {k}) OVER (PARTITION BY city ORDER BY date), med.t)"
                    f" AS temp_lag_{k}h")
    return ("series AS (SELECT imputed.*, " + ", ".join(cols) +
            " FROM imputed, med)")


SERVING = """srank AS (
  SELECT *, CAST(date AS DATE) AS day,
         row_number() OVER (PARTITION BY city, CAST(date AS DATE) ORDER BY date) AS rn,
         count(*) OVER (PARTITION BY city, CAST(date AS DATE)) AS n
  FROM obs
),
sday AS (
  SELECT city, day, min(date) AS first_ts, max(n) AS n_hours,
         avg(temperature_2m) AS temp_mean,
""" + ",\n".join(
    [f"         avg(CASE WHEN rn <= {n} THEN {src} END) AS {v}_roll_{n}h"
     for v, src in (("precip", "precipitation"), ("wind", "windspeed_10m")) for n in (3, 6, 12)]
    + [f"         max(CASE WHEN rn = n - {k} + 1 THEN precipitation END) AS p{k}" for k in (1, 2, 3)]
    + [f"         max(CASE WHEN rn = n - {k} + 1 THEN temperature_2m END) AS t{k}" for k in (1, 2, 3)]
) + """
  FROM srank GROUP BY city, day
)"""

EXTREMES = """ext AS (
  SELECT city, CAST(date AS DATE) AS day,
         min(temperature_2m) AS min_temp, max(temperature_2m) AS max_temp,
         avg(temperature_2m) AS avg_temp, max(windspeed_10m) AS max_wind,
         avg(windspeed_10m) AS avg_wind,
         coalesce(sum(precipitation), 0.0) AS total_precip,
         max(precipitation) AS max_precip_hour,
         avg(relativehumidity_2m) AS avg_humidity
  FROM obs GROUP BY city, CAST(date AS DATE)
)"""


def alerts_sql(w="max_wind", p="total_precip", t="max_temp", h="avg_humidity") -> tuple[str, str]:
    metric = {"max_wind": w, "total_precip": p, "max_temp": t, "avg_humidity": h}
    groups: dict[str, list[str]] = {}
    for group, tag, m, bound in ALERT_TAGS:
        groups.setdefault(group, []).append(f"WHEN {metric[m]} > {bound} THEN {_q(tag)}")
    items = [f"CASE {' '.join(whens)} END" for whens in groups.values()]
    tag, rain, wind, temp = FAVORABLE
    items.append(f"CASE WHEN {p} = {rain} AND {w} < {wind} AND {t} < {temp} THEN {_q(tag)} END")
    text = "concat_ws(', ', " + ", ".join(items) + ")"
    n = "(" + " + ".join(f"CAST(({i}) IS NOT NULL AS INTEGER)" for i in items) + ")"
    return text, n


def _corr_label_sql(r: str = "r") -> str:
    whens = " ".join(f"WHEN abs({r}) < {b} THEN {_q(text)}" for b, text in CORRELATION_BANDS)
    return (f"CASE {whens} WHEN {r} > 0 THEN {_q(STRONG_POSITIVE)} "
            f"ELSE {_q(STRONG_NEGATIVE)} END")


def _corr_rows() -> str:
    pairs = [(a, b) for i, a in enumerate(CORR_VARS) for b in CORR_VARS[i:]]
    one = "cr AS (SELECT " + ", ".join(f"corr({a}, {b}) AS c_{a}__{b}" for a, b in pairs) + " FROM obs)"
    sel = []
    for a, b in pairs:
        sel.append(f"SELECT {_q(a)} AS var_x, {_q(b)} AS var_y, c_{a}__{b} AS r FROM cr")
        if a != b:
            sel.append(f"SELECT {_q(b)} AS var_x, {_q(a)} AS var_y, c_{a}__{b} AS r FROM cr")
    return one + ",\ncm AS (" + "\nUNION ALL ".join(sel) + ")"


def _sentence_sql() -> str:
    parts = []
    for a, b, text in PAIR_SENTENCES:
        k1, k2 = sorted((a, b))
        parts.append(f"WHEN least(var_x, var_y) = {_q(k1)} AND greatest(var_x, var_y) = {_q(k2)}"
                     f" THEN {_q(text)}")
    return "CASE " + " ".join(parts) + f" ELSE {_q(NO_PATTERN)} END"


def _box_sql() -> str:
    longs = "\nUNION ALL ".join(
        f"SELECT suspension AS level, {_q(v)} AS variable, CAST({v} AS DOUBLE) AS value FROM obs"
        for v in BOX_VARS)
    return f"""lng AS (SELECT * FROM ({longs}) WHERE value IS NOT NULL AND level IS NOT NULL),
st AS (
  SELECT level, variable, count(*) AS n, min(value) AS min,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3, max(value) AS max
  FROM lng GROUP BY level, variable
),
st2 AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_low,
               q3 + 1.5 * (q3 - q1) AS fence_high FROM st)"""


def _scenario_sql() -> str:
    vals = ", ".join(
        f"({i}, CAST({t} AS DOUBLE), CAST({p} AS DOUBLE), CAST({w} AS DOUBLE), CAST({h} AS DOUBLE), {hour}, {days})"
        for i, t, p, w, h, hour, days in scenario_combinations(
            SCENARIO_TEMP, SCENARIO_PRECIP, SCENARIO_WIND, SCENARIO_HUMIDITY, SCENARIO_HOURS,
            SCENARIO_DAYS))
    return f"sc(scenario, d_temp, d_precip, d_wind, d_humidity, s_hour, d_days) AS (VALUES {vals})"


def _text_sql(level: str, texts, other: str) -> str:
    whens = " ".join(f"WHEN {level} = {k} THEN {_q(t)}" for k, t in texts)
    return f"CASE {whens} WHEN {level} IS NOT NULL THEN {_q(other)} END"


def _feature_sql() -> dict[str, str]:
    f = {c: c for c in FEATURES}
    f |= {"hour": "hour(date)", "day_of_week": "isodow(date) - 1", "month": "month(date)",
          "is_weekend": "CAST(isodow(date) - 1 >= 5 AS INTEGER)",
          "is_rush_hour": "CAST(hour(date) IN (7, 8, 9, 17, 18, 19) AS INTEGER)",
          "apparent_temp_delta": "apparent_temperature - temperature_2m",
          "precip_intensity": PRECIP_BIN, "wind_category": WIND_BIN}
    f |= {flag: f"coalesce(CAST({x} > {mean} * CAST({factor} AS DOUBLE) AS INTEGER), 0)"
          for flag, x, mean, factor in PEAKS}
    return f


PRECIP_BIN = """CASE WHEN precipitation <= 0 THEN 0 WHEN precipitation <= 5 THEN 1 WHEN precipitation <= 15 THEN 2
       WHEN precipitation <= 50 THEN 3 WHEN precipitation IS NOT NULL THEN 4 END"""
WIND_BIN = """CASE WHEN windspeed_10m <= 20 THEN 0 WHEN windspeed_10m <= 40 THEN 1 WHEN windspeed_10m <= 60 THEN 2
       WHEN windspeed_10m IS NOT NULL THEN 3 END"""
AHEAD = f"""b AS (SELECT min(CAST(date AS DATE)) AS lo, max(CAST(date AS DATE)) AS hi FROM obs),
ahead AS (
  SELECT city, CAST(date + INTERVAL {FORECAST_DAYS} DAY AS DATE) AS day, {", ".join(W)}
  FROM obs, b WHERE date >= CAST(b.hi - {FORECAST_DAYS - 1} AS TIMESTAMP)
),
fc AS (SELECT city, day, avg(relativehumidity_2m) AS relativehumidity_2m,
              avg(temperature_2m) AS temperature_2m, coalesce(sum(precipitation), 0.0) AS precipitation,
              avg(apparent_temperature) AS apparent_temperature, avg(windspeed_10m) AS windspeed_10m
       FROM ahead GROUP BY city, day),
rd AS (SELECT DISTINCT city, CAST(date AS DATE) AS day FROM obs),
req AS (SELECT DISTINCT city, day FROM (SELECT * FROM rd UNION ALL SELECT city, CAST(day + 14 AS DATE) FROM rd), b
        WHERE day BETWEEN b.lo AND b.hi + {FORECAST_DAYS})"""


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    all_cols = "city, date, " + ", ".join(W) + ", suspension"
    o["scan_obs"] = with_() + f"SELECT {all_cols} FROM obs"
    o["forecast_explode"] = with_() + "SELECT city, date, " + ", ".join(W) + " FROM obs"
    clock = "strftime(date, '%Y-%m-%d %H:%M:%S')"
    o["scan_obs_checked"] = with_() + f"""SELECT {all_cols} FROM obs
  WHERE hour(date) NOT IN (3, 7, 11, 13, 17)"""
    o["scan_obs_rejects"] = with_() + f"""SELECT CASE hour(date) WHEN 3 THEN city || ',' || {clock}
    WHEN 7 THEN city || ',someday,1,2,3,4,5,0' WHEN 11 THEN ',' || {clock} || ',1,2,3,4,5,0'
    WHEN 13 THEN city || ',' || {clock} || ',1,2,x,4,5,0'
    ELSE city || ',' || {clock} || ',1,2,3,4,5,6,7,8' END AS line,
  CASE hour(date) WHEN 7 THEN 'date: no time' WHEN 11 THEN 'no city' WHEN 13 THEN 'precipitation: no number'
    ELSE 'wrong number of fields' END AS reason
  FROM obs WHERE hour(date) IN (3, 7, 11, 13, 17)"""
    o["forecast_checked"] = with_() + "SELECT city, date, " + ", ".join(W) + """ FROM obs
  WHERE day(date) % 9 NOT IN (0, 2, 4, 6, 8)"""
    o["forecast_rejects"] = with_("""docs AS (SELECT DISTINCT city, strftime(date, '%Y-%m-%d') AS d,
  day(date) % 9 AS w, '{"city":"' || city || '","date":"' || strftime(date, '%Y-%m-%d') ||
  '","hourly":{"time":[' AS head FROM obs)""") + """SELECT CASE w WHEN 2 THEN head
  WHEN 4 THEN '{"date":"' || d || '"}'
  WHEN 6 THEN head || '"' || d || 'T00:00"],"temperature_2m":[],"relativehumidity_2m":[],"precipitation":[],' ||
    '"apparent_temperature":[],"windspeed_10m":[]}}'
  WHEN 8 THEN head || '"' || d || 'T00:00"]}}'
  ELSE head || '"soon"],"temperature_2m":[1],"relativehumidity_2m":[1],"precipitation":[1],' ||
    '"apparent_temperature":[1],"windspeed_10m":[1]}}' END AS line,
  CASE w WHEN 2 THEN 'not JSON of the schema' WHEN 4 THEN 'no city'
  WHEN 6 THEN 'temperature_2m: other length than time' WHEN 8 THEN 'no temperature_2m'
  ELSE 'time: no time' END AS reason FROM docs WHERE w IN (0, 2, 4, 6, 8)"""
    o["city_rejects"] = f"""WITH {CITY_DIM_CTE.strip()}
SELECT c_custkey, city, 'unknown city' AS reason FROM (
  SELECT c_custkey, n_name || CASE WHEN c_custkey % 12 = 0 THEN '' ELSE '#' || (c_custkey % 12) END AS city
  FROM customer JOIN nation ON n_nationkey = c_nationkey)
WHERE city NOT IN (SELECT city FROM city_dim)"""
    o["dataset_profile"] = with_() + """SELECT count(*) AS n_rows, min(date) AS min_date,
  max(date) AS max_date, CAST(count(DISTINCT city) AS BIGINT) AS n_cities,
  array_to_string(list_sort(list_distinct(list(city))), ',') AS cities FROM obs"""
    o["city_day_slice"] = with_() + f"""SELECT {all_cols} FROM obs
  WHERE date >= TIMESTAMP '{SLICE_DAY} 00:00:00'
    AND date < CAST(DATE '{SLICE_DAY}' + 1 AS TIMESTAMP) AND city = {_q(SLICE_CITY)}"""
    o["range_city_filter"] = with_(FILTERED) + f"SELECT {all_cols} FROM filtered"
    o["impute_obs"] = with_(IMPUTED) + f"SELECT {all_cols} FROM imputed"
    o["route_mode"] = with_(f"""b AS (SELECT min(CAST(date AS DATE)) AS lo, max(CAST(date AS DATE)) AS hi FROM obs),
req AS (
  SELECT CAST(o_orderdate AS DATE) AS request_date FROM orders
  UNION SELECT CAST(date AS DATE) FROM obs
  UNION SELECT CAST(b.hi + CAST(r.range AS INTEGER) AS DATE) FROM b, range(1, {FORECAST_DAYS + 1}) r
)""") + """SELECT request_date,
  CASE WHEN request_date BETWEEN b.lo AND b.hi THEN 'historical' ELSE 'forecast' END AS mode
FROM req, b"""
    o["enrich_city"] = "WITH " + CITY_DIM_CTE + """
SELECT cu.c_custkey, n.n_name AS city, c.lat, c.lon, c.city IS NOT NULL AS known
FROM customer cu JOIN nation n ON n.n_nationkey = cu.c_nationkey
LEFT JOIN city_dim c ON c.city = n.n_name"""
    o["enrich_level"] = with_(MODE, LEVELS) + """SELECT m.city, m.day, m.level,
  coalesce(lv.level_name, 'Unmapped') AS level_name, lv.color, coalesce(lv.risk, 'Unmapped') AS risk
FROM mode_lvl m LEFT JOIN lv ON lv.level = m.level"""
    o["suspension_map"] = with_(MODE, LEVELS, CITY_DIM_CTE.strip()) + """SELECT m.city, m.day,
  c.lat, c.lon, m.level, coalesce(lv.level_name, 'Unmapped') AS level_name, lv.color,
  coalesce(lv.risk, 'Unmapped') AS risk
FROM mode_lvl m LEFT JOIN city_dim c ON c.city = m.city LEFT JOIN lv ON lv.level = m.level"""
    o["rule_wind"] = with_() + (f"SELECT city, date, {wind_signal_sql('windspeed_10m')} AS wind_signal, "
                                f"{wind_level_sql('windspeed_10m')} AS wind_level FROM obs")
    o["rule_rain"] = with_() + (
        f"SELECT city, date, {threshold_level_sql('precipitation', CRITERIA_RAIN)} AS rain_level, "
        f"{threshold_matches_sql('precipitation', CRITERIA_RAIN)} AS rain_matches FROM obs")
    o["rule_heat"] = with_() + (
        f"SELECT city, date, {threshold_level_sql('apparent_temperature', CRITERIA_HEAT)} AS heat_level, "
        f"{threshold_matches_sql('apparent_temperature', CRITERIA_HEAT)} AS heat_matches FROM obs")
    o["rule_engine"] = with_(SUMMARY) + (
        f"SELECT city, day, {rule_level_sql()} AS rule_level, {n_reasons_sql()} AS n_reasons, "
        f"{reasons_sql()} AS reasons FROM cd")
    o["rule_reasons"] = with_() + (
        f"SELECT city, date, {rule_level_sql()} AS rule_level, {reasons_sql()} AS reasons FROM obs")
    o["rule_agreement"] = with_(SUMMARY, MODE) + f"""SELECT {rule_level_sql()} AS rule_level,
  m.level AS actual_level, count(*) AS n
FROM cd JOIN mode_lvl m USING (city, day) GROUP BY ALL"""
    o["final_decision"] = with_(SUMMARY, MODE, LEVELS) + f"""SELECT x.city, x.day, x.level, x.rule_level,
  greatest(x.level, x.rule_level) AS final_level,
  CASE WHEN greatest(coalesce(x.level, 0), x.rule_level) <= 0 THEN 'none'
       WHEN x.rule_level > coalesce(x.level, 0) THEN 'rules' ELSE 'model' END AS decision_source,
  coalesce(lv.level_name, 'Unmapped') AS level_name, coalesce(lv.risk, 'Unmapped') AS risk
FROM (SELECT cd.city, cd.day, m.level, {rule_level_sql()} AS rule_level
      FROM cd JOIN mode_lvl m USING (city, day)) x
LEFT JOIN lv ON lv.level = greatest(x.level, x.rule_level)"""
    o["city_day_summary"] = with_(SUMMARY) + "SELECT * FROM cd"
    o["day_level_mode"] = with_(MODE) + "SELECT * FROM mode_lvl"
    o["level_thresholds"] = with_(IMPUTED) + """SELECT suspension AS level,
  avg(precipitation) AS precipitation_mean, max(precipitation) AS precipitation_max,
  avg(windspeed_10m) AS windspeed_mean, max(windspeed_10m) AS windspeed_max,
  avg(relativehumidity_2m) AS humidity_mean, count(*) AS count
FROM imputed WHERE suspension IS NOT NULL GROUP BY suspension"""
    o["range_kpis"] = with_() + """SELECT count(*) AS total_records,
  avg(CASE WHEN suspension > 0 THEN 1 ELSE 0 END) * 100 AS suspension_rate_pct,
  avg(precipitation) AS avg_precipitation, avg(temperature_2m) AS avg_temperature
FROM obs"""
    o["days_per_level"] = with_() + """SELECT suspension AS level,
  count(DISTINCT CAST(date AS DATE)) AS days
FROM obs WHERE suspension IS NOT NULL AND suspension < 5 GROUP BY suspension"""
    o["city_ranking"] = with_() + """SELECT city, mean_level, n_records,
  CAST(row_number() OVER (ORDER BY mean_level DESC NULLS LAST, city) AS INTEGER) AS rank
FROM (SELECT city, avg(suspension) AS mean_level, count(suspension) AS n_records
      FROM obs WHERE city IS NOT NULL GROUP BY city)"""
    o["daily_trend"] = with_() + """SELECT CAST(date AS DATE) AS day,
  avg(suspension) AS avg_suspension FROM obs GROUP BY 1"""
    o["hour_weekday_pivot"] = with_() + f"""SELECT CAST(isodow(date) - 1 AS INTEGER) AS weekday,
  dayname(date) AS day_name, CAST(hour(date) AS INTEGER) AS hour,
  avg({PIVOT_VARIABLE}) AS mean_value
FROM obs GROUP BY ALL HAVING avg({PIVOT_VARIABLE}) IS NOT NULL"""
    o["hour_weekday_wide"] = with_() + "SELECT CAST(isodow(date) - 1 AS INTEGER) AS weekday, " \
        "dayname(date) AS day_name, " + ", ".join(
            f"avg(CASE WHEN hour(date) = {h} THEN {PIVOT_VARIABLE} END) AS h{h:02d}"
            for h in range(24)) + " FROM obs GROUP BY ALL"
    o["corr_matrix"] = with_(_corr_rows()) + "SELECT var_x, var_y, round(r, 9) AS r FROM cm"
    o["corr_label"] = with_(_corr_rows()) + f"""SELECT var_x AS var1, var_y AS var2,
  round(r, 9) AS r,
  {_corr_label_sql()} AS label,
  {_sentence_sql()} AS sentence
FROM cm WHERE var_x <> var_y"""
    o["day_extremes"] = with_(EXTREMES) + "SELECT * FROM ext"
    o["box_stats"] = with_(_box_sql()) + """SELECT s.level, s.variable, s.n, s.min, s.q1,
  s.median, s.q3, s.max, s.iqr, s.fence_low, s.fence_high,
  CAST(sum(CASE WHEN l.value < s.fence_low OR l.value > s.fence_high THEN 1 ELSE 0 END) AS BIGINT)
    AS n_outliers,
  min(CASE WHEN l.value >= s.fence_low THEN l.value END) AS whisker_low,
  max(CASE WHEN l.value <= s.fence_high THEN l.value END) AS whisker_high
FROM st2 s JOIN lng l ON l.level = s.level AND l.variable = s.variable
GROUP BY ALL"""
    o["class_distribution"] = with_() + """SELECT level, n,
  CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE) AS pct
FROM (SELECT suspension AS level, count(*) AS n FROM obs GROUP BY suspension)"""
    a, b = SCATTER_PAIR
    o["sample_pair"] = with_() + f"SELECT date, city, {a}, {b} FROM obs ORDER BY date, city LIMIT 1000"
    o["confusion_matrix"] = with_(RULE_PRED) + "SELECT actual, predicted, n FROM conf"
    o["per_class_scores"] = with_(RULE_PRED) + "SELECT * FROM pc"
    red = "lambda x, y: x + y"
    o["aggregate_scores"] = with_(RULE_PRED) + f"""SELECT
  CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy,
  list_reduce(list(precision * CAST(support AS DOUBLE) ORDER BY level), {red}) / CAST(sum(support) AS DOUBLE) AS precision_weighted,
  list_reduce(list(recall * CAST(support AS DOUBLE) ORDER BY level), {red}) / CAST(sum(support) AS DOUBLE) AS recall_weighted,
  list_reduce(list(f1 * CAST(support AS DOUBLE) ORDER BY level), {red}) / CAST(sum(support) AS DOUBLE) AS f1_weighted,
  list_reduce(list(precision ORDER BY level), {red}) / CAST(count(*) AS DOUBLE) AS precision_macro,
  list_reduce(list(recall ORDER BY level), {red}) / CAST(count(*) AS DOUBLE) AS recall_macro,
  list_reduce(list(f1 ORDER BY level), {red}) / CAST(count(*) AS DOUBLE) AS f1_macro,
  list_reduce(list(recall ORDER BY level) FILTER (WHERE support > 0), {red})
    / CAST(count(*) FILTER (WHERE support > 0) AS DOUBLE) AS balanced_accuracy
FROM pc"""
    o["confusion_rates"] = with_(RULE_PRED) + """SELECT actual, predicted, n,
  CASE WHEN sum(n) OVER (PARTITION BY actual) > 0
       THEN CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY actual) AS DOUBLE) ELSE 0.0 END AS rate
FROM conf"""
    series = with_(IMPUTED, _series_sql())
    o["rolling_means"] = series + "SELECT city, date, " + ", ".join(
        f"{v}_roll_{n}h" for v in ("precip", "wind") for n in (3, 6, 12)) + " FROM series"
    o["rolling_means_halo"] = o["rolling_means"]
    o["lag_features"] = series + "SELECT city, date, " + ", ".join(
        f"{v}_lag_{k}h" for v in ("precip", "temp") for k in (1, 2, 3)) + " FROM series"
    o["peak_flags"] = series + "SELECT city, date, " + ", ".join(
        f"coalesce(CAST({x} > {mean} * CAST({factor} AS DOUBLE) AS INTEGER), 0) AS {flag}"
        for flag, x, mean, factor in PEAKS) + " FROM series"
    o["series_upkeep"] = series + "SELECT city, date, " + ", ".join(
        [f"{v}_roll_{n}h" for v in ("precip", "wind") for n in (3, 6, 12)]
        + [f"{v}_lag_{k}h" for v in ("precip", "temp") for k in (1, 2, 3)]
        + [f"coalesce(CAST({x} > {mean} * CAST({factor} AS DOUBLE) AS INTEGER), 0) AS {flag}"
           for flag, x, mean, factor in PEAKS]) + " FROM series"
    o["rolling_means_clustered"] = o["rolling_means"]
    o["city_day_clustered"] = with_(IMPUTED) + """SELECT city, CAST(date AS DATE) AS day, count(*) AS n_hours,
  min(date) AS first_ts, avg(temperature_2m) AS temperature_2m, sum(precipitation) AS precipitation,
  max(windspeed_10m) AS windspeed_10m
FROM imputed GROUP BY ALL"""
    o["serving_head_means"] = with_(SERVING) + "SELECT city, day, first_ts, n_hours, " + ", ".join(
        f"{v}_roll_{n}h" for v in ("precip", "wind") for n in (3, 6, 12)) + " FROM sday"
    o["serving_tail_values"] = with_(SERVING) + "SELECT city, day, " + ", ".join(
        [f"CASE WHEN n_hours > {k} THEN p{k} ELSE 0.0 END AS precip_lag_{k}h" for k in (1, 2, 3)]
        + [f"CASE WHEN n_hours > {k} THEN t{k} ELSE temp_mean END AS temp_lag_{k}h" for k in (1, 2, 3)]
    ) + " FROM sday"
    o["temporal_features"] = with_() + """SELECT city, date, CAST(hour(date) AS INTEGER) AS hour,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
  CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
  CAST(hour(date) IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour
FROM obs"""
    o["date_labels"] = with_() + """SELECT city, day, strftime(day, '%A') AS day_name,
  strftime(day, '%B %d, %Y') AS long_date, strftime(day, '%Y%m%d') AS compact_date
FROM (SELECT DISTINCT city, CAST(date AS DATE) AS day FROM obs)"""
    o["weather_bins"] = with_(IMPUTED) + """SELECT city, date,
  apparent_temperature - temperature_2m AS apparent_temp_delta,
  CASE WHEN precipitation <= 0 THEN 0 WHEN precipitation <= 5 THEN 1 WHEN precipitation <= 15 THEN 2
       WHEN precipitation <= 50 THEN 3 WHEN precipitation IS NOT NULL THEN 4 END AS precip_intensity,
  CASE WHEN windspeed_10m <= 20 THEN 0 WHEN windspeed_10m <= 40 THEN 1 WHEN windspeed_10m <= 60 THEN 2
       WHEN windspeed_10m IS NOT NULL THEN 3 END AS wind_category
FROM imputed"""
    o["encode_city"] = with_() + """SELECT city,
  CAST(row_number() OVER (ORDER BY city) - 1 AS INTEGER) AS city_encoded
FROM (SELECT DISTINCT city FROM obs WHERE city IS NOT NULL)"""
    o["risk_label"] = with_(MODE) + """SELECT city, day, level,
  CASE WHEN level IS NOT NULL
    THEN (['None', 'Low', 'Medium', 'High', 'Critical'])[least(level, 4) + 1] END AS risk_level FROM mode_lvl"""
    shares = ", ".join(
        f"avg(CASE WHEN suspension IS NULL THEN NULL WHEN suspension = {i} THEN CAST(1 AS DOUBLE) "
        f"ELSE CAST(0 AS DOUBLE) END) AS p{i}" for i in range(6))
    unn = "\nUNION ALL ".join(f"SELECT city, day, {i} AS level, p{i} * 100 AS pct FROM sh"
                              for i in range(5))
    o["prob_pad"] = with_(f"sh AS (SELECT city, CAST(date AS DATE) AS day, {shares} FROM obs GROUP BY ALL)") + unn
    text, n = alerts_sql()
    o["weather_alerts"] = with_(EXTREMES) + f"SELECT city, day, {n} AS n_alerts, {text} AS alerts FROM ext"
    o["stratified_split"] = with_(SPLIT) + "SELECT city, date, suspension, is_test FROM split"
    o["time_split"] = with_("""h AS (SELECT date, count(*) AS c FROM obs GROUP BY date),
cum AS (SELECT date, sum(c) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum,
               sum(c) OVER () AS n FROM h),
cut AS (SELECT min(date) AS cutoff FROM cum WHERE cum > n - (2 * n + 5) // 10)""") + """SELECT city, date,
  suspension, coalesce(date >= cut.cutoff, false) AS is_test FROM obs, cut"""
    o["class_weights"] = with_(SPLIT) + """SELECT suspension, n,
  CAST(sum(n) OVER () AS DOUBLE) / CAST(count(*) OVER () * n AS DOUBLE) AS weight
FROM (SELECT suspension, count(*) AS n FROM train GROUP BY suspension)"""
    o["oversample_counts"] = with_(SPLIT) + """SELECT suspension,
  CAST(CASE WHEN n < t THEN t ELSE n END AS BIGINT) AS n_after,
  CAST(CASE WHEN n < t THEN t - n ELSE 0 END AS BIGINT) AS n_synthetic
FROM (SELECT suspension, n, CAST(floor(CAST(max(n) OVER () AS DOUBLE) * 0.8) AS BIGINT) AS t
      FROM (SELECT suspension, count(*) AS n FROM train GROUP BY suspension))"""
    o["oversample_copies"] = with_(SPLIT, f"""r AS (
  SELECT city, date, suspension,
         row_number() OVER (PARTITION BY suspension ORDER BY {KEY}, {KEY_TXT}) AS rk,
         count(*) OVER (PARTITION BY suspension) AS n
  FROM train
),
t AS (SELECT CAST(floor(CAST(max(n) AS DOUBLE) * 0.8) AS BIGINT) AS target FROM r)""") + """SELECT city, date,
  suspension,
  CAST(CASE WHEN n < target
            THEN (target - n) // n + CASE WHEN rk <= (target - n) % n THEN 1 ELSE 0 END
            ELSE 0 END AS BIGINT) AS n_copies
FROM r, t"""
    o["cv_folds"] = with_(SPLIT) + f"""SELECT city, date, suspension,
  CAST((row_number() OVER (PARTITION BY suspension ORDER BY {KEY}, {KEY_TXT}) - 1) % 5 AS INTEGER) AS fold
FROM train"""
    o["standardize"] = with_(IMPUTED, f"""x AS (
  SELECT *, apparent_temperature - temperature_2m AS apparent_temp_delta,
         row_number() OVER (PARTITION BY suspension ORDER BY {KEY}, {KEY_TXT})
           <= (2 * count(*) OVER (PARTITION BY suspension) + 5) // 10 AS is_test
  FROM imputed
)""") + "\nUNION ALL ".join(
        f"SELECT {_q(c)} AS column, avg({c}) AS mean, round(stddev_pop({c}), 9) AS std FROM x WHERE NOT is_test"
        for c in W + ["apparent_temp_delta"])
    hist_cols = ", ".join(W)
    o["unified_city_day"] = with_(SUMMARY, MODE, f"""b AS (SELECT max(CAST(date AS DATE)) AS hi FROM obs),
ahead AS (
  SELECT city, date + INTERVAL {FORECAST_DAYS} DAY AS date, {hist_cols}
  FROM obs, b WHERE date >= CAST(b.hi - {FORECAST_DAYS - 1} AS TIMESTAMP)
)""") + f"""SELECT 'historical' AS mode, cd.city, cd.day, {', '.join('cd.' + c for c in W)}, cd.n_hours,
  m.level, false AS is_prediction, CAST(1.0 AS DOUBLE) AS confidence
FROM cd JOIN mode_lvl m USING (city, day)
UNION ALL
SELECT 'forecast' AS mode, city, CAST(date AS DATE) AS day,
  avg(relativehumidity_2m), avg(temperature_2m), coalesce(sum(precipitation), 0.0),
  avg(apparent_temperature), avg(windspeed_10m), count(*), CAST(NULL AS INTEGER), true,
  CAST(NULL AS DOUBLE)
FROM ahead GROUP BY city, CAST(date AS DATE)"""
    text_b, _n = alerts_sql("max_wind", "total_precip", "max_temp", "cd.relativehumidity_2m")
    rule = rule_level_sql("cd.windspeed_10m", "cd.precipitation", "cd.apparent_temperature")
    o["advisory_bulletin"] = with_(SUMMARY, MODE, LEVELS, EXTREMES, CITY_DIM_CTE.strip(), f"""x AS (
  SELECT cd.city, cd.day, m.level, {rule} AS rule_level, greatest(m.level, {rule}) AS final_level,
    {reasons_sql('cd.windspeed_10m', 'cd.precipitation', 'cd.apparent_temperature')} AS reasons,
    {text_b} AS alerts, ext.min_temp, ext.max_temp, ext.avg_temp, ext.max_wind, ext.avg_wind,
    ext.total_precip, ext.max_precip_hour, cd.relativehumidity_2m
  FROM cd JOIN mode_lvl m ON m.city = cd.city AND m.day = cd.day
  JOIN ext ON ext.city = cd.city AND ext.day = cd.day
)""") + f"""SELECT x.*, c.lat, c.lon,
  CASE WHEN x.final_level <= 0 THEN 'none' WHEN x.rule_level > x.level THEN 'rules'
       ELSE 'model' END AS decision_source,
  coalesce(lv.level_name, 'Unmapped') AS level_name, coalesce(lv.risk, 'Unmapped') AS risk,
  {_text_sql('x.final_level', SCOPE_TEXTS, NO_SCOPE)} AS scope,
  {_text_sql('x.final_level', RECOMMENDATIONS, RECOMMENDATION_ABOVE)} AS recommendation
FROM x LEFT JOIN lv ON lv.level = x.final_level LEFT JOIN city_dim c ON c.city = x.city"""
    sw, sp, sa = "s_windspeed", "s_precipitation", "s_apparent"
    o["scenario_grid"] = with_(SUMMARY, _scenario_sql(), """g AS (
  SELECT cd.city, cd.day, sc.scenario, sc.s_hour, CAST(cd.day + sc.d_days AS DATE) AS s_day,
         CASE WHEN cd.relativehumidity_2m IS NOT NULL
              THEN least(100.0, greatest(0.0, cd.relativehumidity_2m + sc.d_humidity)) END AS s_humidity,
         greatest(cd.windspeed_10m + sc.d_wind, 0.0) AS s_windspeed,
         greatest(cd.precipitation + sc.d_precip, 0.0) AS s_precipitation,
         cd.temperature_2m + sc.d_temp + CAST(-2.0 AS DOUBLE) AS s_apparent
  FROM cd CROSS JOIN sc
)""") + f"""SELECT city, day, scenario, s_humidity, s_hour, CAST(isodow(s_day) - 1 AS INTEGER) AS s_weekday,
  CAST(month(s_day) AS INTEGER) AS s_month, {rule_level_sql(sw, sp, sa)} AS rule_level,
  {reasons_sql(sw, sp, sa)} AS reasons FROM g"""
    o["training_features"] = series[:-1] + """,
codes AS (SELECT city, row_number() OVER (ORDER BY city) - 1 AS city_encoded
          FROM (SELECT DISTINCT city FROM obs WHERE city IS NOT NULL))
""" + "SELECT city, date, " + ", ".join(
        f"CAST({e} AS DOUBLE) AS {c}" for c, e in _feature_sql().items()) + \
        ", suspension FROM series LEFT JOIN codes USING (city)"
    o["class_accuracy"] = with_(RULE_PRED) + """SELECT actual AS level, correct, total,
  CASE WHEN total > 0 THEN CAST(correct AS DOUBLE) / CAST(total AS DOUBLE) END AS class_accuracy
FROM (SELECT actual, CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS BIGINT) AS correct,
             CAST(sum(n) AS BIGINT) AS total FROM conf GROUP BY actual)"""
    o["fold_accuracy"] = with_(SPLIT, f"""f AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY suspension ORDER BY {KEY}, {KEY_TXT}) - 1) % 5 AS INTEGER) AS fold
  FROM train
),
p AS (SELECT fold, CAST(sum(CASE WHEN suspension = {rule_level_sql()} THEN 1 ELSE 0 END) AS DOUBLE)
             / CAST(count(*) AS DOUBLE) AS accuracy FROM f GROUP BY fold)""") + """SELECT fold, accuracy,
  round(avg(accuracy) OVER (), 9) AS accuracy_mean,
  round(stddev_pop(accuracy) OVER (), 9) AS accuracy_std FROM p"""
    o["weighted_rows"] = with_(SPLIT) + """SELECT suspension, n, round(CAST(n AS DOUBLE) * CAST(sum(n) OVER () AS DOUBLE)
  / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight
FROM (SELECT suspension, count(*) AS n FROM train GROUP BY suspension)"""
    o["sinks_roundtrip"] = with_(IMPUTED, RULE_PRED) + """SELECT pc.level, pc.precision, pc.recall, pc.f1,
  pc.support, t.precipitation_mean, t.windspeed_max, t.humidity_mean, t.count, w.n_wrong,
  (SELECT CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) FROM pc) AS accuracy
FROM pc LEFT JOIN (SELECT suspension AS level, avg(precipitation) AS precipitation_mean,
    max(windspeed_10m) AS windspeed_max, avg(relativehumidity_2m) AS humidity_mean, count(*) AS count
  FROM imputed WHERE suspension IS NOT NULL GROUP BY 1) t USING (level)
LEFT JOIN (SELECT actual AS level, CAST(sum(n) AS BIGINT) AS n_wrong FROM conf
           WHERE actual <> predicted GROUP BY 1) w USING (level)"""
    o["request_routing"] = with_(SUMMARY, MODE, AHEAD) + f"""SELECT 'historical' AS mode, city, day, {', '.join('cd.' + c for c in W)}, m.level, false AS is_prediction
FROM req JOIN cd USING (city, day) JOIN mode_lvl m USING (city, day)
UNION ALL
SELECT 'forecast', city, day, {', '.join('fc.' + c for c in W)}, CAST(NULL AS INTEGER), true
FROM req JOIN fc USING (city, day)
WHERE NOT EXISTS (SELECT 1 FROM cd JOIN mode_lvl m USING (city, day) WHERE cd.city = req.city AND cd.day = req.day)"""
    o["unanswered_requests"] = with_(SUMMARY, MODE, AHEAD) + """SELECT city, day FROM req
WHERE NOT EXISTS (SELECT 1 FROM cd JOIN mode_lvl m USING (city, day) WHERE cd.city = req.city AND cd.day = req.day)
  AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.city = req.city AND fc.day = req.day)"""
    o["stream_city_day"] = with_(SUMMARY) + (
        "SELECT city, day, " + ", ".join(W) + f", n_hours, {rule_level_sql()} AS rule_level, "
        f"{reasons_sql()} AS reasons FROM cd")
    for name, same in (("kpis", "range_kpis"), ("ranking", "city_ranking"), ("trend", "daily_trend"),
                       ("hour_weekday", "hour_weekday_pivot"), ("extremes", "day_extremes"),
                       ("days_per_level", "days_per_level")):
        o[f"rollup_{name}"] = o[same]
    o["rollup_correlations"] = o["corr_matrix"] + " WHERE var_x <> var_y"
    o["rule_bands"] = o["rule_engine"]
    later = "day >= DATE '2024-01-15'"
    rain1 = f"""CASE WHEN {later} THEN CASE WHEN precipitation >= 2.5 THEN 'Rain from 2.5 mm' END
    WHEN precipitation >= {CRITERIA_RAIN[0][1]} THEN {_q(CRITERIA_RAIN[0][3])} END"""
    items = _reason_items("windspeed_10m", "precipitation", "apparent_temperature")
    items[1] = rain1
    o["rule_bands_changed"] = with_(SUMMARY) + f"""SELECT city, day,
  greatest({wind_level_sql("windspeed_10m")}, CASE WHEN {later} AND precipitation >= 2.5 THEN 2
    WHEN NOT {later} AND precipitation >= {CRITERIA_RAIN[0][1]} THEN {CRITERIA_RAIN[0][2]} ELSE 0 END,
    {threshold_level_sql("precipitation", CRITERIA_RAIN[1:])},
    {threshold_level_sql("apparent_temperature", CRITERIA_HEAT)}) AS rule_level,
  {" + ".join(f"CAST(({i}) IS NOT NULL AS INTEGER)" for i in items)} AS n_reasons,
  concat_ws('; ', {", ".join(items)}) AS reasons FROM cd"""
    o["scenario_table"] = o["scenario_grid"]
    values = " UNION ALL ".join(
        f"SELECT suspension AS level, '{v}' AS variable, {v} AS value FROM obs" for v in BOX_VARS)
    o["sketch_quartiles"] = with_() + f"""SELECT level, variable, count(*) AS n, min(value) AS min,
  max(value) AS max, true AS within FROM ({values}) WHERE level IS NOT NULL AND value IS NOT NULL GROUP BY ALL"""
    o["published_bulletin"] = o["advisory_bulletin"]
    o["published_days"] = with_() + """SELECT CAST(date AS DATE) AS day,
  CASE WHEN bool_or(day(date) % 5 = 0 AND hour(date) >= 12) THEN 2 ELSE 1 END AS version,
  count(DISTINCT city) AS n FROM obs GROUP BY 1"""
    o["stream_state_city_day"] = o["stream_city_day"]
    o["stream_late_readings"] = with_() + f"""SELECT {all_cols} FROM obs
  WHERE hour(date) IN (2, 8, 14, 20) AND date <= (
    SELECT max(date) - INTERVAL 6 HOUR FROM obs WHERE hour(date) NOT IN (2, 8, 14, 20))"""
    o["stream_forecast_latest"] = with_() + "SELECT city, date, " + ", ".join(
        f"{c} + k AS {c}" for c in W) + """,
  date_trunc('day', date) - k * INTERVAL 1 DAY AS issued_at
FROM (SELECT *, unnest([0, 1, 2]) AS k FROM obs) WHERE hour(date) % 3 <> k
QUALIFY row_number() OVER (PARTITION BY city, date ORDER BY k) = 1"""
    return o


ORACLE = build()
