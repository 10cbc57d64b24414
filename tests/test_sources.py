"""Sources: CSV with explicit schema, landed forecast JSON, JSON text payloads."""

import json

from pyspark.sql import functions as F

from stormcell.schema import OBS_SCHEMA
from stormcell.sources import csv_source, forecast
from tests.conftest import obs_frame


def test_csv_round_trip_keeps_schema(spark, tmp_path):
    obs = obs_frame(spark, [("Las Piñas", "2024-01-01 05", None, 25.5, 0.0, 27.25, 12.0, 2)])
    path = str(tmp_path / "obs_csv")
    csv_source.write_obs_csv(obs, path)
    back = csv_source.read_obs_csv(spark, path)
    assert back.schema == OBS_SCHEMA or [f.dataType for f in back.schema] == \
        [f.dataType for f in OBS_SCHEMA]
    assert back.collect() == obs.collect()


def test_forecast_document_explodes_in_order(spark, tmp_path):
    doc = {"city": "Pasig", "date": "2025-01-01", "hourly": {
        "time": ["2025-01-01T00:00", "2025-01-01T01:00", "2025-01-01T02:00"],
        "temperature_2m": [27.1, 26.8, None],
        "relativehumidity_2m": [80.0, 82.0, 85.0],
        "precipitation": [0.0, 1.5, 3.0],
        "apparent_temperature": [30.0, 29.5, 29.0],
        "windspeed_10m": [10.0, 12.0, 9.0]}}
    path = tmp_path / "fc"
    path.mkdir()
    (path / "doc.json").write_text(json.dumps(doc) + "\n")
    rows = forecast.read_forecast(spark, str(path)).orderBy("date").collect()
    assert len(rows) == 3 and rows[1]["precipitation"] == 1.5
    assert rows[2]["temperature_2m"] is None and rows[0]["date"].hour == 0


def test_forecast_from_text_column(spark):
    doc = {"city": "Pasig", "date": "2025-01-01", "hourly": {
        "time": ["2025-01-01T10:00"], "temperature_2m": [30.0], "relativehumidity_2m": [70.0],
        "precipitation": [0.5], "apparent_temperature": [33.0], "windspeed_10m": [5.0]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "value STRING")
    r = forecast.parse_forecast_text(df).first()
    assert r["city"] == "Pasig" and r["date"].hour == 10 and r["apparent_temperature"] == 33.0


def test_docs_round_trip(spark, tmp_path):
    rows = [("A", f"2024-01-01 {h:02d}", 50.0 + h, 20.0, float(h), 22.0, 1.0, 0) for h in (3, 1, 2)]
    obs = obs_frame(spark, rows).drop("suspension")
    path = str(tmp_path / "docs")
    forecast.land_forecast_docs(forecast.docs_from_hourly(obs), path)
    back = forecast.read_forecast(spark, path)
    assert sorted(back.collect()) == sorted(obs.select(back.columns).collect())
    assert F is not None


def test_landing_follows_its_source(spark, tmp_path):
    from stormcell.session import land_once, landed_path
    src = str(tmp_path / "src")

    def load():
        path = land_once(spark, landed_path(spark, "copy", src),
                         lambda p: spark.read.parquet(f"{src}/t.parquet").write.parquet(p))
        return path, spark.read.parquet(path).count()

    spark.range(3).write.parquet(f"{src}/t.parquet")
    first, n = load()
    assert n == 3 and load() == (first, 3)
    spark.range(10).write.mode("overwrite").parquet(f"{src}/t.parquet")
    second, n = load()
    assert n == 10 and second != first
    import os
    assert not os.path.exists(first.replace("file:", ""))  # superseded


def test_every_site_has_coordinates_and_no_city_day_is_lost(spark):
    from stormcell.operators import aggregates, lookups
    from stormcell.queries import q_suspension_map
    from stormcell.sources import dims
    from stormcell.sources.fixture import load_obs
    sf = "/root/testdata/sf0.1"
    days = aggregates.day_level_mode(load_obs(spark, sf))
    got = q_suspension_map(spark, sf)
    assert (got.count(), got.select("city").distinct().count()) == (5010, 167)
    assert got.filter("lat is null").count() == 0
    none = lookups.suspension_map(days, spark.createDataFrame([], dims.CITY_SCHEMA),
                                  dims.level_dim(spark))
    assert none.count() == 5010


OBS_LINES = [
    ("Pasig,2024-01-01 05:00:00,80,25.5,0,27.25,12.0,2", None),
    ("Pasig,2024-01-01 06:00:00,,,,,,0", None),
    ('"Las Piñas, north",2024-01-01 06:00:00,1e1,-2.,.5,+3,4,0', None),
    ("Pasig,2024-01-01 07:00:00,80", "wrong number of fields"),
    ("Pasig,2024-01-01 07:00:00,1,2,3,4,5,0,9", "wrong number of fields"),
    (",2024-01-01 07:00:00,1,2,3,4,5,0", "no city"),
    ("Pasig,,1,2,3,4,5,0", "no date"),
    ("Pasig,2024-02-30 07:00:00,1,2,3,4,5,0", "date: no time"),
    ("Pasig,2024-01-01,1,2,3,4,5,0", "date: no time"),
    ("Pasig,2024-01-01 07:00:00,1,2,NaN,4,5,0", "precipitation: no number"),
    ("Pasig,2024-01-01 07:00:00,1,2,3,4,5d,0", "windspeed_10m: no number"),
    ("Pasig,2024-01-01 07:00:00,1,2,3,4,5,1.5", "suspension: no number"),
    ("<html>", "wrong number of fields"),
]


def test_every_csv_line_is_good_or_in_quarantine(spark, tmp_path):
    from stormcell.sources import rejects
    src = tmp_path / "csv"
    src.mkdir()
    header = ",".join(f.name for f in OBS_SCHEMA.fields)
    for i in (0, 1):
        (src / f"{i}.csv").write_text("\n".join([header, "", *[x for x, _ in OBS_LINES[i::2]], ""]))
    checked = csv_source.checked_obs_csv(spark, str(src))
    path = str(tmp_path / "landed")
    rejects.land(checked, path)
    good, bad = rejects.read_landed(spark, path, checked.schema)
    assert good.count() + bad.count() == len(OBS_LINES)
    assert sorted((r["line"], r["reason"]) for r in bad.collect()) == sorted(x for x in OBS_LINES if x[1])
    assert all(r["source"].endswith(".csv") for r in bad.collect())
    assert {f.name: f.dataType for f in good.schema} == {f.name: f.dataType for f in OBS_SCHEMA}
    rows = {(r["city"], r["date"].hour): r for r in good.collect()}
    assert rows["Pasig", 5]["windspeed_10m"] == 12.0 and rows["Pasig", 6]["precipitation"] is None
    assert rows["Las Piñas, north", 6]["relativehumidity_2m"] == 10.0
    n = {r["reason"]: r["n"] for r in rejects.tally(checked).collect()}
    assert n["ok"] == 3 and sum(n.values()) == len(OBS_LINES)


def test_every_forecast_document_is_good_or_in_quarantine(spark, tmp_path):
    from stormcell.sources import rejects
    sound = {"city": "Pasig", "date": "2025-01-01", "hourly": {
        "time": ["2025-01-01T00:00", "2025-01-01T01:00"], "temperature_2m": [27.1, None],
        "relativehumidity_2m": [80.0, 82.0], "precipitation": [0.0, 1.5],
        "apparent_temperature": [30.0, 29.5], "windspeed_10m": [10.0, 12.0]}}

    def but(**hourly):
        return {**sound, "hourly": {k: v for k, v in {**sound["hourly"], **hourly}.items() if v != "gone"}}

    docs = [
        (json.dumps(sound), None),
        (json.dumps({**sound, "extra": {"a": [1]}, "date": None}), None),
        (json.dumps(sound)[:60], "not JSON of the schema"),
        ("[1, 2", "not JSON of the schema"),
        (json.dumps(but(precipitation=["wet", "dry"])), "not JSON of the schema"),
        (json.dumps({**sound, "city": None}), "no city"),
        (json.dumps({"city": "Pasig"}), "no time"),
        (json.dumps(but(windspeed_10m="gone")), "no windspeed_10m"),
        (json.dumps(but(windspeed_10m=[1.0])), "windspeed_10m: other length than time"),
        (json.dumps(but(time=["2025-01-01T00:00", None])), "time: no time"),
        (json.dumps(but(time=["2025-01-01T00:00", "2025-13-01T00:00"])), "time: no time"),
    ]
    src = tmp_path / "fc"
    src.mkdir()
    (src / "docs.json").write_text("\n".join(x for x, _ in docs) + "\n\n")
    checked = forecast.checked_forecast(spark, str(src))
    assert sorted((r["line"], r["reason"]) for r in rejects.rejected(checked).collect()) == sorted(
        x for x in docs if x[1])
    assert forecast.hourly_rows(rejects.good(checked)).count() == 4


def test_unknown_cities_are_the_reject_output(spark):
    from stormcell.operators import lookups
    req = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "A")], "id int, city string")
    dim = spark.createDataFrame([("A", 1.0, 2.0), ("A", 1.0, 2.0)], "city string, lat double, lon double")
    got = {r["id"]: r["reason"] for r in lookups.unknown_cities(req, dim).collect()}
    assert got == {2: "unknown city", 3: "no city"}
