"""Dimension and rule tables."""

from stormcell.sources import dims


def test_city_and_level_dimensions(spark):
    cities = dims.city_dim(spark).collect()
    assert len(cities) == 17 and len({r["city"] for r in cities}) == 17
    assert {"Las Piñas", "Parañaque"} <= {r["city"] for r in cities}
    levels = dims.level_dim(spark).orderBy("level").collect()
    assert [r["level"] for r in levels] == [0, 1, 2, 3, 4]  # no row for level 5
    assert [r["risk"] for r in levels] == dims.RISK_LEVELS
    assert all(r["description"] for r in levels)


def test_rule_tables(spark):
    wind = dims.criteria_wind(spark).orderBy("signal").collect()
    assert [(r["wind_min"], r["wind_max"]) for r in wind] == [(30.0, 60.0), (60.0, 100.0),
                                                               (100.0, 150.0), (150.0, 300.0)]
    rain = [r["precip"] for r in dims.criteria_rain(spark).orderBy("level").collect()]
    heat = [r["temp"] for r in dims.criteria_heat(spark).orderBy("level").collect()]
    assert rain == sorted(rain) and heat == sorted(heat)
