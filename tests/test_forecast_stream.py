"""Revisions in the stream: the latest issue per hour, days emitted when closed."""

import datetime as dt
import os

import pytest

from stormcell.plans.serving import latest_forecast
from stormcell.schema import WEATHER_COLS
from stormcell.session import scratch_path
from stormcell.streaming import forecast_stream as fs


def issue(city, day, issued, value, hours=(0, 6, 12)):
    return [(city, dt.datetime(2024, 1, day, h), issued, *[float(value + i) for i in range(5)])
            for h in hours]


def frame(spark, rows):
    return spark.createDataFrame(rows, fs.ISSUED)


def _set(df):
    return sorted(tuple(map(str, r)) for r in df.select("city", "date", "issued_at", *WEATHER_COLS).collect())


def _drain(spark, src, sink, ckpt, **options):
    fs.start(fs.forecast_stream(spark, src, **options), sink, ckpt).awaitTermination()


@pytest.fixture
def paths(spark):
    return [scratch_path(spark, n) for n in ("f-src", "f-sink", "f-ckpt")]


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def test_days_close_late_revisions_are_merged_and_open_days_read(spark, paths):
    src, sink, ckpt = paths
    drops = [
        issue("A", 3, at(1, 0), 10) + issue("A", 4, at(1, 0), 20),
        issue("A", 3, at(2, 0), 11, hours=(6, 12)) + issue("B", 3, at(2, 0), 30),
        issue("A", 4, at(5, 12), 21),                                # closes days 3 and 4
        issue("A", 3, at(2, 12), 99, hours=(0,)) + issue("A", 3, at(1, 12), 98, hours=(12,))
        + issue("A", 9, at(5, 0), 40),                               # late ones, an open day
    ]
    for i, rows in enumerate(drops):
        frame(spark, rows).coalesce(1).write.parquet(os.path.join(src, f"drop={i}"))
        _drain(spark, src, sink, ckpt)
    closed = fs.emitted(spark, sink, "closed").collect()
    assert sorted((r.city, r.date.day, r.date.hour, r.issued_at) for r in closed) == sorted(
        [("A", 3, 0, at(1, 0)), ("A", 3, 6, at(2, 0)), ("A", 3, 12, at(2, 0))]
        + [("B", 3, h, at(2, 0)) for h in (0, 6, 12)] + [("A", 4, h, at(5, 12)) for h in (0, 6, 12)])
    assert fs.emitted(spark, sink, "late").count() == 2
    assert fs.open_hours(spark, ckpt).count() == 3
    everything = frame(spark, [r for d in drops for r in d])
    assert _set(fs.latest(spark, sink, ckpt)) == _set(latest_forecast(everything))


@pytest.mark.parametrize("files", [None, 1])
def test_answer_does_not_depend_on_the_file_cut(spark, paths, files):
    src, sink, ckpt = paths
    rows = [r for c in "AB" for d in range(2, 9) for k in range(4)
            for r in issue(c, d, at(max(1, d - k), k), 100 * d + 10 * k)]
    rows += [(None, *rows[0][1:]), ("A", None, *rows[0][2:]), ("A", rows[0][1], None, *rows[0][3:])]
    df = frame(spark, rows)
    df.repartition(4, "city", "date").write.parquet(src)
    _drain(spark, src, sink, ckpt, max_files_per_trigger=files)
    assert _set(fs.latest(spark, sink, ckpt)) == _set(latest_forecast(
        df.where("city IS NOT NULL AND date IS NOT NULL AND issued_at IS NOT NULL")))
