"""The stream with operator state: its answer, its late table, and what a
micro-batch reads."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from stormcell.operators import rules
from stormcell.operators.aggregates import city_day_summary
from stormcell.session import scratch_path
from stormcell.streaming import city_day_stream as stream
from stormcell.streaming import stateful_city_day as stateful
from tests.conftest import obs_frame

COLUMNS = ["city", "day", "temperature_2m", "relativehumidity_2m", "precipitation",
           "apparent_temperature", "windspeed_10m", "n_hours", "rule_level", "rule_reasons"]


def _rows(day, hours, precip=1.0, city="A"):
    return [(city, f"2024-01-{day:02d} {h:02d}", 50.0, 25.0 + h, precip, 27.0, 10.0, 0) for h in hours]


def _set(df):
    return sorted(tuple(map(str, r)) for r in df.select(COLUMNS).collect())


def _drain(spark, src, sink, ckpt, **options):
    stateful.start(stream.city_day_stream(spark, src, **options), sink, ckpt).awaitTermination()


@pytest.fixture
def paths(spark):
    return [scratch_path(spark, n) for n in ("s-src", "s-sink", "s-ckpt")]


def test_late_readings_are_kept_and_merged(spark, paths):
    src, sink, ckpt = paths
    drops = [
        _rows(1, [h for h in range(24) if h != 5]) + _rows(3, range(6)),
        # day 1 is closed: its hour 5 comes late, its hour 2 again with another value
        _rows(3, [3]) + _rows(1, [2], precip=99.0) + _rows(1, [5], precip=7.0) + _rows(3, range(6, 24)),
        _rows(1, [5], precip=50.0) + _rows(2, [1]) + _rows(4, [0]),
    ]
    for i, rows in enumerate(drops):
        obs_frame(spark, rows).coalesce(1).write.parquet(os.path.join(src, f"drop={i}"))
        _drain(spark, src, sink, ckpt)
    closed = {r["day"].day: r for r in spark.read.parquet(os.path.join(sink, "closed")).collect()}
    assert closed[1]["n_hours"] == 23 and closed[1]["precipitation"] == 23.0
    dropped = stateful.dropped_readings(spark, sink)
    assert sorted((r["date"].day, r["date"].hour, r["precipitation"]) for r in dropped.collect()) == [
        (1, 2, 99.0), (1, 5, 7.0), (1, 5, 50.0), (2, 1, 1.0), (3, 3, 1.0)]
    for _ in range(2):  # a second repair changes nothing
        stateful.repair(spark, sink)
        days = {r["day"].day: r for r in stateful.city_days(spark, sink).collect()}
        assert days[1]["n_hours"] == 24 and days[1]["precipitation"] == 30.0  # first delivery counts
        assert days[1]["rule_level"] == 4 and days[2]["n_hours"] == 1
        assert days[3]["n_hours"] == 24 and days[4]["n_hours"] == 1 and len(days) == 4
        late = stateful.late_readings(spark, sink).collect()
        assert sorted((r["date"].day, r["date"].hour) for r in late) == [(1, 5), (2, 1)]


def test_broken_off_repair_is_run_again(spark, paths):
    src, sink, ckpt = paths
    for i, rows in enumerate([_rows(1, range(12)) + _rows(3, [0]), _rows(1, range(10, 20))]):
        obs_frame(spark, rows).coalesce(1).write.parquet(os.path.join(src, f"drop={i}"))
        _drain(spark, src, sink, ckpt)
    stateful.repair(spark, sink)
    want = _set(stateful.city_days(spark, sink))
    shutil.rmtree(os.path.join(sink, "repaired").replace("file:", ""))
    shutil.rmtree(os.path.join(sink, "repaired_upto").replace("file:", ""))
    stateful.repair(spark, sink)
    assert _set(stateful.city_days(spark, sink)) == want


@pytest.mark.parametrize("files", [None, 1, 3])
def test_answer_does_not_depend_on_the_file_cut(spark, paths, files):
    src, sink, ckpt = paths
    rows = [r for c in "ABCD" for d in (1, 2, 3, 9) for r in _rows(d, range(0, 24, 2), city=c)]
    rows += _rows(2, [0, 2], city="A")  # twice
    obs = obs_frame(spark, rows)
    # files hold one city each: every file begins before the watermark of the one before
    obs.repartitionByRange(4, "city").sortWithinPartitions("city", "date").write.parquet(src)
    _drain(spark, src, sink, ckpt, max_files_per_trigger=files)
    stateful.repair(spark, sink)
    want = rules.apply_rules(city_day_summary(obs.distinct()))
    assert _set(stateful.city_days(spark, sink)) == _set(want)


def test_rows_without_city_or_time_are_dropped_not_lost(spark, paths):
    src, sink, ckpt = paths
    obs = obs_frame(spark, _rows(1, range(3)) + _rows(4, [0]))
    bad = obs.limit(2).withColumn("date", F.lit(None).cast("timestamp_ntz"))
    obs.union(bad).coalesce(1).write.parquet(src)
    _drain(spark, src, sink, ckpt)
    assert stateful.dropped_readings(spark, sink).count() == 2
    stateful.repair(spark, sink)
    assert stateful.city_days(spark, sink).count() == 2


def test_a_micro_batch_reads_nothing_back(spark, paths):
    """What earlier batches wrote is destroyed: batch 200 does not look at it, and
    its plan scans no file."""
    src, sink, ckpt = paths
    obs_frame(spark, _rows(1, range(4)) + _rows(3, [0])).coalesce(1).write.parquet(src)
    _drain(spark, src, sink, ckpt)
    for kind in ("accepted", "closed"):
        top = os.path.join(sink, kind).replace("file:", "")
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".parquet"):
                    with open(os.path.join(d, n), "wb") as f:
                        f.write(b"not parquet")
    batch = (obs_frame(spark, _rows(5, [1, 2])).withColumn("kind", F.lit("raw"))
             .withColumn("day", F.to_date("date")).withColumn("n_hours", F.lit(None).cast("long")))
    batch = batch.union(batch.limit(1).withColumn("kind", F.lit("accepted")))
    stateful.write_batch(batch, 200, sink)
    got = spark.read.schema("city string, date timestamp_ntz").parquet(
        os.path.join(sink, "accepted", "day=2024-01-05", "batch_id=200"))
    assert got.count() == 1
    assert spark.read.parquet(os.path.join(sink, "dropped", "batch_id=200")).count() == 1


def test_state_is_bounded_by_the_watermark(spark, paths):
    src, sink, ckpt = paths
    for d in range(1, 8):
        obs_frame(spark, _rows(d, range(24))).coalesce(1).write.parquet(os.path.join(src, f"drop={d}"))
    q = stateful.start(stream.city_day_stream(spark, src, max_files_per_trigger=1), sink, ckpt)
    q.awaitTermination()
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress
            if p["stateOperators"]]
    assert max(held) <= 2 * (24 + 24 + 2)  # the open day's hours and the delay, not all seven days
    assert stateful.city_days(spark, sink).count() == 7
