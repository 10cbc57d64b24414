"""Stream semantics: re-delivered readings count once, late readings are merged
and counted, and the result is that of one batch however files are cut."""

import os

from stormcell.operators import rules
from stormcell.operators.aggregates import city_day_summary
from stormcell.session import scratch_path
from stormcell.streaming import city_day_stream as stream
from tests.conftest import obs_frame


def _rows(day, hours, precip=1.0, city="A"):
    return [(city, f"2024-01-{day:02d} {h:02d}", 50.0, 25.0, precip, 27.0, 10.0, 0) for h in hours]


def _drain(spark, src, sink, ckpt, **options):
    stream.run_to_sink(stream.city_day_stream(spark, src, **options), sink, ckpt).awaitTermination()


def test_dedupes_and_merges_late_readings(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("s-src", "s-sink", "s-ckpt"))
    drops = [
        _rows(1, [h for h in range(24) if h != 5]) + _rows(2, range(6)),
        # hour 3 of day 2 and hour 2 of day 1 again (the latter with another
        # value: the first delivery counts), hour 5 of day 1 far too late
        _rows(2, [3]) + _rows(1, [2], precip=99.0) + _rows(1, [5]) + _rows(2, range(6, 24)),
    ]
    for i, rows in enumerate(drops):
        obs_frame(spark, rows).write.mode("overwrite").parquet(os.path.join(src, f"drop={i}"))
        _drain(spark, src, sink, ckpt)
    out = {r["day"].day: r for r in stream.latest_city_days(spark, sink).collect()}
    assert out[1]["n_hours"] == 24 and out[1]["precipitation"] == 24.0
    assert out[2]["n_hours"] == 24 and out[2]["precipitation"] == 24.0
    assert out[2]["rule_level"] == 3  # 24 mm daily total >= 15
    late = stream.late_readings(spark, sink).orderBy("batch_id").collect()
    assert [(r["readings"], r["late"]) for r in late] == [(29, 0), (21, 2)]


def test_result_does_not_depend_on_the_micro_batches(spark):
    src = scratch_path(spark, "s-src")
    rows = [r for c in "ABCD" for d in (1, 2, 3) for r in _rows(d, range(0, 24, 2), city=c)]
    obs = obs_frame(spark, rows)
    obs.repartitionByRange(4, "city").sortWithinPartitions("city", "date").write.parquet(src)
    want = {(r["city"], r["day"]): (r["n_hours"], r["precipitation"], r["rule_level"]) for r in
            rules.apply_rules(city_day_summary(obs)).collect()}
    for files in (None, 1, 3):
        sink, ckpt = scratch_path(spark, "s-sink"), scratch_path(spark, "s-ckpt")
        _drain(spark, src, sink, ckpt, max_files_per_trigger=files)
        got = {(r["city"], r["day"]): (r["n_hours"], r["precipitation"], r["rule_level"])
               for r in stream.latest_city_days(spark, sink).collect()}
        assert got == want
        assert sum(r["readings"] for r in stream.late_readings(spark, sink).collect()) == len(rows)
