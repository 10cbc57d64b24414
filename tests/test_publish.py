"""Publishing by partition: what a run touches, and what readers see meanwhile."""

import os

import pytest
from pyspark.sql import functions as F

from stormcell.session import scratch_path
from stormcell.sources import publish


def frame(spark, rows):
    return spark.createDataFrame(rows, "city string, day string, level int").withColumn(
        "day", F.col("day").cast("date"))


DAYS = [(c, f"2024-01-{d:02d}", d % 3) for d in range(1, 11) for c in "ABC"]


def files(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n))
            for d, _, names in os.walk(path.replace("file:", "")) for n in names}


def rows(df):
    return sorted((r["city"], str(r["day"]), r["level"]) for r in df.collect())


@pytest.fixture
def path(spark):
    p = scratch_path(spark, "published")
    assert publish.publish(frame(spark, DAYS), p) == 1
    return p


def test_one_changed_day_touches_one_folder(spark, path):
    before = files(path)
    now = [(c, d, 9 if (c, d) == ("B", "2024-01-04") else v) for c, d, v in DAYS]
    assert publish.publish(frame(spark, now), path) == 2
    assert rows(publish.read(spark, path)) == sorted(now)
    after = files(path)
    # nothing was rewritten but the writer's marker file
    assert all(after[f] == t for f, t in before.items() if "_SUCCESS" not in f)
    new = {f.split("/data/")[1].split("/")[0] for f in set(after) - set(before)
           if "/data/" in f and f.endswith(".parquet")}
    assert new == {"day=2024-01-04"}
    assert rows(publish.read(spark, path, version=1)) == sorted(DAYS)


def test_run_without_change_makes_no_commit(spark, path):
    before = files(path)
    assert publish.publish(frame(spark, DAYS[::-1]).repartition(5), path) is None
    assert {f for f in files(path) if "/data/" in f or "/commits/" in f} == {
        f for f in before if "/data/" in f or "/commits/" in f}


def test_half_a_run_is_not_seen_and_is_run_again(spark, path, monkeypatch):
    now = [(c, d, 5) for c, d, _ in DAYS]

    def lost(*_):
        raise OSError("driver lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(publish, "_rename", lost)
        with pytest.raises(OSError):
            publish.publish(frame(spark, now), path)
    assert rows(publish.read(spark, path)) == sorted(DAYS)
    assert publish.publish(frame(spark, now), path) == 2
    assert rows(publish.read(spark, path)) == sorted(now)
    assert publish.vacuum(spark, path, keep=1) == 20  # the first run's days and the lost one's
    assert rows(publish.read(spark, path)) == sorted(now)
    assert not any("_draft-" in f for f in files(path))


def test_second_of_two_writers_fails(spark, path, monkeypatch):
    seen = publish.versions
    monkeypatch.setattr(publish, "versions", lambda s, p: [v for v in seen(s, p) if v < 2])
    assert publish.publish(frame(spark, [("A", "2024-01-01", 7)]), path) == 2
    with pytest.raises(publish.Conflict):
        publish.publish(frame(spark, [("A", "2024-01-01", 8)]), path)
    monkeypatch.undo()
    assert rows(publish.read(spark, path)) == [("A", "2024-01-01", 7)]


def test_days_go_stay_and_a_range_opens_only_its_folders(spark, path):
    part = [("A", "2024-01-02", 8), ("Z", "2024-02-01", 1)]
    assert publish.publish(frame(spark, part), path, whole=False) == 2
    want = sorted([r for r in DAYS if r[1] != "2024-01-02"] + part)
    assert rows(publish.read(spark, path)) == want
    some = publish.read(spark, path, "2024-01-03", "2024-01-04")
    assert rows(some) == [r for r in want if r[1] in ("2024-01-03", "2024-01-04")]
    assert {f.split("/data/")[1].split("/")[0] for f in some.inputFiles()} == {"day=2024-01-03", "day=2024-01-04"}
    assert publish.publish(frame(spark, part), path) == 3
    assert rows(publish.read(spark, path)) == sorted(part)


def test_empty_table_and_other_schema(spark, path):
    assert publish.publish(frame(spark, DAYS).where("false"), path) == 2
    assert publish.read(spark, path).count() == 0
    wider = frame(spark, DAYS).withColumn("more", F.lit("x"))
    assert publish.publish(wider, path) == 3
    assert publish.read(spark, path).columns == ["city", "level", "more", "day"]
    with pytest.raises(ValueError):
        publish.publish(wider.withColumn("day", F.lit(None).cast("date")), path)
