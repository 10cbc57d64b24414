"""A table published by partition, with a commit pointer.

    <path>/data/day=.../run=.../   the rows of a day as one run wrote them
    <path>/commits/0000000012/     which run of each day counts, after that commit

A run writes only the days whose rows have changed, each into a folder of its own,
and then one commit that names them.  The commit is a folder that appears by a
rename which fails if it is there already: readers see all of a run or nothing of
it, and of two writers that began from the same commit the second one fails.  A run
without a change makes no commit.  A broken-off run leaves folders that no commit
names; ``vacuum`` removes them with old versions.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

COMMITS, DATA = "commits", "data"
#: A row per day; the one without a day holds the table's schema.
MANIFEST = "day date, run string, n long, digest string, schema string"


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The commits that are there, oldest first."""
    return [int(n) for n in _names(spark, os.path.join(path, COMMITS)) if n.isdigit()]


def _commit_path(path: str, version: int) -> str:
    return os.path.join(path, COMMITS, f"{version:010d}")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(day, run, n, digest, schema) of a version, the newest by default."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(_commit_path(path, version))


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """False if ``target`` exists."""
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(a.toUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, sc._gateway.new_array(fs.Options.Rename, 0))
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def digests(df: DataFrame) -> DataFrame:
    """(day, n, digest): rows and a fingerprint of them, whatever their order."""
    h = F.xxhash64(*sorted(c for c in df.columns))
    return df.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"),
        F.concat_ws(":", F.sum(h.cast("decimal(20,0)")).cast("string"),
                    F.sum(F.xxhash64(F.lit("again"), h).cast("decimal(20,0)")).cast("string")).alias("digest"))


def publish(df: DataFrame, path: str, cluster: tuple[str, ...] = ("city",), whole: bool = True,
            expect: int | None = None) -> int | None:
    """Publish ``df`` (with a date column ``day``); the new version, or None if no
    day has changed.  With ``whole``, published days that ``df`` lacks go; otherwise
    they stay as they are.  ``expect`` is the version that ``df`` was worked out from:
    if a newer one is there, nothing is written and ``Conflict`` is raised."""
    spark = df.sparkSession
    df = checkpoint(df.select(*[c for c in df.columns if c != "day"], F.col("day").cast("date").alias("day")))
    if df.where("day IS NULL").limit(1).count():
        raise ValueError("rows without a day can't be published")
    base = max(versions(spark, path), default=0)
    if expect is not None and base != expect:
        raise Conflict(f"version {expect} of {path} is no longer the newest, {base} is")
    run = f"{base + 1}-{uuid.uuid4().hex[:8]}"
    old = checkpoint(manifest(spark, path, base))
    # as the files are read back: any column may hold nulls
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]).json()
    same_schema = old.where(F.col("day").isNull() & (F.col("schema") == schema)).count() == 1
    new = checkpoint(digests(df))
    if same_schema:
        kept = new.join(old.where("day IS NOT NULL").select("day", "n", "digest", "run"), ["day", "n", "digest"])
    else:
        kept = new.withColumn("run", F.lit("")).limit(0)
    changed = checkpoint(new.join(kept.select("day"), "day", "left_anti"))
    gone = old.where("day IS NOT NULL").join(new.select("day"), "day", "left_anti")
    if not whole:
        if base and not same_schema:
            raise ValueError("a part of the table can't be published under another schema")
        kept, gone = kept.unionByName(gone.select("day", "n", "digest", "run")), gone.limit(0)
    if base and not changed.limit(1).count() and not gone.limit(1).count() and same_schema:
        return None
    (df.join(F.broadcast(changed.select("day")), "day", "left_semi")
     .withColumn("run", F.lit(run)).repartitionByRange("day", *cluster)
     .sortWithinPartitions("day", *cluster).write.mode("append").partitionBy("day", "run")
     .parquet(os.path.join(path, DATA)))
    rows = changed.withColumn("run", F.lit(run)).unionByName(kept).withColumn(
        "schema", F.lit(None).cast("string")).select("day", "run", "n", "digest", "schema")
    rows = rows.union(spark.createDataFrame([(None, run, None, None, schema)], MANIFEST))
    draft = os.path.join(path, f"_draft-{run}")
    rows.coalesce(1).write.parquet(draft)
    fs, commits = _fs(spark, os.path.join(path, COMMITS))
    fs.mkdirs(commits)
    if not _rename(spark, draft, _commit_path(path, base + 1)):
        raise Conflict(f"version {base + 1} of {path} was committed by another run")
    return base + 1


def read(spark: SparkSession, path: str, start=None, end=None, version: int | None = None,
         only: set | None = None) -> DataFrame:
    """The published rows (between two days, both included, or of the dates ``only``):
    only the folders that the commit names for these days are listed and opened."""
    rows = checkpoint(manifest(spark, path, version))
    schema = T.StructType.fromJson(json.loads(rows.where("day IS NULL").first()["schema"]))
    days = rows.where("day IS NOT NULL")
    if start is not None:
        days = days.where(F.col("day") >= F.lit(str(start)).cast("date"))
    if end is not None:
        days = days.where(F.col("day") <= F.lit(str(end)).cast("date"))
    data = os.path.join(path, DATA)
    folders = [os.path.join(data, f"day={r['day']}", f"run={r['run']}")  # one per day
               for r in days.select("day", "run").toLocalIterator() if only is None or r["day"] in only]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", data).schema(schema).parquet(*folders).select(*schema.names)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` commits, and the folders that none of these
    names.  Run it when no run is writing.  Returns the number of folders removed."""
    found = versions(spark, path)
    kept = found[-keep:]
    needed = {(str(r["day"]), r["run"]) for v in kept
              for r in manifest(spark, path, v).where("day IS NOT NULL").select("day", "run").collect()}
    fs, _ = _fs(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = 0
    for v in found[:-keep]:
        fs.delete(at(_commit_path(path, v)), True)
    for name in _names(spark, path):
        if name.startswith("_draft-"):
            fs.delete(at(os.path.join(path, name)), True)
    for day in _names(spark, os.path.join(path, DATA)):
        for run in _names(spark, os.path.join(path, DATA, day)) if day.startswith("day=") else []:
            if run.startswith("run=") and (day[4:], run[4:]) not in needed:
                fs.delete(at(os.path.join(path, DATA, day, run)), True)
                n += 1
    return n
