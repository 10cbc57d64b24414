"""Rolling means, lags and peak flags kept up to date as readings come in.

The table of W1 - W3 is published by day (``sources.publish``).  A change set, new
hours or corrected ones, touches some (city, day) pairs.  A row's features reach at
most ``halo`` rows back in its series, so only these pairs and the days that hold the
next ``halo`` rows of the same series are worked out anew, from them and from the days
that hold the ``halo`` rows before.  How far away those days are depends on the gaps of
a series; they are looked for near the touched days first and farther off only for the
series that still lack rows.  Every other row is left alone: days that no change
reaches are not opened (but for the search in a series with long gaps, which reads the
city column, by row groups of that city), and in a day that is rewritten the rows of
other series are copied as they are.

Windows over imputed readings need medians that stay the same from run to run, the
ones saved with the model; the caller imputes ``obs`` and the changes with them.
``temp_lag_*`` is null where a series has no row so far back, so that a reader may fill
it with a median of its own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lookups import broadcast_checked
from ..operators.windows import series_features
from ..schema import LAGS, ROLL_WINDOWS
from ..session import checkpoint
from ..sources import publish

HALO = max(max(ROLL_WINDOWS) - 1, max(LAGS))
FIRST_SPAN, WIDER = 1, 8   # days searched on each side, and the factor of the next try


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("date"))


def build(obs: DataFrame, path: str) -> int | None:
    """Publish the features of all rows of ``obs`` (a row per city and hour)."""
    return publish.publish(_day(series_features(obs)), path)


def read(spark: SparkSession, path: str, start=None, end=None, version: int | None = None) -> DataFrame:
    return publish.read(spark, path, start, end, version).drop("day")


def _reach(counts: DataFrame, halo: int, span: int) -> DataFrame:
    """(city, day, n, touched), the stored rows of a series by day, with ``before`` /
    ``after``: the rows between the day and the next / last touched day of its series,
    both left out; and ``few_before`` / ``few_after``: fewer than ``halo`` rows in the
    ``span`` days on that side of the day."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    up_to = (Window.unboundedPreceding, Window.currentRow)
    for name, order in (("after", number.asc()), ("before", number.desc())):
        w = Window.partitionBy("city").orderBy(order)
        # rows so far, and rows so far at the touched day that was passed last
        counts = (counts.withColumn("_sum", F.sum("n").over(w.rowsBetween(*up_to)))
                  .withColumn("_at", F.last(F.when(F.col("touched"), F.col("_sum")), True)
                              .over(w.rowsBetween(*up_to)))
                  .withColumn(name, F.col("_sum") - F.col("n") - F.col("_at")))
    w = Window.partitionBy("city").orderBy(number)
    for name, frame in (("few_before", (-span, -1)), ("few_after", (1, span))):
        counts = counts.withColumn(
            name, F.coalesce(F.sum("n").over(w.rangeBetween(*frame)), F.lit(0)) < halo)
    return counts.drop("_sum", "_at")


def _near(days: set[dt.date], published: set[dt.date], span: int) -> set[dt.date]:
    if 2 * span >= len(published):
        lo, hi = min(days) - dt.timedelta(span), max(days) + dt.timedelta(span)
        return {d for d in published if lo <= d <= hi}
    step = [dt.timedelta(k) for k in range(-span, span + 1)]
    return {d + s for d in days for s in step} & published


def _plan(spark: SparkSession, path: str, version: int, touched: DataFrame, halo: int) -> DataFrame:
    """(city, day, redo): the series' days to read, and those of them to work out anew.

    ``touched`` (city, day) are in it.  The search widens for the series that have fewer
    than ``halo`` known rows on one side of a touched day, until nothing published lies
    farther out."""
    published = {r["day"] for r in publish.manifest(spark, path, version)
                 .where("day IS NOT NULL").select("day").toLocalIterator()}  # one per day
    looked, span, found = touched, FIRST_SPAN, None
    while True:
        days = {r["day"] for r in looked.select("day").distinct().toLocalIterator()}
        near = _near(days, published, span)
        rows = publish.read(spark, path, version=version, only=near).select("city", "day")
        mine = looked.select("city").distinct()
        counts = (rows.join(broadcast_checked(mine), "city", "left_semi")
                  .groupBy("city", "day").agg(F.count(F.lit(1)).alias("n"))
                  .join(looked.withColumn("touched", F.lit(True)), ["city", "day"], "full")
                  .select("city", "day", F.coalesce("n", F.lit(0)).alias("n"),
                          F.coalesce("touched", F.lit(False)).alias("touched")))
        marked = checkpoint(_reach(counts, halo, span))
        lacks = checkpoint(marked.where("touched").where(
            (F.col("few_before") & (F.date_sub("day", span) > F.lit(min(published))))
            | (F.col("few_after") & (F.date_add("day", span) < F.lit(max(published)))))
            .select("city").distinct())
        more = lacks.limit(1).count() > 0
        needed = marked.where(
            F.col("touched") | (F.coalesce("before", F.lit(halo)) < halo)
            | (F.coalesce("after", F.lit(halo)) < halo)).select(
                "city", "day", (F.col("touched") | (F.coalesce("after", F.lit(halo)) < halo)).alias("redo"))
        done = needed.join(lacks, "city", "left_anti") if more else needed
        found = done if found is None else found.unionByName(done)
        if not more:
            return checkpoint(found)
        looked, span = checkpoint(looked.join(lacks, "city", "left_semi")), span * WIDER


def apply(changes: DataFrame, path: str, halo: int = HALO) -> int | None:
    """Bring the table up to date with ``changes``, rows of ``obs`` that are new or take
    the place of the stored one of the same city and hour; the new version, or None if
    nothing has changed (the same change set again, or an empty one).  After it the table
    equals ``build`` over all rows.

    City and hour must be there and must not repeat in the change set (``ValueError``).
    A run that began from a version that is no longer the newest raises
    ``publish.Conflict`` and leaves the table as it is; run it again."""
    spark = changes.sparkSession
    version = max(publish.versions(spark, path), default=0)
    changes = checkpoint(_day(changes))
    keys = changes.groupBy("city", "date").agg(F.count(F.lit(1)).alias("n"))
    if keys.where("city IS NULL OR date IS NULL OR n > 1").limit(1).count():
        raise ValueError("every change needs a city and an hour of its own")
    if not changes.limit(1).count():
        return None
    if not version:
        return build(changes.drop("day"), path)
    touched = checkpoint(changes.select("city", "day").distinct())
    plan = _plan(spark, path, version, touched, halo)
    days = {r["day"] for r in plan.select("day").distinct().toLocalIterator()}
    again = {r["day"] for r in plan.where("redo").select("day").distinct().toLocalIterator()}
    base = [c for c in changes.columns if c != "day"]
    context = (publish.read(spark, path, version=version, only=days).select(*base, "day")
               .join(broadcast_checked(plan.select("city", "day")), ["city", "day"], "left_semi")
               .join(changes.select("city", "date"), ["city", "date"], "left_anti"))
    rows = context.select(*base).unionByName(changes.select(*base))
    redo = plan.where("redo").select("city", "day")
    new = _day(series_features(rows)).join(broadcast_checked(redo), ["city", "day"], "left_semi")
    same = (publish.read(spark, path, version=version, only=again)
            .join(broadcast_checked(redo), ["city", "day"], "left_anti"))
    return publish.publish(same.unionByName(new.select(*same.columns)), path, whole=False, expect=version)
