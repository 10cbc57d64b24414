"""Running totals and ranks over a total order, without a one-task window.

Rows are range-partitioned and sorted on the order, totals are made inside the
partitions, and each partition adds the sum of those before it -- a table of
one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def running_total(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to and including this
    one in ``order``, which has to be a total order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = checkpoint(df.withColumn("_v", value).repartitionByRange(n, *order)
                      .sortWithinPartitions(*order)
                      .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    starts = (line.groupBy(part.alias("_part")).agg(F.sum("_v").alias("_s"))
              .select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start")))
    inside = (Window.partitionBy("_part").orderBy("_at")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (line.withColumn("_part", part).withColumn("_sum", F.sum("_v").over(inside))
            .join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_sum") + F.col("_start"))
            .drop("_v", "_at", "_part", "_sum", "_start"))


def rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... in ``order``."""
    return running_total(df, order, F.lit(1).cast("long"), name)
