"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _two(df: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Two edges (u, v) from each row.  A union would put the plan of ``df`` into
    that of the step twice, and a step's plan is planned on the driver."""
    pair = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (a, b)]
    return df.select(F.explode(F.array(*pair)).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _two(edges, ("u", "v"), ("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return _two(down.join(low, "u"), ("v", "m"), ("u", "m"))


def components(edges: DataFrame, a: str, b: str, max_steps: int = 50) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node.

    Each step is two shuffles of the edges; their number falls towards one per
    node.  Self-loops and nulls are dropped, an empty input gives no rows.
    """
    e = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
         .where("u <> v").distinct())
    seen, before = None, None
    for _ in range(max_steps):
        e, path = staged(_small_star(_large_star(e)).where("u <> v").distinct(), "components")
        discard(e.sparkSession, before)
        before = path
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select("v", "v").distinct())
        seen = now
    raise RuntimeError("components did not settle")
