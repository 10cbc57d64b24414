"""Shards along a Hilbert curve, for file pruning in several dimensions.

Each dimension is cut at its quantiles into 2^bits cells, strings by their rank
among the distinct values, a document's cells give its place on the curve, and the sorted documents are cut into runs of
equal numbers of rows.  Documents alike in all dimensions lie together, so each
shard covers small ranges of every dimension.  Ties on the curve are ordered by
a hash of the row, so that a cell with very many rows is sorted by many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from .common import UID, stage, with_uid

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of cell numbers (one column per dimension)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations and reflections, from the top bit down
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def string_edges(rows: DataFrame, name: str, bits: int = BITS) -> list[str]:
    """The first string of every quantile cell but the lowest, at most 2^bits - 1 of them.

    The distinct values are ranked whole, each with its number of rows, by a running
    total in range partitions; a value with very many rows is one row of that table."""
    values = rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    ranked = running_total(values, ["value"], F.col("n"), "upto")
    total = max(1, rows.count())
    cell = F.expr(f"((upto - n) * {2**bits}) div {total}")
    return sorted(r["edge"] for r in ranked.groupBy(cell.alias("cell")).agg(
        F.min("value").alias("edge")).collect())[1:]


def number_edges(rows: DataFrame, name: str, bits: int = BITS) -> list[int]:
    """The numbers that begin the quantile cells but the lowest."""
    steps = [k / 2**bits for k in range(1, 2**bits)]
    cuts = rows.agg(F.percentile_approx(name, steps, 10_000).alias("cuts")).first()["cuts"]
    return [c + 1 for c in sorted(set(cuts or []))]


def curve(rows: DataFrame, edges: dict[str, list], bits: int = BITS) -> DataFrame:
    """``rows`` with ``_curve``, the place of their cells on the curve; ``edges`` has
    the first value of each cell but the lowest for every dimension."""
    cell = F.lit(0)
    for name, firsts in edges.items():
        part = F.lit(0)
        for first in firsts:
            part = part + F.when(F.col(name) >= F.lit(first), 1).otherwise(0)
        cell = cell * 2**bits + part
    grid = np.stack(np.unravel_index(np.arange(2 ** (bits * len(edges))), (2**bits,) * len(edges)), 1)
    places = rows.sparkSession.createDataFrame(pd.DataFrame(
        {"_cell": np.arange(len(grid), dtype=np.int32),
         "_curve": hilbert_index(grid, bits).astype(np.int32)}))
    return (rows.withColumn("_cell", cell.cast("int"))
            .join(F.broadcast(places), "_cell").drop("_cell"))


def shard(docs: DataFrame, shards: int = 8, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``
    (doc_id, text, lang, source).

    Size is the text's UTF-8 bytes plus one; a null text has none, a null lang or
    source sorts first, with empty ones; other columns are ignored.  The law is ``rows``: the shards' numbers of rows differ
    by one at most, whatever the copies; repeated rows have slots of their own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage(with_uid(docs).select(
        UID, F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]), "metadata")
    placed = curve(rows, {"lang": string_edges(rows, "lang", bits),
                          "source": string_edges(rows, "source", bits),
                          "size": number_edges(rows, "size", bits)}, bits)
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["_curve", "_tie", UID]
    line = stage(placed.withColumn("_tie", F.xxhash64(UID)).repartitionByRange(n, *order)
                 .sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
                 .select("doc_id", "size", "text_crc32", "_at"), "line")
    part = F.shiftright("_at", 33)
    starts = (line.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
              .withColumn("_start", F.coalesce(F.sum("n").over(
                  Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("_part", "_start"))
    total = line.count()
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    shard_of = F.expr(f"cast(_rank * {shards} div {max(1, total)} as int)")
    # the first rank of shard s is ceil(s * total / shards)
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (line.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn("_rank", rank).withColumn("shard", shard_of)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("_rank") - first).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
