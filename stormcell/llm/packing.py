"""Best-fit packing by sums of squares.

A document longer than a sequence is cut into whole sequences, after a first
piece that takes the remainder; only these first pieces and the shorter
documents have to be packed.  A shard packs its pieces from the longest to the
shortest, each where the sum over all gaps g of N(g)^2 becomes smallest, N(g)
being the number of open sequences with g free places; a new sequence is opened
only when no open one has room.  Only (id, length)
pairs travel to the shards; they hold about ``shard_rows`` pieces each, drawn
by a hash of the row, so their number grows with the input and the loss stays
at a few sequences per shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, lean, runs, stage, texts, with_uid
from .tokens import default_path, encode

WINDOW = 1024
END_ID = 2
SHARD_ROWS = 250_000


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(_uid, doc_id, piece, start, length, ids_crc32) for each row of ``docs``."""
    end = np.array([end_id], "<u4").tobytes()

    @lean
    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for uid, doc, text in zip(batch.column(UID).to_pylist(),
                                      batch.column("doc_id").to_pylist(), texts(batch),
                                      strict=True):
                ids = memoryview(encode(text, path) + end)
                n = len(ids) // 4
                edge = [0, *range(n % window or window, n + 1, window)]
                for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
                    for col, v in zip(out, (uid, doc, k, a, b - a,
                                            zlib.crc32(ids[4 * a:4 * b])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (
                    pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                    strict=True)],
                names=[UID, "doc_id", "piece", "start", "length", "ids_crc32"])

    return (with_uid(docs).select(UID, F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(cut, f"{UID} long, doc_id long, piece int, start long, length long, "
                             "ids_crc32 long"))


def sum_of_squares(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order."""
    count = np.zeros(window + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, never = 0, np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # change of the sum of squares when a sequence of gap g gets s
        before = count[s:]
        change = 2 * (count[:window + 1 - s] - before) + 2
        change[0] = 1 - 2 * before[0]  # a full sequence leaves the sum
        change[before == 0] = never
        g = s + int(change.argmin())
        if change[g - s] == never:
            g = window
            b, made = made, made + 1
        else:
            b = open_bins[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, window - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece, the end id.  Repeated rows are
    packed one by one; a null doc_id stays null.  Pieces of ``window`` tokens
    are sequences of their own, with negative ids.
    """
    path = path or default_path()
    cut = stage(pieces(docs, path, window, end_id), "pieces")
    loose = cut.where(F.col("length") < window).select(UID, "length")
    cut = cut.withColumn("_row", F.monotonically_increasing_id())
    shards = max(1, -(-loose.count() // shard_rows))

    @lean
    def place(batches):
        for (shard,), t in runs(batches, ["shard"]):
            uid, length = t.column(UID).to_numpy(), t.column("length").to_numpy()
            order = np.lexsort((uid, -length))
            bins, offsets = sum_of_squares(length[order], window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[order]), pa.array((np.int64(shard) << np.int64(32)) + bins),
                 pa.array(offsets)], names=[UID, "sequence_id", "offset"])

    placed = (loose.withColumn("shard", F.pmod(F.xxhash64(UID), F.lit(shards)))
              .repartition(shards, "shard").sortWithinPartitions("shard")
              .mapInArrow(place, f"{UID} long, sequence_id long, offset long"))
    alone = F.col("length") == window
    return cut.join(placed, UID, "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(alone, -1 - F.col("_row")).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"))
