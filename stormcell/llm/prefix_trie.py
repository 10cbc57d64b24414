"""Prefix trie of conversations by ROLLUP over positional columns of turn ids.

A conversation becomes rows of ``WIDTH`` columns, one per place, that hold turn
ids (128 bits of a SHA-256 over role and text, with the text's code points).  One
``GROUP BY key, ROLLUP(t0 ... t7)`` aggregates all prefixes of a block at once;
``grouping_id`` tells each one's depth.  A longer conversation goes on in further
blocks, whose ``key`` is the node that the blocks before it lead to: the sums of
four 32-bit hashes per (place, turn id).  Texts never shuffle.

A node belongs to its smallest member, its owner, so (owner, depth) names it.  The
nodes that a conversation owns are one unbroken end of its path; what they hold
(leaves, saved tokens) is summed up per owner, and a second ROLLUP adds those sums
over the members of each node: subtree totals, without walking the tree.

Places, keys and the sums along a path are running totals in range partitions, so
that no conversation has to fit into one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, lean, stage, with_uid

WIDTH = 8
ENDS_CHUNK = 4096
_KEY = ["ka", "kb", "kc", "kd"]


def running(df: DataFrame, key: str, order: list, values: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over the key's rows up to and
    including this one.  Rows are range-partitioned by key and order; only keys that
    lie in several partitions (at most two per partition) need the sums of those
    before, so that this table can be broadcast."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, value in values.items():
        df = df.withColumn(name, value.cast("long"))
    rows = stage(df.repartitionByRange(n, key, *order)
                 .withColumn("_part", F.spark_partition_id()), "running")
    names = list(values)
    sums = rows.groupBy(key, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    over = Window.partitionBy(key)
    before = over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("_n", F.count("*").over(over))
              .select(F.col(key).alias("_key"), F.col("_part").alias("_at"), "_n",
                      *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in names])
              .where("_n > 1"))
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    for c in names:
        rows = rows.withColumn(c, F.sum(c).over(inside))
    rows = rows.join(F.broadcast(starts), (F.col(key) == F.col("_key"))
                     & (F.col("_part") == F.col("_at")), "left")
    for c in names:
        rows = rows.withColumn(c, F.col(c) + F.coalesce(f"_{c}", F.lit(0)))
    return rows.drop("_part", "_key", "_at", "_n", *[f"_{c}" for c in names])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, turn_id): the turns in order, from 0.  Order: turn (null
    first), role, turn id.  Null roles and texts are empty; rows without conv_id go."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = with_uid(conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.struct(F.substring(F.unhex(digest), 1, 16).alias("id"),
                 F.length(text).cast("long").alias("n")).alias("turn_id"))).where("conv_id is not null")
    # equal rows are told apart by their row id, so that many of them can be split
    order = [F.asc_nulls_first("turn"), "role", "turn_id", UID]
    return running(rows, "conv_id", order, {"idx": F.lit(1)}).select(
        "conv_id", (F.col("idx") - 1).alias("idx"), "turn_id")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: (conv_id, length) of all, and
    (conv_id, pos, turn_id) of their turns.

    h = crc32(decimal conv_id) % ``most``; the first h turns are those of conversation
    conv_id - conv_id % ``group`` (all if fewer, none if absent), then come the own
    turns after the first h."""
    heads = (turns.where((F.col("conv_id") % group == 0) & (F.col("idx") < most - 1))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("idx", "turn_id")))
                                     .alias("head")))
    convs = (turns.groupBy("conv_id").agg(F.count("*").alias("own"))
             .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most)
             .withColumn("_base", F.col("conv_id") - F.col("conv_id") % group)
             .join(heads.withColumnRenamed("conv_id", "_base"), "_base", "left")
             .withColumn("k", F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0))))
             .select("conv_id", "h", "k", "head",
                     (F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")))
    convs = stage(convs, "trie-conversations")
    lead = convs.where("k > 0").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("k").cast("int")))
                                       .alias("t"))
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where("idx >= h")
    return convs.select("conv_id", "length"), lead.select(
        "conv_id", F.col("t.idx").alias("pos"), "t.turn_id").union(
        own.select("conv_id", (F.col("idx") - F.col("h") + F.col("k")).alias("pos"), "turn_id"))


def _lanes(pos: Column, turn_id: Column) -> list[Column]:
    """Four 32-bit hashes; their sums name a sequence of turns."""
    x, y = F.xxhash64(F.lit(1), pos, turn_id), F.xxhash64(F.lit(2), pos, turn_id)
    return [half for h in (x, y) for half in (
        F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def blocks(convs: DataFrame, turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """(conv_id, length, block, ka..kd, ea..ed, t0 ... ): a row per conversation and
    ``width`` places; k* is the node before the block, e* the node at its end.  A
    conversation without turns has a block of nulls."""
    at = F.col("pos").cast("long")
    lanes = _lanes(at, F.col("turn_id.id"))
    rows = turns.select("conv_id", F.expr(f"pos div {width}").alias("block"),
                        (F.col("pos") % width).alias("_i"), "turn_id",
                        *[x.alias(k) for x, k in zip(lanes, _KEY, strict=True)])
    rows = rows.groupBy("conv_id", "block").agg(
        *[F.sum(k).alias(k) for k in _KEY],
        *[F.max(F.when(F.col("_i") == i, F.col("turn_id"))).alias(f"t{i}") for i in range(width)])
    rows = rows.join(convs.where("length > 0"), "conv_id")
    turnless = convs.where("length = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(0).cast("long").alias(k) for k in _KEY],
        *[F.lit(None).cast("struct<id:binary,n:bigint>").alias(f"t{i}") for i in range(width)], "length")
    rows = stage(rows.unionByName(turnless), "trie-blocks")
    ends = [f"e{k[1]}" for k in _KEY]
    short = rows.where(F.col("length") <= width)
    short = short.select("*", *[F.col(k).alias(e) for k, e in zip(_KEY, ends, strict=True)]).select(
        "conv_id", "length", "block", *[F.lit(0).cast("long").alias(k) for k in _KEY], *ends,
        *[f"t{i}" for i in range(width)])
    long = running(rows.where(F.col("length") > width), "conv_id", ["block"],
                   {e: F.col(k) for k, e in zip(_KEY, ends, strict=True)})
    long = long.select("conv_id", "length", "block",
                       *[(F.col(e) - F.col(k)).alias(k) for k, e in zip(_KEY, ends, strict=True)],
                       *ends, *[f"t{i}" for i in range(width)])
    return stage(short.union(long), "trie-columns")


def prefixes(rows: DataFrame, aggregates: str, width: int = WIDTH) -> DataFrame:
    """(depth, node, parent, n, ...): every prefix once, by one ROLLUP over all blocks.
    ``n`` is the last turn's code points (0 for the root)."""
    names = [f"t{i}" for i in range(width)]
    found = rows.sparkSession.sql(f"""
        SELECT block, {', '.join(_KEY)}, {', '.join(names)},
               {width} - bit_count(grouping_id()) AS level, {aggregates}
        FROM {{rows}} GROUP BY block, {', '.join(_KEY)}, ROLLUP({', '.join(names)})""", rows=rows)
    level = F.col("level")
    last = F.coalesce(*[F.when(level == i + 1, F.col(t)) for i, t in enumerate(names)])
    # a place after a conversation's end groups under null: not a prefix
    found = found.withColumn("_last", last).where(
        ((level == 0) & (F.col("block") == 0)) | F.col("_last").isNotNull())
    node, step = [F.col(k) for k in _KEY], [F.lit(0).cast("long")] * 4
    for i, t in enumerate(names):
        lanes = _lanes(F.col("block") * width + i, F.col(f"{t}.id"))
        node = [n + F.when(level > i, x).otherwise(0) for n, x in zip(node, lanes, strict=True)]
        step = [F.when(level == i + 1, x).otherwise(s) for s, x in zip(step, lanes, strict=True)]
    others = [c for c in found.columns if c not in ("block", "level", "_last", *_KEY, *names)]
    return found.select(
        (F.col("block") * width + level).alias("depth"), F.array(*node).alias("node"),
        F.array(*[n - s for n, s in zip(node, step, strict=True)]).alias("parent"),
        F.coalesce("_last.n", F.lit(0)).alias("n"), *others)


def ends(members: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of members (owner, depth, conv_id): SHA-256 of the
    comma-joined conv_ids.  They are joined in chunks first; a task reads the chunks
    of a node one after the other and holds none but the present one."""
    chunks = (members.groupBy("owner", "depth", F.floor(F.col("conv_id") / ENDS_CHUNK).alias("chunk"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")),
                                            lambda c: c.cast("string")), ",").alias("ids")))

    @lean
    def run(batches):
        now, sha = None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((*now, sha.hexdigest()),
                                                  (pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["owner", "depth", "ends_sha256"])

        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in (
                    "owner", "depth", "ids")), strict=True):
                if (owner, depth) != now:
                    if now is not None:
                        out.append(done())
                    now, sha = (owner, depth), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if now is not None:
            yield done()

    return (chunks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "chunk")
            .select("owner", "depth", "ids")
            .mapInArrow(run, "owner long, depth long, ends_sha256 string"))


def trie(convs: DataFrame, turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` (conv_id, length) holds every conversation once, also those without
    turns; ``turns`` (conv_id, pos, turn_id) their turns.  Without conversations
    there is no node, not even a root."""
    rows = blocks(convs, turns, width)
    first = stage(prefixes(rows, "min(conv_id) AS owner, count(*) AS n_convs", width), "trie-nodes")
    saved = (F.col("n_convs") - 1) * F.col("n")
    owners = first.groupBy("owner").agg(
        F.min("depth").alias("top"), F.max("depth").alias("last"), F.sum(saved).alias("total"),
        F.min_by("parent", "depth").alias("parent"))
    above = first.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("top"),
                         F.col("owner").alias("parent_conv_id"))
    owners = stage(owners.join(above, ["parent", "top"], "left").drop("parent"), "trie-owners")
    branches = (owners.where("top > 0").groupBy("parent_conv_id", "top").agg(F.count("*").alias("branches"))
                .select(F.col("parent_conv_id").alias("owner"), (F.col("top") - 1).alias("depth"),
                        "branches"))
    leaf = (owners.join(branches.withColumnRenamed("depth", "last"), ["owner", "last"], "left")
            .select(F.col("owner").alias("conv_id"), "total",
                    F.col("branches").isNull().cast("long").alias("leaf")))
    # a conversation's sums count once, in the block where it begins or passes
    rows = rows.join(leaf, "conv_id", "left").fillna(0, ["total", "leaf"])
    nodes = prefixes(rows, "min(conv_id) AS owner, count(*) AS n_convs, sum(total) AS totals,"
                     " sum(leaf) AS n_leaves", width)
    nodes = running(nodes.select("owner", "depth", "n_convs", "totals", "n_leaves", saved.alias("saved")),
                    "owner", [F.desc("depth")], {"below": F.col("saved")})
    at_end = (rows.where(F.col("length") <= (F.col("block") + 1) * width)
              .select("conv_id", F.col("length").alias("depth"), F.array("ea", "eb", "ec", "ed").alias("node"))
              .join(first.select("depth", "node", "owner"), ["depth", "node"]))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(owners, "owner").join(branches, ["owner", "depth"], "left")
            .join(ends(at_end.select("owner", "depth", "conv_id")), ["owner", "depth"], "left")
            .select(F.col("owner").alias("conv_id"), "depth",
                    F.when(F.col("depth") > F.col("top"), F.col("owner"))
                    .otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
                    (F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long"))
                    .alias("n_children"), "n_leaves",
                    (F.col("below") + F.col("totals") - F.col("total")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
