"""N-gram Jaccard join by chosen paths.

Every distinct shingle set walks down ``runs`` random trees.  In each bucket of
its paths it chooses those of its shingles whose hash, keyed by the path, lies
below 1 / (similarity * set size), and goes on to one bucket per chosen shingle:
two sets of the wanted similarity share at least one choice on average, unrelated
sets hardly ever.  Every bucket links its members to a pivot.  Links that pass a
sketch are contracted to groups, level by level: a bucket inside one group is
finished, however many sets it has.  Of the others, buckets of at most ``small``
sets are compared by brute force, larger ones are split again.  What is still
large at the last level is compared block by block.  The candidate links only
connect sets into candidate groups; inside every group all pairs are then compared
exactly, so the links, their number per document and the classes are exact for the
groups found.

The number of runs follows from the target recall: a pair of the wanted
similarity shares a bucket at level k of one run with probability s(k) at least,
where s(0) = 1 and s(k + 1) = 1 - exp(-s(k)), as the choices of different buckets
are independent.  Runs are made for pairs that meet at the last level only: all
buckets before it may be large, if very many documents share all passages.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (SIMILARITY, UID, discard, lean, list_column, mix, odd_numbers, packed, runs,
                     shingles, stage, staged, texts, with_uid)
from .components import components

RECALL = 0.999
LEVELS = 5
SMALL = 24
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
DENSE_BLOCK = 2048
SKETCH = 64  # min-hashes of 8 bits, held in 8 longs


def survival(level: int) -> float:
    s = 1.0
    for _ in range(level):
        s = 1 - math.exp(-s)
    return s


def runs_for(recall: float, level: int = LEVELS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(level)))


def least_agreement(similarity: float) -> int:
    """Agreeing min-hashes of 64 that a similar pair misses by chance once in
    30,000 times (four standard deviations below the mean)."""
    p = similarity + (1 - similarity) / 256
    return math.floor(SKETCH * p - 4 * math.sqrt(SKETCH * p * (1 - p)))


def sketch(s: np.ndarray) -> np.ndarray:
    odd = odd_numbers(SKETCH, 11).astype(np.uint32)
    low = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    half = s.astype(np.uint32)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (half[i:i + 4096, None] * odd).min(axis=0))
    return (mix(low.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def choices(s: np.ndarray, n_runs: int, levels: int, similarity: float):
    """(level, parent, token, key) of each bucket on the paths of a set, level by level.

    ``parent`` is the place of the bucket before among those of its level (at
    level 0 the run), ``token`` half of the chosen shingle; ``key`` stands for
    the whole path and keys the choice of the next level, so that choices of
    different buckets are independent."""
    below = np.uint32(min(2**32 - 1, int(2**32 / (similarity * max(1, len(s))))))
    keys = odd_numbers(n_runs, 23)
    found = []
    for level in range(levels):
        odd = (keys.astype(np.uint32) | np.uint32(1))[:, None]
        plus = (keys >> np.uint64(32)).astype(np.uint32)[:, None]
        parents, tokens = [], []
        for i in range(0, len(s), 4096):
            part = s[i:i + 4096].astype(np.uint32)
            x = part * odd
            x += plus
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            parent, at = np.nonzero(x <= below)
            parents.append(parent)
            tokens.append(part[at])
        parent, token = np.concatenate(parents), np.concatenate(tokens)
        keys = mix(keys[parent] * np.uint64(0xC2B2AE3D27D4EB4F) + token.astype(np.uint64))
        found.append((np.full(len(keys), level), parent, token, keys))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


SIGNATURE = (f"{UID} long, doc_id long, digest string, size int, sketch array<long>, "
             "parents array<array<int>>, tokens array<array<int>>")


def _by_level(parts: list[np.ndarray], counts: list[np.ndarray], levels: int):
    """Column with a list per level for each row."""
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts or [[]]))]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(counts) + 1) * levels, pa.int32()),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))


def signatures(docs: DataFrame, n_runs: int, levels: int, similarity: float) -> DataFrame:
    @lean
    def sign(batches):
        for batch in batches:
            digests, sizes, sk, counts, parents, tokens = [], [], [], [], [], []
            for text in texts(batch):
                s = shingles(text)
                sizes.append(len(s))
                if len(s):
                    digests.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                    sk.append(sketch(s).view(np.int64))
                    level, parent, token, _ = choices(s, n_runs, levels, similarity)
                    counts.append(np.bincount(level, minlength=levels))
                    parents.append(parent.astype(np.int32))
                    tokens.append(token.view(np.int32))
                else:
                    digests.append(None)
                    sk.append(np.empty(0, np.int64))
                    counts.append(np.zeros(levels, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(UID), batch.column("doc_id"), pa.array(digests, pa.string()),
                 pa.array(sizes, pa.int32()), list_column(sk, pa.int64()),
                 _by_level(parents, counts, levels), _by_level(tokens, counts, levels)],
                names=[UID, "doc_id", "digest", "size", "sketch", "parents", "tokens"])

    return (with_uid(docs).select(UID, F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(sign, SIGNATURE))


def _agreement(x: str, y: str):
    """Equal bytes of two sketches of eight longs."""
    differ = None
    for i in range(SKETCH // 8):
        t = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        for shift in (4, 2, 1):
            t = t.bitwiseOR(F.shiftrightunsigned(t, shift))
        n = F.bit_count(t.bitwiseAND(F.lit(0x0101010101010101)))
        differ = n if differ is None else differ + n
    return F.lit(SKETCH) - differ


def _sieve(ids: DataFrame, id: str) -> DataFrame:
    """(_word, _bits) of a bit set over hashes of ids: at most 2**18 rows of 16 bytes,
    so that it can be broadcast whatever their number."""
    h = F.pmod(F.xxhash64(id), F.lit(1 << 24))
    return (ids.select(h.alias("_h")).groupBy(F.expr("_h div 64").alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_h % 64 AS int))")).alias("_bits")))


def _sifted(df: DataFrame, id: str, ids: DataFrame, of: str) -> DataFrame:
    """``df`` without most of the rows whose ``id`` is not among ``ids``, none of the
    others: what a join with them need not shuffle."""
    h = F.pmod(F.xxhash64(id), F.lit(1 << 24))
    return (df.withColumn("_h", h).withColumn("_word", F.expr("_h div 64"))
            .join(F.broadcast(_sieve(ids, of)), "_word")
            .where(F.expr("shiftrightunsigned(_bits, cast(_h % 64 AS int)) & 1 = 1"))
            .drop("_h", "_word", "_bits"))


def _path_level(rows, sig, sets, level: int):
    """Rows (id, at, key, root) of the next level: the buckets that the members of
    ``rows`` go on to; all buckets of level 0 without ``rows``.  Only the choices of
    that level are shuffled."""
    paths = sig.where("size > 0").select(F.col(UID).alias("id"), F.arrays_zip(
        F.col("parents")[level].alias("parent"), F.col("tokens")[level].alias("token")).alias("paths"))
    if rows is None:
        return (paths.join(sets.select(F.col("rep").alias("id")), "id")
                .select("id", F.posexplode("paths").alias("at", "c"))
                .select("id", "at", F.xxhash64("c.parent", "c.token").alias("key"), F.col("id").alias("root")))
    live = rows.groupBy("id", "root").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "key"))).alias("live"))
    return (_sifted(paths, "id", rows, "id").join(live, "id")
            .select("id", "root", "live", F.posexplode("paths").alias("at", "c"))
            .select("id", "root", "at", "c", F.try_element_at("live", F.col("c.parent")).alias("before"))
            .where("before is not null")
            .select("id", "at", F.xxhash64("before", "c.token").alias("key"), "root"))


def _near(pairs: DataFrame, sig: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree well enough."""
    side = sig.select(UID, "sketch")
    return (pairs.join(side.select(F.col(UID).alias("a"), F.col("sketch").alias("sa")), "a")
            .join(side.select(F.col(UID).alias("b"), F.col("sketch").alias("sb")), "b")
            .where(_agreement("sa", "sb") >= least_agreement(similarity)).select("a", "b"))


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def candidates(sig: DataFrame, sets: DataFrame, levels: int, small: int, similarity: float):
    """Candidate links (a, b) that pass the sketch, and the rows of the buckets that
    are large and undecided at the last level.

    At each level every bucket links its members to a pivot, the one with the least
    hash of its id, so that the buckets of one group mostly have the same; these
    links are contracted to roots.  A bucket whose members all have one root is
    finished.  Of the others, small ones are compared in pairs of different roots,
    large ones split."""
    spark = sig.sparkSession
    links, rows, last = None, None, None

    def add(links, pairs, name):
        found = stage(_near(pairs, sig, similarity), name)
        return found if links is None else links.union(found)

    for level in range(levels):
        rows = _path_level(rows, sig, sets, level)
        pivot = F.min_by(F.struct("id", "root"), F.xxhash64("id")).alias("pivot")
        buckets = rows.groupBy("key").agg(F.count("*").alias("n"), pivot).where("n > 1")
        rows, path = staged(rows.join(buckets, "key").select(
            "id", "at", "key", "root", "n", F.col("pivot.id").alias("pivot"),
            F.col("pivot.root").alias("above")), "paths")
        discard(spark, last)
        links = add(links, rows.where("root <> above").select(*_ordered("id", "pivot")).distinct(), "near")
        groups = components(links, "a", "b")
        links = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        rows = (rows.select("id", "at", "key", "n").join(groups, F.col("id") == F.col("node"), "left")
                .select("id", "at", "key", "n", F.coalesce("root", "id").alias("root")))
        mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(
            "lo <> hi").select("key")
        rows, last = staged(rows.join(mixed, "key"), "undecided")
        discard(spark, path)
        few = rows.where(F.col("n") <= small).select("key", "id", "root")
        pairs = (few.alias("x").join(few.alias("y"), "key").where("x.id < y.id AND x.root <> y.root")
                 .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
        links = add(links, pairs, "near")
        rows = rows.where(F.col("n") > small)
        if rows.isEmpty():
            break
    return links, rows.select("id", "at", "key", "n")


def _dense(rows: DataFrame, reps: DataFrame, groups: DataFrame, similarity: float,
           block: int) -> DataFrame:
    """Links between different groups inside the buckets that stayed large:
    all blocks of a bucket against each other by sketches."""
    least = least_agreement(similarity)
    member = (rows.join(groups, rows["id"] == groups["node"], "left")
              .select("key", "id", "n", F.coalesce("root", "id").alias("root")))
    mixed = (member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").select("key"))
    blocks = (member.join(mixed, "key")
              .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", "id", "root", "block",
                      F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
              .join(reps.select(F.col(UID).alias("id"), "sketch"), "id"))

    @lean
    def compare(batches):
        for (_, i, j), t in runs(batches, ["key", "i", "j"]):
            ids, root = t.column("id").to_numpy(), t.column("root").to_numpy()
            block = t.column("block").to_numpy()
            sk = np.stack(t.column("sketch").to_numpy()).view(np.uint8)
            right = np.nonzero(block == j)[0]
            # only links that join two groups which no earlier link has joined: fewer
            # than there are groups, and they connect all that any link would
            names, group = np.unique(root, return_inverse=True)
            above, out = np.arange(len(names)), []
            for x in np.nonzero(block == i)[0]:
                hit = right[(above[group[right]] != above[group[x]])
                            & ((sk[right] == sk[x]).sum(axis=1) >= least)]
                met, first = np.unique(above[group[hit]], return_index=True)
                out += [(int(ids[x]), int(ids[y])) for y in hit[first]]
                above[np.isin(above, met)] = above[group[x]]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(compare, "a long, b long"))


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    keep = often[code]
    owner, code = owner[keep], (np.cumsum(often) - 1)[code[keep]]
    total = np.zeros((len(left), len(right)))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = 4096
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        total += m[left] @ m[right].T
    return total


def _compare_group(ids, sets, copies, left, right, same, similarity):
    """(id, linked rows, smallest id linked with) inside a block or between two."""
    n = np.array([len(s) for s in sets])
    inter = _shared(sets, left, right)
    linked = inter * (1 + similarity) >= similarity * (n[left][:, None] + n[right][None, :]) - 1e-6
    if same:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[left] += linked @ copies[right]
    if not same:
        links[right] += linked.T @ copies[left]
    root = np.arange(len(sets))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*np.nonzero(np.triu(linked) if same else linked), strict=True):
        p, q = find(left[x]), find(right[y])
        if p != q:
            p, q = (p, q) if ids[p] < ids[q] else (q, p)
            root[q] = p
    return links, ids[[find(x) for x in range(len(sets))]]


def exact_links(docs: DataFrame, members: DataFrame, similarity: float,
                block: int = BLOCK) -> DataFrame:
    """All pairs inside each group, compared exactly.

    ``members``: id, copies, size, root.  Groups over ``block`` sets, or with more
    than ``BLOCK_SHINGLES`` shingles, are cut into blocks, and every two blocks
    meet in a task of their own.  Returns per set
    and task: id, blocks, links, top (a set of the same class).
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"),
                                        F.sum(F.col("size").cast("long")).alias("total"))
    rows = (members.join(sizes, "root")
            .withColumn("blocks", F.greatest(F.ceil(F.col("n") / block),
                                             F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .select("id", "copies", "root", "blocks", "block"))
    texts = (_sifted(with_uid(docs).select(F.col(UID).alias("id"), "text"), "id", members, "id")
             .join(rows, "id")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
             .drop("other"))

    @lean
    def compare(batches):
        for (_, i, j), t in runs(batches, ["root", "i", "j"]):
            ids = t.column("id").to_numpy()
            copies, blk = t.column("copies").to_numpy(), t.column("block").to_numpy()
            sets = [shingles(x) for x in t.column("text").to_pylist()]
            left, right = np.nonzero(blk == i)[0], np.nonzero(blk == j)[0]
            links, top = _compare_group(ids, sets, copies, left, right, i == j, similarity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), t.column("blocks").combine_chunks(), pa.array(links), pa.array(top)],
                names=["id", "blocks", "links", "top"])

    return (texts.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
            .mapInArrow(compare, "id long, blocks int, links long, top long"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
                    levels: int = LEVELS, small: int = SMALL, block: int = BLOCK,
                    dense_block: int = DENSE_BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    doc_id; class_id: the smallest doc_id among the documents connected by
    links of at least ``similarity``; set_id: the smallest doc_id with the same
    shingle set; copies: documents with that set; n_links: other documents it
    is linked with, copies included; keep: true for one row of each class, that
    with the smallest doc_id (nulls last; of repeated rows one).  ``_uid`` is
    the row's id, as :func:`common.with_uid` gives it to ``docs``.  A text that
    is null or without a word has no links and is a class of its own.
    """
    sig = stage(signatures(docs, runs_for(recall, levels), levels, similarity), "signatures")
    sets = stage(sig.where("size > 0").groupBy("digest").agg(
        F.min(UID).alias("rep"), F.min("doc_id").alias("set_id"), F.count("*").alias("copies"),
        F.max("size").alias("size")),
        "sets")
    reps = sig.join(sets.select(F.col("rep").alias(UID), "copies"), UID)
    near, dense = candidates(sig, sets, levels, small, similarity)
    groups = components(near, "a", "b")
    more = stage(_dense(dense, reps, groups, similarity, dense_block), "dense")
    if not more.isEmpty():
        groups = components(near.union(more), "a", "b")
    members = groups.join(sets, groups["node"] == sets["rep"]).select(
        F.col("node").alias("id"), "copies", "size", "root")
    found = stage(exact_links(docs, members, similarity, block), "links")
    top = found.where("blocks = 1").select("id", "top")
    across = components(found.where("blocks > 1"), "id", "top")
    top = top.union(across.select("node", "root"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_set = (sets.join(top, sets["rep"] == top["id"], "left")
               .select("digest", "rep", "set_id", "copies", F.coalesce("top", "rep").alias("top"))
               .join(links, F.col("rep") == F.col("id"), "left")
               .select("digest", "set_id", "copies", "top",
                       (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = stage(sig.select(UID, "doc_id", "digest").join(per_set, "digest", "left").select(
        UID, "doc_id", F.coalesce("top", UID).alias("top"),
        F.coalesce("set_id", "doc_id").alias("set_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "rows")
    first = rows.groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", UID))
                                    .alias("first"))
    return rows.join(first, "top").select(
        UID, "doc_id", F.col("first.doc_id").alias("class_id"), "set_id", "copies", "n_links",
        (F.col(UID) == F.col(f"first.{UID}")).alias("keep"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with one row of each class: that with the smallest doc_id."""
    gone = near_duplicates(docs, **options).where("not keep").select(UID)
    return packed(docs).join(gone, UID, "left_anti").select("_row.*")
