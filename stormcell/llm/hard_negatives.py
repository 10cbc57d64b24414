"""Hard negatives by an inverted multi-index, exactly.

Vectors become integers, floor(256 x).  Each half of the dimensions has a codebook,
fitted on at most about ``SAMPLE_ROWS`` rows; a pair of codewords is a cell, with the
largest distance of its rows to both codewords.  Cells are packed into shards (large
ones are split), so that rows of a shard lie close together, and an anchor goes only
to the shards of cells whose bound q.c + |q| r, summed over both halves, can still
give it a result.  What it needs at least (its bar) is known from the sample.

A shard has an inverted multi-index of its own: two codebooks over its rows.  A
multi-sequence heap visits its cells in the order of the summed bounds.  Two passes:

1. positives: the rows of the anchor's label; the visit ends when no cell left can
   beat the anchor's last positive;
2. negatives: each positive's score s gives a window [s / 2, 0.95 s]; the visit ends
   when every window is certified, which means no cell left reaches the last of its
   rows (or the window).  Cells that lie above all windows are passed over.

Vectors travel once per block of anchors, anchors once per shard they need.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, lean, stage, with_uid

SCALE = 256
SAMPLE_ROWS = 8_192
SHARD_ROWS = 16_384
ANCHOR_BLOCK = 8_192
MOST_CODES = 64
MAX_TASKS = 20_000
FEW = 1 << 62  # stands for a bar that is not there: below all scores
KEY = ["dim", "shard", "block"]


def scaled(embeddings: DataFrame, label: Column) -> DataFrame:
    """(_uid, vec_id, label, v, dim) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    return (with_uid(embeddings)
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
            .select(UID, F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                    v.alias("v"), F.size(x).alias("dim")))


def kmeans(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """At most ``k`` codewords; the same for the same rows."""
    if not x.shape[1] or not len(x):
        return np.zeros((1, x.shape[1]))
    at = np.random.default_rng(0).choice(len(x), size=min(k, len(x)), replace=False)
    codes = np.unique(x[at], axis=0)
    for _ in range(steps):
        near = nearest(x, codes)[0]
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(codes))[:, None]
        codes = np.where(n > 0, total / np.maximum(n, 1), codes)
    return codes


def nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codeword of each row, and its distance."""
    near = ((codes * codes).sum(axis=1) - 2 * (x @ codes.T)).argmin(axis=1)
    return near, np.sqrt(((x - codes[near]) ** 2).sum(axis=1))


def bounds(q: np.ndarray, codes: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries x codewords): the largest and smallest half score of a code's rows."""
    dot = q @ codes.T
    norm = np.sqrt((q * q).sum(axis=1))[:, None]
    slack = norm * radius
    slack = slack + 1e-9 * (np.abs(dot) + slack + norm * (1 + np.abs(codes).max(initial=0)))
    return dot + slack, dot - slack


def exact(v: np.ndarray) -> np.ndarray:
    """The type in which inner products are exact."""
    most = int(np.abs(v.astype(object)).max()) if v.size else 0
    return v.astype(np.float64 if most * most * max(1, v.shape[1]) < 2**53 else object)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class MultiIndex:
    """Rows in cells of two half codebooks; a cell's rows lie together, by label."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray):
        n, d = v.shape
        self.half = d // 2
        low = v.astype(np.float64)
        k = max(1, min(16, int(np.sqrt(n / 32))))
        self.codes, near, self.radius = [], [], []
        for part in (low[:, :self.half], low[:, self.half:]):
            codes = kmeans(part, k)
            at, far = nearest(part, codes)
            radius = np.zeros(len(codes))
            np.maximum.at(radius, at, far)
            self.codes.append(codes)
            self.radius.append(radius)
            near.append(at)
        wide = len(self.codes[1])
        cell = near[0] * wide + near[1]
        order = np.lexsort((ids, labels, cell))
        self.v, self.ids, self.uids, self.labels = exact(v)[order], ids[order], uids[order], labels[order]
        cell = cell[order]
        self.ends = np.searchsorted(cell, np.arange(len(self.codes[0]) * wide + 1))
        # the same cells for each label: rows of one label are a slice of the cell
        self.runs = {}
        for label in np.unique(self.labels):
            rows = np.flatnonzero(self.labels == label)
            self.runs[int(label)] = (rows, np.searchsorted(cell[rows], np.arange(len(self.ends))))

    def order(self, up1: np.ndarray, up2: np.ndarray):
        """(bound, cell) by falling bound: the multi-sequence algorithm."""
        a, b = np.argsort(-up1, kind="stable"), np.argsort(-up2, kind="stable")
        x, y = up1[a].tolist(), up2[b].tolist()
        heap, seen = [(-x[0] - y[0], 0, 0)], {(0, 0)}
        while heap:
            up, i, j = heapq.heappop(heap)
            yield -up, a[i] * len(y) + b[j]
            for nxt in ((i + 1, j), (i, j + 1)):
                if nxt not in seen and nxt[0] < len(x) and nxt[1] < len(y):
                    seen.add(nxt)
                    heapq.heappush(heap, (-x[nxt[0]] - y[nxt[1]], *nxt))

    def sides(self, q: np.ndarray):
        halves = q[:, :self.half], q[:, self.half:]
        return [bounds(h, c, r) for h, c, r in zip(halves, self.codes, self.radius, strict=True)]

    def positives(self, q, up1, up2, uid: int, label: int, k: int, bar: int):
        """The best (score, id) of the label, but the row ``uid``, at least ``bar``."""
        if label not in self.runs:
            return []
        rows, ends = self.runs[label]
        best, held, at_once = [], [], 1
        for up, cell in self.order(up1, up2):
            if held and (len(held) >= at_once or up < bar):
                best = self._merge(best, np.concatenate(held), q, uid, k, bar)
                bar = max(bar, best[-1][0]) if len(best) == k else bar
                held, at_once = [], min(32, 2 * at_once)
            if up < bar:
                break
            if ends[cell] < ends[cell + 1]:
                held.append(rows[ends[cell]:ends[cell + 1]])
        return self._merge(best, np.concatenate(held), q, uid, k, bar) if held else best

    def _merge(self, best, rows, q, uid, k, bar):
        score = self.v[rows] @ q
        good = np.flatnonzero((score >= bar) & (self.uids[rows] != uid))
        found = [(int(score[i]), int(self.ids[rows[i]])) for i in good]
        return sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]

    def negatives(self, q, one, two, label: int, windows: list[tuple[int, int, int]], k: int):
        """For each window (low, high, bar) the best (score, id) of other labels."""
        (up1, low1), (up2, low2) = one, two
        wide = len(up2)
        best = [[] for _ in windows]
        bars = [max(low, bar) for low, _, bar in windows]
        top = max(high for _, high, _ in windows)
        held, at_once = [], 1

        def merge():
            rows = np.concatenate(held)
            score = self.v[rows] @ q
            good = np.flatnonzero((score >= min(bars)) & (score <= top) & (self.labels[rows] != label))
            found = [(int(score[i]), int(self.ids[rows[i]])) for i in good]
            for w, (_, high, _) in enumerate(windows):
                mine = [x for x in found if bars[w] <= x[0] <= high]
                best[w] = sorted(best[w] + mine, key=lambda x: (-x[0], x[1]))[:k]
                if len(best[w]) == k:
                    bars[w] = max(bars[w], best[w][-1][0])

        for up, cell in self.order(up1, up2):
            if held and (len(held) >= at_once or up < min(bars)):
                merge()
                held, at_once = [], min(32, 2 * at_once)
            if up < min(bars):  # every window is certified
                break
            if low1[cell // wide] + low2[cell % wide] <= top and self.ends[cell] < self.ends[cell + 1]:
                held.append(np.arange(self.ends[cell], self.ends[cell + 1]))
        if held:
            merge()
        return best


def window(score: int) -> tuple[int, int]:
    """Scores n with 50 score <= 100 n <= 95 score."""
    return -(-score // 2), 95 * score // 100


class Layout:
    """What the driver keeps: the sample, the codebooks, the cells and their shards."""

    def __init__(self, rows: DataFrame, shard_rows: int):
        self.count = rows.count()
        share = min(1.0, SAMPLE_ROWS / max(1, self.count))
        drawn = rows.where(F.pmod(F.xxhash64(F.lit("sample"), UID), F.lit(1 << 30)) < int(share * (1 << 30)))
        by: dict[int, list] = {}
        for r in drawn.select(UID, "label", "v", "dim").collect():
            by.setdefault(r["dim"], []).append(r)
        codes = max(2, min(MOST_CODES, int(self.count ** 0.25)))
        self.sample, self.books = {}, {}
        for dim, found in by.items():
            found.sort(key=lambda r: r[UID])
            v = np.array([r["v"] for r in found], np.int64).reshape(len(found), dim)
            self.sample[dim] = (exact(v), np.array([r["label"] for r in found]),
                                np.array([r[UID] for r in found]))
            low = v.astype(np.float64)
            self.books[dim] = [kmeans(h, codes) for h in (low[:, :dim // 2], low[:, dim // 2:])]
        self.shard_rows = shard_rows

    def book(self, dim: int):
        """Lengths that the sample lacks have one cell."""
        half = dim // 2
        return self.books.get(dim) or [np.zeros((1, half)), np.zeros((1, dim - half))]

    def coded(self, rows: DataFrame) -> DataFrame:
        book = self.book

        @lean
        def run(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                out = [np.zeros(len(dims), t) for t in (np.int32, np.int32, float, float)]
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    v = matrix(batch.column("v").take(pa.array(at)), dim).astype(np.float64)
                    for i, h in enumerate((v[:, :dim // 2], v[:, dim // 2:])):
                        out[i][at], out[i + 2][at] = nearest(h, book(int(dim))[i])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, "c1", "c2", "d1", "d2"])

        return rows.mapInArrow(run, "_uid long, vec_id long, label long, v array<long>, dim int,"
                                    " c1 int, c2 int, d1 double, d2 double")

    def shards(self, coded: DataFrame) -> DataFrame:
        """Adds ``shard``; a table of the cells decides (a row per cell)."""
        cells = coded.groupBy("dim", "c1", "c2").agg(
            F.count("*").alias("n"), F.max("d1").alias("r1"), F.max("d2").alias("r2")).collect()
        self.cells: dict[int, list] = {}  # dim -> (c1, c2, r1, r2, first shard, shards)
        shard, room, last, table = -1, 0, None, []
        for c in sorted(cells, key=lambda c: (c["dim"], c["c1"], c["c2"])):
            parts = max(1, -(-c["n"] // self.shard_rows))
            if parts > 1 or c["n"] > room or c["dim"] != last:
                shard, room, last = shard + 1, self.shard_rows, c["dim"]
            self.cells.setdefault(c["dim"], []).append((c["c1"], c["c2"], c["r1"], c["r2"], shard, parts))
            table.append((c["dim"], c["c1"], c["c2"], shard, parts))
            room -= c["n"]
            shard += parts - 1
        self.number = shard + 1
        spark = coded.sparkSession
        places = spark.createDataFrame(table, "dim int, c1 int, c2 int, first int, parts int")
        return (coded.join(F.broadcast(places), ["dim", "c1", "c2"])
                .withColumn("shard", F.col("first") + F.pmod(F.xxhash64(UID), F.col("parts")).cast("int"))
                .select(UID, "vec_id", "label", "v", "dim", "shard"))

    def reach(self, dim: int, q: np.ndarray):
        """(cells of the dim, largest, smallest score of their rows with each query)."""
        cells = self.cells.get(dim, [])
        half = dim // 2
        up, low = 0, 0
        for h, code, radius, book in ((q[:, :half], 0, 2, 0), (q[:, half:], 1, 3, 1)):
            codes = self.book(dim)[book][[c[code] for c in cells]]
            u, l = bounds(h, codes, np.array([c[radius] for c in cells]))  # noqa: E741
            up, low = up + u, low + l
        return cells, up, low


def _routed(layout: Layout, anchors: DataFrame, k: int, negatives: int) -> DataFrame:
    """The anchors, once per shard that can give them a result, with bars from the
    sample; with ``windows`` among the columns, for the second pass."""
    second = "windows" in anchors.columns

    @lean
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            bars, shards = [None] * len(dims), [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = matrix(batch.column("v").take(pa.array(at)), dim)
                cells, up, low = layout.reach(int(dim), v.astype(np.float64))
                s, labels, uids = layout.sample.get(int(dim), (np.zeros((0, dim)), np.zeros(0), np.zeros(0)))
                both = np.concatenate([exact(v), s]) if s.dtype == object else exact(v)
                scores = both[:len(v)] @ s.T
                for row, j in enumerate(at):
                    label, uid = batch.column("label")[j].as_py(), batch.column(UID)[j].as_py()
                    mine = scores[row]
                    if not second:
                        mine = mine[(labels == label) & (uids != uid)]
                        bars[j] = [int(np.sort(mine)[-k]) if len(mine) >= k else -FEW]
                        can = up[row] >= bars[j][0]
                    else:
                        windows = batch.column("windows")[j].as_py()
                        mine = mine[labels != label]
                        bars[j] = []
                        for w in windows:
                            inside = mine[(mine >= w["low"]) & (mine <= w["high"])]
                            bars[j].append(int(np.sort(inside)[-negatives]) if len(inside) >= negatives
                                           else w["low"])
                        can = (up[row] >= min(bars[j])) & (low[row] <= max(w["high"] for w in windows))
                    shards[j] = sorted({x for i in np.flatnonzero(can)
                                        for x in range(cells[i][4], cells[i][4] + cells[i][5])})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bars, pa.list_(pa.int64())), pa.array(shards, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "bars", "shards"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    found = anchors.mapInArrow(run, f"{kind}, bars array<long>, shards array<int>")
    return found.withColumn("shard", F.explode("shards")).drop("shards")


def _search(vectors: DataFrame, anchors: DataFrame, k: int, tasks: int) -> DataFrame:
    """(anchor, w, vec_id, score): in each shard, the shard's vectors come first, the
    anchors are read batch by batch behind them."""
    kind = "array<struct<low:bigint,high:bigint>>"
    if "windows" not in anchors.columns:
        anchors = anchors.withColumn("windows", F.lit(None).cast(kind))
    both = (vectors.select(*KEY, F.lit(0).alias("side"), UID, "vec_id", "label", "v",
                           F.lit(None).cast("array<long>").alias("bars"), F.lit(None).cast(kind).alias("windows"))
            .union(anchors.select(*KEY, F.lit(1), UID, "vec_id", "label", "v", "bars", "windows")))

    def answer(index, t, dim):
        q = matrix(t.column("v"), dim)
        exactly = exact(q)
        (up1, low1), (up2, low2) = index.sides(q.astype(np.float64))
        for j in range(len(q)):
            uid, label = t.column(UID)[j].as_py(), t.column("label")[j].as_py()
            bars, windows = t.column("bars")[j].as_py(), t.column("windows")[j].as_py()
            if windows is None:
                found = [index.positives(exactly[j], up1[j], up2[j], uid, label, k, bars[0])]
            else:
                found = index.negatives(exactly[j], (up1[j], low1[j]), (up2[j], low2[j]), label, [
                    (w["low"], w["high"], b) for w, b in zip(windows, bars, strict=True)], k)
            for w, best in enumerate(found):
                for s, i in best:
                    yield uid, w, i, max(-2**63, min(2**63 - 1, s))

    @lean
    def run(batches):
        now, held, index = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*KEY, "side")), strict=True))
            starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            out = []
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                part, key, dim = batch.slice(a, b - a), keys[a][:3], keys[a][0]
                if key != now:
                    now, held, index = key, [], None
                if keys[a][3] == 0:
                    held.append(part)
                    continue
                if index is None and held:
                    t = pa.Table.from_batches(held)
                    index = MultiIndex(matrix(t.column("v").combine_chunks(), dim),
                                       *(t.column(c).to_numpy() for c in ("vec_id", UID, "label")))
                    held = []
                if index is not None:
                    out += answer(index, part, dim)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                    names=["anchor", "w", "vec_id", "score"])

    return (both.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "side")
            .mapInArrow(run, "anchor long, w int, vec_id long, score long"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, is_anchor: Column, label: Column | None = None,
                   positives: int = 5, negatives: int = 3, shard_rows: int = SHARD_ROWS,
                   anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where ``is_anchor`` (a condition on vec_id) holds; an
    anchor's positives are its best other rows of the same label, a positive's
    negatives the best rows of other labels inside its window; ties go to the smaller
    vec_id.  ``label`` replaces the column of that name.  Rows whose vec_id, label or
    vector is null, or whose vector holds nulls or non-finite numbers, take no part;
    vectors of different lengths are not compared; a row that occurs twice is two
    rows and two anchors; positives without negatives have no rows.  Components
    beyond 64 bits are cut there.
    """
    rows = stage(scaled(embeddings, F.col("label") if label is None else label), "mining-vectors")
    layout = Layout(rows, shard_rows)
    rows = stage(layout.shards(stage(layout.coded(rows), "mining-codes")), "mining-shards")
    anchors = rows.where(is_anchor).drop("shard")
    blocks = max(1, -(-anchors.count() // anchor_block))
    anchors = anchors.withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), UID), F.lit(blocks)).cast("int"))
    vectors = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = max(1, min(MAX_TASKS, 2 * layout.number * blocks))  # a given number is not merged
    found = stage(_best(_search(vectors, _routed(layout, anchors, positives, negatives), positives, tasks),
                        positives), "mining-positives")
    s = F.col("score")
    half = F.expr("score div 2") + (s % 2)  # upwards, for scores that aren't negative
    # 95 s / 100 in two steps, so that no product leaves 64 bits
    high = F.expr("score div 100 * 95 + (score % 100) * 95 div 100")
    spans = (found.where("score >= 0").select("anchor", F.struct(
        F.col("rank"), F.col("vec_id"), s.alias("score"), half.alias("low"), high.alias("high")).alias("p"))
        .where("p.low <= p.high").groupBy("anchor").agg(F.sort_array(F.collect_list("p")).alias("p")))
    asking = anchors.join(spans, F.col(UID) == F.col("anchor")).drop("anchor")
    asking = stage(asking, "mining-windows")
    seek = asking.withColumn("windows", F.transform("p", lambda p: F.struct(p["low"], p["high"]))).drop("p")
    best = _best(_search(vectors, _routed(layout, seek, positives, negatives), negatives, tasks), negatives)
    return (best.join(asking.select(F.col(UID).alias("anchor"), F.col("vec_id").alias("anchor_id"),
                                    F.posexplode("p").alias("w", "p")), ["anchor", "w"])
            .select("anchor_id", F.col("p.vec_id").alias("positive_id"), "rank",
                    F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"),
                    F.col("score").alias("negative_score")))
