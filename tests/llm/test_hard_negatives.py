import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormcell.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, shard string, rank string"
LABEL = ("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")


def vectors():
    r = random.Random(8)
    centers = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.5) for x in centers[i % 12]], r.randrange(4)) for i in range(600)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(200)]  # ties
    rows += [(700, None, 1), (701, [1.0, None] + [0.0] * 6, 1), (702, [float("nan")] + [0.0] * 7, 1),
             (703, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (704, [1.0] * 8, None),
             (800, [1.0, 2.0], 3), (801, [2.0, 2.0], 3), (802, [1.0, 1.0], 2), (850, [2.0], 1), (851, [3.0], 1),
             (852, [1.5], 2), (900, [], 1), (901, [], 1), (902, [], 2), (50, [0.1] * 8, 2), (50, [0.1] * 8, 2),
             (950, [3e5] * 8, 7), (951, [3e5] * 8, 7), (952, [2e5] * 8, 8), (953, [-3e5] * 8, 8)]
    return [(*x, "a", "b", "c") for x in rows]


def brute(rows):
    good = []
    for i, e, label, *_ in rows:
        if None not in (i, e, label) and all(x is not None and math.isfinite(x) for x in e):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in e],
                         (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, q, label) in enumerate(good):
        if i % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j, m) for b, (j, c, m) in enumerate(good)
                   if a != b and len(c) == len(q))
        for ps, j, _ in [x for x in s if x[2] == label][:5]:
            fit = [(n, h) for n, h, m in s if m != label and 50 * -ps <= 100 * -n <= 95 * -ps][:3]
            out += [(i, j, k + 1, h, -ps, -n) for k, (n, h) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60}, {"shard_rows": 200, "anchor_block": 5}])
def test_matches_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(H, "SAMPLE_ROWS", 100 if options else H.SAMPLE_ROWS)
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    got = H.hard_negatives(df, F.expr("vec_id % 50 = 0"), F.expr(LABEL), **options)
    assert sorted(map(tuple, got.collect())) == brute(vectors())


def test_cells_come_by_falling_bound_and_all(spark):
    r = np.random.default_rng(1)
    v = r.integers(-500, 500, (3000, 6))
    index = H.MultiIndex(v, np.arange(3000), np.arange(3000), r.integers(0, 3, 3000))
    (up1, _), (up2, _) = index.sides(v[:1].astype(float))
    cells = list(index.order(up1[0], up2[0]))
    assert [b for b, _ in cells] == sorted((b for b, _ in cells), reverse=True)
    assert len({c for _, c in cells}) == len(cells) == len(up1[0]) * len(up2[0])
    scores = index.v @ v[0]
    for bound, cell in cells:
        assert (scores[index.ends[cell]:index.ends[cell + 1]] <= bound).all()


def test_bounds_spare_shards_and_cells(spark):
    """In clustered data few rows are scored."""
    r = np.random.default_rng(2)
    centers = r.normal(0, 400, (40, 16))
    v = (centers[np.arange(8000) % 40] + r.normal(0, 20, (8000, 16))).astype(np.int64)
    index = H.MultiIndex(v, np.arange(8000), np.arange(8000), np.arange(8000) // 40 % 5)
    seen = []
    merge = index._merge
    index._merge = lambda best, rows, *a: seen.append(len(rows)) or merge(best, rows, *a)
    (up1, _), (up2, _) = index.sides(v[:1].astype(float))
    index.positives(index.v[index.uids == 0][0], up1[0], up2[0], 0, 0, 5, -H.FEW)
    assert sum(seen) < 0.25 * 1600


def test_empty_and_few(spark):
    anchor = F.expr("vec_id % 50 = 0")
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA), anchor).count() == 0
    assert H.hard_negatives(spark.createDataFrame(vectors()[:1], SCHEMA), anchor).count() == 0
