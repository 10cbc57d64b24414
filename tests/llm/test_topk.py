import math
import random

import pytest
from pyspark.sql import functions as F

from stormcell.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string, v string"


def vectors():
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(200)]  # ties
    rows += [(600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] + [0.0] * 7),
             (603, [float("inf")] * 8), (None, [1.0] * 8), (604, [1.0, 2.0]), (700, [3.0, 1.0]),
             (800, []), (5, [0.1] * 8), (100, [0.2] * 8), (900, [3e6] * 8), (901, [-1e-9] * 8)]
    return [(*x, "a", "b", "c") for x in rows]


def brute(k=10):
    import numpy as np
    out = []
    good = []
    for i, e, *_ in vectors():
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((i, [math.floor(1024 * float(np.float32(x))) for x in e]))
    for a, (i, q) in enumerate(good):
        if i % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j) for b, (j, c) in enumerate(good)
                   if a != b and len(c) == len(q))[:k]
        out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 50}, {"shard_rows": 100, "query_block": 4}])
def test_matches_brute_force(spark, options):
    got = topk.top_k(spark.createDataFrame(vectors(), SCHEMA), F.expr("vec_id % 100 = 0"), **options)
    assert sorted((r.query_id, r.vec_id, r.score) for r in got.collect()) == \
        sorted((q, i, s) for q, _, i, s in brute())


def test_empty_and_few(spark):
    is_query = F.expr("vec_id % 100 = 0")
    assert topk.top_k(spark.createDataFrame([], SCHEMA), is_query).count() == 0
    few = spark.createDataFrame(vectors()[:3], SCHEMA)
    assert [(r.query_id, r["rank"]) for r in topk.top_k(few, is_query).orderBy("rank").collect()] == [
        (0, 1), (0, 2)]
