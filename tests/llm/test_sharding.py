import zlib

import numpy as np

from stormcell.llm import sharding

from .samples import clash, documents, frame


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 2**bits
        grid = np.stack(np.unravel_index(np.arange(side**dims), (side,) * dims), 1)
        place = sharding.hilbert_index(grid, bits)
        assert sorted(place) == list(range(side**dims))
        assert np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1).max() == 1


def check(got, rows, shards):
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                   for d, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    n = [len(slots.get(k, [])) for k in range(shards)]
    assert max(n) - min(n) <= 1


def test_laws(spark):
    rows = documents()
    check(sharding.shard(clash(frame(spark, rows))).collect(), rows, 8)
    check(sharding.shard(frame(spark, rows[:3])).collect(), rows[:3], 8)
    many = [(i, "same", "en", "s", 4) for i in range(500)]
    check(sharding.shard(frame(spark, many), shards=7).collect(), many, 7)
    assert sharding.shard(frame(spark, [])).count() == 0


def test_shards_prune_in_every_dimension(spark):
    rows = [(i, "x" * (1 + i * 7919 % 4096), f"l{i % 16:02d}", f"s{i // 16 % 16:02d}", 1)
            for i in range(4096)]
    got = {r.doc_id: r.shard for r in sharding.shard(frame(spark, rows), shards=64).collect()}
    for dim in (2, 3):
        spans = {}
        for r in rows:
            spans.setdefault(got[r[0]], set()).add(r[dim])
        assert np.mean([len(s) for s in spans.values()]) <= 8  # of 16


def test_strings_with_a_long_common_prefix_prune_too(spark):
    far = "https://example.org/" + "a" * 3000 + "/"
    rows = [(i, "x" * (1 + i * 7919 % 4096), f"{far}{i % 16:02d}", f"{far}{i // 16 % 16:02d}", 1)
            for i in range(4096)]
    got = {r.doc_id: r.shard for r in sharding.shard(frame(spark, rows), shards=64).collect()}
    for dim in (2, 3):
        spans = {}
        for r in rows:
            spans.setdefault(got[r[0]], set()).add(r[dim])
        assert np.mean([len(s) for s in spans.values()]) <= 8  # of 16


def test_string_edges_are_quantiles_of_the_ranked_values(spark):
    values = [f"v{i:03d}" for i in range(100)] + ["v050"] * 60 + [None] * 40
    rows = spark.createDataFrame([(v or "",) for v in values], "s string")
    line = sorted(v or "" for v in values)
    cell = {}
    for at, v in enumerate(line):
        cell.setdefault(v, at * 8 // len(line))
    want = {}
    for v in line:
        want.setdefault(cell[v], v)
    assert sharding.string_edges(rows, "s", 3) == sorted(want.values())[1:]
    assert sharding.string_edges(rows.limit(0), "s", 3) == []
    assert sharding.number_edges(rows.limit(0).selectExpr("length(s) AS n"), "n", 3) == []
