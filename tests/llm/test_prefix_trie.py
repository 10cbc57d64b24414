import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stormcell.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, owner string, depth string, node string"


def conversations():
    r = random.Random(4)
    rows = []
    for c in range(0, 260, 1 if r.random() > 2 else 3):
        for t in range(r.choice([0, 1, 2, 5, 7, 8, 9])):
            rows.append((c, t, ("user", "assistant")[t % 2], r.choice(["a", "bb", "é\U0001f600", ""])))
    rows += [(c, t, "user", "same") for c in range(300, 420) for t in range(4)]  # copies
    rows += [(500 + k, t, "user", "long" if t < 40 + k else f"x{k}") for k in range(6) for t in range(45 + 8 * k)]
    rows += [(600, None, "user", "first"), (600, 0, None, None), (600, 0, None, None), (600, 1, "a", "b"),
             (700, 0, "us", "er"), (701, 0, "u", "ser"), (None, 0, "user", "nobody"),
             (-5, 0, "user", "minus"), (-105, 0, "user", "minus"), (90_000, 3, "user", "far")]
    return [(*x, "o", "d", "n") for x in rows]


def brute(rows, key=lambda t, role, text: (t is not None, t or 0, role)):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in own.items():
        own[c] = [(role, text) for _, role, text in sorted(turns, key=lambda x: key(*x))]
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {p: {"kids": 0, "leaves": 0, "saved": 0} for p in nodes}
    for p in nodes:
        if p:
            out[p[:-1]]["kids"] += 1
    for p, members in nodes.items():
        cost = (len(members) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            out[p[:d]]["saved"] += cost
            out[p[:d]]["leaves"] += not out[p]["kids"]
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), out[p]["kids"], out[p]["leaves"],
                   out[p]["saved"], hashlib.sha256(",".join(
                       map(str, sorted(c for c in m if len(full[c]) == len(p)))).encode()).hexdigest())
                  for p, m in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256"]


@pytest.mark.parametrize("width", [8, 3])
def test_matches_brute_force(spark, width):
    rows = conversations()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = P.trie(*P.rebuilt(P.numbered(df)), width=width)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute(rows)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.trie(*P.rebuilt(P.numbered(empty))).count() == 0
    one = spark.createDataFrame([(7, 0, None, None, "", "", "")], SCHEMA)
    got = sorted(map(tuple, P.trie(*P.rebuilt(P.numbered(one))).select(COLUMNS).collect()))
    assert got == brute([(7, 0, None, None)])


def test_running_totals_of_a_key_in_many_partitions(spark):
    rows = [(1, i, i % 7) for i in range(5000)] + [(k, 0, k) for k in range(2, 60)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(5)
    got = {(r.k, r.o): r.s for r in P.running(df, "k", ["o"], {"s": F.col("v")}).collect()}
    total = 0
    for i in range(5000):
        total += i % 7
        assert got[1, i] == total
    assert all(got[k, 0] == k for k in range(2, 60)) and len(got) == len(rows)


def test_ends_in_chunks(spark):
    ids = list(range(-9000, 9000, 3))
    members = spark.createDataFrame([(0, 2, c) for c in ids] + [(5, 1, 5)],
                                    "owner long, depth long, conv_id long").repartition(4)
    got = {r.owner: r.ends_sha256 for r in P.ends(members).collect()}
    assert got == {0: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   5: hashlib.sha256(b"5").hexdigest()}
