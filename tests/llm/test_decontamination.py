import numpy as np

from stormcell.llm import decontamination
from stormcell.llm.common import shingles, words

from .samples import changed, clash, documents, frame, prose


def brute(docs, items):
    out = []
    for d, t in docs:
        whole, w = set(shingles(t).tolist()), words(t)
        for i, x in items:
            v = words(x)
            if 0 < len(v) < 5:  # found in a row, anywhere
                if any(w[k:k + len(v)] == v for k in range(len(w) - len(v) + 1)):
                    out.append((d, i, 1, 1))
                continue
            s = set(shingles(x).tolist())
            if s and len(s & whole) >= 0.8 * len(s) - 1e-9:
                out.append((d, i, len(s & whole), len(s)))
    return sorted(out, key=repr)


def test_matches_brute_force_for_all_item_sizes(spark):
    items = [(i, prose(500 + i, n)) for i, n in enumerate([1, 2, 4, 5, 6, 7, 9, 13, 20, 40, 77, 150, 300])]
    items += [(100, None), (101, ""), (102, "hello there"), (0, prose(500, 1)), (None, prose(777, 30))]
    docs = [r[:2] for r in documents()]
    for k, (_, x) in enumerate(items):
        if x:
            docs.append((1000 + k, prose(600 + k, 700) + " " + x + ", " + prose(700 + k, 300)))
            docs.append((2000 + k, prose(800 + k, 30) + " " + changed(x, len(x.split()) // 30)))
            docs.append((3000 + k, changed(x, len(x.split()) // 3)))
    want = brute(docs, items)
    for block in (decontamination.BLOCK_ITEMS, 4):  # one pass, and several
        got = decontamination.contained(
            clash(frame(spark, docs, "doc_id long, text string")),
            clash(frame(spark, items, "item_id long, text string")), block_items=block).collect()
        assert sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got), key=repr) == want
        assert all(abs(r.containment - r.shared / r.item_shingles) < 1e-12 for r in got)


def test_decontaminate_drops_only_the_leaks(spark):
    item = prose(900, 40)
    rows = [(1, prose(901, 200)), (2, prose(902, 100) + " " + item), (None, item), (3, None), (3, None)]
    docs = frame(spark, rows, "doc_id long, text string")
    items = frame(spark, [(7, item)], "item_id long, text string")
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3]


def test_empty_tables(spark):
    docs, items = frame(spark, []), frame(spark, [], "item_id long, text string")
    assert decontamination.contained(docs, items).count() == 0
    assert decontamination.contained(frame(spark), items).count() == 0
    assert decontamination.decontaminate(frame(spark), items).count() == len(documents())


def test_size_classes_bound_the_window():
    for n in range(1, 600):
        c = decontamination.size_class(n)
        assert n <= 2**(c + 1) and (n > 2**c or c == 0)
    index = decontamination.ItemIndex([(1, prose(1, 64))], 40)
    s = shingles(prose(1, 64))
    assert index.candidates(s) == {0} and index.candidates(np.empty(0, np.uint64)) == set()


def test_short_items_are_found_inside_long_documents(spark):
    items = [(1, "the capital of France"), (2, "zebra"), (3, "ab cd"), (4, "Blue, whale song"), (4, "zebra"),
             (5, "capital the of France"), (6, None), (7, "...")]
    docs = [(10, "They said that The capital, of FRANCE is a city by a wide river."), (11, "ab cd"),
            (12, "ab x cd zebras"), (13, prose(950, 9000) + " blue whale song " + prose(951, 9000)),
            (14, "zebra zebra zebra"), (15, "capital of France"), (16, ""), (17, None)]
    want = [(10, 1), (11, 3), (13, 4), (14, 2), (14, 4)]
    for options in ({}, {"block_bytes": 25}, {"block_bytes": 0}):
        got = decontamination.contained(frame(spark, docs, "doc_id long, text string"),
                                        frame(spark, items, "item_id long, text string"), **options)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want
        assert {(r.shared, r.item_shingles, r.containment) for r in got.collect()} == {(1, 1, 1.0)}


def test_sql_finds_short_items_too(spark):
    import duckdb
    from stormcell.llm.queries import ORACLE

    items = [(1, "the capital of France"), (2, "zebra"), (3, "ab cd"), (8, prose(960, 40))]
    docs = [(10, "The capital of France is far"), (11, "ab cd"), (12, "a zebra, ab cd"),
            (13, prose(961, 50) + " " + prose(960, 40)), (14, ""), (15, None)]
    con = duckdb.connect()
    for name, cols, rows in (("documents", "doc_id BIGINT, text VARCHAR", docs),
                             ("benchmark", "item_id BIGINT, text VARCHAR", items)):
        con.execute(f"CREATE TABLE {name} ({cols})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    got = decontamination.contained(frame(spark, docs, "doc_id long, text string"),
                                    frame(spark, items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE["op4_decontamination"]).fetchall())
