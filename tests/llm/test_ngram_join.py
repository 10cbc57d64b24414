from collections import defaultdict

import numpy as np
import pytest

from stormcell.llm import decontamination, ngram_join
from stormcell.llm.common import shingles

from .samples import changed, clash, documents, frame, prose


def brute(rows, t=0.8):
    sets = [set(shingles(x).tolist()) for _, x in rows]
    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= t * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in range(len(rows)):
        todo = [i] if i not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return sets, links, root


def check(spark, rows, **kw):
    got = ngram_join.near_duplicates(
        clash(frame(spark, rows, "doc_id long, text string")).repartition(1), **kw).collect()
    sets, links, root = brute(rows)
    assert len(got) == len(rows)
    want = []
    for i, (d, _) in enumerate(rows):
        cls = [rows[j][0] for j in root if root[j] == root[i] and rows[j][0] is not None]
        same = [j for j in range(len(rows)) if sets[j] == sets[i] and (sets[i] or j == i)]
        ids = [rows[j][0] for j in same if rows[j][0] is not None]
        want.append((d, min(cls, default=None), min(ids, default=None), len(same), len(links[i])))
    key = repr
    assert sorted(((r.doc_id, r.class_id, r.set_id, r.copies, r.n_links) for r in got), key=key) == \
        sorted(want, key=key)
    assert sum(r.keep for r in got) == len(set(root.values()))


def test_awkward_rows(spark):
    check(spark, [r[:2] for r in documents()])


def test_large_groups_go_down_the_tree_and_into_blocks(spark):
    base = prose(20, 150)
    rows = [(i, changed(base, 1 + i % 4, seed=i)) for i in range(90)]
    shared = prose(21, 60)  # one long passage in documents that are not alike
    rows += [(1000 + i, prose(100 + i, 60) + " " + shared) for i in range(60)]
    rows += [(2000 + i, prose(300 + i // 2, 40)) for i in range(40)]
    check(spark, rows, small=8, levels=3, block=16, dense_block=16)


def test_empty_table(spark):
    empty = frame(spark, [])
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.keep_one(empty).columns == empty.columns


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    docs = frame(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert 1 in ids and not {2, 3, 4, None} & set(ids) and 5 in ids
    assert ids.count(18) == 1 and 6 in ids and 7 in ids


def test_a_column_named_like_the_row_id_is_kept(spark):
    rows = [(7 * i, r[0], r[1]) for i, r in enumerate(documents())]
    docs = frame(spark, rows, "_uid long, doc_id long, text string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {(r["_uid"], r["doc_id"]) for r in kept.collect()} <= {(a, b) for a, b, _ in rows}
    clean = decontamination.decontaminate(docs, frame(spark, [(1, "nothing of this kind at all")],
                                                      "item_id long, text string"))
    assert sorted((r["_uid"] for r in clean.collect())) == [a for a, *_ in rows]


def test_sketch_agrees_with_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 1000).astype(np.uint64)
    other = base.copy()
    other[:111] = r.integers(0, 2**63, 111).astype(np.uint64)  # Jaccard 0.8
    same = (ngram_join.sketch(base) == ngram_join.sketch(other)).sum()
    assert same >= ngram_join.least_agreement(0.8)


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_choices_meet_as_often_as_the_theory_says(similarity):
    r = np.random.default_rng(2)
    met = 0
    for _ in range(60):
        a = r.integers(0, 2**63, 300).astype(np.uint64)
        n = int(300 * 2 * similarity / (1 + similarity))
        b = np.concatenate([a[:n], r.integers(0, 2**63, 300 - n).astype(np.uint64)])
        x, y = (set(zip(*map(np.ndarray.tolist, ngram_join.choices(s, 11, 1, similarity)), strict=True))
                for s in (a, b))
        met += bool(x & y)
    assert met == 60


@pytest.mark.parametrize("inter, n1, n2", [(12, 13, 14), (24, 27, 27), (4, 4, 5), (400, 450, 450)])
def test_pairs_of_exactly_the_similarity_are_linked(inter, n1, n2):
    both = np.arange(inter, dtype=np.uint64)
    a = np.concatenate([both, np.arange(10_000, 10_000 + n1 - inter, dtype=np.uint64)])
    b = np.concatenate([both, np.arange(20_000, 20_000 + n2 - inter, dtype=np.uint64)])
    more = np.append(b, np.uint64(30_000))  # one shingle too many
    ids, copies = np.array([1, 2, 3]), np.ones(3, np.int64)
    at = np.arange(3)
    links, top = ngram_join._compare_group(ids, [a, b, more], copies, at, at, True, 0.8)
    assert links[0] == 1 and top[0] == top[1] == 1


def test_a_set_inside_one_a_quarter_larger_is_met_at_every_level():
    r = np.random.default_rng(4)
    levels, pairs = ngram_join.LEVELS, 500
    met = np.zeros(levels)
    for _ in range(pairs):
        b = np.sort(r.integers(0, 2**63, 150).astype(np.uint64))
        a = b[np.sort(r.permutation(150)[:120])]
        x, y = (ngram_join.choices(s, ngram_join.runs_for(ngram_join.RECALL), levels, 0.8)
                for s in (a, b))
        for level in range(levels):
            met[level] += bool(np.isin(x[-1][x[0] == level], y[-1][y[0] == level]).any())
    assert (met >= 0.994 * pairs).all()  # 0.999 expected at the last level


def test_documents_of_many_shared_passages(spark):
    passages = [prose(40 + i, 14) for i in range(16)]
    r = np.random.default_rng(5)
    rows, pairs = [], 60
    for i in range(pairs):  # a document, and one with a quarter more behind it
        text = " ".join(passages[k] for k in r.permutation(16)[:8])
        rows += [(2 * i, text), (2 * i + 1, text + " " + prose(500 + i, 26))]
    got = {x.doc_id: x for x in ngram_join.near_duplicates(
        frame(spark, rows, "doc_id long, text string").repartition(1), small=2).collect()}
    _, links, _ = brute(rows)
    assert sum(len(x) for x in links.values()) >= 2 * pairs
    assert [got[i].n_links for i, _ in rows] == [len(links[i]) for i in range(len(rows))]


@pytest.mark.parametrize("n", [100, 400])
def test_candidate_links_of_a_group_do_not_grow_with_its_square(spark, n):
    base = prose(60, 300)
    docs = frame(spark, [(i, changed(base, 1 + i % 3, seed=i)) for i in range(n)],
                 "doc_id long, text string").repartition(1)
    sig = ngram_join.stage(ngram_join.signatures(docs, ngram_join.runs_for(0.999), 5, 0.8), "s")
    sets = sig.select(ngram_join.F.col("_uid").alias("rep"))
    links, dense = ngram_join.candidates(sig, sets, 5, 24, 0.8)
    assert n - 1 <= links.count() <= 3 * n
    assert links.select("a").union(links.select("b")).distinct().count() == n
    assert dense.isEmpty()  # the group is decided before the last level


def test_links_of_a_large_bucket_do_not_grow_with_its_square(spark):
    n = 200
    docs = frame(spark, [(i, changed(prose(60, 300), 1 + i % 3, seed=i)) for i in range(n)],
                 "doc_id long, text string").repartition(1)
    sig = ngram_join.stage(ngram_join.signatures(docs, 1, 1, 0.8), "s")
    ids = sorted(r[0] for r in sig.select("_uid").collect())
    rows = frame(spark, [(x, 7, n) for x in ids], "id long, key long, n long")
    groups = frame(spark, [], "node long, root long")  # every set is a group of its own
    links = [tuple(r) for r in ngram_join._dense(rows, sig, groups, 0.8, 128).collect()]
    assert len(links) <= 3 * n  # two blocks: each within itself, and both together
    root = {x: x for x in ids}
    for a, b in links:
        p, q = root[a], root[b]
        root = {k: p if v == q else v for k, v in root.items()}
    assert len(set(root.values())) == 1
