import collections
import math
import random
import zlib

import pytest

from stormcell.llm import langid

from .samples import clash, frame, prose, vocabulary

TONGUES = {"aa": ["ba", "lo", "mi", "ka"], "bb": ["str", "ung", "sch", "ter"], "cc": ["eau", "oi", "ux", "que"]}


def corpus(n=240):
    r = random.Random(6)
    rows = []
    for i in range(n):
        lang = sorted(TONGUES)[i % 3]
        words = ["".join(r.choice(TONGUES[lang]) for _ in range(r.randint(1, 4))) for _ in range(30)]
        rows.append((i, " ".join(words), lang, "s", 1))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(langid.training_rows(frame(spark, corpus())))


def test_held_out_accuracy(spark, model):
    got = {r.doc_id: r for r in langid.identify(clash(frame(spark, corpus())), model).collect()}
    held = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 30
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_unseen_words_back_off_to_their_pieces(spark, model):
    unseen = [(1, "strungschterungstr", None, None, 1), (2, "balomikalobamika", None, None, 1)]
    assert "strungschterungstr" not in model.tables[0]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, unseen), model).collect()}
    assert got == {1: "bb", 2: "aa"}


def test_known_words_score_by_their_frequency(model):
    s = langid.Scorer(model)
    word = next(iter(model.tables[0]))
    assert (s.rows[s[word]] == model.rows[model.tables[0][word]]).all()


def test_awkward_rows(spark, model):
    rows = [(1, None, "aa", "s", 1), (2, "", None, "s", 1), (3, "12 34 !!", "aa", "s", 1),
            (None, "balo", "aa", "s", 1), (4, "balo " * 200_000, "aa", "s", 1), (4, "ба", "aa", "s", 1)]
    got = langid.identify(clash(frame(spark, rows)), model).collect()
    assert len(got) == len(rows)
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    kept = langid.keep_known(frame(spark, rows), model)
    assert kept.columns == frame(spark).columns
    assert {r.text for r in kept.collect()} >= {"balo"} and not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    m = langid.train(frame(spark, [(1, None, "aa", "s", 1), (2, "x", None, "s", 1)]))
    got = langid.identify(frame(spark, [(1, prose(1, 5, vocabulary(2)), None, None, 1)]), m).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.identify(frame(spark, []), m).count() == 0


def test_a_small_cache_changes_nothing(spark, model, monkeypatch):
    text = " ".join(r[1] for r in corpus(40))
    want = langid.Scorer(model).score(text)
    monkeypatch.setattr(langid, "CACHE_ROWS", 10_000)
    few = langid.Scorer(model)
    few.room = 20
    assert few.score(text) == pytest.approx(want) or few.score(text)[0] == want[0]


def test_numerals_are_no_letters():
    assert langid.letters("\u00bd \u00b2 \u2167 12") == []
    assert langid.letters("\u00bd liter") == ["\u00bd", "liter"]


def test_a_small_language_keeps_its_words_beside_a_large_one(spark):
    r = random.Random(5)
    large, small = vocabulary(71, 3000), vocabulary(72, 60)
    rows = [(i, " ".join(r.choice(large) for _ in range(60)), "aa", "s", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(r.choice(small) for _ in range(30)), "bb", "s", 1) for i in range(4)]
    model = langid.train(frame(spark, rows), entries=500)
    used = {w for _, t, lang, *_ in rows if lang == "bb" for w in t.split()}
    assert len(model.tables[0]) <= 500 and used <= set(model.tables[0])
    tests = [(i, " ".join(r.choice(sorted(used)) for _ in range(8)), None, None, 1) for i in range(20)]
    assert {x.lang_pred for x in langid.identify(frame(spark, tests), model).collect()} == {"bb"}


def plain(docs, rows):
    """The whole model and method in a few lines, without a limit."""
    counts, tables = collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, text, lang, *_ in docs:
        for word in langid.letters(text):
            w = f"<{word}>"
            for kind, g in [(0, word)] + [(k, w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)]:
                counts[lang, kind][g] += 1
                tables[kind].add(g)
    langs = sorted({lang for lang, _ in counts})

    def log(lang, kind, g):
        c = counts[lang, kind]
        return math.log(c[g] + 0.5) - math.log(sum(c.values()) + len(c) + 1)

    def word_score(word, lang):
        if word in tables[0]:
            return log(lang, 0, word)
        w, i, got = f"<{word}>", 0, []
        while i < len(w):
            k = next((k for k in range(min(5, len(w) - i), 0, -1) if w[i:i + k] in tables[k]), 0)
            got += [log(lang, k, w[i:i + k])] if k else []
            i += k or 1
        return sum(got) / max(1, len(got))

    for doc_id, text, *_ in rows:
        found = langid.letters(text)
        if not found:
            yield doc_id, "und", 0.0
            continue
        x = [sum(word_score(w, lang) for w in found) / len(found) ** 0.5 for lang in langs]
        yield doc_id, langs[x.index(max(x))], 1 / sum(math.exp(v - max(x)) for v in x)


@pytest.mark.parametrize("entries", [1, 40, 60_000])
def test_all_counts_decide_whatever_is_broadcast(spark, entries):
    docs = corpus(60)
    rows = [*corpus(20), (50, "stru lomi ungx \u0431\u0430 mikaq zzz", None, None, 1), (51, None, "aa", "s", 1),
            (52, "12 !", None, None, 1), (53, "qqq", None, None, 1), (54, "str\u00fcng " * 5 + "balo", None, None, 1)]
    model = langid.train(frame(spark, docs), entries=entries)
    assert (model.whole is None) == (entries == 60_000)
    got = {r.doc_id: r for r in langid.identify(clash(frame(spark, rows)), model).collect()}
    assert len(got) == len(rows)
    for doc_id, lang, score in plain(docs, rows):
        assert got[doc_id].lang_pred == lang and got[doc_id].score == pytest.approx(score, abs=1e-4)
    kept = langid.keep_known(clash(frame(spark, rows)), model, 0.5)
    assert kept.columns == clash(frame(spark, rows)).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, lang, s in plain(docs, rows) if lang != "und" and s >= 0.5}


def test_more_languages_than_the_broadcast_would_hold(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_CELLS", 6000)
    r = random.Random(9)
    tongues = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)]
               for k in range(120)}
    docs = [(i, " ".join(r.choice(tongues[lang]) for _ in range(20)), lang, "s", 1)
            for i, lang in enumerate(sorted(tongues) * 2)]
    model = langid.train(frame(spark, docs))
    assert len(model.langs) == 120 and model.whole is not None and max(map(len, model.tables)) <= 8
    got = {x.doc_id: x.lang_pred for x in langid.identify(frame(spark, docs), model).collect()}
    assert sum(got[d] == lang for d, _, lang, *_ in docs) >= 0.97 * len(docs)
