import random
import zlib

import pytest

from stormcell.llm import toxicity

from .samples import clash, frame, prose, vocabulary

BAD = ["idiot", "worthless", "pathetic", "loser"]
HIDE = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "@", "s": "$"})


def corpus(n=900):
    r = random.Random(9)
    words = vocabulary(4, 300) + ["solo", "ideal", "paths", "worth", "title", "also"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(40)]
        if toxic := i % 4 == 0:
            for b in r.sample(BAD, 2):
                w[r.randrange(40)] = r.choice([b, b.upper(), b.translate(HIDE), b[0] + b[1] * 4 + b[2:],
                                               " ".join(b)])
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    # the words themselves occur plainly in documents without a label
    rows = rows + [(10_000 + i, " ".join(BAD), "en", "s", 1) for i in range(50)]
    return toxicity.train(clash(frame(spark, rows)),
                          clash(frame(spark, labels, "doc_id long, quality int, toxic int")),
                          fold=toxicity.TRAIN)


def test_decoder_restores_disguised_words(model):
    chars = toxicity.CharModel(model.trigrams)
    for word, want in (("1d10t", "idiot"), ("w0rthl3ss", "worthless"), ("p@thetic", "pathetic"),
                       ("looooser", "loser"), ("idi0t", "idiot")):
        assert toxicity.disguised(word) and toxicity.decode(word, chars) == want
    assert not toxicity.disguised("idiot") and not toxicity.disguised("2024")
    assert "idiot" in toxicity.tokens("you i d i o t") and "loser" in toxicity.tokens("l-o-s-e-r")


def test_viterbi_is_the_cheapest_path(model):
    from itertools import product
    chars = toxicity.CharModel(model.trigrams)
    for token in ("1d10t", "p@@th", "s0l0"):
        best = []
        for path in product(*toxicity._slots(token)):
            word = "".join(t for t, _ in path)
            cost, two = sum(c for _, c in path), "^^"
            for c in word + "$":
                cost += chars.cost(two, c)
                two = two[1] + c
            best.append((cost, word))
        assert toxicity.decode(token, chars) == min(best)[1]


def test_held_out_accuracy(spark, model):
    rows, _ = corpus()
    got = {r.doc_id: r.score for r in toxicity.score(clash(frame(spark, rows)), model).collect()}
    held = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)


def test_awkward_rows(spark, model):
    rows = [(1, None, "a", "b", 1), (2, "", "a", "b", 1), (None, "x", "a", "b", 1), (3, "x " * 300_000, "a", "b", 1),
            (3, "@" * 500, "a", "b", 1), (4, "o" * 500, "a", "b", 1), (5, "日本語 ÀÉ", "a", "b", 1)]
    got = toxicity.score(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.keep_clean(frame(spark, rows), model).columns == frame(spark).columns


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 0), (2, 1, None), (None, 1, 1)]])
def test_too_few_labels(spark, labels):
    rows, _ = corpus(20)
    m = toxicity.train(frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(frame(spark, rows), m).collect()
    assert len(got) == 20 and len({r.score for r in got}) == 1
    assert toxicity.score(frame(spark, []), m).count() == 0


@pytest.mark.parametrize("text", [
    "you i.d.i.o.t", "i.d.i.o.t.", "you i d i o t.", "i d i o t, you", "i_d_i_o_t!", "you i.d i.o t",
    "(so i d i o t)", "i d i o t..."])
def test_spelled_words_with_dots_and_before_punctuation(text):
    assert "idiot" in [t.strip(toxicity.MARKS + "!") for t in toxicity.tokens(text)]


def test_long_disguised_tokens_are_decoded(model):
    restore = toxicity.Restorer(toxicity.CharModel(model.trigrams))
    for token in ("i" * 60 + "diot", "l" + "o" * 5000 + "ser", "1" + "d" * 50 + "10t"):
        assert {"idiot", "loser"} & set(restore.words(token))
    assert restore.words("1d10t" * 4000)  # time grows with the length only
