from pyspark.sql import functions as F

from stormcell.llm.common import most_frequent, shingles, word_hashes, words

from .samples import documents


def test_most_frequent(spark):
    df = spark.range(1, 1001).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"))
    for limit in (0, 1, 100, 999, 1000, 5000):
        got = [r["n"] for r in most_frequent(df, "n", limit).collect()]
        assert len(got) <= limit and sorted(got) == list(range(1001 - len(got), 1001))
        assert len(got) >= min(1000, limit) * 0.5 or limit < 100
    per_kind = most_frequent(df, "n", 100, "k").collect()
    assert all(0 < sum(r["k"] == k for r in per_kind) <= 100 for k in (0, 1))
    assert most_frequent(df.where("n < 0"), "n", 5).count() == 0


def test_word_hashes_follow_the_words(monkeypatch):
    from stormcell.llm import common
    seen = {}
    for _, text, *_ in documents():
        w, h = words(text), word_hashes(text)
        assert len(w) == len(h)
        for a, b in zip(w, h.tolist(), strict=True):
            assert seen.setdefault(a, b) == b
        monkeypatch.setattr(common, "CHUNK", 50)
        assert (word_hashes(text) == h).all()
        monkeypatch.undo()
    assert len(set(seen.values())) == len(seen)


def test_short_texts_are_one_shingle():
    assert len(shingles("one two")) == 1 and len(shingles("")) == 0 == len(shingles(None))
    assert shingles("One, two!") == shingles("one two") != shingles("two one")
    assert len(shingles("a b c d e")) == 1 and len(shingles("a b c d e f")) == 2
