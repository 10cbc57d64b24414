"""Language identification: words first, then ever shorter character n-grams.

Training counts words and character n-grams of each language over all training
documents.  A known word scores by its log frequency in each language.  An
unseen word is read from left to right: at each place the longest known n-gram
(up to ``MAX_GRAM`` characters, with a mark for the word's edges) scores, and
reading goes on behind it.  A document's score for a language is the sum over
its words; the answer is the best language, with its share after a softmax of
the mean per word times the square root of their number.

All counts decide.  The ``entries`` words and n-grams of each length that rank first by
their share of the language that uses them most are broadcast, within ``MODEL_CELLS``
floats; the whole model stays a table.  When the broadcast part is not all of it, a
document is read with that part, its other words are looked up in the table by a join on
the distinct words, and the n-grams of those that are not there by a join on the distinct
n-grams.  The result is the same whatever ``entries`` is, up to rounding.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (CACHE_ROWS, UID, lean, list_column, most_frequent, packed, stage, texts,
                     with_uid)

MAX_GRAM = 5
ENTRIES = 60_000
FLUSH = 50_000  # words or n-grams in a batch that a task hands on
ROWS = 500  # words whose n-grams a task holds as Python lists
MODEL_CELLS = 20_000_000  # floats of the model and of a task's cache of unseen words
_LETTERS = re.compile(r"[^\W\d_]+")
TRAIN = "pmod(crc32(cast(doc_id as string)), 4) <> 2"
UNKNOWN = "und"


def letters(text: str | None) -> list[str]:
    """The words of a text; none if it has numerals that are no digits (fractions,
    powers) but no letter."""
    found = _LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def _table(tables: list[tuple[str, int, dict]]) -> pa.RecordBatch:
    langs, kinds, keys, ns = [], [], [], []
    for lang, kind, t in tables:
        langs += [lang] * len(t)
        kinds += [kind] * len(t)
        keys += t.keys()
        ns += t.values()
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.string()),
         pa.array(ns, pa.int64())], names=["lang", "kind", "gram", "n"])


COUNTS = "lang string, kind int, gram string, n long"


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind 0, gram, n): the words of each language."""
    @lean
    def count(batches):
        words: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(),
                                  texts(batch), strict=True):
                c = words.setdefault(lang, Counter())
                before = len(c)
                c.update(letters(text))
                size += len(c) - before
                if size > CACHE_ROWS:
                    yield _table([(lang, 0, c) for lang, c in words.items()])
                    words, size = {}, 0
        yield _table([(lang, 0, c) for lang, c in words.items()])

    return _summed(docs.where("lang is not null and text is not null").select("lang", "text")
                   .mapInArrow(count, COUNTS))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, kind k, gram, n): the k-grams of the counted words."""
    @lean
    def count(batches):
        tables: dict[str, list[defaultdict]] = {}
        size = 0
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "n")),
                                     strict=True):
                by_length = tables.get(lang)
                if by_length is None:
                    by_length = tables[lang] = [defaultdict(int) for _ in range(MAX_GRAM)]
                w = f"<{word}>"
                for k, t in enumerate(by_length, 1):
                    before = len(t)
                    for i in range(len(w) - k + 1):
                        t[w[i:i + k]] += n
                    size += len(t) - before
                if size > CACHE_ROWS:
                    yield _table([(lang, k, t) for lang, ts in tables.items() for k, t in enumerate(ts, 1)])
                    tables, size = {}, 0
        yield _table([(lang, k, t) for lang, ts in tables.items() for k, t in enumerate(ts, 1)])

    return _summed(words.mapInArrow(count, COUNTS))


class Model:
    """Languages, the broadcast part (a row number for each entry, by length; words are
    length 0) and its scores, log totals by length, and the table of all entries, None
    if the broadcast part is all of them."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], rows: np.ndarray,
                 base: np.ndarray | None = None, whole: DataFrame | None = None):
        self.langs, self.tables, self.rows, self.base, self.whole = langs, tables, rows, base, whole


def scores(by, base: np.ndarray) -> np.ndarray:
    """The log frequency of an entry in each language, from its codes and counts in turn."""
    row = math.log(0.5) - base
    for code, n in zip(by[::2], by[1::2], strict=True):
        row[code] = math.log(n + 0.5) - base[code]
    return row.astype(np.float32)


def train(docs: DataFrame, entries: int = ENTRIES) -> Model:
    """Model of the languages in ``docs`` (text, lang); rows without either are left out."""
    spark = docs.sparkSession
    words = stage(word_counts(docs), "language-words")
    table = words.union(stage(gram_counts(words), "language-grams"))
    total = {(r["lang"], r["kind"]): (r["t"], r["v"]) for r in table.groupBy("lang", "kind").agg(
        F.sum("n").alias("t"), F.count("*").alias("v")).collect()}  # a row per language and length
    langs = sorted({k for k, _ in total})
    if not langs:
        return Model([], [{} for _ in range(MAX_GRAM + 1)], np.empty((0, 0), np.float32))
    entries = max(1, min(entries, MODEL_CELLS // (len(langs) * (MAX_GRAM + 1))))
    codes = {lang: k for k, lang in enumerate(langs)}
    totals = spark.createDataFrame([(lang, kind, codes[lang], float(t)) for (lang, kind), (t, _) in
                                    total.items()], "lang string, kind int, code int, t double")
    # an entry ranks by its share of the language that uses it most, so that a language
    # with few documents keeps its words beside one with very many
    by_gram = stage(table.join(totals, ["lang", "kind"]).groupBy("kind", "gram").agg(
        (F.max(F.col("n") / F.col("t")) * 2.0**40).alias("weight"),
        F.flatten(F.collect_list(F.array(F.col("code").cast("long"), "n"))).alias("by")), "language-model")
    tables: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
    base = np.array([[math.log(sum(total.get((lang, kind), (0, 0))) + 1) for lang in langs]
                     for kind in range(MAX_GRAM + 1)])
    rows = []
    head = most_frequent(by_gram, "weight", entries, "kind").select("kind", "gram", "by").toArrow()
    for batch in head.to_batches(max_chunksize=FLUSH):
        for kind, gram, by in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tables[kind][gram] = len(rows)
            rows.append(scores(by, base[kind]))
    whole = by_gram.select("kind", "gram", "by") if by_gram.count() > len(rows) else None
    return Model(langs, tables, np.array(rows, np.float32).reshape(len(rows), len(langs)), base, whole)


def backoff(word: str, find, languages: int) -> np.ndarray:
    """The mean score of a word's pieces, read from left to right, the longest that
    ``find(length, piece)`` knows at each place."""
    w, i, total, n = f"<{word}>", 0, np.zeros(languages, np.float32), 0
    while i < len(w):
        for k in range(min(MAX_GRAM, len(w) - i), 0, -1):
            row = find(k, w[i:i + k])
            if row is not None:
                total += row
                n += 1
                i += k
                break
        else:
            i += 1
    return total / max(1, n)


class Scorer(dict):
    """Row number of each word's scores, worked out once; for a model whose broadcast
    part is all of it."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.clear()
        m = self.model
        self.update(m.tables[0])
        self.room = max(10_000, min(CACHE_ROWS, MODEL_CELLS // max(1, len(m.langs))))
        self.rows = np.concatenate([m.rows, np.zeros((self.room, len(m.langs)), np.float32)])
        self.used = len(m.rows)

    def __missing__(self, word: str) -> int:
        self.rows[self.used] = backoff(word, self._find, len(self.model.langs))
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def _find(self, k: int, piece: str) -> np.ndarray | None:
        at = self.model.tables[k].get(piece)
        return None if at is None else self.model.rows[at]

    def score(self, text: str | None) -> tuple[str, float]:
        found = letters(text)
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        s = np.zeros(len(self.model.langs))
        for a in range(0, len(found), self.room // 2):
            part = found[a:a + self.room // 2]
            if self.used + len(part) > len(self.rows):
                self._reset()
            s += self.rows[list(map(self.__getitem__, part))].sum(axis=0, dtype=np.float64)
        s = s / len(found) * math.sqrt(len(found))
        p = np.exp(s - s.max())
        best = int(s.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def _at_once(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score for the text, by the broadcast part alone."""
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables, model.rows))
    carry = [c for c in docs.columns if c != "text"]

    @lean
    def run(batches):
        scorer = Scorer(Model(*held.value))
        for batch in batches:
            got = [scorer.score(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=[*carry, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType(docs.select(*carry).schema.fields)
                           .add("lang_pred", "string").add("score", "double"))


def _read(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (_uid, text, any more) as (_uid, any more, words, sums, rest): the number
    of words, the sum of the scores of those in the broadcast part, and the others with
    how often they come."""
    held = docs.sparkSession.sparkContext.broadcast((model.tables[0], model.rows))
    carry = [c for c in docs.columns if c != "text"]
    rest_type = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def built(batch, a, counts, sums, rest):
        keys = pa.array([w for r in rest for w in r], pa.string())
        ns = pa.array([n for r in rest for n in r.values()], pa.int64())
        ends = pa.array(np.cumsum([0, *map(len, rest)], dtype=np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([keys, ns], fields=list(rest_type)))
        part = batch.slice(a, len(counts))
        return pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in carry], pa.array(counts, pa.int64()),
             list_column(sums, pa.float64()), lists], names=[*carry, "words", "sums", "rest"])

    @lean
    def run(batches):
        known, rows = held.value
        rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])  # -1: not there
        for batch in batches:
            a, size, counts, sums, rest = 0, 0, [], [], []
            for text in texts(batch):
                found = letters(text)
                others: Counter = Counter()
                total = np.zeros(rows.shape[1])
                for i in range(0, len(found), CACHE_ROWS):
                    part = found[i:i + CACHE_ROWS]
                    at = [known.get(w, -1) for w in part]
                    total += rows[at].sum(axis=0, dtype=np.float64)
                    others.update([w for w, k in zip(part, at, strict=True) if k < 0])
                counts.append(len(found))
                sums.append(total)
                rest.append(others)
                size += len(others)
                if size > FLUSH:
                    yield built(batch, a, counts, sums, rest)
                    a, size, counts, sums, rest = a + len(counts), 0, [], [], []
            if counts:
                yield built(batch, a, counts, sums, rest)

    return docs.mapInArrow(run, T.StructType(docs.select(*carry).schema.fields)
                           .add("words", "long").add("sums", T.ArrayType(T.DoubleType()))
                           .add("rest", T.ArrayType(T.StructType().add("word", "string").add("n", "long"))))


def _pieces(unseen: DataFrame, model: Model) -> DataFrame:
    """(word, gram): the n-grams of the words that are not in the broadcast part."""
    held = unseen.sparkSession.sparkContext.broadcast(model.tables[1:])

    @lean
    def run(batches):
        tables = held.value
        words, pieces = [], []
        for batch in batches:
            for word in batch.column("word").to_pylist():
                w = f"<{word}>"
                for k, t in enumerate(tables, 1):
                    for g in {w[i:i + k] for i in range(len(w) - k + 1)}:
                        if g not in t:
                            words.append(word)
                            pieces.append(g)
                if len(words) > FLUSH:
                    yield pa.RecordBatch.from_pydict({"word": words, "gram": pieces})
                    words, pieces = [], []
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(pieces, pa.string())],
                                         names=["word", "gram"])

    return unseen.select("word").mapInArrow(run, "word string, gram string")


def _looked_up(words: DataFrame, model: Model) -> DataFrame:
    """``words`` (distinct, outside the broadcast part) with their scores ``v``."""
    table = model.whole
    found = stage(words.join(table.where("kind = 0").select(F.col("gram").alias("word"), "by"),
                             "word", "left"), "language-tail")
    pieces = (_pieces(found.where("by is null"), model)
              .join(table.where("kind > 0").select("gram", "by"), "gram")
              .groupBy("word").agg(F.collect_list("gram").alias("grams"), F.collect_list("by").alias("counts")))
    held = words.sparkSession.sparkContext.broadcast((model.langs, model.tables, model.rows, model.base))

    @lean
    def run(batches):
        langs, tables, rows, base = held.value
        for batch in batches:
            words, vectors = batch.column("word").to_pylist(), []
            for a in range(0, len(words), ROWS):
                part = batch.slice(a, ROWS)
                for word, by, grams, counts in zip(*(part.column(c).to_pylist() for c in
                                                     ("word", "by", "grams", "counts")), strict=True):
                    if by is not None:
                        vectors.append(scores(by, base[0]))
                        continue
                    own = {g: scores(c, base[len(g)]) for g, c in zip(grams or (), counts or (), strict=True)}

                    def find(k, piece, own=own):
                        at = tables[k].get(piece)
                        return own.get(piece) if at is None else rows[at]

                    vectors.append(backoff(word, find, len(langs)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()),
                 list_column([v.astype(np.float64) for v in vectors], pa.float64())], names=["word", "v"])

    return found.join(pieces, "word", "left").mapInArrow(run, "word string, v array<double>")


def _classified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (_uid, text, any more) without the text, with lang_pred and score."""
    if model.whole is None:
        return _at_once(docs, model)
    read = stage(_read(docs, model), "language-read")
    rest = read.select(UID, F.inline("rest"))
    vectors = stage(_looked_up(rest.select("word").distinct(), model), "language-words-scored")
    more = (rest.join(vectors, "word").groupBy(UID)
            .agg(F.array(*[F.sum(F.col("n") * F.col("v")[k]) for k in range(len(model.langs))]).alias("more")))
    mean = F.expr("transform(zip_with(sums, more, (a, b) -> a + coalesce(b, 0D)), x -> x / greatest(words, 1) * sqrt(words))")
    best = F.array_max("mean")
    langs = F.array(*[F.lit(lang) for lang in model.langs])
    spoken = F.col("words") > 0
    carry = [c for c in docs.columns if c != "text"]
    return (read.drop("rest").join(more, UID, "left")
            .withColumn("more", F.coalesce("more", F.array(*[F.lit(0.0)] * len(model.langs))))
            .withColumn("mean", mean).withColumn("best", best)
            .select(*carry,
                    F.when(spoken, F.get(langs, F.array_position("mean", F.col("best")).cast("int") - 1))
                    .otherwise(UNKNOWN).alias("lang_pred"),
                    F.when(spoken, F.expr("1D / aggregate(mean, 0D, (a, x) -> a + exp(x - best))"))
                    .otherwise(0.0).alias("score")))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred and score, one row each.

    A text that is null, empty or without a letter is ``und`` with score 0, as
    is every text under a model of no languages; ties go to the language that
    sorts first.  Returns doc_id, lang_pred, score.
    """
    rows = with_uid(docs.select("doc_id", "text"))
    return _classified(rows, model).select("doc_id", "lang_pred", "score")


def training_rows(docs: DataFrame) -> DataFrame:
    """Three quarters of the documents, chosen by a checksum of the id."""
    return docs.where(TRAIN)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of
    at least ``least``.  Null, empty and letterless texts go; repeated rows are kept or
    go together; columns of any name are kept."""
    rows = packed(docs)
    got = _classified(rows.select(UID, F.col("_row.text").alias("text")), model)
    gone = stage(got.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select(UID),
                 "language-gone")
    return rows.join(gone, UID, "left_anti").select("_row.*")
