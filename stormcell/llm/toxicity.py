"""Toxicity by a noisy channel: restore the text, then score it.

A character trigram model is counted over the words of all documents.  Tokens
that look disguised (look-alike signs inside words, letters repeated three
times or more, single characters spelled out with spaces) become a lattice: a
sign may stand for itself or for the letters it resembles, a run of equal
letters for one or two of them.  Viterbi finds the likeliest word under the
character model and the channel's costs.

The classifier is learned from a bounded sample of labelled documents
(``sample`` per class, in the order of a hash of the id): half of it gives a
log-odds weight to each restored word and word beginning, the other half fits a
logistic regression on what these weights say about a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ROWS, lean, most_frequent, stage, texts

SAMPLE = 20_000
TRIGRAMS = 200_000
FEATURES = 200_000
MIN_DOCS = 4
TRAIN = "pmod(crc32(cast(doc_id as string)), 5) <> 0"
#: Signs and the letters they resemble.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
              "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
              "*": "aeiou", "#": "h", "€": "e", "£": "l", "¡": "i"}
SWAP_COST, SAME_SIGN_COST, STRETCH_COST, DOUBLE_COST = 1.0, 6.0, 0.5, 4.0
STEMS = (4, 5, 6)
_SPELLED = re.compile(r"(?<!\S)\S(?:[ ._-]\S){2,}(?=[.,;:?!\"')\]}]*(?!\S))")
MARKS = ".,;:?\"'"
_EDGE = re.compile(r"^[^\w@$!|+(*#€£¡]+|[^\w@$!|+(*#€£¡]+$")
_RUN = re.compile(r"([^\W\d_])\1\1")
_CORE = re.compile(r"[^\W\d_]+")


class CharModel:
    """Add-half trigram model of the letters of words, with edge marks."""

    def __init__(self, trigrams: dict[str, int]):
        self.tri = trigrams
        self.bi: Counter = Counter()
        for t, n in trigrams.items():
            self.bi[t[:2]] += n
        self.size = max(2, len({t[2] for t in trigrams}))
        self.known: dict[str, float] = {}  # costs worked out so far, by trigram

    def cost(self, two: str, c: str) -> float:
        out = self.known.get(two + c)
        if out is None:
            if len(self.known) >= CACHE_ROWS:
                self.known.clear()
            out = self.known[two + c] = -math.log(
                (self.tri.get(two + c, 0) + 0.5) / (self.bi.get(two, 0) + 0.5 * self.size))
        return out


def _slots(token: str):
    """Choices of the lattice: (letters, cost) lists, one per run of equal signs."""
    for c, run in groupby(token):
        n = len(list(run))
        if c.isalpha():
            yield [(c * k, 0.0 if k == n else DOUBLE_COST if n == 2 else STRETCH_COST)
                   for k in sorted({1, min(n, 2)})]
        else:
            yield [("", SAME_SIGN_COST)] + [
                (x * k, SWAP_COST) for x in LOOKS_LIKE.get(c, "") for k in sorted({1, min(n, 2)})]


def _spell(path) -> str:
    """The letters of a path: (path before, text) from its end, None at its start."""
    out = []
    while path is not None:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def decode(token: str, model: CharModel) -> str:
    """The likeliest word behind a disguised token, in time linear in its length."""
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for slot in _slots(token):
        nxt: dict[str, tuple[float, tuple | None]] = {}
        for two, (cost, path) in best.items():
            for text, price in slot:
                state, total = two, cost + price
                for c in text:
                    total += model.cost(state, c)
                    state = state[1] + c
                old = nxt.get(state)
                if (old is None or total < old[0]
                        or total == old[0] and _spell((path, text)) < _spell(old[1])):
                    nxt[state] = (total, (path, text))
        best = nxt
    return min((cost + model.cost(two, "$"), _spell(path)) for two, (cost, path) in best.items())[1]


def disguised(token: str) -> bool:
    if token.isalpha():
        return _RUN.search(token) is not None
    return (any(c in LOOKS_LIKE for c in token) and sum(map(str.isalpha, token)) >= 2
            or _RUN.search(token) is not None)


def tokens(text: str) -> list[str]:
    """Space-separated tokens in lower case, words spelled out sign by sign joined."""
    text = text.lower()
    found = text.split()
    found += [re.sub(r"[ ._-]", "", s) for s in _SPELLED.findall(text)]
    return found


class Restorer(dict):
    """Restored words of a token, worked out once."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= CACHE_ROWS:
            self.clear()
        self[token] = out = self.words(token)
        return out

    def words(self, token: str) -> tuple[str, ...]:
        plain = token.strip(MARKS)
        if plain.isalpha() and not _RUN.search(plain):  # most tokens
            return (plain,)
        core = _EDGE.sub("", token)
        if disguised(core):
            words = (decode(core, self.model), *_CORE.findall(core.rstrip("!|")))
        else:
            words = tuple(_CORE.findall(token))
        return tuple(w for w in words if w)


def features(words) -> set[str]:
    """Whole words and their beginnings."""
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def char_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): trigrams of the letters of all words of all documents."""
    @lean
    def count(batches):
        seen: Counter = Counter()  # tokens; what they hold is looked at once each

        def out():
            words: Counter = Counter()
            for t, n in seen.items():
                if t.isalpha():
                    words[t] += n
                elif not t.isalnum():
                    for w in _CORE.findall(t):
                        words[w] += n
            tri: Counter = Counter()
            for w, n in words.items():
                w = f"^^{w}$"
                for i in range(len(w) - 2):
                    tri[w[i:i + 3]] += n
            return pa.RecordBatch.from_arrays(
                [pa.array(list(tri), pa.string()), pa.array(list(tri.values()), pa.int64())],
                names=["gram", "n"])

        for batch in batches:
            for text in texts(batch):
                if text:
                    seen.update(text.lower().split())
                    if len(seen) > CACHE_ROWS:
                        yield out()
                        seen.clear()
        yield out()

    return (docs.select("text").mapInArrow(count, "gram string, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")))


class Model:
    def __init__(self, trigrams: dict[str, int], weights: dict[str, float], coef: np.ndarray):
        self.trigrams, self.weights, self.coef = trigrams, weights, coef


class Hits(dict):
    """Weighted features of a token, worked out once."""

    def __init__(self, restore: Restorer, weights: dict[str, float]):
        super().__init__()
        self.restore, self.weights = restore, weights

    def __missing__(self, token: str) -> dict[str, float]:
        if len(self) >= CACHE_ROWS:
            self.clear()
        words, weights = self.restore.words(token), self.weights
        out = {w: weights[w] for w in words if w in weights}
        for w in words:
            for n in STEMS:
                if len(w) <= n:
                    break
                stem = w[:n] + "*"
                if stem in weights:
                    out[stem] = weights[stem]
        self[token] = out = out or None
        return out


def evidence(weights) -> np.ndarray:
    """What the weights of a document's features say: best and second best, sum
    of the strong ones, their number, mean of all."""
    w = sorted(weights, reverse=True)
    if not w:
        return np.array([1.0, 0, 0, 0, 0, 0])
    strong = [x for x in w if x > 2.0]
    return np.array([1.0, w[0], w[1] if len(w) > 1 else 0.0, min(30.0, sum(strong)) / 10,
                     min(10, len(strong)) / 5, sum(w) / len(w)])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9),
                               x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
          fold: str | None = None) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``fold`` is a condition on doc_id for the rows to learn from.  Of rows that
    disagree on a document the toxic one counts; null labels or ids don't.
    Without labels of both classes every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    grams = stage(char_counts(docs), "trigrams")
    tri = dict(map(tuple, most_frequent(grams, "n", TRIGRAMS).select("gram", "n").collect()))
    known = labels.where("doc_id is not null and toxic is not null")
    if fold:
        known = known.where(fold)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = {}
    for y in (0, 1):
        for r in known.where((F.col("toxic") > 0) == F.lit(bool(y))).orderBy(order).limit(sample).select(
                "doc_id").collect():
            picked[r["doc_id"]] = y
    held = spark.sparkContext.broadcast((picked, tri))

    @lean
    def read(batches):
        y_of, grams = held.value
        restore = Restorer(CharModel(grams))
        for batch in batches:
            rows = []
            batch = batch.filter(pa.array(
                [doc in y_of for doc in batch.column("doc_id").to_pylist()], pa.bool_()))
            for doc, text in zip(batch.column("doc_id").to_pylist(),
                                 texts(batch), strict=True):
                words = {w for t in set(tokens(text or "")) for w in restore[t]}
                rows.append((doc, y_of[doc], sorted(features(words))))
            if rows:
                d, y, f = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(y, pa.int32()),
                     pa.array(f, pa.list_(pa.string()))], names=["doc_id", "toxic", "found"])

    seen = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, "doc_id long, toxic int, found array<string>"), "labelled")
    first = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    n = {r["toxic"]: r["n"] for r in seen.where(first).groupBy("toxic").agg(
        F.count("*").alias("n")).collect()}
    share = sum(picked.values()) / max(1, len(picked))
    if len(n) < 2:
        return Model(tri, {}, np.array([math.log((share + 1e-6) / (1 - share + 1e-6)), 0, 0, 0, 0, 0]))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1.0)) - F.log((F.col("c") + 0.5) / (n[0] + 1.0))
    weighed = stage(
        seen.where(first).select("toxic", F.explode("found").alias("f"))
        .groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .withColumn("n", F.col("t") + F.col("c")).where(F.col("n") >= MIN_DOCS)
        .select("f", "n", odds.alias("w")).where("abs(w) > 1"), "weights")
    weights = dict(map(tuple, most_frequent(weighed, "n", FEATURES).select("f", "w").collect()))
    held_w = spark.sparkContext.broadcast(weights)

    @lean
    def weigh(batches):
        known = held_w.value
        for batch in batches:
            x = [evidence([known[k] for k in f if k in known])
                 for f in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))],
                names=["toxic", "x"])

    fit = seen.where(~first).select("toxic", "found").mapInArrow(
        weigh, "toxic int, x array<double>").collect()
    if len({r["toxic"] for r in fit}) < 2:
        return Model(tri, {}, np.array([math.log((share + 1e-6) / (1 - share + 1e-6)), 0, 0, 0, 0, 0]))
    coef = _fit(np.array([r["x"] for r in fit]), np.array([float(r["toxic"]) for r in fit]))
    return Model(tri, weights, coef)


def _scorer(model: tuple):
    grams, weights, coef = model
    hits = Hits(Restorer(CharModel(grams)), weights)

    def one(text: str | None) -> float:
        found: dict[str, float] = {}
        for hit in filter(None, map(hits.__getitem__, set(tokens(text or "")))):
            found.update(hit)
        z = float(evidence(found.values()) @ coef)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return one


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text); null or empty
    texts get the score of a text without known words."""
    held = docs.sparkSession.sparkContext.broadcast((model.trigrams, model.weights, model.coef))

    @lean
    def run(batches):
        one = _scorer(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([one(t) for t in texts(batch)], pa.float64())],
                names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, with a score under ``most``."""
    held = docs.sparkSession.sparkContext.broadcast((model.trigrams, model.weights, model.coef))

    @lean
    def run(batches):
        one = _scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(
                [one(t) < most for t in texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
