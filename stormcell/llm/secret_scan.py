"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Patterns give the base spans (``assign``, ``access``, ``hex``).  Every other run
of ``LEAST`` or more signs of base64, base64url or a smaller alphabet is a
candidate.  Its encoding is the smallest alphabet that holds all its signs, and
it is tested against two hypotheses:

* *drawn evenly from its alphabet*: chi-squared of the sign counts, runs above
  and below the middle of the alphabet, serial correlation of neighbours,
  combined by Fisher's method.  A candidate that is rejected is no key.
* *ordinary text of the same length*: signs that follow one another as in the
  words of all documents.  How many times likelier the candidate is when drawn
  evenly bounds the p-value (Markov's inequality), whatever its length.  These
  p-values decide with a false-discovery rate (Benjamini-Hochberg) inside each
  encoding and length class: a short candidate has to stand out more, and many
  short ones don't use up the rate of the long ones.

Built from DataFrame functions only.  Texts are read where they lie; positions
and candidates shuffle by row, distinct candidates by value, distinct words by
word.  Of the corpus only the counts of sign pairs (at most 66 x 66) and the
histogram of p-values (encodings x length classes x ``BINS``) reach the driver.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, stage, with_uid

LEAST = 16
RANDOM_LEVEL = 0.001    # a key is wrongly rejected so often
ARBITRARY = 0.05        # share of signs that ordinary text sets at will
FALSE_DISCOVERY = 0.01  # share of ordinary candidates among those added
BINS = 600              # of -log10 p, in steps of 1/20: up to 1e-30

ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
#: A run's first sign takes in the whole run, so the least length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
KINDS = ["assign", "access", "hex", "random"]
BASE = KINDS[:3]

_UP, _LOW, _DIG = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: name, signs, alphabet; the first whose signs hold all of a candidate.
ENCODINGS = [
    ("decimal", "0-9", _DIG), ("hex", "0-9a-f", _DIG + _LOW[:6]), ("HEX", "0-9A-F", _DIG + _UP[:6]),
    ("lower", "a-z", _LOW), ("upper", "A-Z", _UP), ("base32", "A-Z2-7", _UP + _DIG[2:8]),
    ("base36", "0-9a-z", _DIG + _LOW), ("BASE36", "0-9A-Z", _DIG + _UP),
    ("letters", "A-Za-z", _UP + _LOW), ("base62", "0-9A-Za-z", _DIG + _UP + _LOW),
    ("base64", "0-9A-Za-z+/", _DIG + _UP + _LOW + "+/"),
    ("base64url", "0-9A-Za-z_-", _DIG + _UP + _LOW + "-_"),
]
#: All signs of candidates.
SIGNS = _DIG + _UP + _LOW + "+/-_"


def _matches(kind: str, pattern: str, ok) -> Column:
    """Array of (kind, gap, length, value): each match with the code points between
    the end of the one before and its start.  Matches that fail ``ok`` keep their
    place, with a null kind."""
    gaps = F.transform(F.split("text", pattern, -1), F.length)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    if kind == "assign":
        found = F.arrays_zip(found.alias("m"), F.regexp_extract_all(
            "text", F.lit(pattern), F.lit(2)).alias("v"))
    else:
        found = F.transform(found, lambda m: F.struct(m.alias("m"), m.alias("v")))
    zipped = F.zip_with(gaps, found, lambda g, m: F.struct(
        F.lit(kind).alias("scan"), F.when(ok(m["v"]), F.lit(kind)).alias("kind"),
        g.alias("gap"), F.length(m["m"]).alias("length"), m["v"].alias("value")))
    return F.slice(zipped, F.lit(1), F.size(found))  # one more gap than matches


def matches(documents: DataFrame) -> DataFrame:
    """(_uid, doc_id, kind, start, end, value): base spans and candidates with their
    places in code points; a row with nulls for a document without any."""
    rows = with_uid(documents.select(
        F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    yes = lambda v: F.lit(True)
    found = F.concat(_matches("assign", ASSIGN, lambda v: F.length(v) >= 12),
                     _matches("access", ACCESS, yes), _matches("hex", HEX, yes),
                     _matches("random", CANDIDATE, yes))
    rows = (rows.select(UID, "doc_id", F.posexplode_outer(found).alias("pos", "m"))
            .select(UID, "doc_id", "pos", "m.*"))
    upto = Window.partitionBy(UID, "scan").orderBy("pos")  # the matches of one text
    return (rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto))
            .where(F.col("kind").isNotNull() | F.col("scan").isNull() | (F.col("scan") == "assign"))
            .select(UID, "doc_id", "kind", (F.col("end") - F.col("length")).alias("start"), "end",
                    F.when(F.col("kind").isNotNull(), F.col("value")).alias("value")))


def pair_counts(documents: DataFrame) -> list[tuple[str, str, int]]:
    """How often one sign follows another inside the words (shorter than a
    candidate) of all documents; the next sign of a word's last one is empty."""
    word = F.explode(F.split("text", "[^0-9A-Za-z+/_-]+"))
    words = (documents.select(F.col("text").cast("string").alias("text")).select(word.alias("w"))
             .where(F.length("w").between(1, LEAST - 1)).groupBy("w").agg(F.count("*").alias("n")))
    at = F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i")
    pairs = (words.select("w", "n", at)
             .groupBy(F.col("w").substr(F.col("i"), F.lit(1)).alias("a"),
                      F.col("w").substr(F.col("i") + 1, F.lit(1)).alias("b"))
             .agg(F.sum("n").alias("n")))
    return [(r["a"], r["b"], r["n"]) for r in pairs.collect()]


def ordinary(pairs: list[tuple[str, str, int]]) -> list[float]:
    """-ln of the chance of a sign after another one inside a word, for all pairs of
    ``SIGNS`` (first sign times their number, plus the second).  One sign in
    1 / ``ARBITRARY`` is taken for drawn evenly, so that no single pair, seen or
    not, says much."""
    size = len(SIGNS)
    rank = {s: i for i, s in enumerate(SIGNS)}
    count = [[0] * size for _ in SIGNS]
    for a, b, n in pairs:
        if a in rank and b in rank:
            count[rank[a]][rank[b]] += n
    return [-math.log(ARBITRARY / size + (1 - ARBITRARY) * (n / sum(row) if n else 0))
            for row in count for n in row]


def _choose(values: dict) -> Column:
    """A constant for each encoding."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs)[F.col("encoding")]


def _numbers(values: list[float]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _tail(z: Column) -> Column:
    """P(|normal| >= z) for z >= 0 (rational approximation of the error function)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (
        -1.821255978 + t * 1.330274429))))
    return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), 2 * 0.3989422804 * F.exp(-z * z / 2) * poly))


def _fisher(*ps: Column) -> Column:
    """Chance of p-values whose product is as small as this one's."""
    half = -reduce(lambda a, b: a + b, [F.log(p) for p in ps])
    term = total = F.lit(1.0)
    for i in range(1, len(ps)):
        term = term * half / i
        total = total + term
    return F.least(F.lit(1.0), F.exp(-half) * total)


def tested(values: DataFrame, null: list[float]) -> DataFrame:
    """``values`` (value) with encoding, n, random_p and text_p.  Values that no
    alphabet holds (both kinds of base64 mixed) have a null encoding and are left
    out."""
    enc = F.coalesce(*[F.when(F.col("value").rlike(f"^[{signs}]+$"), F.lit(name))
                       for name, signs, _ in ENCODINGS])
    rows = values.withColumn("encoding", enc).where("encoding is not null")
    rows = rows.withColumn("n", F.length("value").cast("double")).withColumn(
        "k", _choose({e: float(len(a)) for e, _, a in ENCODINGS}))
    rows = rows.withColumn("_sign", F.split("value", "")).withColumn(
        "_alphabet", _choose({e: a for e, _, a in ENCODINGS}))
    # ranks, centred on the alphabet's middle: never zero, as all alphabets are even
    rows = rows.withColumn("_r", F.transform("_sign", lambda s: (
        F.position(s, F.col("_alphabet")) - (F.col("k") + 1) / 2)))
    count = F.transform(F.array_distinct("_sign"), lambda s: F.col("n") - F.length(
        F.replace(F.col("value"), s, F.lit(""))))
    zero = F.lit(0.0)
    after = F.expr("slice(_r, 2, size(_r) - 1)")
    before = F.expr("slice(_r, 1, size(_r) - 1)")
    rows = (rows.withColumn("_c2", F.aggregate(count, zero, lambda t, c: t + c * c))
            .withColumn("_cross", F.aggregate(F.zip_with(before, after, lambda a, b: F.when(
                a * b < 0, 1.0).otherwise(0.0)), zero, lambda t, x: t + x))
            .withColumn("_lag", F.aggregate(F.zip_with(before, after, lambda a, b: a * b), zero,
                                            lambda t, x: t + x)))
    n, k, d = F.col("n"), F.col("k"), F.col("k") - 1
    chi = k / n * F.col("_c2") - n
    z_chi = (F.cbrt(chi / d) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
    z_runs = (2 * F.col("_cross") - (n - 1)) / F.sqrt(n - 1)
    z_lag = F.col("_lag") / ((k * k - 1) / 12) / F.sqrt(n - 1)
    even = F.when(z_chi > 0, _tail(F.abs(z_chi))).otherwise(1.0)
    rows = rows.withColumn("random_p", _fisher(even, _tail(F.abs(z_runs)), _tail(F.abs(z_lag))))
    at = F.transform("_sign", lambda s: F.position(s, F.lit(SIGNS)) - 1)
    rows = rows.withColumn("_at", at)
    costs = F.zip_with(F.expr("slice(_at, 1, size(_at) - 1)"), F.expr("slice(_at, 2, size(_at) - 1)"),
                       lambda a, b: F.get(_numbers(null), a * len(SIGNS) + b))
    gain = F.aggregate(costs, zero, lambda t, c: t + c) - (n - 1) * F.log(k)
    text_p = F.exp(-F.greatest(zero, F.least(F.lit(690.0), gain)))
    return rows.withColumn("text_p", text_p).select(
        *values.columns, "encoding", "n", "random_p", "text_p")


def discoveries(values: DataFrame, rate: float) -> DataFrame:
    """The rows of ``values`` (encoding, n, text_p, ...) that Benjamini-Hochberg
    accepts inside their encoding and length class (half powers of two).

    p-values are rounded up to steps of 1/20 in log10, so that a histogram tells
    where the accepted ones end: what is accepted has at most ``rate``."""
    size = F.floor(2 * F.log2("n")).cast("int")
    step = F.least(F.lit(BINS), F.floor(-20 * F.log10(F.greatest(F.lit(1e-300), F.col("text_p"))))
                   .cast("int"))
    rows = values.withColumn("_size", size).withColumn("_step", F.greatest(F.lit(0), step))
    found: dict[tuple, list] = {}
    for r in rows.groupBy("encoding", "_size", "_step").count().collect():
        found.setdefault((r["encoding"], r["_size"]), []).append((r["_step"], r["count"]))
    keep = F.lit(False)
    for (encoding, at), steps in sorted(found.items()):
        total, seen, least = sum(n for _, n in steps), 0, None
        for s, n in sorted(steps, reverse=True):
            seen += n
            if 10 ** (-s / 20) * total <= rate * seen:
                least = s
        if least is not None:
            keep = keep | ((F.col("encoding") == encoding) & (F.col("_size") == at)
                           & (F.col("_step") >= least))
    return rows.where(keep).drop("_size", "_step")


def find(documents: DataFrame, random_level: float = RANDOM_LEVEL,
         false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """(doc_id, spans): a row per row of ``documents``, with its array of
    (start, order, kind, end, value, encoding, random_p, text_p), sorted by start and kind.

    Null and empty texts have no spans, repeated rows have theirs each, columns
    other than doc_id and text are not looked at; an empty table gives no rows.
    An added span (``random``) that lies within a base span is left out.
    """
    found = stage(matches(documents), "secret-spans")
    values = found.where("kind = 'random'").select("value").distinct()
    tests = stage(tested(values, ordinary(pair_counts(documents))), "secret-tests")
    keys = discoveries(tests.where(F.col("random_p") >= random_level), false_discovery).select(
        F.col("value").alias("_value"), "encoding", "random_p", "text_p")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # null values (failed matches, documents without spans) never find a partner
    rows = (found.join(keys, (F.col("kind") == "random") & (F.col("value") == F.col("_value")), "left")
            .withColumn("order", order))
    inside = Window.partitionBy(UID).orderBy(F.col("start"), F.col("order")).rowsBetween(
        Window.unboundedPreceding, 0)
    rows = rows.withColumn("_base", F.max(F.when(F.col("order") <= len(BASE), F.col("end"))).over(inside))
    good = F.col("kind").isin(BASE) | (F.col("_value").isNotNull() & (
        F.col("_base").isNull() | (F.col("end") > F.col("_base"))))
    span = F.struct("start", "order", "kind", "end", "value", "encoding", "random_p", "text_p")
    return (rows.groupBy(UID, "doc_id").agg(F.sort_array(F.collect_list(F.when(good, span)))
                                            .alias("spans")).drop(UID))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``find``'s rows."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["order"] <= len(BASE))
    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"),
                        text("spans").alias("spans"))
