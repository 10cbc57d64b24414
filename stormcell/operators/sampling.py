"""Exact, deterministic sampling: stratified split, CV folds, oversampling.

Each needs the rank of a row inside its class in a fixed pseudo-random order
(the md5 of a row key).  A window partitioned by class would send the whole
majority class -- 98 % of the rows here -- to one task.  ``hash_rank`` instead
counts rows per (class, hash bucket), turns the counts into offsets on that
small table, and ranks rows inside (class, bucket) partitions: 65,536 buckets
per class, each ranked in parallel, the result is the exact class-wide rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookups import broadcast_checked
from .ordering import running_total

_BUCKET_HEX = 4  # 16 bits of the hash select the bucket


def row_key(*cols) -> Column:
    """Stable text key of a row: fields joined by '|', timestamps as text."""
    parts = []
    for c in cols:
        col = F.col(c) if isinstance(c, str) else c
        parts.append(col.cast("string"))
    return F.concat_ws("|", *parts)


def hash_rank(df: DataFrame, group: str, key: Column | str, rank_col: str = "rank",
              size_col: str | None = None) -> DataFrame:
    """1-based rank of each row within ``group`` ordered by (md5(key), key).
    With ``size_col`` the group's row count is attached too (taken from the
    same bucket counts, no extra pass)."""
    k = F.col(key) if isinstance(key, str) else key
    with_h = (df.withColumn("_key", k)
              .withColumn("_h", F.md5(F.col("_key")))
              .withColumn("_b", F.conv(F.substring("_h", 1, _BUCKET_HEX), 16, 10).cast("int")))
    counts = with_h.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_b",
                            F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy(group)).alias("_gsize"))
    # the other columns settle rows with equal keys, so a task that is run
    # again ranks them alike
    rest = [c for c, t in df.dtypes if c != group and not t.startswith(("map", "variant"))]
    wr = Window.partitionBy(group, "_b").orderBy("_h", "_key", *rest)
    out = (with_h.join(broadcast_checked(offsets, materialize=True), [group, "_b"])
           .withColumn(rank_col, F.col("_off") + F.row_number().over(wr)))
    if size_col:
        out = out.withColumnRenamed("_gsize", size_col)
    return out.drop("_h", "_b", "_off", "_key", "_gsize")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_class"))


def stratified_split(df: DataFrame, label: str, key: Column | str,
                     test_fraction: float = 0.2) -> DataFrame:
    """Adds ``is_test``: in every class exactly round-half-up(fraction * n) rows,
    the first ones in md5 order."""
    ranked = hash_rank(df, label, key, "_rank", size_col="_n_class")
    n_test = F.floor(F.col("_n_class") * F.lit(float(test_fraction)) + F.lit(0.5))
    return (ranked.withColumn("is_test", F.col("_rank") <= n_test)
            .drop("_rank", "_n_class"))


def time_split(df: DataFrame, date_col: str = "date", test_fraction: float = 0.2) -> DataFrame:
    """Adds ``is_test`` for the latest rows in time: test starts at the first
    timestamp whose cumulative row count exceeds the train share (whole
    timestamps, so every series is cut at the same instant; no neighbour of a
    test hour leaks into training as in a random split).

    The cumulative count runs over the distinct timestamps (a histogram made
    with a partial aggregate), not over the rows."""
    hist = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_total(hist, [date_col], F.col("_c"), "_cum")
    total = cum.agg(F.max("_cum")).first()[0] or 0
    n_train = total - math.floor(total * float(test_fraction) + 0.5)
    # the cut-off is a fitted scalar (one aggregate job)
    cutoff = cum.filter(F.col("_cum") > n_train).agg(F.min(date_col)).first()[0]
    if cutoff is None:
        return df.withColumn("is_test", F.lit(False))
    lit = (F.to_timestamp_ntz(F.lit(cutoff.isoformat(sep=" ")))
           if isinstance(df.schema[date_col].dataType, T.TimestampNTZType) else F.lit(cutoff))
    return df.withColumn("is_test", F.coalesce(F.col(date_col) >= lit, F.lit(False)))


def cv_folds(df: DataFrame, label: str, key: Column | str, k: int = 5,
             rank_col: str | None = None) -> DataFrame:
    """Adds ``fold`` in 0..k-1, stratified: (class rank - 1) mod k.  With
    ``rank_col`` the class rank stays, under that name."""
    ranked = hash_rank(df, label, key, "_rank")
    out = ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int"))
    return out.withColumnRenamed("_rank", rank_col) if rank_col else out.drop("_rank")


def rank_without_fold(rank_col: str, k: int, fold: int) -> Column:
    """Class rank among the rows outside ``fold``, from the rank among all: of the
    ranks before a row every k-th is gone, so no row is ranked again."""
    return F.col(rank_col) - F.floor((F.col(rank_col) - 2 - fold + k) / F.lit(k)).cast("long")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = N / (K * n_class) over the classes present (small table)."""
    sizes = class_sizes(df, label)
    # sizes has one row per class: the global window runs over K rows
    w = Window.partitionBy()
    return sizes.select(
        F.col(label),
        F.col("_n_class").alias("n"),
        (F.sum("_n_class").over(w).cast("double")
         / (F.count(F.lit(1)).over(w) * F.col("_n_class")).cast("double")).alias("weight"))


def hash_normal(*cols) -> Column:
    """Standard normal draw from a hash of ``cols`` (Box-Muller): the same value
    whenever a task is re-run, unlike ``randn`` after a shuffle."""
    two53 = float(2 ** 53)
    mask = F.lit(2 ** 53 - 1)
    u1 = (F.xxhash64(*cols, F.lit(1)).bitwiseAND(mask).cast("double") + 1.0) / (two53 + 1.0)
    u2 = F.xxhash64(*cols, F.lit(2)).bitwiseAND(mask).cast("double") / two53
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def oversample_plan(df: DataFrame, label: str, ratio: float = 0.8) -> DataFrame:
    """Per class: n, target T = floor(ratio * max n), copies to add (0 when n >= T)."""
    return plan_from_sizes(class_sizes(df, label).withColumnRenamed("_n_class", "n"),
                           label, ratio)


def plan_from_sizes(sizes: DataFrame, label: str, ratio: float = 0.8) -> DataFrame:
    """The same plan from a (label, n) table of class sizes (one row per class)."""
    w = Window.partitionBy()
    target = F.floor(F.max("n").over(w) * F.lit(float(ratio)))
    return (sizes.withColumn("target", target)
            .withColumn("extra", F.when(F.col("n") < F.col("target"),
                                        F.col("target") - F.col("n")).otherwise(0))
            .select(label, "n", "target", "extra"))


def _draw_copies(small: DataFrame, label: str, seed: int, chunk: int) -> DataFrame:
    """``extra`` draws per class of a class rank in 1..n, uniform with
    replacement.  Draws are generated in chunks of ``chunk`` so no single task
    creates all copies of a large class; each draw is a seeded hash of
    (class, copy index), so a re-run task draws the same ranks."""
    chunks = (small.select(label, "n", "extra", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil(F.col("extra") / F.lit(chunk)).cast("long") - 1))
        .alias("_chunk"))
        .repartition(label, "_chunk"))
    draws = chunks.select(label, "n", F.explode(F.sequence(
        F.col("_chunk") * chunk + 1,
        F.least((F.col("_chunk") + 1) * chunk, F.col("extra").cast("long")))).alias("_copy"))
    rank = F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col("_copy")), F.col("n")) + 1
    return draws.select(label, F.col("_copy"), rank.alias("_rank"))


def oversample(df: DataFrame, label: str, key: Column | str, ratio: float = 0.8,
               noise_cols=(), noise_sd: float | dict = 0.02, mode: str = "even",
               seed: int = 42, chunk: int = 1_000_000,
               rank: Column | None = None) -> DataFrame:
    """Grow every class smaller than floor(ratio * largest class) to exactly that
    size; larger classes are untouched.

    ``mode="even"`` spreads the copies evenly: the row of class rank r gets
    floor(extra / n) + (r <= extra mod n) copies.  ``mode="random"`` draws the
    copied rows uniformly with replacement (seeded, see ``_draw_copies``).
    Copies carry ``is_synthetic = true`` and Gaussian noise on ``noise_cols``
    (``noise_sd`` is one deviation for all, or a dict per column).  ``rank`` is
    the rows' class rank in the order of ``key`` where it is known; then even
    copies are made where their row lies, without a shuffle.
    """
    plan = oversample_plan(df, label, ratio)
    small = plan.filter(F.col("extra") > 0).select(label, "n", "extra")
    base = df.withColumn("is_synthetic", F.lit(False))
    # one row per class: checked (labels are not assumed to be few) and
    # materialised once, it feeds both the semi-join and the join below
    small = broadcast_checked(small, materialize=True)
    # only minority rows are ranked; the (large) majority classes pass through
    minority = df.join(small.select(label), label, "left_semi")
    ranked = (hash_rank(minority, label, key, "_rank") if rank is None
              else minority.withColumn("_rank", rank))
    k = F.col(key) if isinstance(key, str) else key
    if mode == "even":
        ranked = ranked.join(small, label)
        copies_n = (F.floor(F.col("extra") / F.col("n"))
                    + (F.col("_rank") <= F.col("extra") % F.col("n")).cast("long"))
        per_row = ranked.withColumn("_copies", copies_n).filter(F.col("_copies") > 0)
        # the plan table has one row per class and is already materialised
        most = max((-(-r["extra"] // r["n"]) for r in small.collect()), default=0)
        if most > chunk:
            # a tiny class under a huge target: split each row's copies into
            # chunks spread over tasks before generating them
            per_row = (per_row.withColumn("_chunk", F.explode(F.sequence(
                F.lit(0).cast("long"),
                F.ceil(F.col("_copies") / F.lit(chunk)).cast("long") - 1)))
                .repartition(label, "_rank", "_chunk"))
            lo = F.col("_chunk") * chunk + 1
            hi = F.least((F.col("_chunk") + 1) * chunk, F.col("_copies"))
        else:
            lo, hi = F.lit(1), F.col("_copies")
        copies = (per_row.withColumn("_copy", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
                  .drop("n", "extra", "_copies", "_chunk"))
    elif mode == "random":
        copies = ranked.join(_draw_copies(small, label, seed, chunk), [label, "_rank"])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    sd = noise_sd if isinstance(noise_sd, dict) else {c: noise_sd for c in noise_cols}
    noisy = {c: F.col(c) + F.lit(float(sd[c])) * hash_normal(k, F.col("_copy"), F.lit(c))
             for c in noise_cols}
    synth = (copies.withColumns(noisy)
             .drop("_rank", "_copy")
             .withColumn("is_synthetic", F.lit(True)))
    return base.unionByName(synth.select(*base.columns))
