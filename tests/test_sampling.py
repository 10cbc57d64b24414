"""Exact split / folds / oversampling: counts, determinism, completeness."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stormcell.operators import sampling


def _rows(spark, labels):
    return spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "id BIGINT, label INT")


def test_hash_rank_equals_global_row_number(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("label"))
    key = F.col("id").cast("string")
    got = sampling.hash_rank(df, "label", key, "rank")
    w = Window.partitionBy("label").orderBy(F.md5(key), key)
    want = df.withColumn("want", F.row_number().over(w))
    joined = got.join(want, ["id", "label"])
    assert joined.filter(F.col("rank") != F.col("want")).count() == 0
    assert joined.count() == 5000


def test_split_sizes_follow_published_support(spark):
    # class sizes of the reference data set -> published test support per class
    sizes = [740730, 168, 216, 1722, 11964, 2040]
    support = [148146, 34, 43, 344, 2393, 408]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "label INT, n BIGINT")
    got = df.select(F.floor(F.col("n") * F.lit(0.2) + F.lit(0.5)).alias("t")).collect()
    assert [r["t"] for r in got] == support
    assert sum(support) == 151368 and sum(sizes) - sum(support) == 605472


def test_oversample_plan_golden(spark):
    # train sizes = class sizes minus published test support; golden arithmetic:
    # max 592,584 -> target 474,067 -> 2,962,919 rows after oversampling
    train = [592584, 134, 173, 1378, 9571, 1632]
    sizes = spark.createDataFrame(list(enumerate(train)), "label INT, n BIGINT")
    plan = {r["label"]: r for r in sampling.plan_from_sizes(sizes, "label", 0.8).collect()}
    assert {r["target"] for r in plan.values()} == {474067}
    assert plan[0]["extra"] == 0
    assert sum(r["n"] + r["extra"] for r in plan.values()) == 2962919


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=0, max_value=3), min_size=5, max_size=120))
def test_split_is_exact_disjoint_and_complete(spark, labels):
    df = _rows(spark, labels)
    out = sampling.stratified_split(df, "label", F.col("id").cast("string"), 0.2).collect()
    assert sorted(r["id"] for r in out) == list(range(len(labels)))
    for lab in set(labels):
        n = labels.count(lab)
        n_test = sum(1 for r in out if r["label"] == lab and r["is_test"])
        assert n_test == int(n * 0.2 + 0.5)


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=0, max_value=3), min_size=5, max_size=150))
def test_oversample_counts_exact(spark, labels):
    df = _rows(spark, labels).withColumn("x", F.lit(1.0))
    mode = "random" if len(labels) % 2 else "even"
    out = sampling.oversample(df, "label", F.col("id").cast("string"), 0.8,
                              noise_cols=["x"], noise_sd=0.02, mode=mode, chunk=7)
    counts = {r["label"]: (r["n"], r["s"]) for r in out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_synthetic").cast("int")).alias("s")).collect()}
    target = int(max(labels.count(v) for v in set(labels)) * 0.8)
    for lab in set(labels):
        n = labels.count(lab)
        assert counts[lab][0] == max(n, target)
        assert counts[lab][1] == max(0, target - n)
    # originals are untouched, copies are spread evenly over the class
    assert out.filter(~F.col("is_synthetic") & (F.col("x") != 1.0)).count() == 0


def test_oversample_is_deterministic(spark):
    df = _rows(spark, [0] * 50 + [1] * 5).withColumn("x", F.lit(1.0))
    a = sampling.oversample(df, "label", F.col("id").cast("string"), 0.8, ["x"], 0.5)
    b = sampling.oversample(df.repartition(7), "label", F.col("id").cast("string"), 0.8, ["x"], 0.5)
    assert sorted(a.select("id", "x").collect()) == sorted(b.select("id", "x").collect())


def test_cv_folds_balanced(spark):
    df = _rows(spark, [0] * 23 + [1] * 11)
    out = sampling.cv_folds(df, "label", F.col("id").cast("string"), 5)
    sizes = {(r["label"], r["fold"]): r["n"] for r in
             out.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sorted(v for (lab, _f), v in sizes.items() if lab == 0) == [4, 4, 5, 5, 5]
    assert sorted(v for (lab, _f), v in sizes.items() if lab == 1) == [2, 2, 2, 2, 3]


def test_class_weights(spark):
    df = _rows(spark, [0] * 6 + [1] * 2)
    w = {r["label"]: r["weight"] for r in sampling.class_weights(df, "label").collect()}
    assert w[0] == 8 / (2 * 6) and w[1] == 8 / (2 * 2)


def test_random_oversample_draws_with_replacement(spark):
    df = _rows(spark, [0] * 100 + [1] * 10).withColumn("x", F.lit(1.0))
    out = sampling.oversample(df, "label", F.col("id").cast("string"), 0.8, mode="random",
                              seed=7, chunk=13)
    synth = out.filter(F.col("is_synthetic") & (F.col("label") == 1))
    assert synth.count() == 70
    per_row = [r["n"] for r in synth.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per_row) <= 10 and max(per_row) > min(per_row) or len(per_row) < 10
    again = sampling.oversample(df.repartition(3), "label", F.col("id").cast("string"), 0.8,
                                mode="random", seed=7, chunk=5)
    assert sorted(synth.select("id").collect()) == sorted(
        again.filter(F.col("is_synthetic") & (F.col("label") == 1)).select("id").collect())


def test_hot_class_ranked_in_small_partitions(spark):
    """A class holding ~99 % of the rows is ranked in (class, md5-bucket)
    partitions of a handful of rows each, and the ranks stay exact."""
    df = spark.range(20000).select(F.col("id"), F.when(F.col("id") < 19800, 0).otherwise(1)
                                   .cast("int").alias("label"))
    key = F.col("id").cast("string")
    bucket = F.conv(F.substring(F.md5(key), 1, 4), 16, 10)
    biggest = df.groupBy("label", bucket.alias("b")).count().agg(F.max("count")).first()[0]
    assert biggest <= 10
    ranked = sampling.hash_rank(df, "label", key, "rank", size_col="n")
    stats = {r["label"]: r for r in ranked.groupBy("label").agg(
        F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.countDistinct("rank").alias("d"), F.max("n").alias("n")).collect()}
    assert (stats[0]["lo"], stats[0]["hi"], stats[0]["d"], stats[0]["n"]) == (1, 19800, 19800, 19800)
    assert (stats[1]["lo"], stats[1]["hi"], stats[1]["d"]) == (1, 200, 200)


def test_even_copies_chunked_for_tiny_class(spark):
    """Copies of one row spread over chunks (and tasks) when a class is tiny."""
    df = _rows(spark, [0] * 400 + [1] * 3).withColumn("x", F.lit(1.0))
    out = sampling.oversample(df, "label", F.col("id").cast("string"), 0.8, chunk=10)
    synth = out.filter(F.col("is_synthetic"))
    assert synth.count() == 320 - 3
    per_row = sorted(r["n"] for r in synth.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect())
    assert per_row == [105, 106, 106]


def test_hash_rank_plan_is_bucketed(spark):
    """Ranks come from one exchange on (label, hash bucket) plus a broadcast
    join of the small offsets table -- never a window over a whole label."""
    df = _rows(spark, [0] * 50 + [1] * 5)
    plan = sampling.hash_rank(df, "label", F.col("id").cast("string"), "rank") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning(label" in plan and "_b" in plan.split("hashpartitioning(label")[1][:40]
