"""Model path on the smallest data set: train, evaluate, score, persist."""

import pytest
from pyspark.sql import functions as F

from stormcell import queries as Q
from stormcell.operators import sampling
from stormcell.plans import features as feat
from stormcell.plans import serving, training
from stormcell.schema import FEATURES
from stormcell.sources import dims
from stormcell.sources.fixture import city_dim_from_sites, load_obs, read_table
from tests.conftest import SF001


@pytest.fixture(scope="module")
def obs(spark):
    return load_obs(spark, SF001)


def test_training_features_shape(obs):
    f = feat.training_features(obs)
    assert f.columns == ["city", "date", *FEATURES, "suspension"]
    assert f.count() == obs.count()
    assert f.filter(F.col("temp_lag_1h").isNull() | F.col("precip_roll_3h").isNull()).count() == 0


def test_train_eval_and_scoring(spark):
    per_class = Q.q_train_eval(spark, SF001).collect()
    assert per_class and all(0.0 <= r["f1"] <= 1.0 for r in per_class)
    top = Q.q_top_features(spark, SF001).collect()
    assert len(top) == 10 and top[0]["importance"] >= top[-1]["importance"]
    days = Q.q_score_city_days(spark, SF001)
    r = days.first()
    assert len(r["probabilities_5"]) == 5
    assert r["confidence"] == pytest.approx(max(r["probabilities"]))
    served = Q.q_score_serving_days(spark, SF001)
    assert served.count() == days.count()


def test_artifacts_roundtrip(spark):
    rows = Q.q_artifacts_roundtrip(spark, SF001).collect()
    assert {"level", "precision", "recall", "f1", "support"} <= set(rows[0].asDict())


def test_parity_config_turns_on_both_corrections():
    cfg = training.TrainConfig.parity()
    assert cfg.use_class_weights and cfg.use_oversampling
    assert not training.TrainConfig().use_class_weights


def test_bulletin_written_by_day(spark, obs, tmp_path):
    cities = city_dim_from_sites(read_table(spark, SF001, "events"), read_table(spark, SF001, "nation"))
    b = serving.advisory_bulletin(obs, dims.level_dim(spark), cities)
    path = str(tmp_path / "bulletin")
    serving.write_bulletin(b, path)
    back = spark.read.parquet(path)
    one_day = back.filter(F.col("day") == F.lit("2024-01-02").cast("date"))
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert back.count() == b.count()
    assert back.filter("lat IS NULL OR lon IS NULL").count() == 0


def test_request_answers_routes_history_and_forecast(spark, obs):
    ans = Q.q_request_answers(spark, SF001)
    modes = {r["mode"]: r["n"] for r in ans.groupBy("mode").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_days = obs.select("city", F.to_date("date")).distinct().count()
    assert modes["historical"] >= n_days and modes["forecast"] > 0
    fc = ans.filter(F.col("mode") == "forecast")
    assert fc.filter(F.col("level").isNull()).count() == 0


def test_latest_forecast_takes_last_issue(spark):
    import datetime as dtm
    rows = [("A", dtm.datetime(2025, 1, 1, 0), 1.0, 2.0, 3.0, 4.0, 5.0, 1),
            ("A", dtm.datetime(2025, 1, 1, 0), 9.0, 9.0, 9.0, 9.0, 9.0, 2)]
    df = spark.createDataFrame(rows, "city STRING, date TIMESTAMP_NTZ, relativehumidity_2m DOUBLE, "
                               "temperature_2m DOUBLE, precipitation DOUBLE, "
                               "apparent_temperature DOUBLE, windspeed_10m DOUBLE, issued_at INT")
    r = serving.latest_forecast(df).first()
    assert r["precipitation"] == 9.0 and r["issued_at"] == 2


def test_boosted_one_vs_rest_option(spark, obs):
    from stormcell.plans import scoring
    feats = feat.training_features(obs)
    split = training.split(feats)
    cfg = training.TrainConfig(model="boosted", boost_iters=3, max_depth=3)
    model = training.fit(split.filter(~F.col("is_test")), cfg)
    pred = training.predict(model, split.filter(F.col("is_test"))).select("predicted", "probabilities").collect()
    assert pred and all(abs(sum(r["probabilities"]) - 1.0) < 1e-9 for r in pred)
    assert all(r["probabilities"].index(max(r["probabilities"])) == r["predicted"] for r in pred)
    imp = training.feature_importances(spark, model).collect()
    assert len(imp) == len(FEATURES)
    days = scoring.score_city_days(model, split.drop("is_test"))
    assert days.count() > 0


def test_leak_free_features_use_train_medians(spark, obs):
    from stormcell.operators.impute import fit_medians
    lf = training.leak_free_features(obs)
    parity = training.split(feat.training_features(obs))
    a = lf.select("city", "date", "is_test")
    b = parity.select("city", "date", "is_test")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    train_med = fit_medians(obs.join(lf.filter(~F.col("is_test")).select("city", "date"),
                                     ["city", "date"]))
    filled = obs.filter(F.col("temperature_2m").isNull()).select("city", "date") \
        .join(lf, ["city", "date"]).select("temperature_2m").distinct().collect()
    assert [r[0] for r in filled] in ([], [train_med["temperature_2m"]])


def test_scenario_scores(spark, obs):
    out = Q.q_scenario_scores(spark, SF001)
    n_days = obs.select("city", F.to_date("date")).distinct().count()
    n = len(serving.scenario_combinations(
        Q.SCENARIO_TEMP, Q.SCENARIO_PRECIP, Q.SCENARIO_WIND, Q.SCENARIO_HUMIDITY,
        Q.SCENARIO_HOURS, Q.SCENARIO_DAYS))
    assert out.count() == n * n_days
    bad = out.filter((F.col("final_level") < F.col("rule_level")) |
                     (F.col("final_level") < F.col("model_level")))
    assert bad.count() == 0


def test_serving_feature_rows_on_short_days(spark):
    from stormcell.plans import scoring
    from tests.conftest import obs_frame
    rows = [("A", "2024-01-06 09", 60.0, 30.0, 4.0, 33.0, 20.0, 0),          # one-hour day
            ("B", "2024-01-01 07", 50.0, 20.0, 1.0, 21.0, 10.0, 1),          # three hours
            ("B", "2024-01-01 08", 70.0, 22.0, 2.0, 23.0, 30.0, 1),
            ("B", "2024-01-01 09", None, 24.0, 3.0, 25.0, 50.0, 1)]
    obs = obs_frame(spark, rows)
    med = {"relativehumidity_2m": 55.0, "temperature_2m": 22.0,
           "apparent_temperature": 23.0, "windspeed_10m": 20.0}
    out = {r["city"]: r for r in scoring.serving_feature_rows(
        obs, feat.city_codes(obs), med).collect()}
    a, b = out["A"], out["B"]
    assert [c for c in a.asDict() if c in FEATURES] == FEATURES
    # one hour: head means are the values, lags fall back to 0 / the day's temperature
    assert a["precip_roll_12h"] == 4.0 and a["precip_lag_1h"] == 0.0 and a["temp_lag_3h"] == 30.0
    assert (a["hour"], a["day_of_week"], a["is_weekend"], a["is_rush_hour"]) == (9.0, 5.0, 1.0, 1.0)
    # three hours: daily mean / total, first-hour calendar, tail values
    assert b["precipitation"] == 6.0 and b["temperature_2m"] == 22.0
    assert b["relativehumidity_2m"] == 60.0 and b["hour"] == 7.0
    assert b["precip_roll_3h"] == 2.0 and b["precip_lag_1h"] == 3.0 and b["temp_lag_2h"] == 22.0
    assert b["temp_lag_3h"] == 22.0  # 3 >= n: the day's mean temperature
    assert b["is_precip_peak"] == 1.0  # daily total 6 > 1.5 x head mean 2
    assert (a["city_encoded"], b["city_encoded"]) == (0.0, 1.0)


def test_a_new_city_shifts_no_code_and_loses_no_row(spark):
    import pytest

    from stormcell.plans import features as feat
    from tests.conftest import obs_frame
    rows = [(c, f"2024-01-01 {h:02d}", 50.0, 25.0, 1.0, 27.0, 10.0, 0)
            for c in ("B", "C") for h in range(3)]
    codes = feat.city_codes(obs_frame(spark, rows))
    later = obs_frame(spark, rows + [("A", "2024-01-01 00", 50.0, 25.0, 1.0, 27.0, 10.0, 0)])
    enc = feat.encode_city(later, codes)
    assert {(r["city"], r["city_encoded"]) for r in enc.collect()} == {("A", -1), ("B", 0), ("C", 1)}
    assert enc.count() == 7
    assert [tuple(r) for r in feat.unseen_cities(later, codes).collect()] == [("A", 1)]
    with pytest.raises(ValueError, match="A"):
        feat.encode_city(later, codes, policy="error")
    back = feat.decode_city(enc.drop("city"), codes)
    assert {(r["city_encoded"], r["city"]) for r in back.collect()} == {(-1, None), (0, "B"), (1, "C")}


def test_saved_model_carries_codes_and_medians(spark):
    from stormcell.plans import scoring, training
    from stormcell.session import scratch_path
    from stormcell.sources.fixture import city_dim_from_sites, load_obs, read_table
    obs = load_obs(spark, "/root/testdata/sf0.001")
    small = training.TrainConfig(num_trees=2, max_depth=2)
    tag = scratch_path(spark, "tag")
    a = scoring.fitted_model(spark, obs, tag, small)
    b = scoring.fitted_model(spark, obs, tag, training.TrainConfig(num_trees=3, max_depth=2))
    assert a.model.stages[-1].getNumTrees != b.model.stages[-1].getNumTrees
    model, codes, medians = scoring.load_fitted(spark, scoring.model_path(spark, tag, small))
    assert medians == a.medians and sorted(codes.collect()) == sorted(a.codes.collect())
    scoring._FITTED.clear()  # as in a new session that finds the artefact
    grown = obs.union(obs.limit(1).selectExpr("'AAA' AS city", *obs.columns[1:]))
    c = scoring.fitted_model(spark, grown, tag, small)
    assert sorted(c.codes.collect()) == sorted(a.codes.collect()) and c.medians == a.medians
    assert c.split.count() == obs.count() + 1


def test_running_total_and_rank(spark):
    from pyspark.sql import functions as F

    from stormcell.operators.ordering import rank, running_total
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k")).repartition(7)
    got = running_total(df, ["k"], F.col("k"), "t").orderBy("k").collect()
    assert [r["t"] for r in got] == [k * (k + 1) // 2 for k in range(1000)]
    assert {(r["k"], r["rank"]) for r in rank(df, [F.desc("k")]).collect()} == {
        (k, 1000 - k) for k in range(1000)}


def test_training_rows_are_dealt_evenly(spark, obs):
    cfg = training.TrainConfig()
    train = training.split(feat.training_features(obs), cfg).filter(~F.col("is_test")).coalesce(1)
    params = training.scaling.fit_scaler(train, training.SCALED_COLS)
    rows = training.training_rows(train, params, cfg)
    n = rows.count()
    assert training.training_size(train, cfg) == n
    cores = spark.sparkContext.defaultParallelism
    task_rows = n // (3 * cores)
    out = training.dealt(rows, n, task_rows)
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) <= 1.2 * task_rows + 20
    columns = [F.xxhash64(*rows.columns)]
    total = F.bit_xor(*columns), F.count("*")
    assert out.agg(*total).first() == rows.agg(*total).first()
    assert training.dealt(rows, n) is rows
    even = training.TrainConfig(use_oversampling=False)
    assert training.training_size(train, even) == train.count()


def test_folds_make_their_training_rows_without_ranking_them_again(spark, obs, monkeypatch):
    cfg = training.TrainConfig(num_trees=2, max_depth=2)
    train = training.split(feat.training_features(obs), cfg).filter(~F.col("is_test")).drop("is_test")
    key, k = training.row_key_col(), 3
    # rows that come twice share a key and a place in the order
    folded = training.checkpoint(sampling.cv_folds(train.union(train.limit(50)), "suspension", key, k,
                                                   rank_col="class_rank"))
    params = training.scaling.fit_scaler(train, training.SCALED_COLS)
    total = F.bit_xor(F.xxhash64("suspension", "weight", "is_synthetic", "city", "date", *FEATURES)), F.count("*")
    for f in range(k):
        rest = folded.filter(F.col("fold") != f)
        again = sampling.hash_rank(rest.drop("class_rank"), "suspension", key, "want")
        got = rest.withColumn("want", sampling.rank_without_fold("class_rank", k, f))
        cols = ["suspension", "want", "city", "date"]
        assert sorted(got.select(cols).collect()) == sorted(again.select(cols).collect())
        rows = training.training_rows(rest, params, cfg, sampling.rank_without_fold("class_rank", k, f))
        assert rows.agg(*total).first() == training.training_rows(rest, params, cfg).agg(*total).first()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    calls, plain = [], sampling.hash_rank
    monkeypatch.setattr(sampling, "hash_rank", lambda *a, **kw: calls.append(1) or plain(*a, **kw))
    got = {r["fold"]: r["accuracy"] for r in training.cross_validate(train, k, cfg).collect()}
    assert len(calls) == 1 and sorted(got) == [0, 1, 2]
    parted = sampling.cv_folds(train, "suspension", key, k)
    for f in range(k):
        model = training.fit(parted.filter(F.col("fold") != f), cfg)
        conf = training.evaluate(model, parted.filter(F.col("fold") == f))
        assert got[f] == conf["aggregate"].first()["accuracy"]


def test_rows_dealt_by_rank_give_even_training_rows(spark):
    cfg = training.TrainConfig()
    train = spark.range(18000).select(
        F.concat(F.lit("c"), F.col("id") % 7).alias("city"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id))").alias("date"),
        F.expr("CASE WHEN id < 9000 THEN 0 WHEN id < 15000 THEN 1 ELSE 2 END").alias("suspension"),
        *[(F.col("id") % 97).cast("double").alias(c) for c in FEATURES])
    ranked = sampling.cv_folds(train, "suspension", training.row_key_col(), rank_col="class_rank")
    size, task_rows = training.training_size(train, cfg), 2000
    assert size == 9000 + 2 * 7200 and training.copies_stay_even(train, cfg, task_rows)
    out = training.checkpoint(training.dealt_by_rank(ranked, size, task_rows))
    parts = out.rdd.getNumPartitions()
    assert parts == -(-size // task_rows)
    rows = training.training_rows(out, training.scaling.fit_scaler(train, training.SCALED_COLS), cfg,
                                  F.col("class_rank"))
    per_part = rows.groupBy((F.spark_partition_id() % parts).alias("part")).count().collect()
    assert sum(r["count"] for r in per_part) == size
    assert max(r["count"] for r in per_part) <= 1.2 * task_rows
    assert training.dealt_by_rank(ranked, size) is ranked
    # a single row with many copies is dealt after they are made
    few = spark.createDataFrame([(0,)] * 100 + [(1,)], "suspension INT")
    assert training.copies_stay_even(few, cfg) and not training.copies_stay_even(few, cfg, 1000)
    assert not training.copies_stay_even(few, training.TrainConfig.parity())


def test_large_fits_run_one_at_a_time():
    assert training.fits_at_once(5, 1000, 8) == training.PARALLEL_FITS
    assert training.fits_at_once(2, 1000, 8) == 2
    assert training.fits_at_once(5, 100 * training.TASK_ROWS, 8) == 1
