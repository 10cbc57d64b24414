"""Scores from the published 6x6 confusion matrix (golden evaluation)."""

import pytest

from stormcell.operators import scores

# Published test-set confusion matrix (rows = actual 0..5).
GOLDEN_CM = [[144035, 10, 12, 496, 3515, 78], [0, 34, 0, 0, 0, 0], [20, 0, 23, 0, 0, 0],
             [16, 0, 0, 323, 4, 1], [116, 0, 0, 7, 2269, 1], [5, 0, 0, 0, 3, 400]]
PRECISION = [0.9989111739902352, 0.7727272727272727, 0.6571428571428571, 0.3910411622276029,
             0.39181488516663787, 0.8333333333333334]
RECALL = [0.9722503476300406, 1.0, 0.5348837209302325, 0.938953488372093, 0.9481821980777267,
          0.9803921568627451]
F1 = [0.985400461110085, 0.8717948717948718, 0.5897435897435898, 0.5521367521367522,
      0.554496578690127, 0.9009009009009009]
SUPPORT = [148146, 34, 43, 344, 2393, 408]


@pytest.fixture(scope="module")
def conf(spark):
    rows = [(a, p, n) for a, row in enumerate(GOLDEN_CM) for p, n in enumerate(row)]
    return spark.createDataFrame(rows, "actual INT, predicted INT, n BIGINT")


def test_per_class(conf):
    got = {r["level"]: r for r in scores.per_class_scores(conf).collect()}
    for k in range(6):
        assert got[k]["precision"] == pytest.approx(PRECISION[k], abs=1e-12)
        assert got[k]["recall"] == pytest.approx(RECALL[k], abs=1e-12)
        assert got[k]["f1"] == pytest.approx(F1[k], abs=1e-12)
        assert got[k]["support"] == SUPPORT[k]


def test_aggregates(conf):
    r = scores.aggregate_scores(scores.per_class_scores(conf)).first()
    assert r["accuracy"] == pytest.approx(0.9716981132075472, abs=1e-15)
    assert r["precision_weighted"] == pytest.approx(0.9873378510127461, abs=1e-14)
    assert r["recall_weighted"] == pytest.approx(0.9716981132075472, abs=1e-14)
    assert r["f1_weighted"] == pytest.approx(0.9772379210581017, abs=1e-14)
    assert r["balanced_accuracy"] == pytest.approx(0.8957769853121397, abs=1e-14)
    assert r["precision_macro"] == pytest.approx(0.6741617807646566, abs=1e-14)
    assert r["recall_macro"] == pytest.approx(0.8957769853121397, abs=1e-14)
    assert r["f1_macro"] == pytest.approx(0.7424121923960545, abs=1e-14)


def test_rates_and_class_accuracy(conf):
    rates = {(r["actual"], r["predicted"]): r["rate"] for r in scores.confusion_rates(conf).collect()}
    assert rates[(1, 1)] == 1.0 and rates[(2, 0)] == pytest.approx(20 / 43)
    acc = {r["level"]: r["class_accuracy"] for r in scores.per_class_accuracy(conf).collect()}
    assert acc[5] == pytest.approx(400 / 408)


def test_dense_grid_and_zero_division(spark):
    pred = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "actual INT, predicted INT")
    conf = scores.confusion_counts(pred)
    assert conf.count() == 9  # labels {0, 1, 2} from both sides
    per = {r["level"]: r for r in scores.per_class_scores(conf).collect()}
    assert per[2]["support"] == 0 and per[2]["recall"] == 0.0 and per[2]["precision"] == 0.0
    agg = scores.aggregate_scores(scores.per_class_scores(conf)).first()
    assert agg["balanced_accuracy"] == pytest.approx((0.5 + 0.0) / 2)


def test_missing_labels_not_scored(spark):
    pred = spark.createDataFrame([(0, 0), (None, 1), (1, None), (1, 1)], "actual INT, predicted INT")
    conf = scores.confusion_counts(pred)
    assert conf.count() == 4 and conf.agg({"n": "sum"}).first()[0] == 2


def test_fold_summary_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "accuracy DOUBLE")
    r = scores.fold_summary(df).first()
    assert r["accuracy_mean"] == 2.0 and r["accuracy_std"] == pytest.approx((2 / 3) ** 0.5)
