"""Split counts of a forest's nodes, also of the published importances' kind."""

import duckdb
import pytest

from stormcell import queries as Q
from stormcell.plans import training, trees
from stormcell.schema import FEATURES
from stormcell.session import scratch_path
from tests.conftest import SF001


@pytest.fixture(scope="module")
def fitted(spark):
    model, split, *_ = Q._model(spark, SF001)
    return model, split


def test_counts_add_up_to_the_inner_nodes_and_sql_agrees(spark, fitted):
    model, _ = fitted
    nodes = trees.node_table(spark, model)
    counts = trees.split_counts(nodes, FEATURES).collect()
    assert sorted(r["feature"] for r in counts) == sorted(FEATURES)
    forest = model.stages[-1]
    inner = sum(int(t.numNodes) - (int(t.numNodes) + 1) // 2 for t in forest.trees)
    assert sum(r["importance"] for r in counts) == inner > 0
    assert [r["importance"] for r in counts] == sorted((r["importance"] for r in counts), reverse=True)
    path = scratch_path(spark, "nodes")
    nodes.write.parquet(path)
    sql = duckdb.execute(f"""SELECT feature, count(*) FROM read_parquet('{path.replace("file:", "")}/*.parquet')
                             WHERE "left" IS NOT NULL GROUP BY 1""").fetchall()
    assert {f: n for f, n in sql} == {r["feature"]: r["importance"] for r in counts if r["importance"]}
    # a binary tree: every inner node has both children, every node but the root one parent
    n = nodes.count()
    assert nodes.where("(left IS NULL) <> (right IS NULL)").count() == 0
    assert n - 2 * inner == len(forest.trees)


def test_gains_rank_like_the_impurity_importances(spark, fitted):
    model, _ = fitted
    gains = {r["feature"]: r["gain"] for r in trees.gain_totals(trees.node_table(spark, model)).collect()}
    top = max(gains, key=gains.get)
    impurity = {r["feature"]: r["importance"] for r in training.feature_importances(spark, model).collect()}
    assert top in sorted(impurity, key=impurity.get)[-3:]


def test_boosted_models_have_a_forest_per_class(spark, fitted):
    _, split = fitted
    cfg = training.TrainConfig(model="boosted", boost_iters=2, max_depth=3)
    model = training.fit(split.filter("NOT is_test"), cfg)
    nodes = trees.node_table(spark, model)
    n = nodes.select("forest").distinct().count()
    assert n == len(model.stages[-1].models) >= 2
    assert nodes.groupBy("forest", "tree").count().count() == 2 * n
    assert trees.split_counts(nodes, FEATURES).count() == len(FEATURES)
