"""A fitted forest as a table of its nodes, and what can be counted in it.

MLlib saves a forest as Parquet, a row per node; the table is read from there, so
nothing of a model passes through the driver and any forest is counted by one
aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import broadcast_checked
from ..session import scratch_path

ROUND = 1_000_000


def node_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(forest, tree, node, left, right, feature, threshold, gain, n): a row per node.

    Leaves have no feature and no children.  A one-vs-rest model has a forest per
    class, other models have one (0)."""
    last = model.stages[-1]
    forests = last.models if hasattr(last, "models") else [last]
    names = [c.replace("__z", "") for c in model.stages[1].getInputCols()]
    tables = []
    for i, forest in enumerate(forests):
        path = scratch_path(spark, "trees")
        forest.write().overwrite().save(path)
        tables.append(spark.read.parquet(f"{path}/data").select(
            F.lit(i).alias("forest"), F.col("treeID").alias("tree"), "nodeData.*"))
    nodes = reduce(DataFrame.unionByName, tables)
    features = spark.createDataFrame(list(enumerate(names)), "_index int, feature string")
    inner = F.col("leftChild") >= 0
    return (nodes.withColumn("_index", F.when(inner, F.col("split.featureIndex")))
            .join(F.broadcast(features), "_index", "left")
            .select("forest", "tree", F.col("id").alias("node"),
                    F.when(inner, F.col("leftChild")).alias("left"),
                    F.when(inner, F.col("rightChild")).alias("right"), "feature",
                    F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
                    F.when(inner, F.col("gain")).alias("gain"), F.col("rawCount").alias("n")))


def split_counts(nodes: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): the number of inner nodes that split on each feature,
    0 for those that no tree uses; equal counts are ranked by the features' order."""
    spark = nodes.sparkSession
    order = spark.createDataFrame(list(enumerate(features)), "_order int, feature string")
    found = nodes.where("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("importance"))
    return (order.join(broadcast_checked(found), "feature", "left")
            .select("feature", F.coalesce("importance", F.lit(0).cast("long")).alias("importance"), "_order")
            .orderBy(F.desc("importance"), "_order").drop("_order"))


def gain_totals(nodes: DataFrame) -> DataFrame:
    """(feature, gain): impurity decrease, weighted by the rows of each node, over all
    trees; sums of whole millionths, so that they do not depend on the order."""
    weighted = F.round(F.col("gain") * F.col("n") * ROUND).cast("decimal(38,0)")
    return nodes.where("feature IS NOT NULL").groupBy("feature").agg(
        (F.sum(weighted).cast("double") / ROUND).alias("gain"))
