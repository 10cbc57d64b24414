"""Classification scores from (actual, predicted) pairs.

The row-level work is one ``groupBy(actual, predicted).count()``; everything
after that runs on the K x K confusion table.  Sums over classes are taken in
class order (``aggregate`` over a sorted array), so results do not depend on
the order partial sums arrive in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(pred: DataFrame, actual: str = "actual",
                     predicted: str = "predicted") -> DataFrame:
    """Dense confusion table over the sorted union of labels seen on either side
    (pairs with a missing label on either side are not scored)."""
    pred = pred.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    counts = (pred.groupBy(F.col(actual).cast("int").alias("actual"),
                           F.col(predicted).cast("int").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))
    # one row holding the (small) label set; two explodes make the K x K grid
    labels = counts.select(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
        F.array("actual", "predicted"))))).alias("labels"))
    grid = (labels.select(F.explode("labels").alias("actual"), "labels")
            .select("actual", F.explode("labels").alias("predicted")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long")))


def per_class_scores(conf: DataFrame) -> DataFrame:
    """precision, recall, F1 (zero when undefined) and support per class."""
    by_class = conf.groupBy(F.col("actual").alias("level")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    pred_tot = conf.groupBy(F.col("predicted").alias("level")).agg(F.sum("n").alias("n_pred"))
    t = by_class.join(pred_tot, "level")
    return t.select(
        "level",
        F.when(F.col("n_pred") > 0, F.col("tp").cast("double") / F.col("n_pred").cast("double"))
         .otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp").cast("double") / F.col("support").cast("double"))
         .otherwise(0.0).alias("recall"),
        F.when(F.col("support") + F.col("n_pred") > 0,
               (2 * F.col("tp")).cast("double") / (F.col("support") + F.col("n_pred")).cast("double"))
         .otherwise(0.0).alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.col("tp").cast("long").alias("tp"),
        F.col("n_pred").cast("long").alias("n_pred"),
    )


def _ordered_sum(values_sorted_by_level):
    return F.aggregate(values_sorted_by_level, F.lit(0.0), lambda acc, x: acc + x)


def aggregate_scores(per_class: DataFrame) -> DataFrame:
    """Accuracy; support-weighted and macro precision/recall/F1; balanced accuracy
    (mean recall over classes that occur)."""
    s = per_class.agg(F.array_sort(F.collect_list(F.struct(
        "level", "precision", "recall", "f1", "support", "tp"))).alias("c"))
    n = F.aggregate(F.transform("c", lambda x: x["support"]), F.lit(0).cast("long"),
                    lambda a, x: a + x).cast("double")
    tp = F.aggregate(F.transform("c", lambda x: x["tp"]), F.lit(0).cast("long"),
                     lambda a, x: a + x).cast("double")
    k = F.size("c").cast("double")

    def weighted(field):
        return _ordered_sum(F.transform("c", lambda x: x[field] * x["support"].cast("double"))) / n

    def macro(field):
        return _ordered_sum(F.transform("c", lambda x: x[field])) / k

    present = F.filter("c", lambda x: x["support"] > 0)
    return s.select(
        (tp / n).alias("accuracy"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        macro("precision").alias("precision_macro"),
        macro("recall").alias("recall_macro"),
        macro("f1").alias("f1_macro"),
        (_ordered_sum(F.transform(present, lambda x: x["recall"]))
         / F.size(present).cast("double")).alias("balanced_accuracy"),
    )


def confusion_rates(conf: DataFrame) -> DataFrame:
    """Row-normalised confusion table; rows with no samples give 0."""
    row_total = F.sum("n").over(Window.partitionBy("actual"))
    return conf.withColumn(
        "rate", F.when(row_total > 0, F.col("n").cast("double") / row_total.cast("double"))
        .otherwise(0.0))


def per_class_accuracy(conf: DataFrame) -> DataFrame:
    """Diagonal share of each actual class; null when the class has no samples."""
    t = conf.groupBy("actual").agg(
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("correct"),
        F.sum("n").alias("total"))
    return t.select(F.col("actual").alias("level"), "correct", "total",
                    F.when(F.col("total") > 0, F.col("correct") / F.col("total"))
                    .alias("class_accuracy"))


def with_fold_summary(scores: DataFrame, col: str = "accuracy") -> DataFrame:
    """Each fold's score next to the mean and population std over the folds
    (a window over the k fold rows)."""
    w = Window.partitionBy()
    return scores.withColumns({f"{col}_mean": F.avg(col).over(w),
                               f"{col}_std": F.stddev_pop(col).over(w)})


def fold_summary(scores: DataFrame, col: str = "accuracy") -> DataFrame:
    """Mean and population standard deviation of per-fold scores."""
    return scores.agg(F.avg(col).alias(f"{col}_mean"), F.stddev_pop(col).alias(f"{col}_std"))
