"""Sinks for evaluation artefacts: small JSON documents and tidy parquet tables.

Every sink writes through Spark (``_SUCCESS`` marks completion); nothing is
collected to the driver to be written.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_doc(df: DataFrame, path: str) -> None:
    """One small result table as JSON lines in a single file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_metrics(out_dir: str, *, aggregate: DataFrame, per_class: DataFrame,
                  confusion: DataFrame, importances: DataFrame | None = None,
                  thresholds: DataFrame | None = None, summary: DataFrame | None = None) -> None:
    """Evaluation metrics (aggregate + per class), confusion matrix as a long
    table, feature importances, per-level thresholds and the training summary."""
    write_json_doc(aggregate, os.path.join(out_dir, "metrics_aggregate"))
    write_json_doc(per_class.orderBy("level"), os.path.join(out_dir, "metrics_per_class"))
    write_table(confusion, os.path.join(out_dir, "confusion_matrix"))
    if importances is not None:
        write_json_doc(importances.orderBy(F.desc("importance")),
                       os.path.join(out_dir, "feature_importance"))
    if thresholds is not None:
        write_json_doc(thresholds.orderBy("level"), os.path.join(out_dir, "thresholds"))
    if summary is not None:
        write_json_doc(summary, os.path.join(out_dir, "training_summary"))
