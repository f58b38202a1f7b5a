"""A trained model set with its data: models, rows with their split, JSON metadata."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import sort_by_depth

REQUIRED = ("feature_cols", "labels")


@dataclass(frozen=True)
class Bundle:
    models: dict
    dataset: DataFrame
    meta: dict

    def xy(self, label: str, split: str) -> DataFrame:
        """Predictors and positive response of one label for one split."""
        if label not in self.meta["labels"]:
            raise KeyError(f"no label {label!r} in the bundle")
        rows = self.dataset.where((F.col("split") == split) & (F.col(label) > 0))
        return rows.select(*self.meta["feature_cols"], F.col(label).alias("y"))


def save_bundle(models: dict, dataset: DataFrame, feature_cols: list[str], path: str, **meta) -> None:
    """One Spark ML model per label, the dataset with its ``split`` column, and metadata."""
    if "split" not in dataset.columns:
        raise ValueError("the dataset has no split column")
    labels = sort_by_depth(list(models))
    for label in labels:
        models[label].write().overwrite().save(f"{path}/models/{label}")
    dataset.write.mode("overwrite").parquet(f"{path}/dataset")
    info = {"feature_cols": list(feature_cols), "labels": labels, **meta}
    spark = dataset.sparkSession
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    lines = spark.read.text(f"{path}/meta").limit(2).collect()
    if not lines:
        raise ValueError("the bundle has no metadata")
    meta = json.loads(lines[0]["value"])
    absent = [k for k in REQUIRED if not meta.get(k)]
    if absent:
        raise ValueError(f"the bundle metadata lacks {absent}")
    dataset = spark.read.parquet(f"{path}/dataset")
    lacking = [c for c in [*meta["feature_cols"], *meta["labels"], "split"] if c not in dataset.columns]
    if lacking:
        raise ValueError(f"the bundle dataset lacks {lacking}")
    models = {label: GBTRegressionModel.load(f"{path}/models/{label}") for label in meta["labels"]}
    return Bundle(models, dataset, meta)
