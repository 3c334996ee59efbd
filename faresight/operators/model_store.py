"""Model store (A9): the fitted model plus its side tables (encoders,
price stats, popularity stats, metadata) under one folder."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faresight.schema import DEFAULT_AIRLINE_POPULARITY, DEFAULT_ROUTE_POPULARITY

_MODEL_CLASSES = {
    "Random Forest": "pyspark.ml.regression.RandomForestRegressionModel",
    "Gradient Boosting": "pyspark.ml.regression.GBTRegressionModel",
    "Decision Tree": "pyspark.ml.regression.DecisionTreeRegressionModel",
}


@dataclass
class StoredModel:
    model: object
    model_type: str
    feature_columns: list
    encoders: DataFrame
    price_stats: DataFrame | None
    popularity: DataFrame


def save_model(path: str, model, model_type: str, feature_columns: list,
               encoders: DataFrame, price_stats: DataFrame | None,
               popularity: DataFrame | None) -> None:
    """Write model and side tables; replaces an earlier save."""
    spark = encoders.sparkSession
    model.write().overwrite().save(os.path.join(path, "model"))
    encoders.write.mode("overwrite").parquet(os.path.join(path, "encoders"))
    if price_stats is not None:
        price_stats.write.mode("overwrite").parquet(os.path.join(path, "price_stats"))
    if popularity is not None:
        popularity.write.mode("overwrite").parquet(os.path.join(path, "popularity"))
    meta = {"model_type": model_type, "feature_columns": feature_columns}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode(
        "overwrite").json(os.path.join(path, "meta"))


def _exists(spark: SparkSession, p: str) -> bool:
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(p)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hp)


def load_model(spark: SparkSession, path: str) -> StoredModel:
    """Read a saved model; missing popularity statistics get the
    reference's defaults (route 100/50, airline 50/25)."""
    import importlib
    meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
    mod, cls = _MODEL_CLASSES[meta["model_type"]].rsplit(".", 1)
    model = getattr(importlib.import_module(mod), cls).load(os.path.join(path, "model"))
    enc = spark.read.parquet(os.path.join(path, "encoders"))
    ps_path = os.path.join(path, "price_stats")
    ps = spark.read.parquet(ps_path) if _exists(spark, ps_path) else None
    pop_path = os.path.join(path, "popularity")
    defaults = spark.createDataFrame(
        [(DEFAULT_ROUTE_POPULARITY["mean"], DEFAULT_ROUTE_POPULARITY["std"],
          DEFAULT_AIRLINE_POPULARITY["mean"], DEFAULT_AIRLINE_POPULARITY["std"])],
        "d_route_mean double, d_route_std double, d_airline_mean double, d_airline_std double")
    if _exists(spark, pop_path):
        names = ("route_mean", "route_std", "airline_mean", "airline_std")
        stored = spark.read.parquet(pop_path).agg(*[F.max(c).alias(c) for c in names])      # one row, whatever is stored
        pop = stored.crossJoin(defaults).select(
            *[F.coalesce(F.col(c), F.col("d_" + c)).alias(c) for c in names])
    else:
        pop = defaults.select(*[F.col("d_" + c).alias(c) for c in
                                ("route_mean", "route_std", "airline_mean", "airline_std")])
    return StoredModel(model, meta["model_type"], meta["feature_columns"], enc, ps, pop)
