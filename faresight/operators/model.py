"""Fare model (I1-I8, F2, F3): split, trees, cross-validation, metrics,
batch prediction, with ``pyspark.ml``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faresight.schema import FEATURE_COLUMNS
from faresight.session import materialize

KEY_COLUMNS = ["create_at", "flight_number", "type_of_plane", "departure_airport",
               "arrival_airport", "flight_date", "departure_time", "arrival_time",
               "classes", "price"]


def split_key(cols=KEY_COLUMNS) -> Column:
    """md5 of the row's values: a split that is stable under repartition
    and recomputation (``randomSplit`` is not)."""
    def txt(c):
        col = F.col(c)
        v = (F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSS")
             if c in ("create_at", "flight_date") else col.cast("string"))
        return F.coalesce(v, F.lit(""))
    return F.md5(F.concat_ws("|", *[txt(c) for c in cols]))


def _bucket(n: int) -> Column:
    return F.conv(F.substring(split_key(), 1, 8), 16, 10).cast("bigint") % n


def train_test_flag(df: DataFrame, train_tenths: int = 8) -> DataFrame:
    """80/20 split by hash."""
    return df.withColumn("is_train", _bucket(10) < train_tenths)


def fold_column(df: DataFrame, name: str = "fold_hash") -> DataFrame:
    """The row hash that folds are taken from (I6), whatever their number."""
    return df.withColumn(name, F.conv(F.substring(split_key(), 9, 8), 16, 10).cast("bigint"))


def fold_of(fold_hash: str, folds: int) -> Column:
    """Stable fold number 0..folds-1 of a row hash."""
    return (F.col(fold_hash) % folds).cast("int")


def feature_matrix(df: DataFrame, features=FEATURE_COLUMNS, label: str = "price",
                   keep=()) -> DataFrame:
    """Assemble the ordered features into one vector plus a double label."""
    from pyspark.ml.feature import VectorAssembler
    present = [c for c in features if c in df.columns]
    casted = df.select(*[F.col(c).cast("double").alias(c) for c in present],
                       F.col(label).cast("double").alias("label"), *keep)
    return VectorAssembler(inputCols=present, outputCol="features",
                           handleInvalid="error").transform(casted)


# --- fixed values (the reference's model settings) ------------------------
RF_PARAMS = dict(numTrees=200, maxDepth=20, minInstancesPerNode=2,
                 featureSubsetStrategy="sqrt", seed=42)
GBT_PARAMS = dict(maxIter=200, stepSize=0.1, maxDepth=8, minInstancesPerNode=2,
                  subsamplingRate=0.9, seed=42)
DT_PARAMS = dict(maxDepth=20, minInstancesPerNode=2, seed=42)
# Split points a feature: the largest vocabulary (flight numbers) keeps one
# for each code; Spark's default of 32 would merge most of them.
MAX_BINS = 1024
MODEL_ORDER = ["Random Forest", "Gradient Boosting", "Decision Tree"]
# ---------------------------------------------------------------------------


# Speed settings only (they do not change the fitted model): deep trees
# keep each row's node id cached instead of re-walking the tree per level,
# with the cache checkpointed to the shared folder every 10 iterations.
TREE_SPEED = dict(cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=256)


def make_estimator(kind: str, **overrides):
    """Random forest (I3), gradient boosting (I4) or one tree."""
    # Boosted trees are shallow: walking them again costs less than the cache.
    cache = {"cacheNodeIds": kind != "Gradient Boosting"}
    overrides = {"maxBins": MAX_BINS, **TREE_SPEED, **cache, **overrides}
    from pyspark.ml.regression import GBTRegressor

    from faresight.operators.tree_fit import GrownForest, GrownTree
    if kind == "Random Forest":
        return GrownForest(**{**RF_PARAMS, **overrides})
    if kind == "Gradient Boosting":
        return GBTRegressor(**{**GBT_PARAMS, **overrides})
    if kind == "Decision Tree":
        return GrownTree(**{**DT_PARAMS, **overrides})
    raise ValueError(kind)


#: Trees of a forest that are grown together, and nodes of which the driver
#: holds some models of trees at once (see ``forest_parts``).
FOREST_PART, PART_NODES = 20, 1 << 18


def forest_parts(train: DataFrame, part: int = FOREST_PART, **overrides):
    """The random forest (I3) as (first tree's number, model) of at most ``part``
    trees each, one after the other. A forest's trees are independent, so the
    parts together are the forest. Trees are grown ``part`` at a time, their nodes
    stay with the executors; the driver holds the models of trees of some
    ``PART_NODES`` nodes at a time: 20 trees of depth 20 are more than a small
    heap takes (``operators.trees`` joins the parts)."""
    trees = overrides.pop("numTrees", RF_PARAMS["numTrees"])
    seed = overrides.pop("seed", RF_PARAMS["seed"])
    for first in range(0, trees, part):
        est = make_estimator("Random Forest", numTrees=min(part, trees - first), seed=seed + first, **overrides)
        for model in est.fit_parts(train, PART_NODES):
            yield first, model
            first += len(model.trees)
            train.sparkSession._jvm.System.gc()          # models and what was broadcast of them go before the next ones come


def regression_metrics(pred: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE, R² in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    m = pred.agg(F.avg(F.abs(y - p)).alias("mae"),
                 F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
                 F.sum((y - p) * (y - p)).alias("__sse"),
                 F.avg(y).alias("__mean"), F.count(y).alias("__n"),
                 F.sum(y * y).alias("__syy"))
    sst = F.col("__syy") - F.col("__n") * F.col("__mean") * F.col("__mean")
    return m.select("mae", "rmse", (1 - F.col("__sse") / sst).alias("r2"))


def cross_validate(train: DataFrame, estimator, folds: int = 5,
                   parallelism: int | None = None) -> tuple[float, float]:
    """Mean and population std of MAE over stable hash folds."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    ev = RegressionEvaluator(metricName="mae", labelCol="label",
                             predictionCol="prediction")
    cv = CrossValidator(estimator=estimator,
                        estimatorParamMaps=ParamGridBuilder().build(),
                        evaluator=ev, numFolds=folds, foldCol="fold",
                        collectSubModels=False, parallelism=parallelism or folds)
    model = cv.fit(train.withColumn("fold", fold_of("fold_hash", folds)))
    mean = float(model.avgMetrics[0])
    # PySpark reports the population std over folds (numpy, ddof=0), the
    # same as the reference's ``cv_scores.std()``.
    std = float(model.stdMetrics[0]) if model.stdMetrics else 0.0
    return mean, std


@dataclass
class ModelRun:
    name: str
    model: object
    metrics: dict = field(default_factory=dict)


def evaluate_models(matrix: DataFrame, kinds=tuple(MODEL_ORDER), folds: int = 5,
                    overrides: dict | None = None) -> tuple[DataFrame, list[ModelRun]]:
    """Train each model on the 80 % part, cross-validate, score both parts;
    one metrics row per model (I3-I7). ``matrix`` needs ``is_train`` and
    ``fold_hash`` columns besides features and label."""
    spark = matrix.sparkSession
    train = matrix.where("is_train")
    test = matrix.where("NOT is_train")
    runs, rows = [], []
    for order, kind in enumerate(kinds):
        est = make_estimator(kind, **(overrides or {}).get(kind, {}))
        cv_mean, cv_std = (cross_validate(train, est, folds) if folds and folds > 1
                           else (float("nan"), float("nan")))
        model = est.fit(train)
        tr = regression_metrics(model.transform(train)).first()
        te = regression_metrics(model.transform(test)).first()
        ratio = tr["mae"] / te["mae"] if te["mae"] else float("inf")
        m = dict(model=kind, ord=order, cv_mae_mean=cv_mean, cv_mae_std=cv_std,
                 train_mae=tr["mae"], test_mae=te["mae"], train_rmse=tr["rmse"],
                 test_rmse=te["rmse"], train_r2=tr["r2"], test_r2=te["r2"],
                 overfitting_ratio=ratio)
        runs.append(ModelRun(kind, model, m))
        rows.append(m)
    return spark.createDataFrame(rows), runs


def train_best(matrix: DataFrame, kinds=tuple(MODEL_ORDER), folds: int = 5,
               overrides: dict | None = None, features=FEATURE_COLUMNS
               ) -> tuple[ModelRun, DataFrame, DataFrame]:
    """Train and compare, pick the lowest CV error, and give that model, all
    metrics and the chosen model's importances; ``model_store.save_model``
    keeps it (I3-I7, F2, F3). The matrix is written once: every fit and
    score reads it."""
    matrix = materialize(matrix, "feature_matrix")
    metrics, runs = evaluate_models(matrix, kinds, folds, overrides)
    chosen = best_model(metrics).first()["model"]
    run = next(r for r in runs if r.name == chosen)
    return run, metrics, feature_importances(matrix.sparkSession, run.model, features)


def best_model(metrics: DataFrame) -> DataFrame:
    """Lowest CV MAE; the first listed model wins ties."""
    return metrics.orderBy(F.asc("cv_mae_mean"), F.asc("ord")).limit(1)


def feature_importances(spark, model, features=FEATURE_COLUMNS) -> DataFrame:
    """(feature, importance) of a tree model."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])),
                                 "feature string, importance double")


def top_importances(importances: DataFrame, k: int = 10) -> DataFrame:
    """Features by importance, largest first, top ``k`` (F2)."""
    return importances.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def score_by_model(model, features=FEATURE_COLUMNS):
    """Scorer (rows -> rows with ``raw_prediction``) of a fitted model."""
    from pyspark.ml.feature import VectorAssembler

    def scorer(rows: DataFrame) -> DataFrame:
        present = [c for c in features if c in rows.columns]
        x = rows.withColumns({c: F.col(c).cast("double") for c in present})
        x = VectorAssembler(inputCols=present, outputCol="features").transform(x)
        return model.transform(x).withColumnRenamed("prediction", "raw_prediction")
    return scorer


def score_by_nodes(nodes: DataFrame, trees: int, depth: int, key: str, features=FEATURE_COLUMNS, boosted: bool = False):
    """Scorer of a node table (``operators.trees``). ``key`` names a column
    that tells rows apart."""
    from faresight.operators import trees as tr

    def scorer(rows: DataFrame) -> DataFrame:
        rows = materialize(rows, "score_rows")          # read twice: to walk, and to join the scores back
        x = rows.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
        got = tr.score(tr.walk(x, nodes, trees, depth), key, boosted)
        return rows.join(got.withColumnRenamed("prediction", "raw_prediction"), key)
    return scorer


def route_means(train: DataFrame, keys=("departure_airport", "arrival_airport"), label: str = "price") -> DataFrame:
    """Stored statistics of the baseline: the mean label of each route, and
    in a row with ``overall`` set that of all rows."""
    y = F.col(label).cast("double")
    got = train.groupingSets([list(keys), []], *keys).agg(
        F.avg(y).alias("mean"), F.count(y).alias("n"), (F.grouping_id() > 0).alias("overall"))
    return got.where("overall OR n > 0").drop("n")


def score_by_means(means: DataFrame, keys=("departure_airport", "arrival_airport")):
    """Scorer of ``route_means``: the route's mean; where the route is
    unknown or a key is missing, that of all rows."""
    from faresight.operators.joins import cross_one_row, lookup_join

    def scorer(rows: DataFrame) -> DataFrame:
        overall = means.where("overall").agg(F.max("mean").alias("__all"))
        own = means.where("NOT overall").select(*keys, F.col("mean").alias("__own"))
        out = cross_one_row(lookup_join(rows, own, list(keys)), overall)
        return out.withColumn("raw_prediction", F.coalesce("__own", "__all")).drop("__own", "__all")
    return scorer


def predict(scorer, rows: DataFrame, price_stats: DataFrame | None) -> DataFrame:
    """Score rows by any scorer, then clip by the training price stats
    (I8 + G20); without them nothing is clipped."""
    from faresight.functions.text import clip_price
    from faresight.operators.joins import cross_one_row
    out = scorer(rows)
    if price_stats is None:
        return out.withColumn("prediction", F.col("raw_prediction"))
    s = price_stats.agg(F.min("min").alias("__mn"), F.max("max").alias("__mx"))      # one row, whatever is stored
    out = cross_one_row(out, s)
    return (out.withColumn("prediction", clip_price("raw_prediction", "__mn", "__mx"))
            .drop("__mn", "__mx"))


def batch_predict(model, rows_features: DataFrame, price_stats: DataFrame | None,
                  features=FEATURE_COLUMNS) -> DataFrame:
    """Score prepared prediction rows with a fitted model and clip
    (I8 + G20). ``rows_features`` comes from ``prediction_features``."""
    return predict(score_by_model(model, features), rows_features, price_stats)


def out_of_fold_means(train: DataFrame, keys=("departure_airport", "arrival_airport"), fold: str = "fold",
                      label: str = "price") -> DataFrame:
    """``train`` with ``prediction``: the mean label of the row's route over
    the other folds, from the route's sums less the fold's own (I6); where the
    other folds lack the route, the mean of all their rows. One aggregation
    by route and fold serves every fold; the rest works on its table."""
    from pyspark.sql import Window

    from faresight.operators.joins import lookup_join
    y, own_keys = F.col(label).cast("double"), [f"__{k}" for k in keys]
    held = train.withColumns({f"__{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})      # a missing key: no route
    own = materialize(held.groupBy(*own_keys, fold).agg(F.count(y).alias("n"), F.sum(y).alias("s")), "fold_sums")
    by_fold = own.groupBy(fold).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = by_fold.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    rest = by_fold.crossJoin(F.broadcast(every)).select(                                  # one row a fold
        fold, ((F.col("all_s") - F.col("s")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))).alias("__rest"))
    route = Window.partitionBy(*own_keys)                                                 # a route's folds
    others = F.nullif(F.sum("n").over(route) - F.col("n"), F.lit(0))
    means = own.select(*own_keys, fold, ((F.sum("s").over(route) - F.col("s")) / others).alias("__mean"))
    out = lookup_join(held, means, [*own_keys, fold]).join(F.broadcast(rest), fold)
    return out.withColumn("prediction", F.coalesce("__mean", "__rest")).drop("__mean", "__rest", *own_keys)


def fold_errors(scored: DataFrame, fold: str = "fold", label: str = "price") -> DataFrame:
    """(fold, rows, mae, mean, std): the error of each fold, their mean and
    population std (I6)."""
    from faresight.operators.joins import cross_one_row
    per = scored.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"),
                                   F.avg(F.abs(F.col(label).cast("double") - F.col("prediction"))).alias("mae"))
    return cross_one_row(per, per.agg(F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("std")))
