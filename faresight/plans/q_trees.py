"""Registered queries: models as node tables, out-of-fold means,
predictions by stored statistics (I3-I6, I8, F2)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.operators import model as md
from faresight.operators import trees as tr
from faresight.operators.features import FeatureResult, prediction_features
from faresight.plans import fixtures as fx
from faresight.plans.common import R4, cleaned, r4
from faresight.plans.oracle import with_ctes
from faresight.plans.q_clean import _KEY_SQL
from faresight.plans.q_model import _FOLD, _matrix
from faresight.plans.registry import query
from faresight.schema import FEATURE_COLUMNS
from faresight.session import materialize

_TRAIN = f"CAST(('0x' || substr({_KEY_SQL}, 1, 8)) AS BIGINT) % 10 < 8"
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS) + " AND price IS NOT NULL"
# Of the ensembles the queries fit a part: whole fits take many minutes even on
# the small tables (README). Depth and all other settings are the reference's.
SIZES = {"Random Forest": {"numTrees": 20}, "Gradient Boosting": {"maxIter": 60}, "Decision Tree": {}}
_FITS: dict[tuple, _Fit] = {}
_MODELS: dict[tuple, object] = {}


@dataclass
class _Fit:
    """One fit: the matrix with row and x, what the model itself
    predicts for it, its importances, and its written node table."""
    matrix: DataFrame
    theirs: DataFrame
    importances: DataFrame
    nodes: DataFrame
    trees: int
    depth: int
    features: FeatureResult


def _fitted(spark, sf_dir, kind) -> _Fit:
    """One fit a session and table, shared by the queries that read it. The
    forest comes in parts, one model on the driver at a time."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key in _FITS:
        return _FITS[key]
    from pyspark.ml.functions import vector_to_array
    mx, fr = _matrix(spark, sf_dir)
    mx = materialize(mx.withColumns({"row": F.monotonically_increasing_id(), "x": vector_to_array("features")}), "rows")
    train = mx.where("is_train")
    size = SIZES[kind]
    parts = md.forest_parts(train, **size) if kind == "Random Forest" else [(0, md.make_estimator(kind, **size).fit(train))]
    nodes, theirs, imp, trees, depth = [], [], [], 0, 0
    for first, model in parts:
        own = getattr(model, "trees", [model])
        nodes.append(tr.node_table(spark, model).withColumn("tree", F.col("tree") + first))
        theirs.append(materialize(model.transform(mx).select("row", "prediction", F.lit(len(own)).alias("n")), "predictions"))
        imp.append(md.feature_importances(spark, model).withColumn("n", F.lit(len(own))))
        trees, depth = trees + len(own), max(depth, *(t.depth for t in own))

    def mean(frames, by, value):
        x = reduce(DataFrame.unionByName, frames).groupBy(by)
        return x.agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias(value))
    fit = _Fit(mx, mean(theirs, "row", "prediction"), mean(imp, "feature", "importance"),
               reduce(DataFrame.unionByName, nodes), trees, depth, fr)
    if kind == "Decision Tree":
        _MODELS[key] = model
    return _FITS.setdefault(key, fit)


def _walked(spark, sf_dir, kind):
    fit = _fitted(spark, sf_dir, kind)
    rows = fit.matrix.select("row", "is_train", "label", "x")
    return tr.walk(tr.dealt(rows, "row", fit.trees), fit.nodes, fit.trees, fit.depth)


def _agreement(spark, sf_dir, kind):
    """(is_train, rows, same, importances): rows whose native score is the
    model's own, and features whose importance is."""
    fit = _fitted(spark, sf_dir, kind)
    boosted = kind == "Gradient Boosting"
    own = tr.score(_walked(spark, sf_dir, kind), "row", boosted).withColumnRenamed("prediction", "own")
    got = fit.matrix.select("row", "is_train").join(fit.theirs, "row").join(own, "row", "left")
    close = F.abs(F.col("own") - F.col("prediction")) <= 1e-9 * F.abs("prediction")
    imp = tr.importances(fit.nodes, boosted=boosted).join(fit.importances.withColumnRenamed("importance", "theirs"), "feature")
    same = imp.agg(F.count_if(F.abs(F.col("importance") - F.col("theirs")) <= 1e-9).alias("importances"))
    return (got.groupBy("is_train").agg(F.count(F.lit(1)).alias("rows"), F.count_if(close).alias("same"))
            .crossJoin(F.broadcast(same)))


_AGREES = with_ctes(["features"], f"""
SELECT {_TRAIN} AS is_train, count(*) AS rows, count(*) AS same, {len(FEATURE_COLUMNS)}::BIGINT AS importances
FROM features WHERE {_COMPLETE} GROUP BY 1""")


@query("tree_agreement", _AGREES)
def tree_agreement(spark, sf_dir):
    """The decision tree (I5) scored from its node table."""
    return _agreement(spark, sf_dir, "Decision Tree")


@query("forest_agreement", _AGREES)
def forest_agreement(spark, sf_dir):
    """Twenty trees of the random forest (I3) scored from their node table."""
    return _agreement(spark, sf_dir, "Random Forest")


@query("boosting_agreement", _AGREES)
def boosting_agreement(spark, sf_dir):
    """Sixty rounds of the boosted ensemble (I4) scored from their node table."""
    return _agreement(spark, sf_dir, "Gradient Boosting")


@query("forest_eval")
def forest_eval(spark, sf_dir):
    """Train and test errors of the forest's twenty trees (I3, I7), natively scored."""
    scored = materialize(tr.score(_walked(spark, sf_dir, "Random Forest"), "row"), "scored")       # read for both parts
    rows = _fitted(spark, sf_dir, "Random Forest").matrix.join(scored, "row")
    parts = [md.regression_metrics(rows.where(f"is_train = {t}")).withColumn("is_train", F.lit(t)) for t in (True, False)]
    return parts[0].unionByName(parts[1])


@query("boosting_eval")
def boosting_eval(spark, sf_dir):
    """Train and test errors after each of the sixty boosting rounds (I4)."""
    return tr.staged_errors(_walked(spark, sf_dir, "Gradient Boosting"), "row", by=("is_train",))


@query("tree_splits", with_ctes(["features"], f"""
SELECT count(*) AS rows, {R4('avg(CAST(price AS DOUBLE))')} AS mean, {R4('stddev_pop(CAST(price AS DOUBLE))')} AS std,
       count(*) AS in_leaves, 0::BIGINT AS other_nodes, 0::BIGINT AS uneven_splits
FROM features WHERE {_COMPLETE} AND {_TRAIN}"""))
def tree_splits(spark, sf_dir):
    """Split statistics recomputed from the training rows that reach each
    node of the decision tree (I5): the root's, rows of all leaves, nodes
    whose count, mean or variance is not the model's, and splits whose
    children don't add up."""
    fit = _fitted(spark, sf_dir, "Decision Tree")
    nodes = fit.nodes
    walked = tr.walk(fit.matrix.where("is_train").select("row", "label", "x"), nodes, fit.trees, fit.depth, path=True)
    st = materialize(tr.split_statistics(walked), "split_statistics")
    both = nodes.join(st, ["tree", "node"], "left")

    def near(a, b, scale=F.lit(0.0)):
        return F.abs(F.col(a) - F.col(b)) <= 1e-9 * (F.abs(b) + scale + 1)
    squares = F.col("mean") * F.col("mean")               # the variance is what is left of them
    spread = (F.col("left") < 0) | near("variance", "impurity", squares)      # stored for inner nodes only
    agrees = (F.col("n") == F.col("rows")) & near("mean", "value") & spread
    half = st.select("tree", F.col("node").alias("child"), F.col("n").alias("cn"), (F.col("n") * F.col("mean")).alias("cs"))
    split = (both.where("left >= 0").select("tree", "node", "n", (F.col("n") * F.col("mean")).alias("s"),
                                             F.explode(F.array("left", "right")).alias("child"))
             .join(half, ["tree", "child"], "left").groupBy("tree", "node").agg(
                 F.any_value("n").alias("n"), F.any_value("s").alias("s"), F.sum("cn").alias("cn"), F.sum("cs").alias("cs")))
    adds = (F.col("n") == F.col("cn")) & near("s", "cs")
    return (both.agg(F.max(F.when(F.col("node") == 0, F.col("n"))).alias("rows"),
                     r4(F.max(F.when(F.col("node") == 0, F.col("mean")))).alias("mean"),
                     r4(F.sqrt(F.max(F.when(F.col("node") == 0, F.col("variance"))))).alias("std"),
                     F.sum(F.when(F.col("left") < 0, F.col("n"))).alias("in_leaves"),
                     F.count_if(~F.coalesce(agrees, F.lit(False))).alias("other_nodes"))
            .crossJoin(F.broadcast(split.agg(F.count_if(~F.coalesce(adds, F.lit(False))).alias("uneven_splits")))))


@query("cv_route_means", with_ctes(["fares"], f"""
, t AS (SELECT coalesce(departure_airport, '') AS d, coalesce(arrival_airport, '') AS a, CAST(price AS DOUBLE) AS y,
               CAST({_FOLD} % 5 AS BIGINT) AS fold FROM fares WHERE {_TRAIN})
, g AS (SELECT d, a, fold, count(*) AS n, sum(y) AS s FROM t GROUP BY ALL)
, w AS (SELECT d, a, fold, (sum(s) OVER (PARTITION BY d, a) - s) / nullif(sum(n) OVER (PARTITION BY d, a) - n, 0) AS m FROM g)
, o AS (SELECT fold, (sum(sum(s)) OVER () - sum(s)) / nullif(sum(sum(n)) OVER () - sum(n), 0) AS m FROM g GROUP BY fold)
, e AS (SELECT fold, count(*) AS rows, avg(abs(y - coalesce(w.m, o.m))) AS mae
        FROM t JOIN w USING (d, a, fold) JOIN o USING (fold) GROUP BY fold)
SELECT fold, rows, {R4('mae')} AS mae, {R4('avg(mae) OVER ()')} AS mean, {R4('stddev_pop(mae) OVER ()')} AS std FROM e"""))
def cv_route_means(spark, sf_dir):
    """Five-fold errors of route means, each row predicted from the other
    folds (I6)."""
    f = md.fold_column(md.train_test_flag(cleaned(spark, sf_dir).fares)).where("is_train")
    f = f.withColumn("fold", md.fold_of("fold_hash", 5))
    e = md.fold_errors(md.out_of_fold_means(f))
    return e.select(F.col("fold").cast("bigint").alias("fold"), "rows", *[r4(c).alias(c) for c in ("mae", "mean", "std")])


@query("baseline_predict", with_ctes(["fare_raw", "filtered", "fares"], f"""
, t AS (SELECT departure_airport AS d, arrival_airport AS a, CAST(price AS DOUBLE) AS y FROM fares WHERE {_TRAIN})
, m AS (SELECT d, a, avg(y) AS p FROM t GROUP BY 1, 2)
, o AS (SELECT avg(y) AS p FROM t)
, s AS (SELECT least(max(CAST(price AS DOUBLE)), 50000000.0) AS hi, greatest(min(CAST(price AS DOUBLE)), 100000.0) AS lo FROM filtered)
SELECT f.event_id, {R4('coalesce(m.p, o.p)')} AS raw_prediction,
       {R4('least(s.hi, greatest(s.lo, coalesce(m.p, o.p)))')} AS prediction
FROM fare_raw f CROSS JOIN o CROSS JOIN s LEFT JOIN m ON m.d = f.departure_airport AND m.a = f.arrival_airport"""))
def baseline_predict(spark, sf_dir):
    """Every raw history row predicted from stored route means of the
    training part, clipped (I8, G20)."""
    c = cleaned(spark, sf_dir)
    means = materialize(md.route_means(md.train_test_flag(c.fares).where("is_train")), "route_means")
    out = md.predict(md.score_by_means(means), fx.fare_raw(spark, sf_dir), c.price_stats)
    return out.select("event_id", r4("raw_prediction").alias("raw_prediction"), r4("prediction").alias("prediction"))


@query("batch_predict_agreement", with_ctes(["fare_raw"], "SELECT count(*) AS rows, count(*) AS same FROM fare_raw"))
def batch_predict_agreement(spark, sf_dir):
    """Every raw history row scored from the tree's node table and clipped
    is what the model and ``batch_predict`` give (I8)."""
    fit = _fitted(spark, sf_dir, "Decision Tree")
    model, fr = _MODELS[spark.sparkContext.applicationId, sf_dir, "Decision Tree"], fit.features
    stats = cleaned(spark, sf_dir).price_stats
    feats = materialize(prediction_features(fx.fare_raw(spark, sf_dir), fr.encoders, fr.popularity), "prediction_rows")
    own = md.predict(md.score_by_nodes(fit.nodes, fit.trees, fit.depth, "event_id"), feats, stats)
    got = md.batch_predict(model, feats, stats).select("event_id", F.col("prediction").alias("theirs"))
    both = got.join(own, "event_id", "left")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction") == F.col("theirs")).alias("same"))
