"""Registered queries: fare model."""

from __future__ import annotations

from pyspark.sql import functions as F

from faresight.operators import clean as cl
from faresight.operators import model as md
from faresight.operators.features import prediction_features, training_features
from faresight.operators.joins import lookup_join
from faresight.plans import fixtures as fx
from faresight.plans.common import R4, cleaned, r4
from faresight.plans.oracle import with_ctes
from faresight.plans.q_clean import _KEY_SQL
from faresight.plans.registry import query
from faresight.schema import FEATURE_COLUMNS
from faresight.session import materialize


@query("model_metrics", with_ctes(["fares"], f"""
, f AS (SELECT CAST(price AS DOUBLE) AS y,
               avg(CAST(price AS DOUBLE)) OVER (PARTITION BY departure_airport, arrival_airport) AS p
        FROM fares)
, m AS (SELECT avg(y) AS my FROM f)
SELECT {R4('avg(abs(y - p))')} AS mae, {R4('sqrt(avg((y - p) * (y - p)))')} AS rmse,
       {R4('1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my))')} AS r2
FROM f, m"""))
def model_metrics(spark, sf_dir):
    """Metrics (I7) of the route-mean baseline on the cleaned fares."""
    f = cleaned(spark, sf_dir).fares
    means = f.groupBy("departure_airport", "arrival_airport").agg(
        F.avg(F.col("price").cast("double")).alias("prediction"))
    scored = lookup_join(f, means, ["departure_airport", "arrival_airport"])
    m = md.regression_metrics(scored.withColumn("label", F.col("price")))
    return m.select(*[r4(c).alias(c) for c in m.columns])


def _matrix(spark, sf_dir):
    fr = training_features(cleaned(spark, sf_dir).fares)
    f = cl.drop_incomplete_features(fr.features, FEATURE_COLUMNS, "price")
    f = md.fold_column(md.train_test_flag(f))
    return materialize(md.feature_matrix(f, keep=["is_train", "fold_hash"]), "matrix"), fr


@query("decision_tree_eval")
def decision_tree_eval(spark, sf_dir):
    """Train, cross-validate (5 folds) and score the decision tree with the
    reference's settings (I1, I2, I5, I6, I7); best-model pick (F3)."""
    mx, _ = _matrix(spark, sf_dir)
    metrics, _ = md.evaluate_models(mx, kinds=("Decision Tree",), folds=5)
    return md.best_model(metrics)


@query("top_importances")
def top_importances(spark, sf_dir):
    """Ten most important features of the fitted tree (F2)."""
    mx, _ = _matrix(spark, sf_dir)
    model = md.make_estimator("Decision Tree").fit(mx.where("is_train"))
    return md.top_importances(md.feature_importances(spark, model))


@query("feature_matrix", with_ctes(["features"], f"""
SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)}, CAST(price AS DOUBLE) AS label
FROM features WHERE {" AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS)} AND price IS NOT NULL"""))
def feature_matrix_q(spark, sf_dir):
    """The assembled vectors, taken apart again."""
    from pyspark.ml.functions import vector_to_array
    mx, _ = _matrix(spark, sf_dir)
    x = mx.select(vector_to_array("features").alias("x"), "label")
    return x.select(*[F.col("x")[i].alias(c) for i, c in enumerate(FEATURE_COLUMNS)], "label")


_FOLD = f"CAST(('0x' || substr({_KEY_SQL}, 9, 8)) AS BIGINT)"


@query("fold_sizes", with_ctes(["fares"], f"""
SELECT folds, CAST(h % folds AS BIGINT) AS fold, count(*) AS rows
FROM (SELECT {_FOLD} AS h FROM fares), (VALUES (3), (5)) v(folds) GROUP BY 1, 2"""))
def fold_sizes(spark, sf_dir):
    """Rows of each fold for 3 and for 5 folds."""
    f = md.fold_column(cleaned(spark, sf_dir).fares).select("fold_hash")
    f = f.select("fold_hash", F.explode(F.array(F.lit(3), F.lit(5))).alias("folds"))
    return (f.groupBy(F.col("folds").cast("bigint").alias("folds"),
                      F.when(F.col("folds") == 3, md.fold_of("fold_hash", 3))
                      .otherwise(md.fold_of("fold_hash", 5)).cast("bigint").alias("fold"))
            .agg(F.count(F.lit(1)).alias("rows")))


@query("best_of_metrics", with_ctes([], """
SELECT event_type AS model FROM (SELECT event_type, max(user_id) % 7 AS cv_mae_mean, min(event_id) AS ord
FROM events GROUP BY 1) ORDER BY cv_mae_mean, ord LIMIT 1"""))
def best_of_metrics(spark, sf_dir):
    """The pick from a metrics table (F3): lowest error, first of equal ones."""
    m = fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(
        (F.max("user_id") % 7).alias("cv_mae_mean"), F.min("event_id").alias("ord"))
    return md.best_model(m).select("model")


@query("top_of_importances", with_ctes([], """
SELECT 'u' || CAST(user_id AS VARCHAR) AS feature, count(*) / 1024.0::DOUBLE AS importance
FROM events GROUP BY user_id ORDER BY count(*) DESC, feature LIMIT 10"""))
def top_of_importances(spark, sf_dir):
    """The ten largest of an importances table (F2)."""
    imp = fx.table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("feature")).agg(
        (F.count(F.lit(1)) / F.lit(1024.0)).alias("importance"))
    return md.top_importances(imp)


@query("model_reload", with_ctes(["features"], f"""
SELECT true AS same, count(*) AS rows FROM features
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS)} AND price IS NOT NULL GROUP BY 1"""))
def model_reload(spark, sf_dir):
    """A stored and reloaded model predicts the same for every row."""
    import uuid

    from faresight.operators.model_store import load_model, save_model
    from faresight.session import scratch_path
    mx, fr = _matrix(spark, sf_dir)
    model = md.make_estimator("Decision Tree").fit(mx.where("is_train"))
    folder = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    save_model(folder, model, "Decision Tree", FEATURE_COLUMNS, fr.encoders,
               cleaned(spark, sf_dir).price_stats, fr.popularity)
    again = load_model(spark, folder).model
    both = again.transform(model.transform(mx).withColumnRenamed("prediction", "first"))
    return both.groupBy((F.col("first") == F.col("prediction")).alias("same")).agg(F.count(F.lit(1)).alias("rows"))


@query("batch_predict")
def batch_predict(spark, sf_dir):
    """Predict every raw history row with the tree trained on the 80 %
    split: training means for popularity, unseen categories 0, bad
    times 0, then the price clip (I8, G20)."""
    mx, fr = _matrix(spark, sf_dir)
    model = md.make_estimator("Decision Tree").fit(mx.where("is_train"))
    rows = fx.fare_raw(spark, sf_dir)
    feats = prediction_features(rows, fr.encoders, fr.popularity)
    out = md.batch_predict(model, feats, cleaned(spark, sf_dir).price_stats)
    return out.select("event_id", "raw_prediction", "prediction")


_ENC_COLS = ["flight_number", "departure_airport", "arrival_airport", "classes",
             "type_of_plane", "airline"]


def _pred_sql() -> str:
    from faresight.plans.oracle import minutes_sql
    enc = "\n".join(
        f"LEFT JOIN (SELECT value AS v_{c}, code AS c_{c} FROM encoders WHERE attribute = '{c}') e_{c} "
        f"ON coalesce(p.{c}, 'nan') = e_{c}.v_{c}" for c in _ENC_COLS)
    tod = ("CASE WHEN floor(dm / 60) >= 6 AND floor(dm / 60) < 12 THEN 0 "
           "WHEN floor(dm / 60) >= 12 AND floor(dm / 60) < 18 THEN 1 "
           "WHEN floor(dm / 60) >= 18 AND floor(dm / 60) < 22 THEN 2 ELSE 3 END")
    days = "floor(date_diff('microsecond', c, f) / 86400000000)"
    return with_ctes(["fare_raw", "encoders", "features"], f"""
, pop AS (SELECT avg(route_popularity) AS rp, avg(airline_popularity) AS ap FROM features)
, p AS (SELECT event_id, flight_number, departure_airport, arrival_airport, classes, type_of_plane,
          substr(flight_number, 1, 2) AS airline,
          TRY_CAST(create_at AS TIMESTAMP) AS c, TRY_CAST(flight_date AS TIMESTAMP) AS f,
          coalesce({minutes_sql('departure_time')}, 0) AS dm,
          coalesce({minutes_sql('arrival_time')}, 0) AS am
        FROM fare_raw)
SELECT p.event_id,
  {", ".join(f"CAST(coalesce(c_{c}, 0) AS BIGINT) AS {c}_encoded" for c in _ENC_COLS)},
  CAST(coalesce(hour(c), 0) AS BIGINT) AS create_hour,
  CAST(coalesce(isodow(c) - 1, 0) AS BIGINT) AS create_day_of_week,
  CAST(coalesce(month(c), 0) AS BIGINT) AS create_month,
  CAST(coalesce(month(f), 0) AS BIGINT) AS flight_month,
  CAST(coalesce(isodow(f) - 1, 0) AS BIGINT) AS flight_day_of_week,
  CAST(coalesce({days}, 0) AS BIGINT) AS days_in_advance,
  CAST(dm AS BIGINT) AS departure_minutes,
  CAST(CASE WHEN am - dm < 0 THEN am - dm + 1440 ELSE am - dm END AS BIGINT) AS flight_duration,
  CAST(coalesce(CAST(isodow(c) - 1 >= 5 AS INTEGER), 0) AS BIGINT) AS is_weekend_booking,
  CAST(coalesce(CAST(isodow(f) - 1 >= 5 AS INTEGER), 0) AS BIGINT) AS is_weekend_flight,
  CAST(CASE WHEN {days} < 7 THEN 0 WHEN {days} < 30 THEN 1 WHEN {days} < 90 THEN 2 ELSE 3 END AS BIGINT)
    AS booking_category,
  CAST({tod} AS BIGINT) AS departure_time_category,
  {R4('pop.rp')} AS route_popularity, {R4('pop.ap')} AS airline_popularity
FROM p CROSS JOIN pop
{enc}""")


@query("prediction_features", _pred_sql())
def prediction_features_q(spark, sf_dir):
    """Prediction-path features (I8) for every raw history row, with the
    encoders and popularity means of the cleaned training fares."""
    fr = training_features(cleaned(spark, sf_dir).fares)
    p = prediction_features(fx.fare_raw(spark, sf_dir), fr.encoders, fr.popularity)
    ints = [c for c in FEATURE_COLUMNS if c not in ("route_popularity", "airline_popularity")]
    return p.select("event_id", *[F.col(c).cast("bigint").alias(c) for c in ints],
                    r4("route_popularity").alias("route_popularity"),
                    r4("airline_popularity").alias("airline_popularity"))
