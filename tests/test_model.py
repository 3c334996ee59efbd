"""Model operators with small settings (the reference defaults are kept
as library defaults; full-size forests do not fit a test run)."""

import math

from pyspark.sql import functions as F

from faresight.operators import clean as cl
from faresight.operators import model as md
from faresight.operators.features import prediction_features, training_features
from faresight.operators.model_store import load_model, save_model
from faresight.plans import fixtures as fx
from faresight.schema import FEATURE_COLUMNS
from tests.conftest import SMOKE


def _prep(spark):
    c = cl.clean_fares(fx.fare_raw_with_copies(spark, SMOKE))
    fr = training_features(c.fares)
    f = cl.drop_incomplete_features(fr.features, FEATURE_COLUMNS, "price")
    f = md.fold_column(md.train_test_flag(f))
    return md.feature_matrix(f, keep=["is_train", "fold_hash"]).cache(), fr, c


def test_models_metrics_and_importances(spark):
    mx, _, _ = _prep(spark)
    small = {"Random Forest": {"numTrees": 5, "maxDepth": 4},
             "Gradient Boosting": {"maxIter": 5, "maxDepth": 3},
             "Decision Tree": {"maxDepth": 5}}
    metrics, runs = md.evaluate_models(mx, folds=3, overrides=small)
    rows = metrics.collect()
    assert [r.model for r in rows] == md.MODEL_ORDER
    for r in rows:
        assert all(math.isfinite(r[k]) for k in ("cv_mae_mean", "cv_mae_std", "test_mae", "test_r2"))
    best = md.best_model(metrics).first()
    assert best.cv_mae_mean == min(r.cv_mae_mean for r in rows)
    imp = md.feature_importances(spark, runs[0].model)
    assert abs(sum(r.importance for r in imp.collect()) - 1.0) < 1e-6
    assert md.top_importances(imp).count() == 10


def test_train_pick_and_importances(spark):
    mx, _, _ = _prep(spark)
    run, metrics, imp = md.train_best(mx, kinds=("Decision Tree",), folds=2, overrides={"Decision Tree": {"maxDepth": 3}})
    assert run.name == "Decision Tree" and metrics.count() == 1
    assert sorted(r.feature for r in imp.collect()) == sorted(FEATURE_COLUMNS)


def test_folds_are_even_for_any_number(spark):
    mx, _, _ = _prep(spark)
    for folds in (2, 3, 5):
        n = [r["count"] for r in mx.groupBy(md.fold_of("fold_hash", folds)).count().collect()]
        assert len(n) == folds and max(n) < 1.3 * min(n)


def test_split_stable(spark):
    c = cl.clean_fares(fx.fare_raw_with_copies(spark, SMOKE)).fares
    a = md.train_test_flag(c).where("is_train").count()
    b = md.train_test_flag(c.repartition(3)).where("is_train").count()
    assert a == b and 0 < a < c.count()


def test_save_load_same_predictions(spark, tmp_path):
    mx, fr, c = _prep(spark)
    model = md.make_estimator("Decision Tree", maxDepth=5).fit(mx.where("is_train"))
    save_model(str(tmp_path / "m"), model, "Decision Tree", FEATURE_COLUMNS, fr.encoders,
               c.price_stats, fr.popularity)
    st = load_model(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame(
        [("VJ1170", "SGN", "HAN", "23:35", "01:45", "Eco", "Airbus A321",
          "2025-07-04 11:49:00", "2025-07-05T17:00:00.000"),
         ("XX999", "SGN", "HAN", "bad", "10:15", "Eco", "Airbus A321",
          "2024-01-15 10:30:00", "2024-01-20T08:00:00")],
        "flight_number string, departure_airport string, arrival_airport string,"
        " departure_time string, arrival_time string, classes string, type_of_plane string,"
        " create_at string, flight_date string")
    f1 = prediction_features(rows, fr.encoders, fr.popularity)
    f2 = prediction_features(rows, st.encoders, st.popularity)
    p1 = [r.prediction for r in md.batch_predict(model, f1, c.price_stats).orderBy("flight_number").collect()]
    p2 = [r.prediction for r in md.batch_predict(st.model, f2, st.price_stats).orderBy("flight_number").collect()]
    assert p1 == p2 and all(100000 <= p <= 5e7 for p in p1)
    unseen = f1.where(F.col("flight_number") == "XX999").first()
    assert unseen.flight_number_encoded == 0 and unseen.departure_minutes == 0


def test_missing_popularity_defaults(spark, tmp_path):
    mx, fr, c = _prep(spark)
    model = md.make_estimator("Decision Tree", maxDepth=3).fit(mx.where("is_train"))
    save_model(str(tmp_path / "m"), model, "Decision Tree", FEATURE_COLUMNS, fr.encoders,
               None, None)
    st = load_model(spark, str(tmp_path / "m"))
    p = st.popularity.first()
    assert (p.route_mean, p.route_std, p.airline_mean, p.airline_std) == (100, 50, 50, 25)
    assert st.price_stats is None
