"""Models as node tables: scores, importances, split statistics and staged
errors against the models' own; out-of-fold means against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from faresight.operators import model as md
from faresight.operators import trees as tr
from faresight.schema import FEATURE_COLUMNS

KINDS = {"Decision Tree": {"maxDepth": 7}, "Random Forest": {"numTrees": 5, "maxDepth": 5},
         "Gradient Boosting": {"maxIter": 6, "maxDepth": 3}}


@pytest.fixture(scope="module")
def matrix(spark):
    from faresight.plans.q_model import _matrix
    from tests.conftest import SMOKE
    mx, _ = _matrix(spark, SMOKE)
    return mx.withColumns({"row": F.monotonically_increasing_id(), "x": vector_to_array("features")}).cache()


@pytest.mark.parametrize("kind", KINDS)
def test_node_table_gives_the_models_scores(spark, matrix, kind, monkeypatch):
    model = md.make_estimator(kind, **KINDS[kind]).fit(matrix.where("is_train"))
    own = getattr(model, "trees", [model])
    nodes, depth, boosted = tr.node_table(spark, model).cache(), max(t.depth for t in own), kind == "Gradient Boosting"
    assert nodes.count() == sum(t.numNodes for t in own)
    imp = {r["feature"]: r["importance"] for r in tr.importances(nodes, boosted=boosted).collect()}
    assert [imp[f] for f in FEATURE_COLUMNS] == pytest.approx(model.featureImportances.toArray().tolist(), abs=1e-12)
    want = {r["row"]: r["prediction"] for r in model.transform(matrix).collect()}
    for limit in (tr.GROUP_NODES, 40):               # all trees together, and in groups
        monkeypatch.setattr(tr, "GROUP_NODES", limit)
        walked = tr.walk(matrix.select("row", "label", "x"), nodes, len(own), depth)
        got = {r["row"]: r["prediction"] for r in tr.score(walked, "row", boosted).collect()}
        assert got == pytest.approx(want, rel=1e-12)
    if boosted:
        staged = {r["rounds"]: r["mae"] for r in tr.staged_errors(walked, "row").collect()}
        assert sorted(staged) == list(range(1, 7))
        assert staged[6] == pytest.approx(md.regression_metrics(model.transform(matrix)).first()["mae"], rel=1e-9)


def test_split_statistics(spark, matrix):
    train = matrix.where("is_train")
    model = md.make_estimator("Decision Tree", maxDepth=6).fit(train)
    walked = tr.walk(train.select("row", "label", "x"), tr.node_table(spark, model), 1, model.depth, path=True)
    nodes = {r["node"]: r for r in tr.node_table(spark, model).collect()}
    got = {r["node"]: r for r in tr.split_statistics(walked).collect()}
    assert got.keys() == nodes.keys() and got[0]["n"] == train.count()
    for k, r in got.items():
        assert r["n"] == nodes[k]["rows"] and r["mean"] == pytest.approx(nodes[k]["value"], rel=1e-12)
        if nodes[k]["left"] >= 0:
            assert r["n"] == got[nodes[k]["left"]]["n"] + got[nodes[k]["right"]]["n"]
            assert r["variance"] == pytest.approx(nodes[k]["impurity"], rel=1e-9)


def test_nominal_splits(spark):
    """A split by categories sends exactly those to the left."""
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    from pyspark.ml.regression import DecisionTreeRegressor
    r = random.Random(1)
    rows = [(i, float(c), float([3, 9, 1, 7, 5][c] * 10 + r.random())) for i, c in enumerate(r.choices(range(5), k=300))]
    df = VectorAssembler(inputCols=["c"], outputCol="v").transform(spark.createDataFrame(rows, "row long, c double, label double"))
    df = VectorIndexer(inputCol="v", outputCol="features", maxCategories=8).fit(df).transform(df)
    model = DecisionTreeRegressor(maxDepth=4).fit(df)
    nodes = tr.node_table(spark, model)
    assert nodes.where("categories IS NOT NULL").count() > 0
    x = df.select("row", vector_to_array("features").alias("x"))
    got = {r["row"]: r["prediction"] for r in tr.score(tr.walk(x, nodes, 1, model.depth), "row").collect()}
    assert got == pytest.approx({r["row"]: r["prediction"] for r in model.transform(df).collect()})


def test_forest_parts(matrix):
    parts = list(md.forest_parts(matrix.where("is_train"), part=2, numTrees=5, maxDepth=2))
    assert [(first, len(m.trees)) for first, m in parts] == [(0, 2), (2, 2), (4, 1)]


@pytest.mark.parametrize("local", [1 << 15, 40])
def test_grown_tree_is_spark_mls(spark, local, monkeypatch):
    """One group for the whole tree, or upper levels by Spark and many subtrees: the
    nodes are those of Spark ML, also with more values than bins and equal gains."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import DecisionTreeRegressor

    from faresight.operators import tree_fit as tf
    monkeypatch.setattr(tf, "LOCAL_ROWS", local)
    monkeypatch.setattr(tf, "HIST_BYTES", 24 * 40 * 5)          # a few nodes a pass
    r = random.Random(3)
    rows = [(r.randrange(5), r.randrange(90), r.randrange(3), 7, r.choice([0, 0, 0, 1])) for _ in range(900)]
    df = spark.createDataFrame([(Vectors.dense(x), float(100 * x[0] + x[1] % 7 * 30 + r.randrange(40))) for x in rows * 2],
                               ["features", "label"])
    settings = dict(maxDepth=12, maxBins=32, minInstancesPerNode=2, seed=1)
    want, got = DecisionTreeRegressor(**settings).fit(df), tf.GrownTree(**settings).fit(df)
    assert (got.numNodes, got.depth, got.toDebugString.split("\n")[1:]) == (
        want.numNodes, want.depth, want.toDebugString.split("\n")[1:])
    assert got.featureImportances.toArray().tolist() == pytest.approx(want.featureImportances.toArray().tolist(), abs=1e-12)


def test_forest_in_parts_is_the_whole_forest(spark, matrix, monkeypatch):
    """Trees depend on their own number only; their roots hold bootstrap draws."""
    from faresight.operators import tree_fit as tf
    monkeypatch.setattr(tf, "LOCAL_ROWS", 200)
    train = matrix.where("is_train").select("features", "label")
    nodes = {part: [t for _, m in md.forest_parts(train, part=part, numTrees=3, maxDepth=6) for t in m.trees] for part in (2, 3)}
    assert [t.toDebugString.split("\n")[1:] for t in nodes[2]] == [t.toDebugString.split("\n")[1:] for t in nodes[3]]
    held = [tr.node_table(spark, t).where("node = 0").first()["rows"] for t in nodes[3]]
    n = train.count()
    assert len({*held}) > 1 and all(abs(x - n) < 5 * math.sqrt(n) for x in held)
    assert len({t.toDebugString for t in nodes[3]}) == 3


def test_forest_is_loaded_in_parts_of_few_nodes(spark, matrix, monkeypatch):
    """One growth, models of some nodes at a time: all trees, and the scores of the whole."""
    from faresight.operators import tree_fit as tf
    grown, grow = [], tf.grow
    monkeypatch.setattr(tf, "grow", lambda *a, **k: grown.append(1) or grow(*a, **k))
    train = matrix.where("is_train").select("features", "label")
    whole = md.make_estimator("Random Forest", numTrees=5, maxDepth=5).fit(train)
    most = 2 * max(t.numNodes for t in whole.trees)
    monkeypatch.setattr(md, "PART_NODES", most)
    parts = list(md.forest_parts(train, numTrees=5, maxDepth=5))
    assert len(grown) == 2 and len(parts) > 1
    assert [first for first, _ in parts] == [sum(len(m.trees) for _, m in parts[:i]) for i in range(len(parts))]
    assert all(sum(t.numNodes for t in m.trees) <= most for _, m in parts)
    assert [t.toDebugString.split("\n")[1:] for _, m in parts for t in m.trees] == [t.toDebugString.split("\n")[1:] for t in whole.trees]
    held = [tr.node_table(spark, m).count() for _, m in parts]
    assert held == [sum(t.numNodes for t in m.trees) for _, m in parts]


def test_deep_trees_are_walked_whole(spark):
    """A tree of more levels than one generated method walks; missing values go right."""
    deep = 2 * tr.LEVELS + 3
    nodes = [(0, 1.0, 2 * i, 0, float(deep - i), 2 * i + 2, 2 * i + 1, -1.0) for i in range(deep)]        # smaller values go on
    nodes += [(0, 1.0, 2 * i + 1, None, None, -1, -1, float(i)) for i in range(deep)] + [(0, 1.0, 2 * deep, None, None, -1, -1, 99.0)]
    table = spark.createDataFrame(nodes, "tree int, weight double, node int, feature int, threshold double, left int, right int, value double")
    table = table.withColumn("categories", F.lit(None).cast("array<double>"))
    rows = spark.createDataFrame([(k, [v]) for k, v in enumerate([0.0, 1.5, 7.0, deep + 1.0, None, math.nan])], "row int, x array<double>")
    got = {r["row"]: r for r in tr.walk(rows, table, 1, deep, path=True).collect()}
    assert [got[k]["leaf_value"] for k in range(6)] == [99.0, deep - 1.0, deep - 6.0, 0.0, 0.0, 0.0]
    assert got[0]["path"] == [2 * i for i in range(deep + 1)] and got[3]["path"] == [0, 1]
    short = {r["row"]: r["leaf"] for r in tr.walk(rows, table, 1, 2).collect()}
    assert short[0] == 4 and short[3] == 1                # cut off where ``depth`` says


def test_dealt_rows_are_not_shuffled_again(spark, matrix):
    model = md.make_estimator("Gradient Boosting", **KINDS["Gradient Boosting"]).fit(matrix.where("is_train"))
    rows = matrix.select("row", "label", "x")
    walked = [tr.walk(x, tr.node_table(spark, model), 6, 3) for x in (rows, tr.dealt(rows, "row", 6))]
    plan = tr.staged_errors(walked[1], "row")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window"):]
    assert below.count("Exchange hashpartitioning(row") == 1 and "Generate" in below[:below.index("Exchange hashpartitioning(row")]
    a, b = ({r["rounds"]: r["mae"] for r in tr.staged_errors(w, "row").collect()} for w in walked)
    assert a == pytest.approx(b, rel=1e-12) and len(a) == 6


def test_out_of_fold_means(spark):
    r = random.Random(2)
    rows = [(r.choice(["A", "B", None, ""]), r.choice("XY"), r.randrange(3), float(r.randrange(100))) for _ in range(60)]
    rows.append(("only", "here", 1, 50.0))           # a route that the other folds lack
    df = spark.createDataFrame(rows, "departure_airport string, arrival_airport string, fold int, price double")
    want = defaultdict(list)
    for d, a, f, y in rows:
        rest = [y2 for d2, a2, f2, y2 in rows if ((d2 or ""), a2) == ((d or ""), a) and f2 != f]
        rest = rest or [y2 for *_, f2, y2 in rows if f2 != f]
        want[f].append(abs(y - sum(rest) / len(rest)))
    scored = md.out_of_fold_means(df)
    assert scored.count() == len(rows)
    errors = [sum(v) / len(v) for v in want.values()]
    for e in md.fold_errors(scored).collect():
        assert e["rows"] == len(want[e["fold"]]) and e["mae"] == pytest.approx(sum(want[e["fold"]]) / e["rows"])
        assert e["mean"] == pytest.approx(sum(errors) / 3)
        assert e["std"] == pytest.approx(math.sqrt(sum((x - sum(errors) / 3) ** 2 for x in errors) / 3))
    one = md.out_of_fold_means(df.where("fold = 1")).select("prediction").distinct().collect()
    assert [x["prediction"] for x in one] == [None]          # no other fold to learn from


def test_predict_by_stored_means(spark):
    train = spark.createDataFrame([("A", "B", 100.0), ("A", "B", 300.0), ("A", None, 50.0)],
                                  "departure_airport string, arrival_airport string, price double")
    rows = spark.createDataFrame([(1, "A", "B"), (2, "B", "A"), (3, None, "B")], "id long, departure_airport string, arrival_airport string")
    scorer = md.score_by_means(md.route_means(train))
    got = {r["id"]: r["prediction"] for r in md.predict(scorer, rows, None).collect()}
    assert got == {1: 200.0, 2: 150.0, 3: 150.0}
    stats = spark.createDataFrame([(160000.0, 170000.0)], "min double, max double")
    assert {r["prediction"] for r in md.predict(scorer, rows, stats).collect()} == {160000.0}
