"""Fitted trees as a table of nodes.

A fitted tree, forest or boosted ensemble becomes one relation, a row for
each node. Rows are scored by walking that relation level by level, so scoring,
staged errors, split statistics and importances are DataFrame work that needs no
model object on the executors.

A tree's nodes are packed into arrays, one row a tree, so that a level is a few
array look-ups and not a join. Trees are broadcast in groups of some ``GROUP_NODES``
nodes, one group after the other where there are several; a tree of depth 20 has
at most 2^21 nodes, so a group of one tree is bounded too.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faresight.schema import FEATURE_COLUMNS
from faresight.session import materialize, scratch_path

GROUP_NODES = 1 << 19     # broadcast together; some 30 bytes each
DEALT = 1 << 22           # walked rows of a task, about
LEVELS = 8                # walked by one generated method: over 8000 bytes, the JVM would interpret it
BOOSTED = "GBTRegressionModel"


def node_table(spark, model) -> DataFrame:
    """(tree, weight, node, feature, threshold, categories, left, right,
    value, gain, rows, impurity) of a fitted model: left and right are -1 in
    leaves, ``threshold`` is set for ordered features (left if at most),
    ``categories`` for nominal ones (left if among them). A model that was loaded
    from what ``tree_fit`` stored is read from there, not sent to executors again."""
    path = getattr(model, "stored_at", None)
    if path is None:
        path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
        model.write().overwrite().save(path)
    return read_nodes(spark, path, hasattr(model, "trees"), type(model).__name__ == BOOSTED)


def read_nodes(spark, path: str, ensemble: bool, boosted: bool = False) -> DataFrame:
    """The node table of a model stored by ``model_store`` or Spark ML."""
    data = spark.read.parquet(os.path.join(path, "data"))
    if boosted:
        trees = spark.read.parquet(os.path.join(path, "treesMetadata")).select(
            F.col("_1").alias("tree"), F.col("_3").alias("weight"))                                  # one row a tree
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(F.broadcast(trees), "tree")
    elif ensemble:                                       # all weigh 1: no table to join for each part of a forest
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*", F.lit(1.0).alias("weight"))
    else:
        data = data.withColumns({"tree": F.lit(0), "weight": F.lit(1.0)})
    split, inner = F.col("split"), F.col("leftChild") >= 0
    ordered = split["numCategories"] < 0
    return data.select(
        "tree", "weight", F.col("id").alias("node"), F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner & ordered, split["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner & ~ordered, split["leftCategoriesOrThreshold"]).alias("categories"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("value"),
        "gain", F.col("impurityStats")[0].alias("rows"), "impurity")


_PACKED = "tree int, size long, weight double, nominal boolean, node array<int>, step array<long>, threshold array<double>, " \
          "categories array<array<double>>, value array<double>"


def _pack(key: tuple, v: pd.DataFrame) -> pd.DataFrame:
    """A tree's nodes as arrays, the two children of a node side by side:
    ``step`` holds the left one's place and, in its last 16 bits, the feature. A
    leaf leads to itself and has no threshold."""
    v = v.sort_values("node")
    node, inner, n = v["node"].to_numpy(np.int64), v["left"].to_numpy() >= 0, len(v)
    pairs = np.stack([np.searchsorted(node, v[c].to_numpy()[inner]) for c in ("left", "right")], 1)
    order = np.r_[0, pairs.ravel()]                      # the root, then the children of each inner node
    place = np.zeros(n, np.int64)
    place[order] = np.arange(n)
    left = place.copy()
    left[inner] = place[pairs[:, 0]]
    step = left << 16 | v["feature"].fillna(0).astype(int).to_numpy()
    threshold = np.where(inner, v["threshold"].to_numpy(float), np.nan)
    among, nominal = v["categories"].tolist(), bool(v["categories"].notna().any())
    held = {"tree": key[0], "size": n, "weight": v["weight"].iloc[0], "nominal": nominal, "node": node[order], "step": step[order],
            "threshold": threshold[order], "categories": [among[i] for i in order] if nominal else None,
            "value": v["value"].to_numpy(float)[order]}
    return pd.DataFrame({k: [x] for k, x in held.items()})


def dealt(rows: DataFrame, key: str, trees: int) -> DataFrame:
    """``rows`` shuffled by ``key`` before they are walked: a window or an
    aggregate over a row's trees then needs no shuffle of all of them."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() * trees / DEALT))
    return rows.repartition(parts, key)


def walk(rows: DataFrame, nodes: DataFrame, trees: int, depth: int, x: str = "x", path: bool = False) -> DataFrame:
    """``rows`` once for each tree, with tree, leaf, leaf_value and weight and
    without ``x``, the array of features. ``path`` adds the nodes passed, leaf
    included. ``depth`` is the deepest tree's."""
    packed = materialize(nodes.where(F.col("tree") < trees).groupBy("tree").applyInPandas(_pack, _PACKED), "nodes")
    groups, held, nominal = [], math.inf, False
    for r in packed.select("tree", "size", "nominal").orderBy("tree").collect():        # one row a tree
        if held + r["size"] > GROUP_NODES:
            groups, held = [*groups, []], 0
        groups[-1].append(r["tree"])
        held, nominal = held + r["size"], nominal or r["nominal"]
    keep = [c for c in rows.columns if c != x]
    out = None
    for g in groups:
        own = packed.where(F.col("tree").isin(g)).select("tree", "weight", *[F.col(c).alias(f"__{c}") for c in _ARRAYS])
        at = rows.select(*keep, F.col(x).alias("__x"), F.lit(0).alias("__at"), F.explode(F.lit(g).cast("array<int>")).alias("tree"))
        at = at.join(F.broadcast(own), "tree")
        if path:
            at = at.withColumn("path", F.slice("__node", 1, 1))
        for level in range(depth):
            if level and level % LEVELS == 0:            # rows leave one method for the next, without the arrays
                at = at.select(*keep, "__x", "__at", *(["path"] if path else []), F.explode(F.array("tree")).alias("tree"))
                at = at.join(F.broadcast(own), "tree")
            at = at.withColumn("__go", _of("step"))
            left, v = F.shiftright("__go", 16).cast("int"), F.get("__x", F.col("__go").bitwiseAND(F.lit(0xFFFF)).cast("int"))
            right = F.coalesce(v, F.lit(math.nan)) > _of("threshold")         # never in a leaf
            if nominal:
                among = _of("categories")
                right = F.when(among.isNull(), right).otherwise(~F.coalesce(F.array_contains(among, v), F.lit(False)))
            step = left + F.when(right, 1).otherwise(0)
            if path:
                at = at.withColumn("path", F.when(left == F.col("__at"), F.col("path")).otherwise(
                    F.array_append("path", F.get("__node", step))))
            at = at.withColumn("__at", step)
        at = at.select(*keep, "tree", _of("node").alias("leaf"), _of("value").alias("leaf_value"), "weight", *(["path"] if path else []))
        if len(groups) > 1:
            at = materialize(at, "walked")                # one group's nodes in memory at a time
        out = at if out is None else out.unionByName(at)
    return out


_ARRAYS = ("node", "step", "threshold", "categories", "value")


def _of(array: str) -> Column:
    return F.get(f"__{array}", "__at")


def score(walked: DataFrame, key: str, boosted: bool = False) -> DataFrame:
    """(key, prediction): the mean of a forest's trees (one tree: its leaf),
    the weighted sum of a boosted ensemble's."""
    part = F.col("leaf_value") * F.col("weight")
    return walked.groupBy(key).agg((F.sum(part) if boosted else F.avg(part)).alias("prediction"))


def staged_errors(walked: DataFrame, key: str, label: str = "label", by: tuple = ()) -> DataFrame:
    """(by..., rounds, mae, rmse): the errors of a boosted ensemble cut off
    after each round. The running sums are windows over one row's trees."""
    upto = Window.partitionBy(key).orderBy("tree").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    error = F.col(label) - F.sum(F.col("leaf_value") * F.col("weight")).over(upto)
    return (walked.select(*by, (F.col("tree") + 1).alias("rounds"), error.alias("e")).groupBy(*by, "rounds")
            .agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")))


def split_statistics(walked: DataFrame, label: str = "label") -> DataFrame:
    """(tree, node, n, mean, variance) of the labels that reach each node,
    recomputed from rows walked with ``path``. Rows are summed by leaf; only
    the leaves' sums go up the paths."""
    y = F.col(label)
    leaves = walked.groupBy("tree", "leaf").agg(F.any_value("path").alias("path"), F.count(y).alias("n"), F.sum(y).alias("s"),
                                                F.sum(y * y).alias("q"))
    up = leaves.select("tree", F.explode("path").alias("node"), "n", "s", "q").groupBy("tree", "node").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return up.select("tree", "node", "n", mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("variance"))


def importances(nodes: DataFrame, features=FEATURE_COLUMNS, boosted: bool = False) -> DataFrame:
    """(feature, importance): the gain of each feature's splits times the
    rows that reach them, over each tree's whole (a boosted ensemble's: over
    all), and over all trees (F2)."""
    names = F.array(*[F.lit(f) for f in features])
    g = nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    if not boosted:
        g = g.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("tree")))      # a tree's features
    g = g.groupBy("feature").agg(F.sum("g").alias("g"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("g").alias("whole"))))
    held = g.select(F.element_at(names, F.col("feature") + 1).alias("feature"), (F.col("g") / F.col("whole")).alias("importance"))
    every = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return every.join(held, "feature", "left").na.fill(0.0, ["importance"])
