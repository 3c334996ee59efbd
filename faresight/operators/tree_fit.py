"""Fitting deep regression trees and forests (I3, I5) without a dense histogram
for each node.

Spark ML sums, for every node, every bin of every feature in every partition:
with 1024 bins and depth 20 almost all of these sums are of nodes with a
handful of rows. Here a tree is grown in two parts. Nodes of more than
``LOCAL_ROWS`` rows are split level by level: tasks sum the bins that occur,
Spark adds them up by node, and the driver holds only these few nodes. The rows
of each smaller node are then shuffled to one group, which grows the rest of
its subtree from the bins that occur. The work of a level is in proportion to
the rows, whatever the number of nodes.

Bins, stopping rules, gains, the order of equal gains and the merging of equal
leaves are Spark ML's, and the fitted nodes are stored in its format and loaded
as its model. A tree is therefore the one that Spark ML fits wherever its sums
are exact. A forest's bootstrap weights and feature subsets are drawn from
hashes of row, tree and node, and not from Spark ML's generators.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.regression import (DecisionTreeRegressionModel, DecisionTreeRegressor, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from faresight.session import materialize, materialize_counted, scratch_path

LOCAL_ROWS = 1 << 15      # rows of a node whose subtree one group grows
HIST_BYTES = 64 << 20     # sums of nodes that a task holds at once
CHUNK = 1 << 16           # rows walked together
_EPSILON = 2.0 ** -52
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
_NODE = "tree int, node int, feature int, bin int, left int, right int, n double, s double, q double, gain double"


def thresholds(rows: DataFrame, n: int, bins: int, seed: int) -> list[np.ndarray]:
    """Split points of each feature of ``rows`` (x: array), chosen as Spark
    ML does: between all values where there are at most ``bins`` of them, else
    at equal shares of the rows; from max(bins^2, 10000) sampled rows, as there, or all."""
    most, possible = max(bins * bins, 10_000), min(bins, n)
    if n > most:
        rows = rows.sample(most / n, seed)

    def cut(key, v):
        v = v.sort_values("v")
        x, count = v["v"].to_numpy(float), v["n"].to_numpy(float)
        if len(x) <= possible:
            t = (x[1:] + x[:-1]) / 2.0
        else:
            stride, t = count.sum() / possible, []
            upto, aim = np.cumsum(count), count.sum() / possible
            for k in range(1, len(x)):
                if abs(upto[k - 1] - aim) < abs(upto[k] - aim):
                    t.append((x[k - 1] + x[k]) / 2.0)
                    aim += stride
        return pd.DataFrame({"f": key[0], "t": [np.asarray(t, float).tolist()]})

    counts = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["f"]: r["t"] for r in counts.groupBy("f").applyInPandas(cut, "f int, t array<double>").collect()}
    return [np.array(got[f], float) for f in sorted(got)]


def binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(row, b, y): a number for each row, its bins as 16-bit integers, its label."""
    held = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for v in frames:
            x = np.stack(v["x"].to_numpy()) if len(v) else np.zeros((0, len(held.value)))
            b = np.stack([np.searchsorted(t, x[:, f]) for f, t in enumerate(held.value)], 1).astype("<u2")
            yield pd.DataFrame({"row": v["row"], "b": [r.tobytes() for r in b], "y": v["y"]})

    return materialize(rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(run, "row long, b binary, y double"), "bins")


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``frames`` in pieces of some ``CHUNK`` rows."""
    held, n = [], 0
    for v in frames:
        held.append(v)
        n += len(v)
        if n >= CHUNK:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _bins(v: pd.DataFrame, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(v["b"]), "<u2").reshape(-1, features)


def bootstrap(row: np.ndarray, seed: int) -> np.ndarray:
    """How often each row is drawn: Poisson(1) of a hash of row and seed."""
    z = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + 1) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(float) / 2.0 ** 53, "right").astype(float)


def _subsets(key: list[int], nodes: int, features: int, some: int) -> np.ndarray | None:
    """(node, feature) that may be split: ``some`` features a node; none for all."""
    if some >= features:
        return None
    order = np.random.default_rng(key).random((nodes, features)).argsort(1)
    out = np.zeros((nodes, features), bool)
    out[np.arange(nodes)[:, None], order[:, :some]] = True
    return out


class _Best:
    """The best split of each of some nodes, feature after feature."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray, least: float):
        self.n, self.s, self.q, self.least = n, s, q, least
        self.impurity = (q - s * s / n) / n
        self.gain = np.full(len(n), -np.inf)
        self.feature = np.full(len(n), -1)
        self.bin = np.full(len(n), -1)
        self.left = np.zeros((3, len(n)))

    def offer(self, feature: int, node: np.ndarray, bin_: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        """The sums of the bins that occur, in the order of (node, bin)."""
        if not len(node):
            return
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        of = np.cumsum(np.r_[False, node[1:] != node[:-1]])
        left = []
        for v in (n, s, q):                              # wide sums: exact for integers beyond one node's
            c = np.cumsum(v.astype(np.longdouble))
            left.append((c - (c[first] - v[first])[of]).astype(float))
        ln, ls, lq = left
        rn, rs, rq = self.n[node] - ln, self.s[node] - ls, self.q[node] - lq
        may = (ln >= self.least) & (rn >= self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (self.impurity[node] - (ln / (ln + rn)) * ((lq - ls * ls / ln) / ln)
                    - (rn / (ln + rn)) * ((rq - rs * rs / rn) / rn))
        gain[~may] = -np.inf
        at = np.flatnonzero(gain == np.maximum.reduceat(gain, first)[of])
        at = at[np.r_[True, node[at][1:] != node[at][:-1]]]          # the first of equal ones
        at = at[gain[at] > self.gain[node[at]]]
        k = node[at]
        self.gain[k], self.feature[k], self.bin[k] = gain[at], feature, bin_[at]
        self.left[:, k] = ln[at], ls[at], lq[at]


def subtree(b: np.ndarray, y: np.ndarray, w: np.ndarray, level: int, sizes: list[int], depth: int, least: int, some: int,
            key: list[int]) -> dict[str, np.ndarray]:
    """The nodes of the subtree of rows (bins, labels, weights) whose root
    stands at ``level``; node 0 is the root, children follow their parents."""
    out = {c: [] for c in ("feature", "bin", "left", "right", "n", "s", "q", "gain")}
    wy, wyy = w * y, w * y * y
    n, s, q = np.array([w.sum()]), np.array([wy.sum()]), np.array([wyy.sum()])
    at, total, levels = np.zeros(len(y), np.int64), 0, []
    grown, lasting = np.arange(len(y)), np.array([True])
    while len(n):
        k = len(n)
        levels.append((total, total + k))
        best, own = _Best(n, s, q, least), np.flatnonzero(lasting)
        if level < depth and len(own):
            sub = _subsets([*key, level], k, len(sizes), some)
            for f, size in enumerate(sizes):
                rows = grown if sub is None else grown[sub[at, f]]
                if size < 2 or not len(rows):
                    continue
                code = (at if sub is None else at[sub[at, f]]) * size + b[rows, f]
                order = np.argsort(code)
                code, rows = code[order], rows[order]
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                best.offer(f, code[first] // size, code[first] % size, *(np.add.reduceat(v[rows], first) for v in (w, wy, wyy)))
        split = lasting & (best.gain > 0)
        child = total + k + 2 * (np.cumsum(split) - 1)
        for c, v in (("feature", np.where(split, best.feature, -1)), ("bin", np.where(split, best.bin, -1)),
                     ("left", np.where(split, child, -1)), ("right", np.where(split, child + 1, -1)),
                     ("n", n), ("s", s), ("q", q), ("gain", np.where(split, best.gain, -1.0))):
            out[c].append(v)
        stays = split[at]
        grown, at = grown[stays], at[stays]
        goes_right = b[grown, best.feature[at]] > best.bin[at]
        at = 2 * (np.cumsum(split) - 1)[at] + goes_right
        total, level, k = total + k, level + 1, 2 * int(split.sum())
        ln, ls, lq = best.left[:, split]
        n, s, q = (np.stack([a, v[split] - a], 1).ravel() for a, v in ((ln, n), (ls, s), (lq, q)))
        lasting = (np.abs((q - s * s / n) / n) >= _EPSILON) & (level < depth)
        kept = lasting[at]
        grown, at = grown[kept], at[kept]
    nodes = {c: np.concatenate(v) for c, v in out.items()}
    value, keep = nodes["s"] / nodes["n"], np.ones(total, bool)
    for a, z in levels[::-1]:                            # two leaves of one value are one leaf
        p = a + np.flatnonzero(nodes["left"][a:z] >= 0)
        l, r = nodes["left"][p], nodes["right"][p]
        same = (nodes["left"][l] < 0) & (nodes["left"][r] < 0) & (value[l] == value[r])
        keep[l[same]] = keep[r[same]] = False
        value[p[same]] = value[l[same]]
        for c in ("feature", "bin", "left", "right", "gain"):
            nodes[c][p[same]] = -1
    number = np.cumsum(keep) - 1
    for c in ("left", "right"):
        nodes[c] = np.where(nodes[c] >= 0, number[nodes[c]], -1)
    return {c: v[keep] for c, v in nodes.items()}


def _walk(tree: dict, b: np.ndarray) -> np.ndarray:
    """The node of the upper tree that each row reaches."""
    at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(tree["levels"]):
        f = tree["feature"][at]
        goes = np.where(b[rows, np.maximum(f, 0)] <= tree["bin"][at], tree["left"][at], tree["right"][at])
        at = np.where(f >= 0, goes, at)
    return at


def grow(train: DataFrame, features: str = "features", label: str = "label", trees: int = 1, depth: int = 20, least: int = 2,
         bins: int = 1024, some: int | None = None, seed: int = 42, bagged: bool = False) -> DataFrame:
    """The nodes of ``trees`` trees (``_NODE`` with threshold): 0 is a tree's
    root, children have larger numbers. ``some`` features may be split in a
    node (all), and with ``bagged`` each tree has weights of its own."""
    from pyspark.ml.functions import vector_to_array
    spark = train.sparkSession
    y = F.col(label).cast("double")
    y = F.when(F.abs(y) < math.inf, y).otherwise(F.raise_error(F.lit("labels must be finite numbers")).cast("double"))
    rows, n = materialize_counted(train.select(vector_to_array(features).alias("x"), y.alias("y")), "train")
    if not n:
        raise ValueError("no rows to fit a tree on")
    cuts = thresholds(rows, n, bins, seed)
    data, sizes, some = binned(rows, cuts), [len(t) + 1 for t in cuts], some or len(cuts)
    begin, wide = np.cumsum([0, *sizes]), sum(sizes)
    at_once = max(1, HIST_BYTES // (24 * wide))

    # the upper trees: plain lists on the driver
    upper = [{"feature": [-1], "bin": [-1], "left": [-1], "right": [-1], "level": [0], "n": [None], "s": [0.0], "q": [0.0],
              "gain": [-1.0], "open": [True], "levels": 0} for _ in range(trees)]

    def arrays(which) -> dict[int, dict]:
        return {t: {**{c: np.array(upper[t][c]) for c in ("feature", "bin", "left", "right")}, "levels": upper[t]["levels"]}
                for t in which}

    def weights(row: np.ndarray, t: int) -> np.ndarray:
        return bootstrap(row, seed + t) if bagged else np.ones(len(row))

    def split(slots: list[tuple[int, int]]) -> list[Row]:
        subs = [_subsets([seed + t, 0, k], 1, len(sizes), some) for t, k in slots]
        held = spark.sparkContext.broadcast((arrays({t for t, _ in slots}), slots, subs))

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shape, slots, subs = held.value
            slot_of = {t: np.full(len(shape[t]["feature"]), -1) for t in shape}
            for i, (t, k) in enumerate(slots):
                slot_of[t][k] = i
            whole = np.zeros((3, len(slots) * wide))
            for v in _chunks(frames):
                b, row, y = _bins(v, len(sizes)), v["row"].to_numpy(), v["y"].to_numpy()
                for t in shape:
                    w = weights(row, t)
                    slot = slot_of[t][_walk(shape[t], b)]
                    own = np.flatnonzero((slot >= 0) & (w > 0))
                    if not len(own):
                        continue
                    slot, w, yy = slot[own], w[own], y[own]
                    lo, hi = int(slot.min()), int(slot.max()) + 1
                    code = ((slot - lo)[:, None] * wide + begin[:-1] + b[own]).ravel()
                    for held_, value in zip(whole, (w, w * yy, w * yy * yy)):
                        held_[lo * wide:hi * wide] += np.bincount(code, np.repeat(value, len(sizes)), (hi - lo) * wide)
            some_ = np.flatnonzero(whole[0])
            if len(some_):
                place = some_ % wide
                f = np.searchsorted(begin, place, "right") - 1
                yield pd.DataFrame({"slot": some_ // wide, "f": f, "bin": place - begin[f], "n": whole[0, some_],
                                    "s": whole[1, some_], "q": whole[2, some_]})

        def pick(key, v):
            sub, v = held.value[2][key[0]], v.sort_values(["f", "bin"])
            one = v[v["f"] == v["f"].iloc[0]]
            n, s, q = (np.array([one[c].sum()]) for c in "nsq")
            best = _Best(n, s, q, least)
            for f, g in v.groupby("f"):
                if sub is None or sub[0, f]:
                    best.offer(f, np.zeros(len(g), np.int64), *(g[c].to_numpy() for c in ("bin", "n", "s", "q")))
            return pd.DataFrame({"slot": key[0], "n": n, "s": s, "q": q, "feature": best.feature, "bin": best.bin,
                                 "gain": best.gain, "ln": best.left[0], "ls": best.left[1], "lq": best.left[2]})

        got = data.mapInPandas(sums, "slot int, f int, bin int, n double, s double, q double").groupBy("slot", "f", "bin").agg(
            *[F.sum(c).alias(c) for c in "nsq"])
        return got.groupBy("slot").applyInPandas(pick, "slot int, n double, s double, q double, feature int, bin int, gain double, "
                                                       "ln double, ls double, lq double").collect()       # one row a node

    wait = [(t, 0) for t in range(trees)] if n > LOCAL_ROWS else []
    while wait:
        following = []
        for a in range(0, len(wait), at_once):
            slots = wait[a:a + at_once]
            for r in sorted(split(slots), key=lambda r: r["slot"]):
                t, k = slots[r["slot"]]
                u = upper[t]
                if k == 0:
                    u["n"][0], u["s"][0], u["q"][0] = r["n"], r["s"], r["q"]
                u["open"][k] = False
                if not r["gain"] > 0:
                    continue
                level = u["level"][k] + 1
                u["feature"][k], u["bin"][k], u["gain"][k], u["levels"] = r["feature"], r["bin"], r["gain"], max(u["levels"], level)
                for side, sums_ in (("left", (r["ln"], r["ls"], r["lq"])), ("right", tuple(r[c] - r["l" + c] for c in "nsq"))):
                    cn, cs, cq = sums_
                    u[side][k] = len(u["n"])
                    lasts = abs((cq - cs * cs / cn) / cn) >= _EPSILON and level < depth
                    for c, v in (("feature", -1), ("bin", -1), ("left", -1), ("right", -1), ("level", level), ("n", cn), ("s", cs),
                                 ("q", cq), ("gain", -1.0), ("open", lasts)):
                        u[c].append(v)
                    if lasts and cn > LOCAL_ROWS:
                        following.append((t, u[side][k]))
        wait = following

    roots = [(t, k) for t in range(trees) for k, o in enumerate(upper[t]["open"]) if o]
    held = spark.sparkContext.broadcast((arrays(range(trees)), roots, [upper[t]["level"][k] for t, k in roots]))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape, roots, _ = held.value
        slot_of = {t: np.full(len(shape[t]["feature"]), -1) for t in shape}
        for i, (t, k) in enumerate(roots):
            slot_of[t][k] = i
        for v in _chunks(frames):
            b, row = _bins(v, len(sizes)), v["row"].to_numpy()
            for t in shape:
                w = weights(row, t)
                slot = slot_of[t][_walk(shape[t], b)]
                own = np.flatnonzero((slot >= 0) & (w > 0))
                if len(own):
                    yield pd.DataFrame({"slot": slot[own], "b": v["b"].to_numpy()[own], "y": v["y"].to_numpy()[own], "w": w[own]})

    def finish(key, v):
        _, roots, levels = held.value
        t, k = roots[key[0]]
        got = subtree(_bins(v, len(sizes)), v["y"].to_numpy(), v["w"].to_numpy(), levels[key[0]], sizes, depth, least, some,
                      [seed + t, 1, k])
        return pd.DataFrame({"slot": key[0], "local": np.arange(len(got["n"])), **got})

    tasks = max(spark.sparkContext.defaultParallelism * 2, math.ceil(n * trees / LOCAL_ROWS / 4))
    low = materialize(
        data.mapInPandas(deal, "slot int, b binary, y double, w double").repartition(tasks, "slot").groupBy("slot").applyInPandas(
            finish, "slot int, local int, feature int, bin int, left int, right int, n double, s double, q double, gain double"),
        "subtrees")

    # numbers: the upper nodes that stay, then the subtrees one after the other
    size = {r["slot"]: r["count"] for r in low.groupBy("slot").count().collect()}        # one row a subtree
    top, place, number = [], [], [{} for _ in range(trees)]
    for t, u in enumerate(upper):
        mine = [k for k in range(len(u["n"])) if not u["open"][k]]
        number[t] = {k: i for i, k in enumerate(mine)}
        upto = len(mine)
        for i, (t2, k) in enumerate(roots):
            if t2 == t:
                number[t][k] = upto
                if i not in size:                        # a tree that drew no row: one leaf of them all
                    all_ = rows.agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).first()
                    top.append((t, upto, -1, -1, -1, -1, float(n), all_["s"], all_["q"], -1.0))
                    continue
                place.append((i, t, upto))
                upto += size[i]
        for k in mine:
            side = [number[t][u[c][k]] if u["feature"][k] >= 0 else -1 for c in ("left", "right")]
            top.append((t, number[t][k], int(u["feature"][k]), int(u["bin"][k]), *side, *(float(u[c][k]) for c in ("n", "s", "q", "gain"))))
    at = spark.createDataFrame(place, "slot int, tree int, base int")
    low = low.join(F.broadcast(at), "slot")
    inner = F.col("left") >= 0
    nodes = low.select("tree", (F.col("base") + F.col("local")).alias("node"), "feature", "bin",
                       *[F.when(inner, F.col(c) + F.col("base")).otherwise(F.lit(-1)).alias(c) for c in ("left", "right")],
                       "n", "s", "q", "gain").unionByName(spark.createDataFrame(top, _NODE))
    points = spark.createDataFrame([(f, i, float(x)) for f, t in enumerate(cuts) for i, x in enumerate(t)] or [(-2, -2, 0.0)],
                                   "feature int, bin int, threshold double")          # at most bins a feature
    return nodes.join(F.broadcast(points), ["feature", "bin"], "left")


def _metadata(est, kind: str, uid: str, skip=(), **more) -> str:
    own = {p.name: est.getOrDefault(p) for p in est.params if est.isSet(p) and p.name not in skip}
    usual = {p.name: est.getOrDefault(p) for p in est.params if est.hasDefault(p) and not est.isSet(p) and p.name not in skip}
    return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000),
                       "uid": uid, "paramMap": own, "defaultParamMap": usual, **more})


def _store(est, nodes: DataFrame, features: int, trees: int | None) -> str:
    """The nodes in Spark ML's format."""
    spark = nodes.sparkSession
    path, version = scratch_path(spark, f"model-{uuid.uuid4().hex}"), {"sparkVersion": spark.version}
    inner = F.col("left") >= 0
    node = F.struct(
        F.col("node").alias("id"), (F.col("s") / F.col("n")).alias("prediction"),
        ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.col("n")).alias("impurity"),
        F.array("n", "s", "q").alias("impurityStats"), F.col("n").cast("long").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.when(inner, F.col("feature")).otherwise(F.lit(-1)).alias("featureIndex"),
                 F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split"))
    if trees is None:
        nodes.select(node.alias("d")).select("d.*").write.parquet(f"{path}/data")
        about = _metadata(est, "DecisionTreeRegressionModel", est.uid, numFeatures=features, **version)
    else:
        nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")
        plain = ("numTrees", "subsamplingRate", "featureSubsetStrategy", "bootstrap")
        each = [(t, _metadata(est, "DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", plain, **version), 1.0)
                for t in range(trees)]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        about = _metadata(est, "RandomForestRegressionModel", est.uid, numFeatures=features, numTrees=trees, **version)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return path


def _loaded(kind, path: str):
    """The stored model, with its place: ``trees.node_table`` reads that again."""
    model = kind.load(path)
    model.stored_at = path
    return model


def _plain(est, train: DataFrame) -> bool:
    """Whether the settings and the features are those handled here."""
    attrs = train.schema[est.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    weighted = est.hasParam("weightCol") and est.isSet("weightCol") and est.getOrDefault("weightCol")
    share = est.getOrDefault("subsamplingRate") if est.hasParam("subsamplingRate") else 1.0
    return not (weighted or "nominal" in attrs or "binary" in attrs or share != 1.0 or est.getMinInfoGain() != 0.0
                or est.getOrDefault("minWeightFractionPerNode") != 0.0)


def _settings(est) -> dict:
    return dict(features=est.getFeaturesCol(), label=est.getLabelCol(), depth=est.getMaxDepth(), least=est.getMinInstancesPerNode(),
                bins=est.getMaxBins(), seed=est.getSeed())


def _features(train: DataFrame, column: str) -> int:
    return train.select(column).first()[0].size


class GrownTree(DecisionTreeRegressor):
    """``DecisionTreeRegressor`` whose fit is ``grow``."""

    def _fit(self, dataset):
        if not _plain(self, dataset):
            return super()._fit(dataset)
        nodes = grow(dataset, **_settings(self))
        return _loaded(DecisionTreeRegressionModel, _store(self, nodes, _features(dataset, self.getFeaturesCol()), None))


class GrownForest(RandomForestRegressor):
    """``RandomForestRegressor`` whose fit is ``grow``."""

    def _grown(self, dataset) -> tuple[DataFrame, int] | None:
        """The nodes and the number of features; none where Spark ML fits."""
        some = {"sqrt": lambda f: math.ceil(math.sqrt(f)), "all": lambda f: f, "onethird": lambda f: math.ceil(f / 3.0),
                "log2": lambda f: max(1, math.ceil(math.log2(f)))}.get(self.getFeatureSubsetStrategy())
        if not _plain(self, dataset) or some is None:
            return None
        features = _features(dataset, self.getFeaturesCol())
        return grow(dataset, trees=self.getNumTrees(), some=some(features), bagged=self.getBootstrap(), **_settings(self)), features

    def _fit(self, dataset):
        got = self._grown(dataset)
        if got is None:
            return super()._fit(dataset)
        return _loaded(RandomForestRegressionModel, _store(self, *got, self.getNumTrees()))

    def fit_parts(self, dataset, most: int) -> Iterator[RandomForestRegressionModel]:
        """The forest as models of consecutive trees, of ``most`` nodes each or
        one tree, loaded one after the other. It is grown once."""
        got = self._grown(dataset)
        if got is None:
            yield super()._fit(dataset)
            return
        nodes, features = got
        size = {r["tree"]: r["count"] for r in nodes.groupBy("tree").count().collect()}      # one row a tree
        first, trees = 0, self.getNumTrees()
        while first < trees:
            end = first + 1
            while end < trees and sum(size[t] for t in range(first, end + 1)) <= most:
                end += 1
            own = nodes.where(F.col("tree").between(first, end - 1)).withColumn("tree", F.col("tree") - first)
            path = _store(self.copy({self.numTrees: end - first}), own, features, end - first)
            yield _loaded(RandomForestRegressionModel, path)
            first = end
