"""Embedding near-duplicates by spherical k-means cells.

Vectors are scaled to length 1 in double precision and equal ones collapse
to one class. Cells are the nearest of k centres, fitted on a bounded
sample. A pair can be split by the plane between two centres, and a pair at
cosine ``t`` or above is at most sqrt(2 - 2t) apart, so one of the two is
within half of that of the plane, in whatever direction they differ. Each
vector is therefore also compared in every cell whose plane it is that near
to, and no pair is lost: the exact margin. Most data need far less, so by
default the margin is measured: up to ``QUERIES`` vectors are compared with
all others, and the margin is the smallest step of ``STEPS`` at which each of
their links is found, and one step more. Where fewer than ``LEAST`` of them have
links at all, the exact margin holds. Neighbouring cells are packed into groups of about
``BLOCK`` vectors and large ones split, so that a vector is copied once for a
block and not for each cell: data without any directions of its own, where
most planes are near, costs up to all pairs of blocks. The blocks are
compared by matrix products; each linked pair counts in one group only. Of
each block only link counts and a spanning star of its links are passed on,
and the stars join into components.

Cells are fitted on at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``; every vector is assigned
and compared. A group of any size is split into blocks.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing; only vectors of the same number of
dimensions are compared; equal vectors and repeated rows link with each
other; a null id counts as a vector for none and is kept; an empty table
gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import map_arrow, materialize, table
from faresight.llm.components import components

THRESHOLD = 0.9
SAMPLE = 40_000
SAMPLE_BYTES = 64 << 20   # of the sample as doubles: fewer vectors of very many dimensions
PER_CENTRE = 16           # sampled vectors for each centre, at least
ROUNDS = 8
QUERIES = 2_048           # sampled vectors compared with all to measure the margin
QUERY_BYTES = 16 << 20    # of them as doubles
STEPS = 64                # of the exact margin
LEAST = 64                # sampled vectors with links that a measured margin rests on
BLOCK = 4096              # vectors on each side of a product, about
BLOCK_BYTES = 32 << 20    # of them as doubles


def unit_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, digest, unit): unit is the vector in doubles at length
    1, null for vectors that can't link."""

    def scale(b: pa.RecordBatch) -> pa.RecordBatch:
        dims, digests, units = [], [], []
        for v in b.column(1):
            x = None if not v.is_valid or v.values.null_count or not len(v.values) else v.values.to_numpy(
                zero_copy_only=False).astype(float)
            if x is not None and np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                x = x / top                        # no overflow of squares
                x = x / math.sqrt(float(x @ x))
                dims.append(len(x))
                units.append(x.tobytes())
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            else:
                dims.append(None)
                units.append(None)
                digests.append(None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()),
                                           pa.array(units, pa.binary())], ["vec_id", "dim", "digest", "unit"])

    return map_arrow(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding)), scale,
                     "vec_id long, dim int, digest binary, unit binary")


def centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centres. The first ones are spread over the
    sample; an empty cell takes the vector that fits its own worst."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home, best = np.empty(len(x), int), np.empty(len(x))
        for a in range(0, len(x), 2048):
            s = x[a:a + 2048] @ c.T
            home[a:a + 2048], best[a:a + 2048] = s.argmax(1), s.max(1)
        order = np.argsort(home, kind="stable")
        first = np.searchsorted(home[order], np.arange(k))
        filled = np.flatnonzero(np.diff(np.append(first, len(x))) > 0)
        new = np.zeros_like(c)
        new[filled] = np.add.reduceat(x[order], first[filled], axis=0)
        norm = np.linalg.norm(new, axis=1)
        empty = np.flatnonzero(norm < 1e-9)
        new[empty] = x[np.argsort(best, kind="stable")[:len(empty)]]
        c = new / np.linalg.norm(new, axis=1, keepdims=True)
    return c


def pack(x: np.ndarray, c: np.ndarray, size: int, block: int) -> np.ndarray:
    """The group of each cell, of ``size`` vectors that fall into cells as the
    sample ``x`` does: a chain from each centre to the nearest one left, cut
    where a group would pass ``block`` vectors."""
    held = np.zeros(len(c))
    for a in range(0, len(x), 2048):
        held += np.bincount((x[a:a + 2048] @ c.T).argmax(1), minlength=len(c))
    held *= size / len(x)
    near = c @ c.T
    group, left, at, number, total = np.zeros(len(c), int), np.ones(len(c), bool), 0, 0, 0.0
    for _ in range(len(c)):
        if total and total + held[at] > block:
            number, total = number + 1, 0.0
        group[at], left[at], total = number, False, total + held[at]
        at = int(np.where(left, near[at], -np.inf).argmax())
    return group


def exact_margin(threshold: float = THRESHOLD) -> float:
    """Both ends of a pair look across: half the distance each, and rounding."""
    return math.sqrt(2 - 2 * threshold) / 2 + 1e-9


def needed_steps(classes: DataFrame, c: np.ndarray, group: np.ndarray, threshold: float = THRESHOLD,
                 queries: int = QUERIES) -> pd.DataFrame:
    """(query, step, n): of each sampled vector with links, how many of its
    links with all vectors need which step of the margin to be found."""
    dim = c.shape[1]
    rows = (classes.orderBy(F.xxhash64("digest", F.lit(1)), "rep")
            .limit(max(1, min(queries, QUERY_BYTES // (8 * dim)))).select("rep", "unit").toPandas())
    q = np.frombuffer(b"".join(rows["unit"])).reshape(len(rows), dim)
    held = classes.sparkSession.sparkContext.broadcast((c, group, rows["rep"].to_numpy(), q))
    step = exact_margin(threshold) / STEPS
    known: list[tuple] = []

    def cells(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ c.T
        return s, s.argmax(1)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c, group, names, q = held.value
        if not known:
            known.append(cells(q, c))
        sq, hq = known[0]
        x = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, -1)
        sx, hx = cells(x, c)
        i, j = np.nonzero(x @ q.T >= threshold)
        other = b.column(0).to_numpy()[i] != names[j]
        i, j = i[other], j[other]
        apart = np.sqrt(np.maximum(2 - 2 * (c[hx[i]] * c[hq[j]]).sum(1), 1e-18))
        need = np.minimum(sx[i, hx[i]] - sx[i, hq[j]], sq[j, hq[j]] - sq[j, hx[i]]) / apart
        need[group[hx[i]] == group[hq[j]]] = 0
        at = np.minimum(np.ceil(need / step).astype(np.int64), STEPS)
        found, n = np.unique(j * (STEPS + 1) + at, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names[found // (STEPS + 1)]), pa.array(found % (STEPS + 1)),
                                           pa.array(n.astype(np.int64))], ["query", "step", "n"])

    return (map_arrow(classes.select("rep", "unit"), run, "query long, step long, n long")
            .groupBy("query", "step").agg(F.sum("n").alias("n")).toPandas())    # at most queries * (STEPS + 1) rows


def measured_margin(classes: DataFrame, c: np.ndarray, group: np.ndarray, threshold: float = THRESHOLD) -> float:
    """The margin that finds every link of the sampled vectors, and a step more."""
    most = exact_margin(threshold)
    if group.max() == 0:                           # one group: everything is compared
        return 0.0
    seen = needed_steps(classes, c, group, threshold)
    if seen["query"].nunique() < LEAST:
        return most
    return most * min(STEPS, int(seen["step"].max()) + 1) / STEPS


def assign(classes: DataFrame, c: np.ndarray, group: np.ndarray, margin: float) -> DataFrame:
    """(rep, n, unit, home, groups): the home cell's group and all groups to
    compare in."""
    held = classes.sparkSession.sparkContext.broadcast((c, group))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c, group = held.value
        x = np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(b.num_rows, -1)
        s = x @ c.T
        home = s.argmax(1)
        apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 1e-18))
        near = (s[np.arange(len(x)), home][:, None] - s) <= margin * apart
        near[np.arange(len(x)), home] = True
        order = np.argsort(group, kind="stable")
        first = np.searchsorted(group[order], np.arange(group.max() + 1))
        groups = [np.flatnonzero(r).tolist() for r in np.logical_or.reduceat(near[:, order], first, axis=1)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(group[home].astype(np.int32)),
                                           pa.array(groups, pa.list_(pa.int32()))], ["rep", "n", "unit", "home", "groups"])

    return map_arrow(classes.select("rep", "n", "unit"), run,
                     "rep long, n long, unit binary, home int, groups array<int>")


def _links(ok: np.ndarray, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
    """(rep, links, lead) of the rows p and q that are linked by ``ok``."""
    rows, cols = ok.any(1), ok.any(0)
    ok, p, q = ok[rows][:, cols], p[rows], q[cols]
    n, most = (p["n"].to_numpy(), q["n"].to_numpy()), np.iinfo(np.int64).max
    links = np.zeros(len(p), np.int64), np.zeros(len(q), np.int64)
    lead = p["rep"].to_numpy().copy(), q["rep"].to_numpy().copy()
    for a in range(0, len(p), 256):
        part = ok[a:a + 256]
        links[0][a:a + 256] = part @ n[1]
        links[1][:] += n[0][a:a + 256] @ part
    changed = bool(len(p))
    while changed:
        before = lead[0].copy(), lead[1].copy()
        for a in range(0, len(p), 256):
            part, own = ok[a:a + 256], lead[0][a:a + 256]
            np.minimum(own, np.where(part, lead[1], most).min(1), out=own)
            np.minimum(lead[1], np.where(part, own[:, None], most).min(0), out=lead[1])
        changed = any((x != y).any() for x, y in zip(before, lead))
    return pd.DataFrame({"rep": np.concatenate([p["rep"], q["rep"]]), "links": np.concatenate(links),
                         "lead": np.concatenate(lead)})


def compare(assigned: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """(rep, links, lead) for each vector and pair of blocks in which it has
    links: how many vectors it links with there, and the smallest vector
    that the block's links lead to. A group's own vectors are split into
    blocks; each meets itself (chunk 0) and the other vectors that are to be
    compared in the group, in chunks."""
    block = block or BLOCK
    assigned = materialize(assigned, "vector_cells")
    own = assigned.groupBy("home").agg(F.count(F.lit(1)).alias("own"), F.ceil(F.count(F.lit(1)) / block).alias("splits"))
    seen = assigned.select(F.explode("groups").alias("home")).groupBy("home").agg(F.count(F.lit(1)).alias("seen"))
    sizes = materialize(own.join(seen, "home").select(
        F.col("home").alias("group"), "splits",
        F.ceil((F.col("seen") - F.col("own") / F.col("splits")) / block).alias("chunks")), "vector_groups")
    mine = (F.col("group") == F.col("home")) & (F.col("at") == F.col("split"))
    rows = (assigned.join(F.broadcast(sizes.select(F.col("group").alias("home"), "splits")), "home")     # at most a row a centre
            .select("rep", "n", "unit", "home", "groups", F.pmod(F.xxhash64("rep"), "splits").alias("split"),
                    F.explode("groups").alias("group"))
            .join(F.broadcast(sizes), "group")
            .withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
            .withColumn("mine", mine)
            .withColumn("chunk", F.explode(F.when(F.col("mine"), F.sequence(F.lit(0).cast("long"), F.col("chunks"))).otherwise(
                F.array(1 + F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest("chunks", F.lit(1).cast("long")))))))
            .select("group", "at", "chunk", "mine", "rep", "n", "unit", "home", "split",
                    F.when(F.col("mine"), F.col("groups")).alias("groups")))

    def blocks(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        group, at, chunk = (int(k) for k in key)
        own = g["mine"].to_numpy(bool)
        p, q = g[own], g if chunk == 0 else g[~own]
        if not len(p) or not len(q):
            return pd.DataFrame({"rep": [], "links": [], "lead": []}).astype("int64")
        x, y = (np.frombuffer(b"".join(t["unit"])).reshape(len(t), -1) for t in (p, q))
        ok = np.empty((len(p), len(q)), bool)
        for a in range(0, len(p), 256):
            ok[a:a + 256] = x[a:a + 256] @ y.T >= threshold
        if chunk == 0:
            np.fill_diagonal(ok, False)
            found = _links(ok, p, q)
            return found.iloc[:len(found) // 2]    # both sides are the same
        # found in two groups' blocks: the lower one counts it
        home, split = q["home"].to_numpy(), q["split"].to_numpy()
        lower = np.flatnonzero((home < group) | (home == group) & (split < at))
        names = np.unique(home[lower])
        there = np.zeros((len(p), len(names)), bool)
        if len(names):
            row, listed = np.repeat(np.arange(len(p)), p["groups"].map(len)), np.concatenate(p["groups"].to_list())
            where = np.minimum(np.searchsorted(names, listed), len(names) - 1)
            hit = names[where] == listed
            there[row[hit], where[hit]] = True
        ok[:, lower] &= ~there[:, np.searchsorted(names, home[lower])]
        return _links(ok, p, q)

    return rows.groupBy("group", "at", "chunk").applyInPandas(blocks, "rep long, links long, lead long")


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                           threshold: float = THRESHOLD, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. ``exact``:
    whether the margin is the one that can't lose a pair."""
    rows = materialize(unit_vectors(vectors, vec_id, embedding), "vectors")
    known = rows.where("vec_id IS NOT NULL AND unit IS NOT NULL")
    classes = materialize(known.groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("unit").alias("unit"),
        F.any_value("dim").alias("dim")), "vector_classes")
    found = None
    for dim, size in classes.groupBy("dim").count().orderBy("dim").collect():      # usually one
        own = classes.where(F.col("dim") == dim)
        most = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
        k = max(1, min(math.ceil(math.sqrt(size)), most // PER_CENTRE))
        got = own.orderBy(F.xxhash64("digest"), "rep").limit(min(most, 64 * k)).select("unit").toPandas()["unit"]
        x = np.frombuffer(b"".join(got)).reshape(len(got), -1)
        c, block = centres(x, k), max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))
        group = pack(x, c, size, block)
        margin = exact_margin(threshold) if exact else measured_margin(own, c, group, threshold)
        part = compare(assign(own, c, group, margin), threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = materialize(found, "vector_links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("u"), F.col("lead").alias("v")).unionByName(
        _several(known, classes)))
    per_class = (classes.select("digest", "rep", "n").join(links, "rep", "left").join(comps, classes.rep == comps.node, "left")
                 .select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id")))
    linked = known.select("vec_id", "digest").join(per_class, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec_id IS NULL OR unit IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _several(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of an id that has several vectors."""
    member = known.select("vec_id", "digest").join(classes.select("digest", "rep"), "digest").select("vec_id", "rep")
    twice = member.groupBy("vec_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last")
    return member.join(twice, "vec_id").select(F.col("rep").alias("u"), "v")


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs in double precision, and their components (small tables only).
SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM {embeddings}),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_sum([x * x FOR x IN e]) > 0
      AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
