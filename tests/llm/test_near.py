"""Components, near-duplicates and vectors against brute force."""

import random

import numpy as np
import pytest

from faresight.llm import components as cc
from faresight.llm import embeddings, minhash


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {"random": [(r.randrange(300), r.randrange(300)) for _ in range(180)],
             "path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(200)]}[kind]
    edges += [(7, 7), edges[0], edges[0][::-1]]
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    got = {x["node"]: x["component"] for x in cc.components(df).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in closure(linked, [e for e in edges if e[0] != e[1]]).items()}
    assert cc.components(df.limit(0)).count() == 0


def texts():
    """Groups of near copies at many similarities, chains and look-alikes."""
    r, out = random.Random(5), []
    for g in range(12):
        base = [f"g{g}w{r.randrange(500)}" for _ in range(r.choice([6, 40, 150]))]
        for _ in range(20):
            t = base[:]
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(t))
    chain = [f"c{i}" for i in range(100)]
    for i in range(25):                             # neighbours link, ends don't
        chain[(4 * i) % 100] = f"n{i}"
        out.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))  # shared passage at under 0.75
    out += [passage + " " + " ".join(f"q{j}{i}" for i in range(25)) for j in range(60)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [8, minhash.BLOCK])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = list(enumerate(texts()))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    links = [(i, j) for i in sets for j in sets if i < j
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = closure(sets, links)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(500, 24))
    near = [b + s * r.normal(size=24) * np.linalg.norm(b) / 24 ** 0.5 for b in base[:250] for s in (0.05, 0.3, 0.42)]
    hot = [base[0] * (1 + i) for i in range(300)] + [base[1] + 0.02 * r.normal(size=24) for _ in range(300)]
    x = np.concatenate([base, near, hot])
    r.shuffle(x)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, 0)
    links = sim >= 0.9
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= links.sum(1)).all()            # none below the threshold
    assert found.sum() >= 0.99 * links.sum()        # recall
    want = closure(range(len(x)), np.argwhere(links).tolist())
    assert np.mean([got[i]["component_id"] == want[i] for i in want]) > 0.99


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    test_vectors_against_all_pairs(spark)


@pytest.mark.parametrize("dim,scale", [(64, lambda i: np.where(i < 8, 1, 1e-3)), (384, lambda i: (i + 1.0) ** -0.8)])
def test_vectors_of_few_directions(spark, dim, scale):
    r = np.random.default_rng(4)
    own = scale(np.arange(dim))
    base = r.normal(size=(1500, dim)) * own
    x = np.concatenate([base, base + r.uniform(0.1, 0.45, size=(1500, 1)) * r.normal(size=base.shape) * own])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.triu(u @ u.T >= 0.9, 1).sum()
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg({"n_links": "sum"}).first()[0] == 2 * links > 2000


def test_vectors_of_few_directions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    test_vectors_of_few_directions(spark, 64, lambda i: np.where(i < 8, 1, 1e-3))


def test_measured_and_exact_margins(spark, monkeypatch):
    """Vectors without directions of their own: the measured margin is a small
    part of the exact one and finds the same links."""
    monkeypatch.setattr(embeddings, "BLOCK", 256)
    r = np.random.default_rng(6)
    base = r.normal(size=(2000, 64))
    x = np.concatenate([base, base[:400] + r.uniform(0.05, 0.4, size=(400, 1)) * r.normal(size=(400, 64))])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<double>").repartition(3)
    margins, assign = [], embeddings.assign
    monkeypatch.setattr(embeddings, "assign", lambda *a: margins.append(a[-1]) or assign(*a))
    want, got = (sorted(embeddings.near_duplicate_vectors(rows, exact=e).collect()) for e in (True, False))
    assert margins[0] == embeddings.exact_margin() > 3 * margins[1] > 0
    missed = sum(a["n_links"] - b["n_links"] for a, b in zip(want, got))
    assert all(a["n_links"] >= b["n_links"] for a, b in zip(want, got))
    assert missed <= 0.01 * sum(a["n_links"] for a in want)
    # too few links to measure by: the exact margin
    monkeypatch.setattr(embeddings, "LEAST", 10_000)
    assert sorted(embeddings.near_duplicate_vectors(rows).collect()) == want and margins[2] == margins[0]
