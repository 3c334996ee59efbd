"""MinHash near-duplicate detection.

A text is the set of its distinct word shingles (five words; a shorter text
is one shingle). Each set gets many universal-hash minima; bands of them are
bucket keys. Texts with equal sets are one candidate from there on. In each
bucket the smallest member is compared with all others first; buckets that
are still in several components after that are compared in blocks, so no
link between different texts is lost and no bucket's pairs are all written.
A pair is checked by its signatures and then confirmed on the full shingle
sets; links form components by alternating large-star and small-star.

With 32 bands of 4 minima, a pair at similarity 0.75 meets in no band with
probability 5e-6. Shingles are compared by 64-bit fingerprints.

Defined results: a null or blank text has no shingles and links with
nothing; rows that repeat an id each give a row, and are one document that
links by any of their texts; a null id links with nothing and is kept; an
empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import map_arrow, materialize, materialize_counted, small, table
from faresight.llm.components import components
from faresight.llm.words import SPACED, Words, sequence_hashes

SHINGLE = 5
THRESHOLD = 75            # per cent: 100 * common >= 75 * union
BANDS, ROWS = 32, 4
#: Pairs whose signatures agree in fewer places than this share of the
#: threshold's mean less 5 deviations are no links.
SLACK = 5.0
BLOCK = 512               # members of a bucket that are compared at once

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_C = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle fingerprints of a text's word fingerprints."""
    if not len(h):
        return np.zeros(0, np.uint64)
    s = np.sort(sequence_hashes(h, min(n, len(h))))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def minima(s: np.ndarray) -> np.ndarray:
    """The signature: the minimum of each universal hash over the set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        part = x[a:a + 1024]
        np.minimum(out, (_A[:, None] * part[None, :] + _C[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, sig): one pass over the texts."""

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column(1), SPACED)
        h = w.hashes()
        n, digest, sig = [], [], []
        for i in range(b.num_rows):
            s = shingle_set(h[w.first[i]:w.first[i + 1]], shingle)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(minima(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                           pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), sign,
                     "doc_id long, n_shingles long, digest binary, sig binary")


def band_keys(reps: DataFrame) -> DataFrame:
    """(rep, band, key) for each band of a signature."""
    width = 4 * ROWS
    return reps.select("rep", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(F.col("sig").substr(i * width + 1, F.lit(width)), i))).alias("band", "key"))


def _agreement() -> float:
    t = THRESHOLD / 100
    return t - SLACK * (t * (1 - t) / (BANDS * ROWS)) ** 0.5


def shared_buckets(keys: DataFrame) -> DataFrame:
    """(key, rep, band, lead) of buckets with several members; lead: the smallest."""
    first = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    return keys.join(first.select("key", "lead"), "key")


def signature_check(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree often enough."""
    least = _agreement()

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
        ok = pa.array((x == y).mean(axis=1) >= least)
        return pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    sig = reps.select("rep", "sig")
    both = (pairs.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a").select("a", "b", "sig_a", "sig_b"))
    return map_arrow(both, check, "a long, b long")


def full_sets(ids: DataFrame, n: int, docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, shingles) of at most ``n`` ids, from their whole texts."""

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column(1), SPACED)
        h = w.hashes()
        out = [shingle_set(h[w.first[i]:w.first[i + 1]], shingle).tobytes() for i in range(b.num_rows)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "shingles"])

    texts = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
             .join(small(ids, n, 16), "doc_id", "left_semi"))
    return materialize(map_arrow(texts, sets, "doc_id long, shingles binary"), "near_sets")


def shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of others."""
    y = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
    return np.add.reduceat(hit, np.cumsum([0, *(len(o) for o in others[:-1])]), dtype=np.int64)


def block_links(buckets: DataFrame, comps: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str,
                shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Links (u, v) between components within buckets that hold more than
    one, beside those of the bucket's first member.

    Members are dealt into blocks by a hash, and each pair of blocks is one
    group: a group holds some 2 * BLOCK rows, whatever the bucket's size. It
    tests the pairs that meet in no earlier band, by signature, then on the
    full sets, and passes on a spanning forest of the links it finds."""
    least = _agreement()
    marked = (buckets.join(comps, buckets.rep == comps.node, "left")
              .select("key", "band", "rep", "lead", F.coalesce("component", "rep").alias("component")))
    mixed = (marked.where("rep > lead").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        .where("c0 < c1").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    rows, n = materialize_counted(marked.where("rep > lead").join(mixed, "key").select(
        "key", "band", "rep", "component", "blocks"), "near_mixed")
    if not n:
        return docs.sparkSession.createDataFrame([], "u long, v long")
    sets = full_sets(rows.select(F.col("rep").alias("doc_id")).distinct(), n, docs, doc_id, text, shingle)
    rows = (rows.withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("key", "band", "rep", "component", F.least("mine", "other").alias("i"),
                    F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left")))
    rows = rows.join(reps, "rep").join(sets, rows.rep == sets.doc_id).drop("doc_id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), -1)
        own = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        size = np.array([len(s) for s in own])
        rep, comp, band = group["rep"].to_numpy(), group["component"].to_numpy().copy(), group["band"].iloc[0]
        same = group["i"].iloc[0] == group["j"].iloc[0]
        left = group["left"].to_numpy()
        one = np.arange(len(group)) if same else np.flatnonzero(left)
        two = np.arange(len(group)) if same else np.flatnonzero(~left)
        links = []
        for x in one:
            y = two[comp[two] != comp[x]]
            y = y[rep[y] > rep[x]] if same else y
            y = y[100 * np.minimum(size[y], size[x]) >= threshold * np.maximum(size[y], size[x])]
            if not len(y):
                continue
            agree = sig[y] == sig[x]
            ok = (agree.mean(axis=1) >= least) & (agree.reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1) == band)
            y = y[ok]
            if not len(y):
                continue
            common = shared(own[x], [own[k] for k in y])
            for k in y[100 * common >= threshold * (size[x] + size[y] - common)]:
                if comp[k] != comp[x]:
                    links.append((rep[x], rep[k]))
                    comp[comp == comp[k]] = comp[x]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long")


def confirm(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE,
            threshold: int = THRESHOLD) -> DataFrame:
    """Pairs whose full shingle sets meet the threshold: only the texts of
    the pairs' members are read into sets, and one set a pair is shuffled."""
    pairs, n = materialize_counted(pairs, "near_pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    members = full_sets(ids, 2 * n, docs, doc_id, text, shingle)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int(shared(x, [y])[0]) if len(x) and len(y) else 0
                ok.append(common > 0 and 100 * common >= threshold * (len(x) + len(y) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    both = (pairs.join(members.toDF("b", "set_b"), "b").join(members.toDF("a", "set_a"), "a")
            .select("a", "b", "set_a", "set_b"))
    return both.mapInArrow(check, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest
    id reachable by links), kept (doc_id = component_id)."""
    rows = materialize(signatures(docs, doc_id, text, shingle), "near_signatures")
    known = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")),
                          "near_classes")
    reps = classes.select("rep", "sig")
    buckets = materialize(shared_buckets(band_keys(reps)), "near_buckets")
    first = buckets.where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(confirm(signature_check(first, reps), docs, doc_id, text, shingle, threshold), "near_links")

    member = known.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest")
    member = materialize(member.select("doc_id", "n_shingles", "rep"), "near_members")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last")
    same = member.join(several, "doc_id").select(F.col("rep").alias("u"), "v")

    comps = materialize(components(links.unionByName(same)), "near_components")
    more = materialize(block_links(buckets, comps, reps, docs, doc_id, text, shingle, threshold), "near_links")
    if not more.isEmpty():
        comps = materialize(components(
            comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "near_components")
    linked = member.join(comps, member.rep == comps.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("doc_id IS NULL OR digest IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component; of rows that repeat a
    kept id, one."""
    found = materialize(near_duplicates(docs, doc_id, text, **options), "near_found")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    twice = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(
        F.col("doc_id").alias("_gone"))
    gone, n = materialize_counted(gone.withColumn("_twice", F.lit(False)).unionByName(
        twice.withColumn("_twice", F.lit(True))), "near_gone")
    key = F.col(doc_id).cast("long")
    left = docs.join(small(gone, n, 16), key == F.col("_gone"), "left")
    once = left.where("_gone IS NULL").select(*docs.columns)
    if gone.where("_twice").isEmpty():
        return once
    return once.unionByName(left.where("_twice").select(*docs.columns).dropDuplicates([doc_id]))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and their components (small tables only).
SQL = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x20\x09-\x0D]+') AS w FROM {documents}),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM low WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s
          JOIN n m ON m.doc_id = x.doc_id JOIN n o ON o.doc_id = y.doc_id
          GROUP BY x.doc_id, y.doc_id, m.n, o.n HAVING 100 * count(*) >= 75 * (m.n + o.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM low UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT low.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id, low.doc_id = comp.component_id AS kept
FROM low LEFT JOIN n ON n.doc_id = low.doc_id JOIN comp ON comp.a = low.doc_id
"""
