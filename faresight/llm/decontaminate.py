"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words is one window). A document contains a window when its
words occur in it in order. A window is a set of shingles (runs of up to
``shingle`` words); since all of them must occur, the necessary prefix is
its one rarest shingle by corpus count. Documents are matched on those
prefix shingles only; the shingle's offset in the window then fixes where
the window would begin and end (positional and length bound), and the words
there are compared in full.

Defined results: a null text or an item without words matches nothing; an
item text that is repeated counts for each of its ids; repeated document
rows each give a row; an empty benchmark or corpus gives no hits. Other
columns are passed through; output names that clash get a leading ``_``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import BROADCAST_BYTES, aside, map_arrow, materialize, table
from faresight.llm.words import ALNUM, Words, sequence_hashes

WINDOW = 10
SHINGLE = 3
#: Windows of one pass: about 250 bytes each as a Python broadcast. A larger
#: benchmark is matched block by block over the same rows.
BLOCK = BROADCAST_BYTES // 256


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text",
                      window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: words (joined by spaces), n, shingles (their 64-bit
    fingerprints by offset) and the ids of the items that hold them."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column(1), ALNUM)
        h = w.hashes()
        ids, texts, sizes, shingles = [], [], [], []
        for i, item in enumerate(b.column(0).to_pylist()):
            a, z = int(w.first[i]), int(w.first[i + 1])
            n = min(window, z - a)
            if item is None or n < 1:
                continue
            s = sequence_hashes(h[a:z], min(shingle, n)).view(np.int64)
            for k in range(z - a - n + 1):
                ids.append(str(item))
                texts.append(w.joined(a + k, a + k + n).decode("utf-8", "replace"))
                sizes.append(n)
                shingles.append(s[k:k + n - min(shingle, n) + 1].tolist())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()),
             pa.array(shingles, pa.list_(pa.int64()))], ["item", "words", "n", "shingles"])

    cuts = map_arrow(items.select(item_id, text), cut, "item string, words string, n int, shingles array<long>")
    return cuts.groupBy("words", "n", "shingles").agg(F.array_sort(F.collect_set("item")).alias("items"))


def shingle_counts(docs: DataFrame, text: str, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(shingle, count) over all documents, of the windows' shingles. Blocks
    of the windows' shingles are looked up in each batch; counts are summed
    per batch first."""
    spark = docs.sparkSession
    keys = materialize(windows.select(F.least(F.lit(shingle), F.col("n")).alias("k"),
                                      F.explode("shingles").alias("shingle")).distinct(), "leak_shingles")
    parts = max(1, -(-keys.count() // (BROADCAST_BYTES // 8)))
    found = None
    for part in range(parts):
        rows = (keys if parts == 1 else keys.where(F.pmod("shingle", F.lit(parts)) == part)).toPandas()
        held = spark.sparkContext.broadcast({
            int(k): np.sort(g["shingle"].to_numpy().view(np.uint64)) for k, g in rows.groupby("k")})

        def count(b: pa.RecordBatch, held=held) -> pa.RecordBatch | None:
            w = Words(b.column(0), ALNUM)
            h, at, ns = w.hashes(), [], []
            for k, known in held.value.items():
                s = sequence_hashes(h, k)
                s = s[_whole(w, len(s), k)]
                i = np.searchsorted(known, s)
                i = i[known[np.minimum(i, len(known) - 1)] == s]
                n = np.bincount(i, minlength=len(known))
                at.append(known[n > 0])
                ns.append(n[n > 0])
            if not at:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).view(np.int64)),
                                               pa.array(np.concatenate(ns).astype(np.int64))], ["shingle", "n"])

        got = map_arrow(docs.select(text), count, "shingle long, n long")
        found = got if found is None else found.unionByName(got)
    return found.groupBy("shingle").agg(F.sum("n").alias("count"))


def _whole(w: Words, n: int, k: int) -> np.ndarray:
    """Which of the n runs of k words lie inside one text."""
    ok = np.ones(n, bool)
    for e in range(1, k):
        cut = w.first[1:-1] - e
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


class Matcher:
    """A block of windows by prefix shingle, and its matches in batches."""

    def __init__(self, rows: list[tuple]):
        #: rows: (words, n, offset of the prefix, k, prefix shingle, items)
        self.rows = rows
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {r[3] for r in rows}:
            idx = np.array([i for i, r in enumerate(rows) if r[3] == k])
            key = np.array([rows[i][4] for i in idx], np.int64).view(np.uint64)
            order = np.argsort(key, kind="stable")
            self.keys[k] = (key[order], idx[order])
        self.n = np.array([r[1] for r in rows], np.int64)
        self.offset = np.array([r[2] for r in rows], np.int64)
        self.bytes = [r[0].encode() for r in rows]

    def match(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each verified occurrence."""
        owner_first = w.first
        starts, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (key, idx) in self.keys.items():
            s = sequence_hashes(h, k)
            lo, hi = np.searchsorted(key, s, "left"), np.searchsorted(key, s, "right")
            pos = np.flatnonzero(hi > lo)
            if not len(pos):
                continue
            times = (hi - lo)[pos]
            at = np.repeat(pos, times)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            win = idx[np.repeat(lo[pos], times) + inner]
            start = at - self.offset[win]
            text = np.searchsorted(owner_first, at, "right") - 1
            ok = (start >= owner_first[text]) & (start + self.n[win] <= owner_first[text + 1])
            starts.append(start[ok])
            wins.append(win[ok])
        start, win = np.concatenate(starts), np.concatenate(wins)
        if not len(start):
            return start, win
        # words are compared in full: each word's bytes, then single spaces
        good = np.fromiter((self._same(w, int(a), int(i)) for a, i in zip(start, win)), bool, len(start))
        return start[good], win[good]

    def _same(self, w: Words, a: int, i: int) -> bool:
        want, n = self.bytes[i], int(self.n[i])
        s, e = w.start[a], w.end[a + n - 1]
        if e - s == len(want):                     # single separators
            got = w.low[s:e].tobytes().replace(b"\0", b" ")
            return got == want
        return e - s > len(want) and w.joined(a, a + n) == want


def find_leaks(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence), items (ids
    as text, sorted), spans (first word, end) and contaminated."""
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(items, item_id, item_text, window, shingle), "leak_windows")
    counts = shingle_counts(docs, doc_text, windows, shingle)
    # the rarest shingle that the corpus holds at all places; a window with
    # a shingle that occurs nowhere can't occur and is left out
    each = windows.select("words", "n", "items", F.posexplode("shingles").alias("offset", "shingle"))
    ranked = each.join(counts, "shingle", "left")
    prefix = (ranked.groupBy("words", "n", "items").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "shingle")).alias("p"))
        .where("p.count > 0")
        .select("words", "n", "items", "p.offset", "p.shingle", F.least(F.lit(shingle), F.col("n")).alias("k")))
    prefix = materialize(prefix, "leak_prefixes")
    blocks = max(1, -(-prefix.count() // BLOCK))
    names = {c: aside(docs.columns, c) for c in ("n_words", "n_hit", "items", "spans", "contaminated")}
    out = docs.withColumns({names["n_words"]: F.lit(None).cast("long"),
                            names["spans"]: F.array().cast("array<struct<first:long,end:long>>"),
                            names["items"]: F.array().cast("array<string>")})
    for part in range(blocks):
        rows = (prefix if blocks == 1 else prefix.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == part))
        held = spark.sparkContext.broadcast(
            [(r.words, r.n, r.offset, r.k, r.shingle, list(r["items"])) for r in rows.collect()])
        out = _match_block(out, doc_text, held, names)
    spans = F.col(names["spans"])
    return out.withColumn(names["n_hit"], F.aggregate(
        spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])).withColumn(
        names["contaminated"], F.size(spans) > 0)


def _match_block(docs: DataFrame, text: str, held, names: dict[str, str]) -> DataFrame:
    matcher: list[Matcher] = []

    def match(b: pa.RecordBatch) -> pa.RecordBatch:
        if not matcher:
            matcher.append(Matcher(held.value))
        m, cols = matcher[0], b.schema.names
        w = Words(b.column(cols.index(text)), ALNUM)
        start, win = m.match(w, w.hashes())
        spans = b.column(cols.index(names["spans"])).to_pylist()
        items = b.column(cols.index(names["items"])).to_pylist()
        if len(start):
            doc = np.searchsorted(w.first, start, "right") - 1
            order = np.lexsort((start, doc))
            doc, start, win = doc[order], start[order], win[order]
            for a, z in zip(*_runs(doc)):
                d = int(doc[a])
                first = int(w.first[d])
                own = [(s["first"], s["end"]) for s in spans[d]]
                own += zip((start[a:z] - first).tolist(), (start[a:z] + m.n[win[a:z]] - first).tolist())
                spans[d] = [{"first": s, "end": e} for s, e in _merged(own)]
                items[d] = sorted({*items[d], *(x for i in set(win[a:z].tolist()) for x in m.rows[i][5])})
        new = {names["n_words"]: pa.array(w.counts(), pa.int64()),
               names["spans"]: pa.array(spans, b.schema.field(names["spans"]).type),
               names["items"]: pa.array(items, b.schema.field(names["items"]).type)}
        return pa.RecordBatch.from_arrays([new.get(c, b.column(i)) for i, c in enumerate(cols)], names=cols)

    return map_arrow(docs, match, docs.schema)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.diff(x)) + 1
    return np.concatenate([[0], at]), np.concatenate([at, [len(x)]])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any item."""
    found = find_leaks(docs, items, **options)
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Windows by list slices, occurrences by their joined words.
SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM {documents}),
bench AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM {benchmark}),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS x
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM bench WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS x
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM low, sizes WHERE len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.x = win.x),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(low.w) AS BIGINT) AS n_words, CAST(coalesce(per.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(per.n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN per ON low.doc_id = per.doc_id LEFT JOIN it ON low.doc_id = it.doc_id
"""
