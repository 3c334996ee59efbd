"""Audit of how sources differ: vocabulary divergence by language.

Equal texts of a language collapse to one, with the number of copies in each
source, and are tokenized once; their document frequencies and counts are
added with those multiplicities. Terms in at least ``MIN_DOCS`` documents of
a language are kept. A source's smoothed share of each kept term, in whole
billionths, is compared with that of every other source of the language
(the sum of absolute differences) and with the language's own (the terms that
the source uses more).

Pairs are evaluated from the occurring (source, term) entries only. A term
that neither source holds contributes the difference of their base shares,
so a pair's sum is that difference for all terms plus, for each occurring
term, what it differs from it. Entries are dealt by blocks of terms and, for
many sources, tiles of sources: a task holds some ``ENTRIES`` of them and
returns one number a pair of its tiles.

All arithmetic is on integers; shares are divided as decimals, exact up to
10^19 occurrences.

Defined results: null text, language and source are empty ones; a group
without terms, or without kept ones, has base shares only; a language without
kept terms gives pairs of value 0 and no terms; equal values are ranked by the
item's UTF-8 bytes; repeated rows count each; very long texts are counted
whole; an empty table gives an empty table. Only the named columns are read;
the result is a new table, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.llm.common import arrow_batches, materialize, table
from faresight.llm.interning import distinct_words
from faresight.llm.words import Words, byte_class

MIN_DOCS = 30
SMOOTH = 5
TERMS = 50                # ranks of part ``term``
UNIT = 1_000_000_000
ENTRIES = 200_000         # of (source, term) in a task that compares sources
TILE = 256                # sources on each side of such a task
CELLS = 1 << 20           # of the dense slices that a task works on
HELD = 500_000            # tallies that a tokenizing task holds before passing them on

LETTERS = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def collapse(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, text, copies): each distinct text of a language once, with
    ``copies`` an array of (source, n). Copies are counted by digest before
    they are joined to the text, so a text's many copies leave a task as one row."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))   # a source, an entry
    texts = rows.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


class _Tally:
    """Sums of (group, term) -> (n, docs) of one task."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.summed = 0

    def add(self, group: np.ndarray, term: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((group << 32 | term, n, docs))
        self.rows += len(n)
        if self.rows - self.summed > HELD:
            self._sum()

    def _sum(self) -> None:
        key, n, docs = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.parts = [(key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))]
        self.rows = self.summed = len(first)

    def take(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        self._sum()
        key, n, docs = self.parts[0]
        pairs = list(self.groups)
        group, term = key >> 32, pa.array(key & 0xFFFFFFFF)
        out = [pa.array([p[k] for p in pairs]).take(pa.array(group)) for k in (0, 1)]
        out.append(pa.array([t.decode() for t in self.terms]).take(term))
        self.__init__()
        return pa.RecordBatch.from_arrays([*out, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(collapsed: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, copies counted."""
    arrow_batches(collapsed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for b in batches:
            words = Words(b.column(1), LETTERS)
            names, number = distinct_words(words)
            names = np.array([tally.terms.setdefault(w, len(tally.terms)) for w in names], np.int64)
            doc = np.repeat(np.arange(b.num_rows), words.counts())
            key, n = np.unique(doc * max(1, len(names)) + number, return_counts=True)
            doc, term = np.divmod(key, max(1, len(names)))
            group, times, size = [], [], []
            for lang, copies in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                size.append(len(copies))
                for c in copies:
                    group.append(tally.groups.setdefault((lang, c["source"]), len(tally.groups)))
                    times.append(c["n"])
            group, times, size = (np.array(x, np.int64) for x in (group, times, size))
            reps = size[doc]                                  # a text's terms, once for each of its sources
            step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            at = np.repeat((np.cumsum(size) - size)[doc], reps) + step
            tally.add(group[at], np.repeat(names[term], reps), np.repeat(n, reps) * times[at], times[at])
            if tally.summed > HELD or len(tally.terms) > HELD:
                if (out := tally.take()) is not None:
                    yield out
        if (out := tally.take()) is not None:
            yield out

    rows = collapsed.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n, total, kept):
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * kept)), exact."""
    return F.expr(f"1 + ({UNIT} * (cast({n} as decimal(20, 0)) + {SMOOTH})) div "
                  f"(cast({total} as decimal(20, 0)) + {SMOOTH} * {kept})")


def shares(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang",
           source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(groups, entries), both written. Groups: lang, source, kept (the
    language's kept terms), base (share of a term that the group lacks).
    Entries, one for each kept term that a group holds: lang, source, term, p,
    q (the language's share)."""
    counts = term_counts(collapse(docs, text, lang, source))
    same = Window.partitionBy("lang", "term")
    counts = (counts.withColumn("all_n", F.sum("n").over(same)).withColumn("all_docs", F.sum("docs").over(same))
              .withColumn("first", F.row_number().over(same.orderBy("source")) == 1)
              .where(F.col("all_docs") >= min_docs).drop("all_docs", "docs"))
    counts = materialize(counts, "divergence_counts")
    totals = materialize(counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("own")),
                         "divergence_totals")
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("own").alias("kept"))
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
    groups = (names.distinct().join(totals.drop("own"), ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "lang_total", "kept"]))
    groups = materialize(groups.withColumn("base", F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(0)),
                         "divergence_groups")
    entries = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "kept").alias("p"), _share("all_n", "lang_total", "kept").alias("q"))
    return groups, materialize(entries, "divergence_entries")


def _pair_sums(g: pd.DataFrame, same: bool) -> pd.DataFrame:
    """(a, b, value) of each pair of groups (a from tile ``left``): the base
    difference of all kept terms where ``kept`` is given, and for each
    occurring term what it differs from that."""
    base = g[g["term"].isna()].sort_values(["left", "source"], ascending=[False, True])
    entry = g[g["term"].notna()]
    names, left = base["source"].to_numpy(), base["left"].to_numpy(bool)
    low, kept = base["p"].to_numpy(np.int64), base["kept"].to_numpy(np.int64)
    row = pd.Index(names).get_indexer(entry["source"])
    column, terms = pd.factorize(entry["term"])
    order = np.argsort(column, kind="stable")
    row, column, p = row[order], column[order], entry["p"].to_numpy(np.int64)[order]
    width = max(1, CELLS // max(1, len(names)))
    pairs = [np.arange(i + 1, len(names)) if same else np.flatnonzero(~left) for i in range(len(names)) if same or left[i]]
    sums = [np.abs(low[i] - low[j]) * kept[j] for i, j in enumerate(pairs)]
    for a in range(0, len(terms), width):
        n = min(width, len(terms) - a)
        i, j = np.searchsorted(column, [a, a + n])
        dense = np.repeat(low[:, None], n, axis=1)
        dense[row[i:j], column[i:j] - a] = p[i:j]
        for x, others in enumerate(pairs):
            sums[x] += np.abs(dense[others] - dense[x]).sum(1) - np.abs(low[others] - low[x]) * n
    size = [len(j) for j in pairs]
    return pd.DataFrame({"a": np.repeat(names[:len(pairs)], size), "b": names[np.concatenate(pairs)] if size else [],
                         "value": np.concatenate(sums) if size else np.zeros(0, np.int64)})


def pair_values(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each ordered pair of a language's sources."""
    by_name = Window.partitionBy("lang").orderBy("source")                      # a language's sources
    every = Window.partitionBy("lang")
    sizes = entries.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).alias("blocks"))
    placed = groups.withColumn("tile", F.floor((F.row_number().over(by_name) - 1) / TILE))
    placed = placed.withColumn("tiles", F.max("tile").over(every)).join(sizes, "lang", "left").na.fill(1, ["blocks"])
    placed = materialize(placed, "divergence_tiles")
    bases = (placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("lang", "source", "tile", "tiles", "block", F.lit(None).cast("string").alias("term"),
                     F.col("base").cast("long").alias("p"), F.when(F.col("block") == 0, F.col("kept")).otherwise(0).alias("kept")))
    held = entries.join(placed.select("lang", "source", "tile", "tiles", "blocks"), ["lang", "source"]).select(
        "lang", "source", "tile", "tiles", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term",
        F.col("p").cast("long").alias("p"), F.lit(0).cast("long").alias("kept"))
    rows = bases.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "tiles")))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"),
                       (F.col("tile") <= F.col("other")).alias("left"), "source", "term", "p", "kept")

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = _pair_sums(g, key[2] == key[3])
        out.insert(0, "lang", key[0])
        return out

    sums = rows.groupBy("lang", "block", "ta", "tb").applyInPandas(compare, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", "value", F.inline(both)).select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS, text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, every other
    source of the language by divergence; part ``term``, the ``terms`` terms
    that the source uses more than its language."""
    groups, entries = shares(docs, min_docs, text, lang, source)
    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(groups, entries).withColumn("rank", ranks).withColumn("part", F.lit("pair"))
    more = (entries.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            .withColumn("rank", ranks).where(F.col("rank") <= terms).withColumn("part", F.lit("term")))
    return pairs.unionByName(more).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"),
                                          F.col("rank").cast("int").alias("rank"))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {documents}),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
tot AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(tot.n, 0) + 5 * v.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q
      FROM grp g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
      LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows
QUALIFY part = 'pair' OR rank <= 50
"""
