"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight, a target number of words and a weight schedule
over training time 0..1. The integral of the schedule is the source's
cumulative word demand; its documents, in an order fixed by a hash of their
id, fill that demand one after the other (again from the start when the
target exceeds the source), and the time at which the demand reaches a
document is its training position. Documents are range-sorted by position.

Defined results: a null or blank text has size 0 and is never taken; a null
source is a source of its own, ordered last; repeated rows are taken like
any others; an empty table gives an empty table. Only the named columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.llm.common import materialize, materialize_counted, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5               # of all words
CAP = 2.0                 # times a source's own words
#: Weight schedule of each weight's sources: (time, relative weight) knots,
#: straight lines between. Heavy sources rise, light ones fall.
SCHEDULES = {
    5: ((0.0, 0.7), (0.5, 1.0), (1.0, 1.3)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    1: ((0.0, 1.6), (0.4, 1.0), (1.0, 0.4)),
}
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 2_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE,
            cap: float = CAP) -> DataFrame:
    """(source, source_size) -> also rank, weight, target.

    Sources by code point, null last, take the weights in turn. Shares are
    proportional to the weights up to ``cap`` times a source's size; what is
    above is shared again. In order of cap per weight that ends at one level
    (words per weight): the largest among those that no longer pass the cap
    of the first source they would be handed to. One row per source: the
    windows here run over the list of sources, not over documents."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("ratio", "rank")
    every = Window.partitionBy()
    cyc = F.array(*[F.lit(w) for w in weights])
    s = (sources.withColumn("rank", F.row_number().over(by_name))
         .withColumn("weight", F.element_at(cyc, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
         .withColumn("most", F.lit(cap) * F.col("source_size"))
         .withColumn("ratio", F.col("most") / F.col("weight")))
    s = s.withColumn("level", (
        F.lit(share) * F.sum("source_size").over(every)
        - (F.sum("most").over(by_cap) - F.col("most")))
        / (F.sum("weight").over(every) - F.sum("weight").over(by_cap) + F.col("weight")))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return s.select("source", "rank", "weight", "source_size",
                    F.least("most", F.coalesce("level", F.lit(math.inf)) * F.col("weight")).alias("target"))


def _segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(t0, y0, w0, slope, t1) of each line, y the integral up to t0 as a
    part of the whole integral."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, y, out = sum(area), 0.0, []
    for (t0, w0), (t1, w1), part in zip(knots, knots[1:], area):
        out.append((t0, y / whole, w0 / whole, (w1 - w0) / (t1 - t0) / whole, t1))
        y += part
    return out


def position(y, knots):
    """The time at which the schedule's integral reaches the part ``y``."""
    out = None
    for t0, y0, w0, slope, t1 in reversed(_segments(knots)):
        d = F.greatest(y - F.lit(y0), F.lit(0.0))
        t = F.lit(t0) + (d / F.lit(w0) if abs(slope) < 1e-12 else
                         (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * d, F.lit(0.0))) - F.lit(w0)) / F.lit(slope))
        t = F.least(t, F.lit(t1))
        out = t if out is None else F.when(y >= out_from, out).otherwise(t)
        out_from = F.lit(y0)
    return out


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           source: str = "source", weights=WEIGHTS, share: float = SHARE,
           cap: float = CAP, schedules=None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target,
    taken (words, repeats counted) and ``takes``, an array of (position,
    words), one for each pass over the source that reaches the document.

    A source's running word counts come from sums over (source, bucket of
    the hash) and a window inside each bucket, so that no task ever holds a
    whole source. The last document of a source is taken up to the word
    that meets the target."""
    schedules = schedules or SCHEDULES
    flat = ((0.0, 1.0), (1.0, 1.0))
    narrow, rows = materialize_counted(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("u")), "mix_sizes")
    n = 1
    while n < 1 << 16 and n * ROWS_PER_BUCKET < rows:
        n *= 2
    bucket = F.floor(F.conv(F.substring("u", 1, 4), 16, 10).cast("long") * n / 65536)
    goal = materialize(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")),
                               weights, share, cap), "mix_targets")
    dealt = (narrow.withColumn("bucket", bucket)
             .join(goal.withColumnRenamed("source", "g_source"),
                   F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source"))
    upto = Window.partitionBy("rank").orderBy("bucket")
    begins = (dealt.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
              .select("rank", "bucket", (F.sum("words").over(upto) - F.col("words")).alias("begin")))
    inside = Window.partitionBy("rank", "bucket").orderBy("u", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    at = (dealt.join(begins, ["rank", "bucket"])
          .withColumn("begin", F.col("begin") + F.sum("size").over(inside) - F.col("size"))
          .withColumn("whole", F.floor("target")))
    takes = []
    for p in range(max(1, math.ceil(cap))):
        first = F.lit(p) * F.col("source_size") + F.col("begin")
        words = F.greatest(F.least(F.col("size"), F.col("whole") - first), F.lit(0)).cast("long")
        y = first / F.greatest(F.col("whole"), F.lit(1))
        when = position(y, flat)
        for w in dict.fromkeys(weights):
            when = F.when(F.col("weight") == w, position(y, schedules.get(w, flat))).otherwise(when)
        takes.append(F.struct(when.alias("position"), words.alias("words")))
    at = at.withColumn("takes", F.filter(F.array(*takes), lambda t: t["words"] > 0))
    return at.select("doc_id", "source", "size", "source_size", "target",
                     F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"]).alias("taken"), "takes")


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per take, range-sorted by training position."""
    return (assigned.select("doc_id", "source", F.inline("takes"))
            .orderBy("position", "doc_id", "words"))


def by_first_position(assigned: DataFrame) -> DataFrame:
    """Documents range-sorted by the position of their first take; documents
    that are not taken last."""
    return (assigned.withColumn("position", F.array_min(F.transform("takes", lambda t: t["position"])))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return (by_first_position(assign(table(spark, sf_dir, "documents")))
            .select("doc_id", "size", "source_size", "target", "taken"))


#: Rows of ``from_table`` (doc_id, text, source) under the same rules.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS u,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rnk FROM s),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS most FROM r),
q AS (SELECT *, most / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER o - most))
              / (sum(weight) OVER () - sum(weight) OVER o + weight) AS lev
      FROM q WINDOW o AS (ORDER BY ratio, rnk)),
t AS (SELECT source, rnk, source_size,
             least(most, max(CASE WHEN lev <= ratio THEN lev END) OVER () * weight) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS whole,
             CAST(sum(d.size) OVER (PARTITION BY t.rnk ORDER BY d.u, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(size, whole - b), 0) + greatest(least(size, whole - source_size - b), 0) AS BIGINT) AS taken
FROM c
"""
