"""Licence scan: TF-IDF cosine to templates, then directory inheritance.

Candidate lines of each text (those with a licence word) are compared with
licence templates as sparse TF-IDF vectors: term counts in the line, inverse
document frequencies over all documents, a join on terms and a sum per pair
of line and template. Equal lines are scored once. A document takes its best
template at ``THRESHOLD`` or above. Documents that act as the licence file
of their directory hand their licence down: each directory joins its
ancestors' paths, the nearest one with a licence wins, and documents without
a licence of their own inherit it.

DataFrame and SQL functions only.

Defined results: null, empty and blank texts match nothing; a null path is
in no directory; of several licence files of a directory the best score,
then the smallest licence and path counts; equal scores go to the smallest
template name; repeated rows each give a row; empty tables give empty
tables. Output names that clash with input columns get a leading ``_``; the
query reads only the columns it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import aside, materialize, materialize_counted, small, table

THRESHOLD = 0.5
#: Texts that hold one of these, in lower case, may have candidate lines.
TRIGGERS = ("licens", "licenc", "copyright", "permission", "redistribut", "public domain", "warranty", "spdx", "gpl",
            "creative commons")
#: Lines with one of these are candidates; every template line has one.
CANDIDATE = r"(?i)licen[sc]e|copyright|permission|redistribut|public domain|warranty|spdx|\bgpl\b|creative commons"
TERM = "[^a-z0-9.]+"

# Licence names and the words by which texts refer to them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def _parts(text: Column) -> Column:
    """Lower-case terms (letters, digits and inner points), and maybe ''."""
    outer = r"\.+(?![a-z0-9.])|\.(?<![a-z0-9.]\.)\.*"
    return F.split(F.regexp_replace(F.lower(text), outer, " "), TERM)


def terms(text: Column) -> Column:
    """Lower-case terms: letters, digits and inner points."""
    return F.filter(_parts(text), lambda t: t != "")


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """(template, license, term, tf) of the given templates."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)],
                                 "template int, license string, line string")
    return (rows.select("template", "license", F.explode(terms(F.col("line"))).alias("term"))
            .groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf")))


def inverse_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> DataFrame:
    """(term, idf): ln((1 + documents) / (1 + documents with the term)) + 1
    over all documents, for the templates' terms."""
    own = F.array_intersect(_parts(F.coalesce(F.col(text), F.lit(""))), F.array(*[F.lit(t) for t in vocabulary]))
    seen = materialize(docs.select(F.explode(F.concat(own, F.array(F.lit(""))))).groupBy(F.col("col").alias("term"))
                       .agg(F.count(F.lit(1)).alias("df")), "license_terms")
    every = seen.where("term = ''").select(F.col("df").alias("n"))
    words = docs.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    return (words.join(seen, "term", "left").join(F.broadcast(every), how="left")      # one row
            .select("term", (F.log((F.lit(1.0) + F.coalesce("n", F.lit(0))) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1)
                    .alias("idf"), (F.log(F.lit(1.0) + F.coalesce("n", F.lit(0))) + 1).alias("most")))


def score_lines(lines: DataFrame, idf: DataFrame, templates: DataFrame) -> DataFrame:
    """Distinct ``line``s -> (line, license, score) of the best template.
    Terms outside the templates weigh as terms that no document has."""
    unseen = idf.agg(F.max("most").alias("unseen"))
    weighed = templates.join(F.broadcast(idf.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    weighed = weighed.join(norms, "template").select("template", "license", "term", "w", "t_norm")
    tf = (lines.select("line", F.explode(terms(F.col("line"))).alias("term")).groupBy("line", "term")
          .agg(F.count(F.lit(1)).alias("tf")))
    tf = (tf.join(F.broadcast(idf.select("term", "idf")), "term", "left").join(F.broadcast(unseen))   # one row
          .withColumn("v", F.col("tf") * F.coalesce("idf", "unseen")).select("line", "term", "v"))
    norm = tf.groupBy("line").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = (tf.join(F.broadcast(weighed), "term").groupBy("line", "template", "license", "t_norm")
            .agg(F.sum(F.col("v") * F.col("w")).alias("dot")))
    scored = dots.join(norm, "line").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6))
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    return best.select("line", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"))


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with own_license, license_score and first_line: whether the
    text opens with that licence line."""
    spark = docs.sparkSession
    model = template_table(spark, templates)
    vocabulary = [r["term"] for r in model.select("term").distinct().orderBy("term").collect()]
    idf = materialize(inverse_frequencies(docs, text, vocabulary), "license_idf")
    at = aside(docs.columns, "lines")
    own = F.array_distinct(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)),
                                    lambda x: x.rlike(CANDIDATE)))
    # the lambda's variable holds the lower-cased text, computed once
    maybe = F.exists(F.array(F.lower(F.col(text))),
                     lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) for t in TRIGGERS]))
    rows = docs.withColumn(at, F.when(maybe, own).otherwise(F.array().cast("array<string>")))
    # the distinct sets of lines, then the distinct lines: equal ones once
    held = materialize(rows.where(F.size(at) > 0).groupBy(F.col(at).alias("held")).agg(F.count(F.lit(1)).alias("n")),
                       "license_sets")
    lines = held.select(F.explode("held").alias("line")).distinct()
    scored, n = materialize_counted(score_lines(lines, idf, model).where(F.col("score") >= threshold), "license_lines")
    found = held.select("held", F.explode("held").alias("line"))
    best = (found.join(small(scored, n, 256), "line").groupBy("held")
            .agg(F.min(F.struct((-F.col("score")).alias("minus"), "license", "line")).alias("b")))
    k, lic, sco, lin = (aside([*docs.columns, at], c) for c in ("found_lines", "found_license", "found_score", "found_line"))
    best, m = materialize_counted(best.select(F.col("held").alias(k), F.col("b.license").alias(lic),
                                              (-F.col("b.minus")).alias(sco), F.col("b.line").alias(lin)), "license_best")
    joined = rows.join(small(best, m, 512), (F.size(at) > 0) & (F.col(at) == F.col(k)), "left")
    names = {c: aside(docs.columns, c) for c in ("own_license", "license_score", "first_line")}
    return joined.select(*docs.columns, F.col(lic).alias(names["own_license"]), F.col(sco).alias(names["license_score"]),
                         F.coalesce(F.trim(F.substring_index(F.col(text), "\n", 1)) == F.col(lin),
                                    F.lit(False)).alias(names["first_line"]))


def directory(path: Column) -> Column:
    """The path before the last slash; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """A directory and those above it, '' last."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(
        F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
                    lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(""))))


def inherit(scanned: DataFrame, path: str, own: str, score: str, is_file: Column) -> DataFrame:
    """``scanned`` with license (own or inherited) and license_dir (the
    directory it comes from, null for own ones)."""
    at, to, origin, given = (aside(scanned.columns, c) for c in ("in_dir", "to_dir", "from_dir", "given_license"))
    files = (scanned.where(is_file & F.col(own).isNotNull() & F.col(path).isNotNull())
             .groupBy(directory(F.col(path)).alias(origin))
             .agg(F.min(F.struct((-F.col(score)).alias("minus"), F.col(own).alias("license"), F.col(path).alias("path"))).alias("b"))
             .select(F.col(origin), F.col("b.license").alias(given)))
    files = materialize(files, "license_dirs")
    dirs = scanned.where(F.col(path).isNotNull()).select(directory(F.col(path)).alias(to)).distinct()
    nearest = (dirs.select(to, F.explode(ancestors(F.col(to))).alias(origin)).join(files, origin)
               .groupBy(to).agg(F.max(F.struct(F.length(origin).alias("depth"), origin, given)).alias("b"))
               .select(to, f"b.{origin}", f"b.{given}"))
    out = scanned.withColumn(at, directory(F.col(path))).join(nearest, F.col(at) == F.col(to), "left")
    names = {c: aside(scanned.columns, c) for c in ("license", "license_dir")}
    return out.select(*scanned.columns, F.coalesce(F.col(own), F.col(given)).alias(names["license"]),
                      F.when(F.col(own).isNull(), F.col(origin)).alias(names["license_dir"]))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents as files of a source tree: source, then directories of 512
    and of 8 ids. A text that opens with its licence line is its directory's
    licence file."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(
        "/", "source", F.concat(F.lit("d"), F.floor(n / 512)), F.concat(F.lit("e"), F.floor(n / 8)),
        F.concat(n.cast("string"), F.lit(".txt"))).alias("path"))
    found = scan(docs).drop("text")
    return inherit(found, "path", "own_license", "license_score", F.col("first_line")).select(
        "doc_id", "path", "own_license", "license_score", "license", "license_dir")


def _values() -> str:
    return ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))


_TERMS = ("[y FOR y IN [regexp_replace(t, '^\\.+|\\.+$', '', 'g') FOR t IN regexp_split_to_array(lower({x}), "
          "'[^a-z0-9.]+')] IF y <> '']")
SQL = r"""
WITH m AS (SELECT * FROM (VALUES {values}) v(template, license, line)),
mt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({terms_line}) AS term FROM m) GROUP BY ALL),
voc AS (SELECT DISTINCT term FROM mt),
d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, 'd' || CAST(floor(doc_id / 512) AS BIGINT),
             'e' || CAST(floor(doc_id / 8) AS BIGINT), doc_id || '.txt') AS path FROM {documents}),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({terms_text}) AS term FROM d) WHERE term IN (SELECT term FROM voc) GROUP BY term),
idf AS (SELECT voc.term, ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS idf FROM voc LEFT JOIN df USING (term)),
tw AS (SELECT template, license, term, tf * idf AS w FROM mt JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS t_norm FROM tw GROUP BY template),
li AS (SELECT DISTINCT doc_id, trim(l) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '(?i)licen[sc]e|copyright|permission|redistribut|public domain|warranty|spdx|\bgpl\b|creative commons')),
dl AS (SELECT DISTINCT line FROM li),
lt AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest({terms_line}) AS term FROM dl) GROUP BY ALL),
lw AS (SELECT line, lt.term, tf * coalesce(idf, ln(1.0::DOUBLE + (SELECT count(*) FROM d)) + 1) AS v FROM lt LEFT JOIN idf ON idf.term = lt.term),
nrm AS (SELECT line, sqrt(sum(v * v)) AS norm FROM lw GROUP BY line),
sc AS (SELECT lw.line, license, round(sum(v * w) / (any_value(norm) * any_value(t_norm)), 6) AS score
       FROM lw JOIN tw ON tw.term = lw.term JOIN tn USING (template) JOIN nrm ON nrm.line = lw.line GROUP BY lw.line, template, license),
bl AS (SELECT line, license, score FROM sc WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
b AS (SELECT doc_id, li.line, license, score FROM li JOIN bl USING (line)
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, li.line) = 1),
f AS (SELECT d.doc_id, d.path, regexp_replace(d.path, '/?[^/]*$', '') AS dir, b.license AS own, b.score,
             coalesce(trim(string_split(d.text, chr(10))[1]) = b.line, false) AS top FROM d LEFT JOIN b USING (doc_id)),
fi AS (SELECT dir AS src, own AS given FROM f WHERE top AND own IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own, path) = 1),
dirs AS (SELECT DISTINCT dir FROM f),
near AS (SELECT dir, src, given FROM dirs JOIN fi ON src = '' OR dir = src OR starts_with(dir, src || '/')
         QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(src) DESC) = 1)
SELECT f.doc_id, f.path, f.own AS own_license, f.score AS license_score, coalesce(f.own, near.given) AS license,
       CASE WHEN f.own IS NULL THEN near.src END AS license_dir
FROM f LEFT JOIN near ON near.dir = f.dir
""".replace("{values}", _values()).replace("{terms_line}", _TERMS.replace("{x}", "line")).replace(
    "{terms_text}", _TERMS.replace("{x}", "text"))
