"""From documents to a training mix.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir) and works
on all that the one before kept, written as Parquet and read again. Toxic
and poor documents go, one document of each group of near-duplicates stays,
documents that hold a benchmark passage go, and the rest is mixed to target
weights. All but the last return the columns of ``docs``; the last returns
the mix: doc_id, source, size, source_size, target, taken and position (null
if the mix doesn't take the document).

Null ids pass the filters; null texts score as empty ones; empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faresight.llm import decontaminate as leaks
from faresight.llm import minhash, mixing, quality, toxicity
from faresight.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.by_first_position(mixing.assign(docs)).drop("takes")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifiers and the component search have no SQL form; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
