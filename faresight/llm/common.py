"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faresight.session import materialize, materialize_counted, scratch_path  # noqa: F401

#: Rows per Arrow batch handed to Python: with texts of a few kB a batch
#: stays at about 1 MB, and what Python derives from it at some tens.
BATCH_ROWS = "256"
#: Tables are broadcast up to this many bytes (rows x stated width).
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session where it still has defaults."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one batch."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b) if b.num_rows else None
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows times their stated
    width stay within ``BROADCAST_BYTES``; beyond that a shuffle join."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def aside(columns: list[str], name: str) -> str:
    """A column name like ``name`` that is not among ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
