"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faresight.operators.clean import clean_fares
from faresight.plans import fixtures as fx


def r4(c) -> Column:
    """Round a float result to 4 places as a decimal, so partition order
    cannot change the compared value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,4)")


def ts_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def cleaned(spark: SparkSession, sf_dir: str):
    """The reference's cleaning chain over the dirty history fixture."""
    return clean_fares(fx.fare_raw_with_copies(spark, sf_dir))


def R4(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,4))"


def TS(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%g')"


def bigint_cols(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})
