"""Cleaning: dedupe, IQR outlier filter, date and plane parsing."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faresight.functions.timeparts import parse_flight_date, parse_timestamp
from faresight.operators.stats import price_bounds, price_stats
from faresight.session import materialize


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Drop rows equal on every column; NULL equals NULL (B1).

    One shuffle on all columns after a map-side distinct, so a value
    repeated in a third of the rows is collapsed before it moves.
    """
    return df.dropDuplicates()


def filter_price_iqr(df: DataFrame, bounds: DataFrame | None = None,
                     price: str = "price") -> DataFrame:
    """Keep prices in [Q1 - 1.5 IQR, Q3 + 1.5 IQR], inclusive (B2).

    NULL prices fail the test and go, as in the reference.
    """
    if bounds is None:
        bounds = price_bounds(df, price)
    b = bounds.select("lower_bound", "upper_bound").first()     # one row
    if b is None or b[0] is None or b[1] is None:
        return df.where(F.lit(False))
    kind = df.schema[price].dataType
    if not isinstance(kind, T.DecimalType):
        p = F.col(price).cast("double")
        return df.where(~F.isnan(p) & p.between(F.lit(b[0]), F.lit(b[1])))
    # Literals of the column's own type, so the range reaches the scan. The
    # bounds are rounded inwards to the column's scale: same rows.
    with localcontext() as c:
        c.prec = 400
        step = Decimal(1).scaleb(-kind.scale)
        most = Decimal(10) ** (kind.precision - kind.scale) - step
        lo = min(max(Decimal(repr(b[0])).quantize(step, ROUND_CEILING), -most), most)
        hi = min(max(Decimal(repr(b[1])).quantize(step, ROUND_FLOOR), -most), most)
    return df.where((F.col(price) >= F.lit(lo)) & (F.col(price) <= F.lit(hi)))


def parse_created_at(df: DataFrame, col: str = "create_at") -> DataFrame:
    """Text -> timestamp; rows that do not parse are dropped."""
    return (df.withColumn(col, parse_timestamp(col))
            .where(F.col(col).isNotNull()))


def parse_flight_dates(df: DataFrame, col: str = "flight_date") -> DataFrame:
    """Only ISO text with 'T' parses; the rest is dropped."""
    return (df.withColumn(col, parse_flight_date(col))
            .where(F.col(col).isNotNull()))


def clean_plane(df: DataFrame, col: str = "type_of_plane") -> DataFrame:
    """Strip surrounding white space (Unicode too), drop empty/NULL."""
    stripped = F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", "")
    return (df.withColumn(col, stripped)
            .where(F.col(col).isNotNull() & (F.col(col) != "")))


def drop_incomplete_features(df: DataFrame, features: list[str],
                             label: str = "price") -> DataFrame:
    """Keep rows whose features and label are all non-NULL."""
    present = [c for c in features if c in df.columns]
    return df.na.drop(how="any", subset=present + [label])


def feature_projection(df: DataFrame, features: list[str],
                       keep: list[str] | None = None) -> DataFrame:
    """The ordered feature list, cut to the columns present."""
    return df.select(*[c for c in features if c in df.columns], *(keep or []))


def parse_ok(create_at: str = "create_at", flight_date: str = "flight_date",
             plane: str = "type_of_plane") -> F.Column:
    """True when a row survives B3-B5 (the same tests as the stages)."""
    stripped = F.regexp_replace(F.col(plane), r"(?U)^\s+|\s+$", "")
    return F.coalesce(parse_timestamp(create_at).isNotNull()
                      & parse_flight_date(flight_date).isNotNull()
                      & stripped.isNotNull() & (stripped != ""), F.lit(False))


@dataclass
class CleanResult:
    deduped: DataFrame
    bounds: DataFrame
    price_stats: DataFrame
    filtered: DataFrame
    fares: DataFrame


def clean_fares(raw: DataFrame, price: str = "price",
                reuse_dedupe: bool = True) -> CleanResult:
    """The reference's stage order: dedupe -> bounds -> IQR filter ->
    price stats -> create_at -> flight_date -> plane.

    The deduped table feeds both the quartiles and the rows; Catalyst
    pushes the later not-NULL filters below the row-side dedupe, so the
    two sides would not share one shuffle. With ``reuse_dedupe`` it is
    written once to the shared folder and read by both.
    """
    deduped = dedupe_exact(raw)
    if reuse_dedupe and not raw.isStreaming:
        deduped = materialize(deduped, "deduped")
    bounds = price_bounds(deduped, price)
    if not raw.isStreaming:                     # one row, computed once
        bounds = raw.sparkSession.createDataFrame([bounds.first()], bounds.schema)
    filtered = filter_price_iqr(deduped, bounds, price)
    stats = price_stats(filtered, bounds, price)
    fares = clean_plane(parse_flight_dates(parse_created_at(filtered)))
    return CleanResult(deduped, bounds, stats, filtered, fares)
