"""Feature derivation shared by training and prediction (G1-G9, D2, D3,
E7, F1, D5). One definition; ``mode`` selects the few places where the
reference's two paths differ."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.functions import timeparts as tp
from faresight.operators.encode import (apply_label_encoders, category_text,
                                        rank_vocabulary)
from faresight.operators.joins import BROADCAST_BYTE_LIMIT, ROW_BYTES, cross_one_row
from faresight.operators.lookup import group_counts, grouping_id_of, join_popularity
from faresight.operators.stats import popularity_stats
from faresight.schema import CATEGORICAL_COLUMNS, FEATURE_COLUMNS


def add_time_features(df: DataFrame, on_bad: str = "null") -> DataFrame:
    """Booking and flight calendar parts, advance days, weekend flags,
    buckets, minutes, duration, time of day (G1-G8)."""
    c, f = F.col("create_at"), F.col("flight_date")
    out = df.withColumns({
        "create_hour": F.hour(c),
        "create_day_of_week": tp.weekday(c),
        "create_month": F.month(c),
        "flight_month": F.month(f),
        "flight_day_of_week": tp.weekday(f),
        "days_in_advance": tp.days_in_advance(f, c),
        "departure_minutes": tp.time_to_minutes("departure_time", on_bad),
        "arrival_minutes": tp.time_to_minutes("arrival_time", on_bad),
    })
    return out.withColumns({
        "is_weekend_booking": tp.is_weekend("create_day_of_week"),
        "is_weekend_flight": tp.is_weekend("flight_day_of_week"),
        "booking_category": tp.booking_category("days_in_advance"),
        "flight_duration": tp.flight_duration("departure_minutes",
                                              "arrival_minutes"),
        "departure_time_category": tp.time_of_day("departure_minutes"),
        "airline": tp.airline_code("flight_number"),
    })


@dataclass
class FeatureResult:
    features: DataFrame
    encoders: DataFrame
    popularity: DataFrame


def training_features(fares: DataFrame) -> FeatureResult:
    """Training path: real popularity counts, encoders fitted on the
    cleaned fares (before incomplete rows are dropped), bad times NULL."""
    df = add_time_features(fares, on_bad="null")
    # One pass over the rows counts the combinations of all categories; the
    # grouping sets (route counts, airline counts, every vocabulary) then
    # expand that much smaller table only.
    sets = [["departure_airport", "arrival_airport"]] + [[c] for c in CATEGORICAL_COLUMNS]
    counts, n, cols = group_counts(df, sets)
    df = join_popularity(df, counts, cols, n * ROW_BYTES <= BROADCAST_BYTE_LIMIT)
    pop = popularity_stats(df)
    # NULL becomes the text 'nan', so distinct after the mapping.
    vocab = reduce(DataFrame.unionByName, [
        counts.where(F.col("__g") == grouping_id_of(cols, [c]))
        .select(F.lit(c).alias("attribute"), category_text(c).alias("value"))
        for c in CATEGORICAL_COLUMNS]).distinct()
    enc = rank_vocabulary(vocab)
    df = apply_label_encoders(df, enc, CATEGORICAL_COLUMNS, bound=n)
    return FeatureResult(df, enc, pop)


def prediction_features(rows: DataFrame, encoders: DataFrame,
                        popularity: DataFrame) -> DataFrame:
    """Prediction path: popularity = training means, unseen category 0,
    bad time 0, any missing feature 0 (I8)."""
    df = rows.withColumns({
        "create_at": tp.parse_timestamp("create_at"),
        "flight_date": tp.parse_timestamp("flight_date"),
    })
    df = add_time_features(df, on_bad="zero")
    pop = popularity.select(F.col("route_mean").alias("route_popularity"),
                            F.col("airline_mean").alias("airline_popularity"))
    df = cross_one_row(df, pop)
    df = apply_label_encoders(df, encoders, CATEGORICAL_COLUMNS,
                              flag_unseen=True)
    present = [c for c in FEATURE_COLUMNS if c in df.columns]
    return df.fillna(0, subset=present)
