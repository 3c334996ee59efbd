"""Schemas and fixed column lists of the fare data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference's layouts) --------------------
# Column names the analysis reads the fare history under, in file order.
FARE_COLUMNS = [
    "create_at", "flight_number", "type_of_plane", "departure_airport",
    "arrival_airport", "flight_date", "departure_time", "arrival_time",
    "classes", "price",
]
# Header of the 13-column history writer (with passenger counts).
WRITER13_COLUMNS = [
    "created_at", "flight_number", "aircraft_type", "departure_airport",
    "arrival_airport", "flight_date", "departure_time", "arrival_time",
    "classes", "price", "adult", "child", "infant",
]
# Header of the 10-column history writer: the first ten of the above.
WRITER10_COLUMNS = WRITER13_COLUMNS[:10]
# Writer name -> analysis name.
WRITER_RENAMES = {"created_at": "create_at", "aircraft_type": "type_of_plane"}
# Categorical columns that get a label encoder, in the reference's order.
CATEGORICAL_COLUMNS = [
    "flight_number", "departure_airport", "arrival_airport", "classes",
    "type_of_plane", "airline",
]
# The ordered model features.
FEATURE_COLUMNS = [
    "flight_number_encoded", "departure_airport_encoded",
    "arrival_airport_encoded", "classes_encoded", "type_of_plane_encoded",
    "airline_encoded",
    "create_hour", "create_day_of_week", "create_month",
    "flight_month", "flight_day_of_week",
    "days_in_advance", "departure_minutes", "flight_duration",
    "is_weekend_booking", "is_weekend_flight",
    "booking_category", "departure_time_category",
    "route_popularity", "airline_popularity",
]
# Defaults used when a stored model carries no popularity statistics.
DEFAULT_ROUTE_POPULARITY = {"mean": 100.0, "std": 50.0}
DEFAULT_AIRLINE_POPULARITY = {"mean": 50.0, "std": 25.0}
# Prediction clip limits.
CLIP_FLOOR = 100000
CLIP_CEILING = 50000000
# Days covered by one search request.
SEARCH_DAYS = 15
# ---------------------------------------------------------------------------

PRICE_TYPE = T.DecimalType(18, 2)

# Raw analysis layout: everything text, as read from CSV before coercion.
FARE_RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in FARE_COLUMNS])

WRITER13_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in WRITER13_COLUMNS])
WRITER10_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in WRITER10_COLUMNS])

PRICE_OPTION = T.StructType([
    T.StructField("flight_number", T.StringType()),
    T.StructField("departure_airport", T.StringType()),
    T.StructField("arrival_airport", T.StringType()),
    T.StructField("flight_date", T.StringType()),
    T.StructField("departure_time", T.StringType()),
    T.StructField("arrival_time", T.StringType()),
    T.StructField("total_price", T.StringType()),
    T.StructField("classes", T.StringType()),
    T.StructField("aircraft_type", T.StringType()),
])

DAY_RESULT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("search_date", T.StringType()),
    T.StructField("departure_airport", T.StringType()),
    T.StructField("arrival_airport", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("total_flights", T.LongType()),
    T.StructField("prices", T.ArrayType(PRICE_OPTION)),
    T.StructField("errors", T.ArrayType(T.StringType())),
])

CRAWL_RUN = T.StructType([
    T.StructField("total_days_crawled", T.LongType()),
    T.StructField("total_price_options", T.LongType()),
    T.StructField("total_unique_flights", T.LongType()),
    T.StructField("daily_results", T.ArrayType(DAY_RESULT)),
    # Other crawlers return prices at the top level.
    T.StructField("prices", T.ArrayType(PRICE_OPTION)),
])

# A run as it lies in a file: with the run's id where the writer knows it.
RUN_FILE_SCHEMA = T.StructType([T.StructField("run_id", T.LongType())] + CRAWL_RUN.fields)

SEARCH_OPTIONS = T.StructType([
    T.StructField("trip_type", T.StringType()),
    T.StructField("find_cheapest", T.BooleanType()),
    T.StructField("departure_date", T.StringType()),
    T.StructField("return_date", T.StringType()),
])

SEARCH_REQUEST = T.StructType([
    T.StructField("departure_airport", T.StringType()),
    T.StructField("arrival_airport", T.StringType()),
    T.StructField("search_options", SEARCH_OPTIONS),
    T.StructField("adult", T.StringType()),
    T.StructField("child", T.StringType()),
    T.StructField("infant", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

CRAWL_OUTCOME = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("route", T.StringType()),
    T.StructField("duration", T.LongType()),
    T.StructField("results", T.StringType()),
    T.StructField("screenshots", T.ArrayType(T.StringType())),
    T.StructField("steps", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("startTime", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("userAgent", T.StringType()),
        T.StructField("errorTime", T.StringType()),
        T.StructField("errorStack", T.StringType()),
    ])),
])

AIRPORT_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("airport_name", T.StringType()),
    T.StructField("country", T.StringType()),
])
