"""Registered queries: cleaning, statistics, features (A1 B1-B7 C9 C10
E1-E7 F1 D2 D3 D5 G1-G9 G20 G21 I2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faresight.functions import text as tx
from faresight.functions.timeparts import airline_code
from faresight.operators import clean as cl
from faresight.operators import stats as st
from faresight.operators.encode import apply_label_encoders, fit_label_encoders
from faresight.operators.features import training_features
from faresight.operators.joins import cross_one_row
from faresight.operators.model import train_test_flag
from faresight.plans import fixtures as fx
from faresight.plans.common import R4, TS, bigint_cols, cleaned, r4, ts_text
from faresight.plans.oracle import FARE_COLS, with_ctes
from faresight.plans.registry import query
from faresight.schema import CATEGORICAL_COLUMNS, FEATURE_COLUMNS

# -- flagship: route popularity of the cleaned history ----------------------


@query("route_popularity", with_ctes(["fares"], """
SELECT departure_airport, arrival_airport, count(*) AS route_count
FROM fares WHERE departure_airport IS NOT NULL AND arrival_airport IS NOT NULL
GROUP BY 1, 2"""))
def route_popularity(spark, sf_dir):
    return (st.route_counts(cleaned(spark, sf_dir).fares)
            .orderBy(F.desc("route_count"), "departure_airport", "arrival_airport"))


@query("dedupe_exact", with_ctes(["deduped"], f"SELECT {FARE_COLS} FROM deduped"))
def dedupe_exact(spark, sf_dir):
    return cl.dedupe_exact(fx.fare_raw_with_copies(spark, sf_dir))


@query("price_bounds", with_ctes(["bounds"], f"""
SELECT {R4('q1')} AS q1, {R4('q3')} AS q3, {R4('iqr')} AS iqr,
       {R4('lower_bound')} AS lower_bound, {R4('upper_bound')} AS upper_bound FROM bounds"""))
def price_bounds(spark, sf_dir):
    b = st.price_bounds(cl.dedupe_exact(fx.fare_raw_with_copies(spark, sf_dir)))
    return b.select(*[r4(c).alias(c) for c in b.columns])


@query("price_bounds_approx", None)
def price_bounds_approx(spark, sf_dir):
    """The named fast mode: approximate quartiles (rows-only check)."""
    b = st.price_bounds(cl.dedupe_exact(fx.fare_raw_with_copies(spark, sf_dir)),
                        method="approx")
    return b.select(*[r4(c).alias(c) for c in b.columns])


@query("filter_price_iqr", with_ctes(["filtered"], f"SELECT {FARE_COLS} FROM filtered"))
def filter_price_iqr(spark, sf_dir):
    return cleaned(spark, sf_dir).filtered


@query("price_stats", with_ctes(["filtered", "bounds"], f"""
SELECT {R4('min(CAST(price AS DOUBLE))')} AS min, {R4('max(CAST(price AS DOUBLE))')} AS max,
       {R4('avg(CAST(price AS DOUBLE))')} AS mean, {R4('stddev_samp(CAST(price AS DOUBLE))')} AS std,
       {R4('any_value(b.q1)')} AS Q1, {R4('any_value(b.q3)')} AS Q3
FROM filtered, bounds b"""))
def price_stats(spark, sf_dir):
    s = cleaned(spark, sf_dir).price_stats
    return s.select(*[r4(c).alias(c) for c in s.columns])


@query("clean_fares", with_ctes(["fares"], f"""
SELECT {TS('create_at')} AS create_at, flight_number, type_of_plane, departure_airport,
       arrival_airport, {TS('flight_date')} AS flight_date, departure_time, arrival_time,
       classes, price FROM fares"""))
def clean_fares_q(spark, sf_dir):
    f = cleaned(spark, sf_dir).fares
    return f.withColumns({"create_at": ts_text("create_at"),
                          "flight_date": ts_text("flight_date")})


def _describe_sql(src):
    p = "CAST(price AS DOUBLE)"
    return f"""
SELECT count({p}) AS count, {R4(f'avg({p})')} AS mean, {R4(f'stddev_samp({p})')} AS std,
  {R4(f'min({p})')} AS min, {R4(f'quantile_cont({p}, 0.25)')} AS p25,
  {R4(f'quantile_cont({p}, 0.5)')} AS p50, {R4(f'quantile_cont({p}, 0.75)')} AS p75,
  {R4(f'max({p})')} AS max FROM {src}"""


def _round_all(df, keep=("count", "rows")):
    return df.select(*[F.col(c) if c in keep else r4(c).alias(c) for c in df.columns])


@query("describe_price_raw", with_ctes(["deduped"], _describe_sql("deduped")))
def describe_price_raw(spark, sf_dir):
    return _round_all(st.describe_price(cleaned(spark, sf_dir).deduped))


@query("describe_price_clean", with_ctes(["fares"], _describe_sql("fares")))
def describe_price_clean(spark, sf_dir):
    return _round_all(st.describe_price(cleaned(spark, sf_dir).fares))


@query("distribution_summary", with_ctes(["fares"], f"""
SELECT count(*) AS rows, {R4('min(CAST(price AS DOUBLE))')} AS min,
  {R4('max(CAST(price AS DOUBLE))')} AS max, {R4('avg(CAST(price AS DOUBLE))')} AS mean,
  {R4('quantile_cont(CAST(price AS DOUBLE), 0.5)')} AS median FROM fares"""))
def distribution_summary(spark, sf_dir):
    return _round_all(st.distribution_summary(cleaned(spark, sf_dir).fares))


@query("null_profile", with_ctes(["deduped"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS null_count FROM deduped"
    for c in FARE_COLS.split(", "))))
def null_profile(spark, sf_dir):
    from faresight.operators.rules import null_profile as np_
    return np_(cleaned(spark, sf_dir).deduped)


@query("row_accounting", with_ctes(["fare_raw_copies", "deduped", "filtered", "fares"], """
SELECT (SELECT count(*) FROM fare_raw_copies) AS rows_in,
       (SELECT count(*) FROM fare_raw_copies) - (SELECT count(*) FROM deduped) AS duplicates,
       (SELECT count(*) FROM deduped) - (SELECT count(*) FROM filtered) AS outliers,
       (SELECT count(*) FROM filtered) - (SELECT count(*) FROM fares) AS unparsable,
       (SELECT count(*) FROM fares) AS rows_out"""))
def row_accounting(spark, sf_dir):
    from faresight.operators.rules import row_accounting as ra
    c = cleaned(spark, sf_dir)
    return ra(fx.fare_raw_with_copies(spark, sf_dir), c.deduped, c.bounds)


@query("airline_counts", with_ctes(["fare_time"], """
SELECT airline, count(*) AS airline_count FROM fare_time
WHERE airline IS NOT NULL GROUP BY 1"""))
def airline_counts(spark, sf_dir):
    f = cleaned(spark, sf_dir).fares.withColumn("airline", airline_code("flight_number"))
    return st.airline_counts(f)


@query("popularity_stats", with_ctes(["features"], f"""
SELECT {R4('avg(route_popularity)')} AS route_mean, {R4('stddev_samp(route_popularity)')} AS route_std,
  {R4('avg(airline_popularity)')} AS airline_mean,
  {R4('stddev_samp(airline_popularity)')} AS airline_std FROM features"""))
def popularity_stats(spark, sf_dir):
    p = training_features(cleaned(spark, sf_dir).fares).popularity
    return p.select(*[r4(c).alias(c) for c in p.columns])


@query("label_encoders", with_ctes(["encoders"], "SELECT attribute, value, code FROM encoders"))
def label_encoders(spark, sf_dir):
    from faresight.operators.features import add_time_features
    f = add_time_features(cleaned(spark, sf_dir).fares)
    return bigint_cols(fit_label_encoders(f, CATEGORICAL_COLUMNS), ["code"])


_FEATS_SQL = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in FEATURE_COLUMNS)


@query("fare_features", with_ctes(["features"], f"""
SELECT {_FEATS_SQL}, price FROM features
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURE_COLUMNS)} AND price IS NOT NULL"""))
def fare_features(spark, sf_dir):
    f = training_features(cleaned(spark, sf_dir).fares).features
    f = cl.drop_incomplete_features(f, FEATURE_COLUMNS, "price")
    return bigint_cols(cl.feature_projection(f, FEATURE_COLUMNS, ["price"]),
                       FEATURE_COLUMNS)


_KEY_SQL = ("md5(concat_ws('|', " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '')" for c in
    ["strftime(create_at, '%Y-%m-%d %H:%M:%S.%g')", "flight_number", "type_of_plane",
     "departure_airport", "arrival_airport", "strftime(flight_date, '%Y-%m-%d %H:%M:%S.%g')",
     "departure_time", "arrival_time", "classes", "price"]) + "))")


@query("train_test_split", with_ctes(["fares"], f"""
SELECT CASE WHEN CAST(('0x' || substr({_KEY_SQL}, 1, 8)) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'test' END AS split,
       count(*) AS rows
FROM fares GROUP BY 1"""))
def train_test_split(spark, sf_dir):
    f = train_test_flag(cleaned(spark, sf_dir).fares)
    return (f.groupBy(F.when(F.col("is_train"), "train").otherwise("test").alias("split"))
            .agg(F.count(F.lit(1)).alias("rows")))


@query("encode_unseen", with_ctes(["fare_time"], f"""
, t AS (SELECT *, CAST(('0x' || substr({_KEY_SQL}, 1, 8)) AS BIGINT) % 10 < 8 AS is_train FROM fare_time)
, enc AS (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS BIGINT) AS code
          FROM (SELECT DISTINCT coalesce(flight_number, 'nan') AS value FROM t WHERE is_train))
SELECT coalesce(flight_number, 'nan') AS flight_number, coalesce(e.code, 0) AS flight_number_encoded,
       e.code IS NULL AS flight_number_unseen, count(*) AS rows
FROM t LEFT JOIN enc e ON coalesce(t.flight_number, 'nan') = e.value
WHERE NOT is_train GROUP BY 1, 2, 3"""))
def encode_unseen(spark, sf_dir):
    from faresight.operators.features import add_time_features
    f = train_test_flag(add_time_features(cleaned(spark, sf_dir).fares))
    enc = fit_label_encoders(f.where("is_train"), ["flight_number"])
    test = apply_label_encoders(f.where(~F.col("is_train")), enc, ["flight_number"],
                                flag_unseen=True)
    return (test.groupBy(F.coalesce("flight_number", F.lit("nan")).alias("flight_number"),
                         F.col("flight_number_encoded").cast("bigint")
                         .alias("flight_number_encoded"), "flight_number_unseen")
            .agg(F.count(F.lit(1)).alias("rows")))


@query("clip_price", with_ctes(["filtered", "fares"], """
, s AS (SELECT min(CAST(price AS DOUBLE)) AS mn, max(CAST(price AS DOUBLE)) AS mx FROM filtered)
SELECT CAST(least(least(s.mx, 50000000.0), greatest(greatest(s.mn, 100000.0), CAST(f.price AS DOUBLE))) AS DECIMAL(18,4)) AS clipped,
       count(*) AS rows
FROM fares f, s GROUP BY 1"""))
def clip_price(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    s = c.price_stats.select(F.col("min").alias("__mn"), F.col("max").alias("__mx"))
    f = cross_one_row(c.fares, s)
    clipped = tx.clip_price(F.col("price").cast("double"), "__mn", "__mx")
    return f.groupBy(r4(clipped).alias("clipped")).agg(F.count(F.lit(1)).alias("rows"))


@query("route_label", with_ctes(["fares"], """
SELECT coalesce(departure_airport, 'null') || ' → ' || coalesce(arrival_airport, 'null') AS route,
       count(*) AS rows FROM fares GROUP BY 1"""))
def route_label(spark, sf_dir):
    f = cleaned(spark, sf_dir).fares
    return (f.groupBy(tx.route_label("departure_airport", "arrival_airport").alias("route"))
            .agg(F.count(F.lit(1)).alias("rows")))
