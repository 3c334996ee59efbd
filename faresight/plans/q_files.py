"""Registered queries: files written and read back (A1-A8, A10). Each writes
a derived table to the scratch folder, reads it with the operator and gives
its rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faresight.operators import stats as st
from faresight.operators.expand import history_projection
from faresight.plans import fixtures as fx
from faresight.plans.oracle import with_ctes
from faresight.plans.q_crawl import _OPT
from faresight.plans.registry import query
from faresight.schema import FARE_COLUMNS, WRITER13_COLUMNS
from faresight.session import scratch_path
from faresight.sources import files as fl
from faresight.streaming.ingest import ingest_stream

STAMP = "2024-01-01T00:00:00.000Z"
RUNS_PER_FILE = 1024      # of a drop of JSON lines, as the stream reads each file whole
_KEEP_SPACES = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("fare_file_scan", with_ctes(["fare_raw"], f"""
SELECT {", ".join(FARE_COLUMNS)} FROM fare_raw"""))
def fare_file_scan(spark, sf_dir):
    """A1: the history file by position, under another header."""
    folder = _folder(spark, "fares")
    raw = fx.fare_raw(spark, sf_dir).drop("event_id")
    raw.toDF(*[f"h{i}" for i in range(len(raw.columns))]).write.options(**_KEEP_SPACES).csv(folder)
    return fl.coerce_fare_types(fl.scan_fare_history(spark, folder))


@query("layout_files", with_ctes(["fare_raw"], """
SELECT create_at, flight_number, type_of_plane, CAST(price AS VARCHAR) AS price,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 + 1 AS INTEGER) END AS adult FROM fare_raw"""))
def layout_files(spark, sf_dir):
    """A2: 13- and 10-column files, each under its own header."""
    r = fx.fare_raw(spark, sf_dir).withColumnsRenamed(
        {"create_at": "created_at", "type_of_plane": "aircraft_type"})
    eid = F.col("event_id")
    wide = r.where(eid % 2 == 0).withColumns({"adult": eid % 3 + 1, "child": eid % 2, "infant": eid % 4})
    p13, p10 = _folder(spark, "wide"), _folder(spark, "narrow")
    wide.select(*WRITER13_COLUMNS).write.options(**_KEEP_SPACES).csv(p13)
    r.where(eid % 2 == 1).select(*WRITER13_COLUMNS[:10]).write.options(**_KEEP_SPACES).csv(p10)
    return fl.scan_fare_layouts(spark, p13, p10).select("create_at", "flight_number", "type_of_plane", "price", "adult")


@query("airport_file_scan", with_ctes([], """
SELECT c_name AS code, c_mktsegment AS city, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'n' || CAST(c_nationkey AS VARCHAR) END
  AS airport_name, 'N' AS country FROM customer"""))
def airport_file_scan(spark, sf_dir):
    """A3: padded and missing values of an airport list of customers."""
    c, folder = fx.table(spark, sf_dir, "customer"), _folder(spark, "airports")
    c.select(F.concat(F.lit(" \t"), "c_name", F.lit(" ")).alias("code"), F.concat("c_mktsegment", F.lit("\t")).alias("city"),
             F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"))).alias("airport_name"),
             F.lit(" N ").alias("country")).write.options(**_KEEP_SPACES).csv(folder)
    return fl.scan_airports(spark, folder)


@query("request_file_scan", with_ctes(["requests"], """
SELECT departure_airport, arrival_airport, trip_type, departure_date, adult, count(*) AS rows
FROM requests GROUP BY 1, 2, 3, 4, 5"""))
def request_file_scan(spark, sf_dir):
    """A4: request files (one text each) of all orders; the raw text and
    the parsed struct come from the same operator."""
    r, folder = fx.requests(spark, sf_dir), _folder(spark, "requests")
    body = F.to_json(F.struct("departure_airport", "arrival_airport", F.struct("trip_type", "departure_date")
                              .alias("search_options"), "adult"))
    # many requests a file here, so each line is one; the operator parses texts
    r.select(body.alias("value")).write.text(folder)
    got = fl.scan_search_requests(spark, folder, wholetext=False)
    return got.groupBy("departure_airport", "arrival_airport", "search_options.trip_type", "search_options.departure_date",
                       "adult").agg(F.count(F.lit(1)).alias("rows"))


@query("run_files_round_trip", with_ctes(["run_rows"], f"SELECT {_OPT} FROM run_rows"))
def run_files_round_trip(spark, sf_dir):
    """Runs appended as JSON lines in two batches, read back."""
    runs, folder = fx.runs(spark, sf_dir), _folder(spark, "runs")
    for part in (0, 1):
        fl.append_crawl_runs(runs.where(F.col("run_id") % 2 == part), folder)
    return fl.flatten_runs(fl.scan_crawl_runs(spark, folder)).select(*_OPT.split(", "))


@query("run_array_files", with_ctes(["run_rows"], f"SELECT {_OPT} FROM run_rows"))
def run_array_files(spark, sf_dir):
    """A5: files of one pretty-printed array each, beside JSON lines."""
    runs, folder = fx.runs(spark, sf_dir), _folder(spark, "arrays")
    block = F.floor(F.col("run_id") / 32)
    arrays = (runs.where(block % 2 == 0).groupBy(block.alias("b")).agg(F.collect_list(F.struct(*runs.columns)).alias("r"))
              .select(F.to_json("r", {"pretty": "true"}).alias("value")))
    arrays.write.option("maxRecordsPerFile", 1).text(folder)
    fl.append_crawl_runs(runs.where(block % 2 == 1), folder)
    return fl.flatten_runs(fl.scan_crawl_runs(spark, folder)).select(*_OPT.split(", "))


_HISTORY = """
SELECT '2024-01-01T00:00:00.000Z' AS created_at, r.flight_number, r.aircraft_type, r.departure_airport, r.arrival_airport,
  r.flight_date, r.departure_time, r.arrival_time, r.classes, r.total_price AS price, q.adult, q.child, q.infant,
  substr(r.flight_date, 1, 10) AS flight_day
FROM run_rows r LEFT JOIN requests q ON q.request_id = r.run_id"""


@query("history_append", with_ctes(["run_rows", "requests"], _HISTORY))
def history_append(spark, sf_dir):
    """History appended in two batches, read back."""
    rows, folder = fx.run_rows(spark, sf_dir), _folder(spark, "history")
    for part in (0, 1):
        fl.append_fare_history(history_projection(rows.where(F.col("event_id") % 2 == part), fx.requests(spark, sf_dir),
                                                  batch_ts=STAMP), folder, batch_ts=STAMP)
    return spark.read.parquet(folder).withColumn("flight_day", F.col("flight_day").cast("string"))


@query("stream_ingest_fares", with_ctes(["run_rows", "requests"], _HISTORY))
def stream_ingest_fares(spark, sf_dir):
    """A10: runs arrive as a drop of JSON lines and one of arrays; an
    availableNow stream appends their history rows after each."""
    base = _folder(spark, "stream")
    src, sink, ck = base + "/in", base + "/out", base + "/ckpt"
    runs, requests = fx.runs(spark, sf_dir), fx.requests(spark, sf_dir)
    block = F.floor(F.col("run_id") / 32)
    lines = runs.where(block % 2 == 0)
    arrays = (runs.where(block % 2 == 1).groupBy(block.alias("b")).agg(F.collect_list(F.struct(*runs.columns)).alias("r"))
              .select(F.to_json("r", {"pretty": "true"}).alias("value")))
    lines.write.mode("append").option("maxRecordsPerFile", RUNS_PER_FILE).json(src)
    ingest_stream(spark, src, sink, ck, requests=requests, batch_ts=STAMP)
    arrays.write.mode("append").option("maxRecordsPerFile", 1).text(src)
    ingest_stream(spark, src, sink, ck, requests=requests, batch_ts=STAMP)
    return spark.read.parquet(sink).withColumn("flight_day", F.col("flight_day").cast("string"))


@query("report_round_trip", with_ctes(["day_errors"], r"""
SELECT regexp_replace(error, 'price option \d+', 'price option N') AS error, count(*) AS n
FROM day_errors WHERE error IS NOT NULL GROUP BY 1"""))
def report_round_trip(spark, sf_dir):
    """A report written twice (the second replaces it), read back."""
    report, folder = st.crawl_errors(fx.runs(spark, sf_dir)), _folder(spark, "report")
    for _ in (0, 1):
        fl.write_report(report, folder)
    return fl.read_report(spark, folder, report.schema)


@query("price_bounds_rank_error", with_ctes(["fare_raw"], """
SELECT count(price) AS n, count(price) // 10000 + 1 AS slack, 2 AS bounds_within FROM fare_raw"""))
def price_bounds_rank_error(spark, sf_dir):
    """E1 approx: the number of prices, the rank error that the stated accuracy
    allows, and how many of the two approximate quartiles keep to it."""
    accuracy, raw = 10_000, fx.fare_raw(spark, sf_dir).where(F.col("price").isNotNull())
    b = st.price_bounds(raw, method="approx", accuracy=accuracy)
    p = F.col("price").cast("double")
    ranks = raw.crossJoin(F.broadcast(b)).agg(        # one row
        F.count(F.lit(1)).alias("n"), *[F.count_if(p < F.col(q)).alias(f"{q}_lo") for q in ("q1", "q3")],
        *[F.count_if(p <= F.col(q)).alias(f"{q}_hi") for q in ("q1", "q3")])
    slack = F.col("n") / accuracy + 1
    ok = [(F.col(f"{q}_lo") <= F.col("n") * f + slack) & (F.col(f"{q}_hi") >= F.col("n") * f - slack)
          for q, f in (("q1", 0.25), ("q3", 0.75))]
    return ranks.select("n", (F.floor(F.col("n") / accuracy) + 1).cast("bigint").alias("slack"),
                        sum(o.cast("int") for o in ok).cast("bigint").alias("bounds_within"))
