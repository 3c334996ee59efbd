"""Fare-shaped tables derived by Spark from the given test tables.

The reference ships no data, so the fare history, search requests,
captured panel text, crawl runs, crawl log and attempt log are derived
row for row from ``events`` and ``orders`` (see FIXTURES.md). All
derivations are narrow (per-row) except where a fixture is nested, and
they grow with the input tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faresight.functions.timeparts import iso_millis
from faresight.operators.extract import LOG_NOISE_TERMS as LOG_NOISE
from faresight.sources.airports import AIRPORTS
from faresight.operators.extract import URL_NOISE_TERMS as URL_NOISE

# --- fixed values (fixture construction, shared with the SQL oracle) ------
AIRLINE_BY_EVENT = {"click": "VJ", "view": "VN", "purchase": "QH",
                    "signup": "BL", "error": "VU"}
DEP_CODES = "SGNHANDADCXRPQCVDOHUIHPHVDHVII"
ARR_CODES = "HANSGNDADPQCCXRVDOHUIHPHVDHVII"
CLASSES = ["Eco", "Deluxe", "Business", "SkyBoss"]
# Passenger counts as JavaScript reads them, and texts that only look like numbers
ODD_COUNTS = ["nan", "NaN", "2d", "1f", "inf", "Infinity", "0x2", "0X1F", "0o3", "0b1", "0x", " 3\u00a0", "1e0", ".5", "2.", "+1",
              "-0", "1_0", "١", "- 1", ""]
OTHER_DIGITS = "١٢:٣٤ - ١٥:٣٠ ٩٩ VND ٣h "
REQ_DEP_CODES = "SGNhanDADXXXPQC"
REQ_ARR_CODES = "HANSGNDADCXRPQC"
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table (pruning and filters reach its parquet scan). The test
    tables are single files of one row group, so a scan that yields fewer
    splits than cores is dealt out once here, before the fixtures' per-row
    work; a table of many splits is left as it is. A plain scan has no
    shuffle to run for the count."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _mod(c: Column, n: int) -> Column:
    return c % F.lit(n)


def _utc(ts: Column) -> Column:
    """Test-table stamps are timestamp_ntz; keep them as wall clock."""
    return ts.cast("timestamp_ntz")


def fare_raw(spark: SparkSession, sf_dir: str, keep_id: bool = True) -> DataFrame:
    """The dirty fare history (analysis layout), one row per event."""
    e = table(spark, sf_dir, "events")
    eid, uid, ts = F.col("event_id"), F.col("user_id"), _utc(F.col("ts"))
    prefix = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v))
                          for k, v in AIRLINE_BY_EVENT.items()])
    plane = (F.when(_mod(eid, 97) == 0, F.lit("  "))
             .when(_mod(eid, 101) == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit(" Airbus A32"), _mod(eid, 4).cast("string"),
                                 F.lit(" "))))
    fdate = F.date_add(F.to_date(ts), (_mod(uid * 37, 140) - 5).cast("int"))
    cls = F.element_at(F.array(*[F.lit(c) for c in CLASSES]),
                       (_mod(eid, 4) + 1).cast("int"))
    cols = {
        "create_at": F.when(_mod(eid, 89) == 0, F.lit("bad")).otherwise(iso_millis(ts)),
        "flight_number": F.when(_mod(eid, 79) == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(prefix, (100 + _mod(uid, 400)).cast("string"))),
        "type_of_plane": plane,
        "departure_airport": F.substring(F.lit(DEP_CODES),
                                         (1 + 3 * _mod(uid, 10)).cast("int"), 3),
        "arrival_airport": F.substring(F.lit(ARR_CODES),
                                       (1 + 3 * _mod(eid, 10)).cast("int"), 3),
        "flight_date": F.when(_mod(eid, 83) == 0, F.lit("2024-03-01"))
        .otherwise(F.date_format(fdate, "yyyy-MM-dd'T'00:00:00.000'Z'")),
        "departure_time": F.when(_mod(eid, 71) == 0, F.lit("n/a")).otherwise(
            F.concat(_pad2(_mod(eid, 24)), F.lit(":"), _pad2(_mod(eid * 7, 60)))),
        "arrival_time": F.concat(_pad2(_mod(eid + 2 + _mod(uid, 3), 24)), F.lit(":"),
                                 _pad2(_mod(eid * 11, 60))),
        "classes": cls,
        "price": (F.col("value") * 10000).cast("decimal(18,2)"),
    }
    out = e.select(*([eid] if keep_id else []),
                   *[v.alias(k) for k, v in cols.items()])
    return out


def fare_raw_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fare_raw`` plus a second copy of every 50th row, id left out:
    the input of exact dedupe (B1)."""
    raw = fare_raw(spark, sf_dir)
    copies = raw.where(F.col("event_id") % 50 == 0)
    return raw.unionByName(copies).drop("event_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests, one per order, with bad and missing values."""
    o = table(spark, sf_dir, "orders")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    dep_date = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "dd/MM/yyyy")
    odd = F.element_at(F.array(*[F.lit(x) for x in ODD_COUNTS]), (F.floor(k / 13) % len(ODD_COUNTS) + 1).cast("int"))
    child = (F.when(_mod(k, 23) == 0, F.lit("x")).when(_mod(k, 13) == 5, odd)
             .otherwise((_mod(ck, 3) - F.when(_mod(k, 29) == 0, 3).otherwise(0))
                        .cast("string")))
    return o.select(
        k.alias("request_id"),
        F.substring(F.lit(REQ_DEP_CODES), (1 + 3 * _mod(k, 5)).cast("int"), 3)
        .alias("departure_airport"),
        F.when(_mod(k, 17) == 0, F.lit(None).cast("string")).otherwise(
            F.substring(F.lit(REQ_ARR_CODES), (1 + 3 * _mod(_mod(k, 7), 5)).cast("int"), 3))
        .alias("arrival_airport"),
        dep_date.alias("departure_date"),
        F.when(_mod(k, 3) == 0, F.lit("roundtrip")).when(_mod(k, 19) == 0, F.lit("multi"))
        .otherwise(F.lit("oneway")).alias("trip_type"),
        F.when(_mod(k, 6) == 0, dep_date).alias("return_date"),
        F.when(_mod(k, 13) == 2, odd).otherwise(_mod(ck, 4).cast("string")).alias("adult"),
        child.alias("child"),
        F.when(_mod(k, 13) == 7, odd).otherwise(_mod(ck, 5).cast("string")).alias("infant"),
    )


def panel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured booking-panel text built from each fare row."""
    r = fare_raw(spark, sf_dir)

    def s(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    eid, amount = F.col("event_id"), F.concat(s(F.floor(F.col("price")).cast("bigint")), F.lit(",000"))
    # white space around, a zero total with a trip price, a trip price only
    price = (F.when(_mod(eid, 13) == 0, F.concat(F.lit("Tổng tiền 0 VND Chuyến đi "), amount, F.lit(" ₫ ")))
             .when(_mod(eid, 17) == 0, F.concat(F.lit("Chuyến đi\n"), amount, F.lit("₫ ")))
             .otherwise(F.concat(F.lit("Tổng tiền "), amount, F.lit(" VND "))))
    txt = F.concat(F.when(_mod(eid, 5) == 0, F.lit("\n\t ")).otherwise(F.lit("")),
                   F.when(_mod(eid, 19) == 0, F.lit(OTHER_DIGITS)).otherwise(F.lit("")), price,
                   s(F.col("flight_number")), F.lit(" "),
                   s(F.col("departure_time")), F.lit(" - "), s(F.col("arrival_time")),
                   F.lit(" "), s(F.col("classes")),
                   F.when(_mod(eid, 7) == 0, F.lit(" \n")).otherwise(F.lit("")))
    return r.select("event_id", txt.alias("text"))


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat price options with their run and search day: a run is a block
    of 64 consecutive events, a day its rows of one flight date."""
    r = fare_raw(spark, sf_dir)
    fd = F.col("flight_date")
    day = F.concat(F.substring(fd, 9, 2), F.lit("/"), F.substring(fd, 6, 2),
                   F.lit("/"), F.substring(fd, 1, 4))
    return r.select(
        (F.col("event_id") / 64).cast("bigint").alias("run_id"),
        day.alias("search_date"), "event_id", "flight_number",
        "departure_airport", "arrival_airport", "flight_date", "departure_time",
        "arrival_time", F.col("price").cast("string").alias("total_price"),
        "classes", F.col("type_of_plane").alias("aircraft_type"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested crawl runs (A5 layout): days hold price options and errors.

    Arrays are bounded by construction (at most 64 options per run).
    """
    rows = run_rows(spark, sf_dir)
    opt = F.struct("flight_number", "departure_airport", "arrival_airport",
                   "flight_date", "departure_time", "arrival_time",
                   "total_price", "classes", "aircraft_type")
    first = F.min("event_id")
    errors = (F.when(first % 7 == 0, F.array(F.lit("Timeout: Could not find any prices on the page.")))
              .when(first % 11 == 0, F.array(F.concat(
                  F.lit("Failed to click price option "), (first % 5).cast("string"),
                  F.lit("."))))
              .otherwise(F.array().cast("array<string>")))
    days = rows.groupBy("run_id", "search_date", "departure_airport",
                        "arrival_airport").agg(
        F.sort_array(F.collect_list(F.struct("event_id", opt.alias("o")))).alias("__p"),
        errors.alias("errors"), first.alias("__first"))
    days = days.select(
        "run_id", "__first",
        F.struct(F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"), "search_date",
                 "departure_airport", "arrival_airport",
                 F.lit("fixture").alias("source"),
                 F.size(F.array_distinct(F.transform(
                     "__p", lambda p: p["o"]["flight_number"]))).cast("bigint")
                 .alias("total_flights"),
                 F.transform("__p", lambda p: p["o"]).alias("prices"),
                 "errors").alias("d"))
    return days.groupBy("run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__first", "d"))),
                    lambda x: x["d"]).alias("daily_results"))


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl outcome / browser log line per event."""
    e = table(spark, sf_dir, "events")
    eid, uid, ts = F.col("event_id"), F.col("user_id"), _utc(F.col("ts"))
    noise = F.element_at(F.array(*[F.lit(t) for t in LOG_NOISE]),
                         (_mod(eid, 8) + 1).cast("int"))
    tracker = F.element_at(F.array(*[F.lit(t) for t in URL_NOISE]),
                           (_mod(eid, 10) + 1).cast("int"))
    log_type = (F.when(F.col("event_type").isin("click", "view"), F.lit("log"))
                .when(F.col("event_type") == "purchase", F.lit("warning"))
                .when(F.col("event_type") == "error", F.lit("error"))
                .otherwise(F.lit("debug")))
    message = F.concat(F.lit("message "), eid.cast("string"),
                       F.when(_mod(eid, 3) == 0, F.concat(F.lit(" "), noise))
                       .otherwise(F.lit("")))
    url = F.concat(F.lit("https://www.example.com/p/"), eid.cast("string"),
                   F.when(_mod(eid, 4) == 0, F.concat(F.lit("?src="), tracker))
                   .otherwise(F.lit("")))
    dur = F.coalesce((F.col("value") * 1000).cast("bigint"), F.lit(0).cast("bigint"))
    err_ts = F.timestamp_add("MILLISECOND", dur, ts)
    is_err = F.col("event_type") == "error"
    return e.select(
        eid, log_type.alias("type"), message.alias("message"), url.alias("url"),
        (~is_err).alias("success"),
        F.concat(F.substring(F.lit(DEP_CODES), (1 + 3 * _mod(uid, 10)).cast("int"), 3),
                 F.lit(" → "),
                 F.substring(F.lit(ARR_CODES), (1 + 3 * _mod(eid, 10)).cast("int"), 3))
        .alias("route"),
        dur.alias("duration"),
        F.when(_mod(eid, 6) == 0, F.lit(None).cast("string")).otherwise(F.lit("ok"))
        .alias("results"),
        F.array_repeat(F.lit("shot.png"), _mod(eid, 4).cast("int")).alias("screenshots"),
        F.array_repeat(F.lit("step"), _mod(uid, 9).cast("int")).alias("steps"),
        F.when(is_err, F.concat(F.lit("failed at "), eid.cast("string"))).alias("error"),
        F.struct(iso_millis(ts).alias("startTime"),
                 F.lit("https://www.example.com/").alias("url"),
                 F.lit("fixture-agent").alias("userAgent"),
                 F.when(is_err, iso_millis(err_ts)).alias("errorTime"),
                 F.lit(None).cast("string").alias("errorStack")).alias("metadata"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt log: blocks of six consecutive events are one request's
    attempts 1..6; an error event is a failed attempt."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    failed = F.col("event_type") == "error"
    return e.select(
        (eid / 6).cast("bigint").alias("request_id"),
        (_mod(eid, 6) + 1).cast("int").alias("attempt"),
        (~failed).alias("success"),
        F.when(failed & (_mod(eid, 4) != 0), F.concat(F.lit("attempt failed: event "), eid.cast("string")))
        .alias("error"))


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures: some without url, title or body, some with
    flight results."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    html = F.when(k % 3 == 0, F.replace("html", F.lit('class="ad"'), F.lit('class="flight ad"'))).otherwise(F.col("html"))
    html = F.when(k % 7 == 0, F.regexp_replace(html, "<title>[^<]*</title>", "<title></title>")).otherwise(html)
    html = F.when(k % 17 == 0, F.replace(html, F.lit("<body"), F.lit("<main"))).otherwise(html)
    return p.select("page_id", F.when(k % 13 == 0, F.lit("about:blank")).when(k % 11 != 0, F.col("url")).alias("url"),
                    html.alias("html"))


def short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, some of them one word with white space around."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.withColumn("text", F.when(k % 97 == 0, F.lit("\n the\t")).when(k % 101 == 0, F.lit("The"))
                        .otherwise(F.col("text")))


def airport_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, every fourth with the city of an airport."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    city = F.element_at(F.array(*[F.lit(a[1]) for a in AIRPORTS]), (F.floor(k / 4) % len(AIRPORTS) + 1).cast("int"))
    return d.withColumn("text", F.when(k % 4 == 0, F.concat("text", F.lit(" "), city)).otherwise(F.col("text")))


def endpoint_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request as the raw JSON body of an endpoint call: counts that
    are absent, null or text, and bodies that are cut off."""
    r, k = requests(spark, sf_dir), F.col("request_id")

    def pair(name, c, when=F.lit(True)):
        text = F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
        return F.when(when, F.concat(F.lit(f'"{name}":'), text))

    raw = F.concat(F.lit("{"), F.concat_ws(
        ",", pair("departure_airport", F.col("departure_airport")), pair("arrival_airport", F.col("arrival_airport")),
        pair("departure_date", F.col("departure_date")), pair("trip_type", F.col("trip_type"), k % 8 != 0),
        pair("return_date", F.col("return_date"), F.col("return_date").isNotNull()),
        pair("adult", F.when(k % 14 != 0, F.col("adult")), k % 43 != 0),
        pair("child", F.when(k % 10 != 0, F.col("child")), k % 9 != 0),
        pair("infant", F.when(k % 12 != 0, F.col("infant")), k % 15 != 0)), F.lit("}"))
    return r.select("request_id", F.when(k % 41 == 0, F.substring(raw, 1, 30)).otherwise(raw).alias("raw"))


def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request as raw JSON text, with absent keys, explicit nulls and
    values of the wrong JSON type (for the structure check on raw JSON)."""
    r = requests(spark, sf_dir)
    k = F.col("request_id")

    def js(c):
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), c, F.lit('"')))

    fc = (F.when(k % 7 == 0, F.lit(',"find_cheapest":"yes"'))
          .when(k % 13 == 0, F.lit(',"find_cheapest":null'))
          .when(k % 2 == 0, F.lit(',"find_cheapest":true')).otherwise(F.lit("")))
    dd = F.when(k % 11 == 0, F.lit("20250101")).otherwise(js(F.col("departure_date")))
    so = F.when(k % 31 == 0, F.lit("")).otherwise(F.concat(
        F.lit(',"search_options":{"trip_type":'), js(F.col("trip_type")), fc,
        F.lit(',"departure_date":'), dd, F.lit("}")))
    dep = F.when(k % 37 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"departure_airport":'), js(F.col("departure_airport")), F.lit(",")))
    raw = F.concat(F.lit("{"), dep, F.lit('"arrival_airport":'), js(F.col("arrival_airport")),
                   so, F.lit(',"adult":'), js(F.col("adult")), F.lit("}"))
    # every 41st request is cut off in the middle
    raw = F.when(k % 41 == 0, F.substring(raw, 1, 25)).otherwise(raw)
    return r.select("request_id", raw.alias("raw"))
