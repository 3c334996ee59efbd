"""Registered queries: crawl runs, extraction, logs, pages, texts
(A2 A11 B9-B12 D4 D6 E8-E13 G10-G13 G17-G19 H2 H3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faresight.functions import text as tx
from faresight.operators import stats as st
from faresight.operators.expand import history_projection, result_fallback
from faresight.operators.extract import (booking_fields, filter_log_noise,
                                         filter_url_noise, generic_flight,
                                         page_info, text_match_summary)
from faresight.operators.lookup import aircraft_at, aircraft_lookup, airport_mention
from faresight.plans import fixtures as fx
from faresight.plans.oracle import with_ctes
from faresight.plans.registry import query
from faresight.sources.airports import airports_df
from faresight.sources.files import flatten_runs, reconcile_layouts

_OPT = ("run_id, search_date, flight_number, departure_airport, arrival_airport, flight_date, "
        "departure_time, arrival_time, total_price, classes, aircraft_type")


@query("flatten_runs", with_ctes(["run_rows"], f"SELECT {_OPT} FROM run_rows"))
def flatten_runs_q(spark, sf_dir):
    return flatten_runs(fx.runs(spark, sf_dir)).select(*_OPT.split(", "))


@query("crawl_summary", with_ctes(["run_rows"], """
SELECT run_id, count(DISTINCT (search_date, departure_airport, arrival_airport)) AS total_days_crawled,
  count(*) AS total_price_options,
  count(DISTINCT flight_number) + max(CAST(flight_number IS NULL AS BIGINT)) AS total_unique_flights
FROM run_rows GROUP BY run_id"""))
def crawl_summary(spark, sf_dir):
    return st.crawl_summary(fx.runs(spark, sf_dir))


@query("crawl_errors", with_ctes(["day_errors"], r"""
SELECT regexp_replace(error, 'price option \d+', 'price option N') AS error, count(*) AS n
FROM day_errors WHERE error IS NOT NULL GROUP BY 1"""))
def crawl_errors(spark, sf_dir):
    return st.crawl_errors(fx.runs(spark, sf_dir))


@query("daily_flight_count", with_ctes(["run_rows"], """
SELECT run_id, search_date, departure_airport, arrival_airport, count(*) AS price_options,
  count(DISTINCT flight_number) + max(CAST(flight_number IS NULL AS BIGINT)) AS total_flights
FROM run_rows GROUP BY 1, 2, 3, 4"""))
def daily_flight_count(spark, sf_dir):
    """Per day of a run (one search day and route): options and flights."""
    return st.daily_flight_count(fx.run_rows(spark, sf_dir),
                                 keys=("run_id", "search_date", "departure_airport",
                                       "arrival_airport"))


def _aircraft(c="aircraft_type"):
    return F.nullif(F.trim(F.col(c)), F.lit(""))


@query("aircraft_map", with_ctes(["run_rows"], """
SELECT run_id, flight_number, arg_max(nullif(trim(aircraft_type), ''), event_id) AS aircraft_type
FROM run_rows WHERE flight_number IS NOT NULL AND nullif(trim(aircraft_type), '') IS NOT NULL
GROUP BY 1, 2"""))
def aircraft_map(spark, sf_dir):
    r = fx.run_rows(spark, sf_dir).withColumn("aircraft_type", _aircraft())
    return st.aircraft_map(r, pos="event_id")


@query("aircraft_lookup", with_ctes(["run_rows"], """
, r AS (SELECT run_id, event_id, flight_number, nullif(trim(aircraft_type), '') AS a FROM run_rows)
, base AS (SELECT run_id, flight_number, arg_max(a, event_id) AS a FROM r
           WHERE event_id % 64 < 32 AND flight_number IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2)
, cur AS (SELECT run_id, flight_number, arg_max(a, event_id) AS a FROM r
          WHERE event_id % 3 = 0 AND flight_number IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2)
SELECT r.run_id, r.event_id, r.flight_number, coalesce(cur.a, base.a) AS aircraft_type
FROM r LEFT JOIN base ON r.run_id = base.run_id AND r.flight_number = base.flight_number
LEFT JOIN cur ON r.run_id = cur.run_id AND r.flight_number = cur.flight_number"""))
def aircraft_lookup_q(spark, sf_dir):
    """All rows are read; the flags say which of them each capture saw (the
    start of the page its first half, the price time every third row)."""
    r = fx.run_rows(spark, sf_dir).withColumn("aircraft_type", _aircraft())
    return aircraft_at(r, F.col("event_id") % 64 < 32, F.col("event_id") % 3 == 0, pos="event_id").select(
        "run_id", "event_id", "flight_number", "aircraft_type")


@query("aircraft_maps_joined", with_ctes(["run_rows"], """
, r AS (SELECT run_id, event_id, flight_number, nullif(trim(aircraft_type), '') AS a FROM run_rows)
, cur AS (SELECT run_id, flight_number, arg_max(a, event_id) AS a FROM r
          WHERE flight_number IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2)
, base AS (SELECT run_id + 1 AS run_id, flight_number, a FROM cur)
SELECT r.run_id, r.event_id, r.flight_number, coalesce(cur.a, base.a) AS aircraft_type
FROM r LEFT JOIN base ON r.run_id = base.run_id AND r.flight_number = base.flight_number
LEFT JOIN cur ON r.run_id = cur.run_id AND r.flight_number = cur.flight_number"""))
def aircraft_maps_joined(spark, sf_dir):
    """Two given maps (D4): this run's, else the run's before."""
    r = fx.run_rows(spark, sf_dir).withColumn("aircraft_type", _aircraft())
    cur = st.aircraft_map(r, pos="event_id")
    base = cur.withColumn("run_id", F.col("run_id") + 1)
    return aircraft_lookup(r, base, cur).select("run_id", "event_id", "flight_number", "aircraft_type")


_NORM = (r"nullif(trim(regexp_replace(regexp_replace(replace({x}, ',', ''), '\s*VND\s*', '', 'g'),"
         r" '\s*₫\s*', '', 'g')), '')")


def _norm_price(x):
    n = _NORM.format(x=x)
    return f"TRY_CAST(CASE WHEN {n} = '0' THEN NULL ELSE {n} END AS DECIMAL(18,2))"


@query("booking_fields", with_ctes(["panel_text"], rf"""
SELECT event_id,
  nullif(regexp_extract(text, '(VJ\d+)', 1), '') AS flight_number,
  nullif(regexp_extract(text, '(\d{{2}}:\d{{2}})\s*-\s*(\d{{2}}:\d{{2}})', 1), '') AS departure_time,
  nullif(regexp_extract(text, '(\d{{2}}:\d{{2}})\s*-\s*(\d{{2}}:\d{{2}})', 2), '') AS arrival_time,
  nullif(regexp_extract(text, '(?i)(Skyboss|Business|Deluxe|Eco)', 1), '') AS classes,
  coalesce({_norm_price("nullif(regexp_extract(text, 'Tổng tiền\\s*([\\d][\\d,.]*\\s*(?:VND|₫)?)', 1), '')")},
           {_norm_price("nullif(regexp_extract(text, 'Chuyến đi\\s*([\\d][\\d,.]*\\s*(?:VND|₫)?)', 1), '')")}) AS total_price
FROM panel_text"""))
def booking_fields_q(spark, sf_dir):
    return booking_fields(fx.panel_text(spark, sf_dir)).select(
        "event_id", "flight_number", "departure_time", "arrival_time", "classes",
        "total_price")


@query("generic_flight", with_ctes(["panel_text"], r"""
SELECT event_id + 1 AS index, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
  coalesce(nullif(regexp_extract(text, '(?i)([\d,]+\s*(?:VND|₫|VNĐ))', 1), ''),
           nullif(regexp_extract(text, '([\d,]+)', 1), '')) AS price,
  array_to_string(regexp_extract_all(text, '\d{2}:\d{2}'), ',') AS times,
  nullif(regexp_extract(text, '(?i)(\d+h\s*\d*m?)', 1), '') AS duration
FROM panel_text WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''"""))
def generic_flight_q(spark, sf_dir):
    g = generic_flight(fx.panel_text(spark, sf_dir), index_col="event_id")
    return g.select("index", "text", "price", F.array_join("times", ",").alias("times"),
                    "duration")


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
             ("&nbsp;", " "), ("&amp;", "&")]
_PAGE_TEXT = (r"regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), "
              r"'<[^>]*>', '', 'g')")
for _e, _ch in _ENTITIES:
    _PAGE_TEXT = f"replace({_PAGE_TEXT}, '{_e}', '{_ch}')"
_PAGE_TEXT = f"substr({_PAGE_TEXT}, 1, 1000)"


@query("page_info", with_ctes(["captured_pages"], rf"""
SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
  {_PAGE_TEXT} AS page_text,
  regexp_matches(html, '(?i:class)\s*=\s*["''][^"'']*flight') AS has_results,
  (regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) NOT IN ('', 'about:blank')
   AND coalesce(url, '') NOT IN ('', 'about:blank') AND contains(lower(html), '<body')) AS valid
FROM captured_pages"""))
def page_info_q(spark, sf_dir):
    p = page_info(fx.captured_pages(spark, sf_dir))
    return p.select("page_id", "url", "title", "page_text", "has_results", "valid")


_LOG_TERMS = fx.LOG_NOISE
_URL_TERMS = fx.URL_NOISE


@query("log_noise_filter", with_ctes(["crawl_log"], f"""
SELECT event_id, type, message FROM crawl_log
WHERE type IN ('log', 'error', 'warning')
  AND NOT ({' OR '.join(f"contains(message, '{t}')" for t in _LOG_TERMS)})"""))
def log_noise_filter(spark, sf_dir):
    return filter_log_noise(fx.crawl_log(spark, sf_dir)).select("event_id", "type", "message")


@query("url_noise_filter", with_ctes(["crawl_log"], f"""
SELECT event_id, url FROM crawl_log
WHERE NOT success AND NOT ({' OR '.join(f"contains(url, '{t}')" for t in _URL_TERMS)})"""))
def url_noise_filter(spark, sf_dir):
    c = fx.crawl_log(spark, sf_dir).where(~F.col("success"))
    return filter_url_noise(c).select("event_id", "url")


@query("text_match", with_ctes(["short_documents"], r"""
SELECT 'contains' AS mode, count(*) AS matches, min(doc_id) AS first_doc_id FROM short_documents WHERE instr(lower(text), 'the') > 0
UNION ALL SELECT 'contains_case', count(*), min(doc_id) FROM short_documents WHERE instr(text, 'The') > 0
UNION ALL SELECT 'exact', count(*), min(doc_id) FROM short_documents WHERE lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) = 'the'
UNION ALL SELECT 'exact_case', count(*), min(doc_id) FROM short_documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') = 'The'"""))
def text_match_q(spark, sf_dir):
    d = fx.short_documents(spark, sf_dir)
    return text_match_summary(d, [("contains", "the", False, False),
                                  ("contains_case", "The", False, True),
                                  ("exact", "the", True, False),
                                  ("exact_case", "The", True, True)])


@query("airport_mention", with_ctes(["airports", "airport_texts"], """
SELECT a.code, count(*) AS n_texts, min(d.doc_id) AS first_doc_id
FROM airport_texts d JOIN airports a
  ON instr(d.text, a.code) > 0 OR instr(d.text, a.city) > 0 OR instr(d.text, a.airport_name) > 0
GROUP BY a.code"""))
def airport_mention_q(spark, sf_dir):
    return airport_mention(fx.airport_texts(spark, sf_dir), airports_df(spark))


@query("execution_stats", with_ctes(["crawl_log"], """
SELECT event_id, duration AS executionTime, printf('%.2fs', duration / 1000.0) AS executionTimeFormatted,
  success, n_steps AS stepsCompleted, n_screenshots AS screenshotsTaken,
  (results IS NOT NULL AND results <> '') AS hasResults, route, start_time AS startTime,
  coalesce(error_time, strftime(CAST(start_time AS TIMESTAMP) + to_milliseconds(duration),
           '%Y-%m-%dT%H:%M:%S.%gZ')) AS endTime
FROM crawl_log"""))
def execution_stats(spark, sf_dir):
    e = st.execution_stats(fx.crawl_log(spark, sf_dir))
    return e.select("event_id", "executionTime", "executionTimeFormatted", "success",
                    F.col("stepsCompleted").cast("bigint").alias("stepsCompleted"),
                    F.col("screenshotsTaken").cast("bigint").alias("screenshotsTaken"),
                    "hasResults", "route", "startTime", "endTime")


@query("retry_outcome", with_ctes(["attempts"], """
SELECT request_id, min(CASE WHEN success THEN attempt END) IS NOT NULL AS success,
  coalesce(min(CASE WHEN success THEN attempt END), max(attempt)) AS attempts_used,
  CASE WHEN min(CASE WHEN success THEN attempt END) IS NULL
       THEN arg_max(coalesce(error, 'Crawler failed without specific error'), attempt) FILTER (WHERE NOT success) END AS error
FROM attempts WHERE attempt <= 4 GROUP BY request_id"""))
def retry_outcome(spark, sf_dir):
    return st.retry_outcome(fx.attempts(spark, sf_dir), max_retries=3)


@query("history_projection", with_ctes(["run_rows", "requests"], """
SELECT r.run_id, '2024-01-01T00:00:00.000Z' AS created_at, r.flight_number, r.aircraft_type,
  r.departure_airport, r.arrival_airport,
  coalesce(CASE WHEN r.event_id % 5 <> 0 THEN r.flight_date END,
           strftime(strptime(r.search_date, '%d/%m/%Y'), '%Y-%m-%dT00:00:00.000Z')) AS flight_date,
  r.departure_time, r.arrival_time, r.classes, r.total_price AS price, q.adult, q.child, q.infant
FROM run_rows r LEFT JOIN requests q ON q.request_id = r.run_id"""))
def history_projection_q(spark, sf_dir):
    """Every fifth option lost its scraped date, so the search day fills it."""
    src = fx.run_rows(spark, sf_dir).withColumn(
        "flight_date", F.when(F.col("event_id") % 5 != 0, F.col("flight_date")))
    return history_projection(src, fx.requests(spark, sf_dir),
                              batch_ts="2024-01-01T00:00:00.000Z")


@query("result_fallback", with_ctes(["run_rows", "panel_text"], """
, src AS (
  SELECT run_id AS request_id, 1 AS priority, 'script' AS source FROM run_rows
   WHERE CASE WHEN run_id % 4 <> 0 THEN total_price END IS NOT NULL
  UNION ALL SELECT event_id // 64, 2, 'generic' FROM panel_text
   WHERE CASE WHEN (event_id // 64) % 8 <> 0 THEN text END IS NOT NULL
  UNION ALL SELECT page_id, 3, 'page_info' FROM pages)
, best AS (SELECT request_id, min(priority) AS priority FROM src GROUP BY 1)
SELECT s.request_id, s.source, count(*) AS rows FROM src s
JOIN best b ON s.request_id = b.request_id AND s.priority = b.priority GROUP BY 1, 2"""))
def result_fallback_q(spark, sf_dir):
    """Every fourth run's script found no price, every eighth page's generic
    extraction no text: all rows are read, the operators' filters on those
    values decide."""
    script = (fx.run_rows(spark, sf_dir).withColumnRenamed("run_id", "request_id")
              .withColumn("total_price", F.when(F.col("request_id") % 4 != 0, F.col("total_price")))
              .where(F.col("total_price").isNotNull()))
    generic = (fx.panel_text(spark, sf_dir)
               .withColumn("request_id", (F.col("event_id") / 64).cast("bigint"))
               .withColumn("text", F.when(F.col("request_id") % 8 != 0, F.col("text")))
               .where(F.col("text").isNotNull()))
    pages = fx.table(spark, sf_dir, "pages").withColumnRenamed("page_id", "request_id")
    chosen = result_fallback([(1, "script", script), (2, "generic", generic),
                              (3, "page_info", pages.select("request_id", "url"))])
    return chosen.groupBy("request_id", "source").agg(F.count(F.lit(1)).alias("rows"))


_LAYOUT_COLS = ("create_at, flight_number, type_of_plane, departure_airport, arrival_airport, "
                "flight_date, departure_time, arrival_time, classes, price, adult, child, infant")


@query("layouts_reunited", with_ctes(["fare_raw"], f"""
SELECT {_LAYOUT_COLS} FROM (
  SELECT create_at, flight_number, type_of_plane, departure_airport, arrival_airport, flight_date,
    departure_time, arrival_time, classes, CAST(price AS VARCHAR) AS price,
    CAST(event_id % 3 + 1 AS INTEGER) AS adult, CAST(event_id % 2 AS INTEGER) AS child,
    CAST(event_id % 4 = 0 AS INTEGER) AS infant FROM fare_raw WHERE event_id % 2 = 0
  UNION ALL BY NAME
  SELECT create_at, flight_number, type_of_plane, departure_airport, arrival_airport, flight_date,
    departure_time, arrival_time, classes, CAST(price AS VARCHAR) AS price
  FROM fare_raw WHERE event_id % 2 = 1)"""))
def layouts_reunited(spark, sf_dir):
    r = fx.fare_raw(spark, sf_dir).withColumn("price", F.col("price").cast("string"))
    w = {"create_at": "created_at", "type_of_plane": "aircraft_type"}
    eid = F.col("event_id")
    l13 = (r.where(eid % 2 == 0).withColumnsRenamed(w)
           .withColumns({"adult": (eid % 3 + 1).cast("string"),
                         "child": (eid % 2).cast("string"),
                         "infant": (eid % 4 == 0).cast("int").cast("string")})
           .drop("event_id"))
    l10 = r.where(eid % 2 == 1).withColumnsRenamed(w).drop("event_id")
    return reconcile_layouts(l13, l10).select(*_LAYOUT_COLS.split(", "))


@query("month_header", with_ctes([], r"""
SELECT TRY_CAST(regexp_extract(lower(h), 'tháng\s+(\d+)\s+(\d+)', 1) AS INTEGER) AS month,
       TRY_CAST(regexp_extract(lower(h), 'tháng\s+(\d+)\s+(\d+)', 2) AS INTEGER) AS year,
       count(*) AS rows
FROM (SELECT 'Tháng ' || strftime(o_orderdate, '%m') || ' ' || strftime(o_orderdate, '%Y') AS h
      FROM orders) GROUP BY 1, 2"""))
def month_header(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    h = F.concat(F.lit("Tháng "), F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "MM yyyy"))
    m, y = tx.month_header(h)
    return o.groupBy(m.alias("month"), y.alias("year")).agg(F.count(F.lit(1)).alias("rows"))


@query("aircraft_name", with_ctes(["fare_raw"], r"""
SELECT CASE WHEN regexp_matches(trim(coalesce(type_of_plane, '') || ' - Bay thẳng'), '(?i)^(Airbus|Boeing)')
            THEN trim(split_part(trim(coalesce(type_of_plane, '') || ' - Bay thẳng'), '-', 1)) END AS aircraft,
       regexp_matches(coalesce(flight_number, ''), '^VJ\d{3,4}$') AS direct_flight, count(*) AS rows
FROM fare_raw GROUP BY 1, 2"""))
def aircraft_name_q(spark, sf_dir):
    r = fx.fare_raw(spark, sf_dir)
    span = F.concat(F.coalesce("type_of_plane", F.lit("")), F.lit(" - Bay thẳng"))
    container = F.concat(F.coalesce("flight_number", F.lit("")), F.lit(" "), span)
    return r.groupBy(tx.aircraft_name(span).alias("aircraft"),
                     F.coalesce(tx.is_direct_container(container, F.coalesce(
                         "flight_number", F.lit(""))), F.lit(False)).alias("direct_flight")
                     ).agg(F.count(F.lit(1)).alias("rows"))


@query("crawl_day_errors", with_ctes(["day_errors"], """
SELECT run_id, search_date, departure_airport, arrival_airport,
  coalesce(error, '') AS errors, CAST(CASE WHEN error IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_errors
FROM day_errors"""))
def crawl_day_errors(spark, sf_dir):
    """Per day of a run: error list (joined as text) and error count."""
    d = st.crawl_day_errors(fx.runs(spark, sf_dir))
    return d.select("run_id", "search_date", "departure_airport", "arrival_airport",
                    F.array_join("errors", "|").alias("errors"), "n_errors")
