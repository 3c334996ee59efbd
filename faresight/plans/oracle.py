"""DuckDB SQL twins of the fixtures and cleaning stages.

Each entry is a CTE body plus the CTEs it reads; ``with_ctes`` resolves
the order. The oracle is written independently of the Spark code: it
reads the same parquet views and derives everything in plain SQL.
"""

from __future__ import annotations

from faresight.operators.extract import LOG_NOISE_TERMS, URL_NOISE_TERMS
from faresight.plans.fixtures import ODD_COUNTS, OTHER_DIGITS
from faresight.sources.airports import AIRPORTS

TIME_RE = r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$"

CTES: dict[str, tuple[str, list[str]]] = {}


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"




def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTES[name] = (sql, deps or [])


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    return f"WITH {parts}\n{body}"


def minutes_sql(col: str) -> str:
    return (f"(TRY_CAST(regexp_extract({col}, '{TIME_RE}', 1) AS BIGINT) * 60 + "
            f"TRY_CAST(regexp_extract({col}, '{TIME_RE}', 2) AS BIGINT))")


cte("fare_raw", r"""
SELECT event_id,
  CASE WHEN event_id % 89 = 0 THEN 'bad'
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS create_at,
  CASE WHEN event_id % 79 = 1 THEN NULL
       ELSE (CASE event_type WHEN 'click' THEN 'VJ' WHEN 'view' THEN 'VN'
             WHEN 'purchase' THEN 'QH' WHEN 'signup' THEN 'BL' WHEN 'error' THEN 'VU' END)
            || CAST(100 + user_id % 400 AS VARCHAR) END AS flight_number,
  CASE WHEN event_id % 97 = 0 THEN '  ' WHEN event_id % 101 = 0 THEN NULL
       ELSE ' Airbus A32' || CAST(event_id % 4 AS VARCHAR) || ' ' END AS type_of_plane,
  substr('SGNHANDADCXRPQCVDOHUIHPHVDHVII', CAST(1 + 3 * (user_id % 10) AS INTEGER), 3) AS departure_airport,
  substr('HANSGNDADPQCCXRVDOHUIHPHVDHVII', CAST(1 + 3 * (event_id % 10) AS INTEGER), 3) AS arrival_airport,
  CASE WHEN event_id % 83 = 0 THEN '2024-03-01'
       ELSE strftime(CAST(ts AS DATE) + CAST((user_id * 37) % 140 - 5 AS INTEGER),
                     '%Y-%m-%dT00:00:00.000Z') END AS flight_date,
  CASE WHEN event_id % 71 = 0 THEN 'n/a'
       ELSE lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':'
            || lpad(CAST((event_id * 7) % 60 AS VARCHAR), 2, '0') END AS departure_time,
  lpad(CAST((event_id + 2 + user_id % 3) % 24 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST((event_id * 11) % 60 AS VARCHAR), 2, '0') AS arrival_time,
  (['Eco', 'Deluxe', 'Business', 'SkyBoss'])[CAST(event_id % 4 + 1 AS INTEGER)] AS classes,
  CAST(value * 10000 AS DECIMAL(18,2)) AS price
FROM events""")

FARE_COLS = ("create_at, flight_number, type_of_plane, departure_airport, "
             "arrival_airport, flight_date, departure_time, arrival_time, classes, price")

cte("fare_raw_copies", f"""
SELECT {FARE_COLS} FROM fare_raw
UNION ALL
SELECT {FARE_COLS} FROM fare_raw WHERE event_id % 50 = 0""", ["fare_raw"])

cte("deduped", f"SELECT DISTINCT {FARE_COLS} FROM fare_raw_copies", ["fare_raw_copies"])

cte("bounds", """
SELECT q[1] AS q1, q[2] AS q3, q[2] - q[1] AS iqr,
       q[1] - 1.5 * (q[2] - q[1]) AS lower_bound, q[2] + 1.5 * (q[2] - q[1]) AS upper_bound
FROM (SELECT quantile_cont(CAST(price AS DOUBLE), [0.25, 0.75]) AS q FROM deduped)""",
    ["deduped"])

cte("filtered", """
SELECT d.* FROM deduped d, bounds b
WHERE CAST(d.price AS DOUBLE) BETWEEN b.lower_bound AND b.upper_bound""",
    ["deduped", "bounds"])

cte("fares", """
SELECT * FROM (
  SELECT TRY_CAST(create_at AS TIMESTAMP) AS create_at, flight_number,
         trim(type_of_plane) AS type_of_plane, departure_airport, arrival_airport,
         CASE WHEN contains(flight_date, 'T') THEN TRY_CAST(flight_date AS TIMESTAMP) END AS flight_date,
         departure_time, arrival_time, classes, price
  FROM filtered)
WHERE create_at IS NOT NULL AND flight_date IS NOT NULL
  AND type_of_plane IS NOT NULL AND type_of_plane <> ''""", ["filtered"])

cte("fare_time", f"""
SELECT *,
  CAST(hour(create_at) AS BIGINT) AS create_hour,
  CAST(isodow(create_at) - 1 AS BIGINT) AS create_day_of_week,
  CAST(month(create_at) AS BIGINT) AS create_month,
  CAST(month(flight_date) AS BIGINT) AS flight_month,
  CAST(isodow(flight_date) - 1 AS BIGINT) AS flight_day_of_week,
  CAST(floor(date_diff('microsecond', create_at, flight_date) / 86400000000) AS BIGINT) AS days_in_advance,
  {minutes_sql('departure_time')} AS departure_minutes,
  {minutes_sql('arrival_time')} AS arrival_minutes,
  substr(flight_number, 1, 2) AS airline
FROM fares""", ["fares"])

cte("route_cnt", """
SELECT departure_airport, arrival_airport, count(*) AS route_popularity
FROM fare_time WHERE departure_airport IS NOT NULL AND arrival_airport IS NOT NULL
GROUP BY 1, 2""", ["fare_time"])

cte("airline_cnt", """
SELECT airline, count(*) AS airline_popularity FROM fare_time
WHERE airline IS NOT NULL GROUP BY 1""", ["fare_time"])

ENC = ["flight_number", "departure_airport", "arrival_airport", "classes",
       "type_of_plane", "airline"]

cte("encoders", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS attribute, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS BIGINT) AS code "
    f"FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM fare_time)"
    for c in ENC), ["fare_time"])

_enc_joins = "\n".join(
    f"LEFT JOIN (SELECT value AS v_{c}, code AS {c}_encoded FROM encoders WHERE attribute = '{c}') e_{c} "
    f"ON coalesce(CAST(t.{c} AS VARCHAR), 'nan') = e_{c}.v_{c}" for c in ENC)

cte("features", f"""
SELECT t.*,
  CAST(t.create_day_of_week >= 5 AS BIGINT) AS is_weekend_booking,
  CAST(t.flight_day_of_week >= 5 AS BIGINT) AS is_weekend_flight,
  CASE WHEN t.days_in_advance < 7 THEN 0 WHEN t.days_in_advance < 30 THEN 1
       WHEN t.days_in_advance < 90 THEN 2 ELSE 3 END AS booking_category,
  CASE WHEN t.arrival_minutes - t.departure_minutes < 0
       THEN t.arrival_minutes - t.departure_minutes + 1440
       ELSE t.arrival_minutes - t.departure_minutes END AS flight_duration,
  CASE WHEN floor(t.departure_minutes / 60) >= 6 AND floor(t.departure_minutes / 60) < 12 THEN 0
       WHEN floor(t.departure_minutes / 60) >= 12 AND floor(t.departure_minutes / 60) < 18 THEN 1
       WHEN floor(t.departure_minutes / 60) >= 18 AND floor(t.departure_minutes / 60) < 22 THEN 2
       ELSE 3 END AS departure_time_category,
  coalesce(r.route_popularity, 0) AS route_popularity,
  coalesce(a.airline_popularity, 0) AS airline_popularity,
  {", ".join(f"{c}_encoded" for c in ENC)}
FROM fare_time t
LEFT JOIN route_cnt r ON t.departure_airport = r.departure_airport AND t.arrival_airport = r.arrival_airport
LEFT JOIN airline_cnt a ON t.airline = a.airline
{_enc_joins}""", ["fare_time", "route_cnt", "airline_cnt", "encoders"])

cte("requests", r"""
SELECT o_orderkey AS request_id,
  substr('SGNhanDADXXXPQC', CAST(1 + 3 * (o_orderkey % 5) AS INTEGER), 3) AS departure_airport,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       ELSE substr('HANSGNDADCXRPQC', CAST(1 + 3 * ((o_orderkey % 7) % 5) AS INTEGER), 3) END AS arrival_airport,
  strftime(o_orderdate, '%d/%m/%Y') AS departure_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'roundtrip' WHEN o_orderkey % 19 = 0 THEN 'multi'
       ELSE 'oneway' END AS trip_type,
  CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS return_date,
  CASE WHEN o_orderkey % 13 = 2 THEN {ODD} ELSE CAST(o_custkey % 4 AS VARCHAR) END AS adult,
  CASE WHEN o_orderkey % 23 = 0 THEN 'x' WHEN o_orderkey % 13 = 5 THEN {ODD}
       ELSE CAST(o_custkey % 3 - CASE WHEN o_orderkey % 29 = 0 THEN 3 ELSE 0 END AS VARCHAR) END AS child,
  CASE WHEN o_orderkey % 13 = 7 THEN {ODD} ELSE CAST(o_custkey % 5 AS VARCHAR) END AS infant
FROM orders""".replace("{ODD}", "[" + ", ".join(f"'{x}'" for x in ODD_COUNTS) + f"][o_orderkey // 13 % {len(ODD_COUNTS)} + 1]"))

cte("panel_text", """
SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN chr(10) || chr(9) || ' ' ELSE '' END
  || CASE WHEN event_id % 19 = 0 THEN '{OTHER}' ELSE '' END
  || CASE WHEN event_id % 13 = 0 THEN 'Tổng tiền 0 VND Chuyến đi ' || coalesce(CAST(CAST(floor(price) AS BIGINT) AS VARCHAR), '') || ',000 ₫ '
          WHEN event_id % 17 = 0 THEN 'Chuyến đi' || chr(10) || coalesce(CAST(CAST(floor(price) AS BIGINT) AS VARCHAR), '') || ',000₫ '
          ELSE 'Tổng tiền ' || coalesce(CAST(CAST(floor(price) AS BIGINT) AS VARCHAR), '') || ',000 VND ' END
  || coalesce(flight_number, '') || ' ' || coalesce(departure_time, '') || ' - '
  || coalesce(arrival_time, '') || ' ' || coalesce(classes, '')
  || CASE WHEN event_id % 7 = 0 THEN ' ' || chr(10) ELSE '' END AS text
FROM fare_raw""".replace("{OTHER}", OTHER_DIGITS), ["fare_raw"])

cte("run_rows", """
SELECT event_id // 64 AS run_id,
  substr(flight_date, 9, 2) || '/' || substr(flight_date, 6, 2) || '/' || substr(flight_date, 1, 4) AS search_date,
  event_id, flight_number, departure_airport, arrival_airport, flight_date,
  departure_time, arrival_time, CAST(price AS VARCHAR) AS total_price, classes,
  type_of_plane AS aircraft_type
FROM fare_raw""", ["fare_raw"])

cte("run_days", """
SELECT run_id, search_date, departure_airport, arrival_airport, min(event_id) AS first_id,
  count(*) AS n_options
FROM run_rows GROUP BY 1, 2, 3, 4""", ["run_rows"])

cte("day_errors", """
SELECT run_id, search_date, departure_airport, arrival_airport,
  CASE WHEN first_id % 7 = 0 THEN 'Timeout: Could not find any prices on the page.'
       WHEN first_id % 11 = 0 THEN 'Failed to click price option ' || CAST(first_id % 5 AS VARCHAR) || '.'
  END AS error
FROM run_days""", ["run_days"])

_CRAWL_LOG = """
SELECT event_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'log' WHEN event_type = 'purchase' THEN 'warning'
       WHEN event_type = 'error' THEN 'error' ELSE 'debug' END AS type,
  'message ' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN ' ' ||
    ([{LOG_TERMS}])[CAST(event_id % 8 + 1 AS INTEGER)]
    ELSE '' END AS message,
  'https://www.example.com/p/' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 4 = 0 THEN '?src=' ||
    ([{URL_TERMS}])[CAST(event_id % 10 + 1 AS INTEGER)]
    ELSE '' END AS url,
  event_type <> 'error' AS success,
  coalesce(CAST(trunc(value * 1000) AS BIGINT), 0) AS duration,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'ok' END AS results,
  event_id % 4 AS n_screenshots, user_id % 9 AS n_steps,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS start_time,
  CASE WHEN event_type = 'error' THEN strftime(ts + to_milliseconds(coalesce(CAST(trunc(value * 1000) AS BIGINT), 0)),
       '%Y-%m-%dT%H:%M:%S.%gZ') END AS error_time,
  substr('SGNHANDADCXRPQCVDOHUIHPHVDHVII', CAST(1 + 3 * (user_id % 10) AS INTEGER), 3) || ' → ' ||
  substr('HANSGNDADPQCCXRVDOHUIHPHVDHVII', CAST(1 + 3 * (event_id % 10) AS INTEGER), 3) AS route
FROM events"""
cte("crawl_log", _CRAWL_LOG
    .replace("{LOG_TERMS}", ", ".join(_sql_text(t) for t in LOG_NOISE_TERMS))
    .replace("{URL_TERMS}", ", ".join(_sql_text(t) for t in URL_NOISE_TERMS)))

cte("attempts", """
SELECT event_id // 6 AS request_id, CAST(event_id % 6 + 1 AS INTEGER) AS attempt,
  event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN 'attempt failed: event ' || CAST(event_id AS VARCHAR) END AS error
FROM events""")

# The airport dimension as inline VALUES, built from its one definition.
AIRPORT_ROWS = ("SELECT * FROM (VALUES\n" + ",\n".join(
    "(" + ", ".join(_sql_text(v) for v in row) + ")" for row in AIRPORTS)
    + "\n) AS t(code, city, airport_name, country)")

cte("airports", AIRPORT_ROWS)

cte("captured_pages", """
SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'about:blank' WHEN page_id % 11 <> 0 THEN url END AS url,
  CASE WHEN page_id % 17 = 0 THEN replace(h, '<body', '<main') ELSE h END AS html
FROM (SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN regexp_replace(h, '<title>[^<]*</title>', '<title></title>', 'g') ELSE h END AS h
      FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN replace(html, 'class="ad"', 'class="flight ad"') ELSE html END AS h
            FROM pages))""")

cte("short_documents", """
SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN chr(10) || ' the' || chr(9) WHEN doc_id % 101 = 0 THEN 'The' ELSE text END AS text
FROM documents""")

_CITIES = ", ".join(_sql_text(a[1]) for a in AIRPORTS)
cte("airport_texts", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' ' || ([{_CITIES}])[CAST((doc_id // 4) % {len(AIRPORTS)} AS INTEGER) + 1]
  ELSE text END AS text FROM documents""")

def _pair(name: str, value: str, when: str) -> str:
    return (f"CASE WHEN {when} THEN '\"{name}\":' || coalesce('\"' || {value} || '\"', 'null') END")


_BODY = ", ".join([
    _pair("departure_airport", "departure_airport", "true"), _pair("arrival_airport", "arrival_airport", "true"),
    _pair("departure_date", "departure_date", "true"), _pair("trip_type", "trip_type", "request_id % 8 <> 0"),
    _pair("return_date", "return_date", "return_date IS NOT NULL"),
    _pair("adult", "CASE WHEN request_id % 14 <> 0 THEN adult END", "request_id % 43 <> 0"),
    _pair("child", "CASE WHEN request_id % 10 <> 0 THEN child END", "request_id % 9 <> 0"),
    _pair("infant", "CASE WHEN request_id % 12 <> 0 THEN infant END", "request_id % 15 <> 0")])
cte("endpoint_json", f"""
SELECT request_id, CASE WHEN request_id % 41 = 0 THEN substr(raw, 1, 30) ELSE raw END AS raw
FROM (SELECT request_id, '{{' || concat_ws(',', {_BODY}) || '}}' AS raw FROM requests)""", ["requests"])

cte("request_json", """
SELECT request_id, CASE WHEN request_id % 41 = 0 THEN substr(raw, 1, 25) ELSE raw END AS raw FROM (
SELECT request_id,
  '{' || CASE WHEN request_id % 37 = 0 THEN ''
              ELSE '"departure_airport":' || CASE WHEN departure_airport IS NULL THEN 'null'
                   ELSE '"' || departure_airport || '"' END || ',' END
  || '"arrival_airport":' || CASE WHEN arrival_airport IS NULL THEN 'null' ELSE '"' || arrival_airport || '"' END
  || CASE WHEN request_id % 31 = 0 THEN ''
          ELSE ',"search_options":{"trip_type":' || CASE WHEN trip_type IS NULL THEN 'null' ELSE '"' || trip_type || '"' END
               || CASE WHEN request_id % 7 = 0 THEN ',"find_cheapest":"yes"'
                       WHEN request_id % 13 = 0 THEN ',"find_cheapest":null'
                       WHEN request_id % 2 = 0 THEN ',"find_cheapest":true' ELSE '' END
               || ',"departure_date":' || CASE WHEN request_id % 11 = 0 THEN '20250101'
                    WHEN departure_date IS NULL THEN 'null' ELSE '"' || departure_date || '"' END
               || '}' END
  || ',"adult":' || CASE WHEN adult IS NULL THEN 'null' ELSE '"' || adult || '"' END || '}' AS raw
FROM requests)""", ["requests"])
