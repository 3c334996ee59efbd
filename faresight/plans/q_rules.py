"""Registered queries: request rules, airport lookups, search days
(B8 C1-C8 D1 G14-G16 H1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faresight.functions import text as tx
from faresight.functions import timeparts as tp
from faresight.operators import rules as ru
from faresight.operators.expand import expand_search_days
from faresight.operators.lookup import enrich_airports
from faresight.plans import fixtures as fx
from faresight.plans.oracle import with_ctes
from faresight.plans.registry import query
from faresight.operators.joins import lookup_join
from faresight.sources.airports import AIRPORT_ROWS, airports_df


_JS_TRIM = ("chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(5760) || list_aggregate([chr(CAST(x AS INTEGER)) FOR x IN "
            "range(8192, 8203)], 'string_agg', '') || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(65279)")


def _js_num(c):
    """JavaScript's Number() of a text, its grammar spelt out."""
    t = f"trim({c}, {_JS_TRIM})"
    based = " ".join(
        f"WHEN regexp_full_match({t}, '0{x}[{digits}]+') THEN list_reduce([CAST(strpos('0123456789abcdef', d) - 1 AS DOUBLE) "
        f"FOR d IN string_split(lower(substr({t}, 3)), '')], lambda p, q: p * {base} + q)"
        for x, digits, base in (("[xX]", "0-9a-fA-F", 16), ("[oO]", "0-7", 8), ("[bB]", "01", 2)))
    return (f"(CASE WHEN {c} IS NULL THEN 0.0 WHEN {t} = '' THEN 0.0 "
            f"WHEN regexp_full_match({t}, '[+-]?(Infinity|([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)') THEN TRY_CAST({t} AS DOUBLE) "
            f"{based} END)")


@query("request_rules", with_ctes(["requests"], f"""
, n AS (SELECT *, {_js_num('adult')} AS a, {_js_num('child')} AS c, {_js_num('infant')} AS i FROM requests)
SELECT request_id,
  CASE WHEN NOT (coalesce(departure_airport, '') <> '' AND coalesce(arrival_airport, '') <> ''
                 AND coalesce(departure_date, '') <> '') THEN 'missing'
       WHEN coalesce(trip_type, 'oneway') = 'roundtrip' AND coalesce(return_date, '') = '' THEN 'return'
       WHEN a IS NULL OR a < 1 THEN 'adult'
       WHEN c IS NULL OR c < 0 THEN 'child'
       WHEN i IS NULL OR i < 0 THEN 'infant'
       WHEN i > a THEN 'infant_exceeds_adult'
       ELSE 'ok' END AS rule
FROM n"""))
def request_rules(spark, sf_dir):
    r = ru.validate_required_and_passengers(fx.requests(spark, sf_dir))
    return r.select("request_id", "rule")


_MISS = "Missing or invalid required fields in flight config: "


@query("request_structure", with_ctes(["requests"], f"""
SELECT request_id,
  CASE WHEN trim(coalesce(departure_airport, '')) = '' AND trim(coalesce(arrival_airport, '')) = ''
         THEN '{_MISS}departure_airport, arrival_airport'
       WHEN trim(coalesce(departure_airport, '')) = '' THEN '{_MISS}departure_airport'
       WHEN trim(coalesce(arrival_airport, '')) = '' THEN '{_MISS}arrival_airport'
       WHEN coalesce(trip_type, '') <> '' AND trip_type NOT IN ('oneway', 'roundtrip')
         THEN 'Invalid trip_type: ' || trip_type || '. Must be ''oneway'' or ''roundtrip'''
  END AS structure_error
FROM requests"""))
def request_structure(spark, sf_dir):
    r = ru.validate_request_structure(fx.requests(spark, sf_dir))
    return r.select("request_id", "structure_error")


def _route_sql(strict: bool) -> str:
    if strict:
        join = ("LEFT JOIN airports d ON r.departure_airport = d.code "
                "LEFT JOIN airports a ON r.arrival_airport = a.code")
        same = "coalesce(r.departure_airport = r.arrival_airport, false)"
        first = ("WHEN coalesce(r.departure_airport, '') = '' OR coalesce(r.arrival_airport, '') = '' "
                 "THEN 'Both departure and arrival airports are required' ")
    else:
        join = ("LEFT JOIN airports d ON upper(r.departure_airport) = upper(d.code) "
                "LEFT JOIN airports a ON upper(r.arrival_airport) = upper(a.code)")
        same = "coalesce(d.code = a.code, false)"
        first = ""
    return with_ctes(["requests", "airports"], f"""
SELECT r.request_id,
  (d.code IS NOT NULL AND a.code IS NOT NULL AND NOT {same}) AS route_ok,
  CASE {first}
       WHEN d.code IS NULL THEN 'Departure airport ''' || coalesce(r.departure_airport, 'null') || ''' not found in airports database'
       WHEN a.code IS NULL THEN 'Arrival airport ''' || coalesce(r.arrival_airport, 'null') || ''' not found in airports database'
       WHEN {same} THEN 'Departure and arrival airports cannot be the same' END AS route_error
FROM requests r {join}""")


@query("route_known", _route_sql(False))
def route_known(spark, sf_dir):
    v = ru.validate_route(fx.requests(spark, sf_dir), airports_df(spark), strict=False,
                          airport_bound=AIRPORT_ROWS)
    return v.select("request_id", "route_ok", "route_error")


@query("route_strict", _route_sql(True))
def route_strict(spark, sf_dir):
    v = ru.validate_route(fx.requests(spark, sf_dir), airports_df(spark), strict=True,
                          airport_bound=AIRPORT_ROWS)
    return v.select("request_id", "route_ok", "route_error")


@query("route_supported", with_ctes(["fare_raw", "airports"], """
SELECT f.departure_airport, f.arrival_airport,
       (d.code IS NOT NULL AND a.code IS NOT NULL AND d.code <> a.code) AS route_supported,
       count(*) AS rows
FROM fare_raw f
LEFT JOIN airports d ON upper(f.departure_airport) = upper(d.code)
LEFT JOIN airports a ON upper(f.arrival_airport) = upper(a.code)
GROUP BY 1, 2, 3"""))
def route_supported(spark, sf_dir):
    s = ru.route_supported(fx.fare_raw(spark, sf_dir), airports_df(spark),
                           airport_bound=AIRPORT_ROWS)
    return (s.groupBy("departure_airport", "arrival_airport", "route_supported")
            .agg(F.count(F.lit(1)).alias("rows")))


@query("request_defaults", with_ctes(["requests"], """
SELECT request_id, upper(departure_airport) AS departure_airport,
  upper(arrival_airport) AS arrival_airport, coalesce(trip_type, 'oneway') AS trip_type,
  coalesce(departure_date, 'today') AS departure_date, coalesce(adult, '1') AS adult,
  coalesce(child, '0') AS child, coalesce(infant, '0') AS infant, 'false' AS find_cheapest
FROM requests"""))
def request_defaults(spark, sf_dir):
    d = ru.request_defaults(fx.requests(spark, sf_dir), endpoint=True)
    return d.select("request_id", "departure_airport", "arrival_airport", "trip_type",
                    "departure_date", "adult", "child", "infant", "find_cheapest")


@query("airports_validated", with_ctes(["requests", "airports"], """
, codes AS (SELECT DISTINCT departure_airport AS code FROM requests)
SELECT c.code, a.city, a.airport_name, a.country,
  concat_ws(', ', CASE WHEN trim(coalesce(c.code, '')) = '' THEN 'code' END,
            CASE WHEN trim(coalesce(a.city, '')) = '' THEN 'city' END,
            CASE WHEN trim(coalesce(a.airport_name, '')) = '' THEN 'airport_name' END,
            CASE WHEN trim(coalesce(a.country, '')) = '' THEN 'country' END) AS missing,
  NOT regexp_matches(coalesce(c.code, ''), '^[A-Z]{3}$') AS code_warning
FROM codes c LEFT JOIN airports a ON c.code = a.code"""))
def airports_validated(spark, sf_dir):
    codes = fx.requests(spark, sf_dir).select(F.col("departure_airport").alias("code")).distinct()
    rows = lookup_join(codes, airports_df(spark), "code", bound=AIRPORT_ROWS)
    v = ru.validate_airports(rows)
    return v.select("code", "city", "airport_name", "country",
                    F.array_join("missing_fields", ", ").alias("missing"), "code_warning")


@query("enrich_airports", with_ctes(["fare_raw", "airports"], """
SELECT f.event_id, d.city AS departure_city, d.airport_name AS departure_airport_name,
       a.city AS arrival_city, a.airport_name AS arrival_airport_name
FROM fare_raw f
LEFT JOIN airports d ON upper(f.departure_airport) = upper(d.code)
LEFT JOIN airports a ON upper(f.arrival_airport) = upper(a.code)"""))
def enrich_airports_q(spark, sf_dir):
    e = enrich_airports(fx.fare_raw(spark, sf_dir), airports_df(spark),
                        airport_bound=AIRPORT_ROWS)
    return e.select("event_id", "departure_city", "departure_airport_name",
                    "arrival_city", "arrival_airport_name")


@query("airports_by_country", with_ctes(["requests", "airports"], """
SELECT r.departure_airport, count(*) AS rows FROM requests r
WHERE upper(r.departure_airport) IN (SELECT upper(code) FROM airports
                                     WHERE lower(country) = lower('VIỆT NAM'))
GROUP BY 1"""))
def airports_by_country(spark, sf_dir):
    from faresight.operators.lookup import airports_by_country as abc
    a = abc(airports_df(spark), "VIỆT NAM").select(F.upper("code").alias("__k"))
    r = fx.requests(spark, sf_dir).withColumn("__k", F.upper("departure_airport"))
    return (lookup_join(r, a.distinct(), "__k", "left_semi", bound=AIRPORT_ROWS)
            .groupBy("departure_airport").agg(F.count(F.lit(1)).alias("rows")))


@query("search_days", with_ctes(["requests"], """
, d AS (SELECT *, CAST(strptime(departure_date, '%d/%m/%Y') AS DATE) AS d0 FROM requests)
, x AS (SELECT d.*, CAST(t.i AS INTEGER) AS day_index, d0 + CAST(t.i AS INTEGER) AS day
        FROM d, range(15) t(i))
SELECT request_id, day_index, strftime(day, '%d/%m/%Y') AS search_date,
  strftime(day, '%Y-%m-%dT00:00:00.000Z') AS search_date_iso,
  strftime(day + 1, '%d/%m/%Y') AS next_date,
  'https://baydep.vn/flights/' || coalesce(departure_airport, 'null') || coalesce(arrival_airport, 'null')
    || replace(strftime(day, '%d/%m/%Y'), '/', '') || '/' || coalesce(adult, 'null') || '/'
    || coalesce(child, 'null') || '/' || coalesce(infant, 'null') || '?nearby-airport=yes' AS search_url
FROM x"""))
def search_days(spark, sf_dir):
    days = expand_search_days(fx.requests(spark, sf_dir))
    return days.select(
        "request_id", "day_index", "search_date",
        tp.date_to_iso("search_day").alias("search_date_iso"),
        F.date_format(F.date_add("search_day", 1), "dd/MM/yyyy").alias("next_date"),
        tx.search_url("departure_airport", "arrival_airport", "search_date",
                      "adult", "child", "infant").alias("search_url"))


_JSON_SQL = with_ctes(["request_json"], """
, t AS (SELECT request_id,
   json_type(raw, '$.departure_airport') AS dep_t, json_extract_string(raw, '$.departure_airport') AS dep_v,
   json_type(raw, '$.arrival_airport') AS arr_t, json_extract_string(raw, '$.arrival_airport') AS arr_v,
   json_type(raw, '$.search_options') AS so_t,
   json_extract_string(raw, '$.search_options.trip_type') AS trip_v,
   json_type(raw, '$.search_options.find_cheapest') AS fc_t,
   json_extract_string(raw, '$.search_options.find_cheapest') AS fc_v,
   json_type(raw, '$.search_options.departure_date') AS dd_t,
   json_extract_string(raw, '$.search_options.departure_date') AS dd_v
  FROM (SELECT request_id, CASE WHEN json_valid(raw) THEN raw END AS raw FROM request_json))
, b AS (SELECT *, (coalesce(dep_t, '') <> 'VARCHAR' OR trim(coalesce(dep_v, '')) = '') AS bad_dep,
               (coalesce(arr_t, '') <> 'VARCHAR' OR trim(coalesce(arr_v, '')) = '') AS bad_arr FROM t)
SELECT request_id,
  CASE WHEN bad_dep AND bad_arr THEN '@MISS@departure_airport, arrival_airport'
       WHEN bad_dep THEN '@MISS@departure_airport'
       WHEN bad_arr THEN '@MISS@arrival_airport'
       WHEN so_t = 'OBJECT' AND coalesce(trip_v, '') <> '' AND trip_v NOT IN ('oneway', 'roundtrip')
         THEN 'Invalid trip_type: ' || trip_v || '. Must be ''oneway'' or ''roundtrip'''
       WHEN so_t = 'OBJECT' AND fc_t IS NOT NULL AND fc_t <> 'BOOLEAN'
         THEN 'Invalid find_cheapest: ' || coalesce(fc_v, 'null') || '. Must be boolean'
       WHEN so_t = 'OBJECT' AND dd_v IS NOT NULL AND dd_v NOT IN ('', '0', 'false') AND dd_t <> 'VARCHAR'
         THEN 'Invalid departure_date: ' || dd_v || '. Must be string'
  END AS structure_error
FROM b""").replace("@MISS@", _MISS)


@query("request_json_structure", _JSON_SQL)
def request_json_structure(spark, sf_dir):
    """C2 on raw request JSON: absent vs null vs wrong JSON type."""
    return ru.json_type_errors(fx.request_json(spark, sf_dir)).select(
        "request_id", "structure_error")


@query("request_dates", with_ctes(["requests"], """
SELECT request_id,
  strftime(strptime(departure_date, '%d/%m/%Y'), '%Y-%m-%dT00:00:00.000Z') AS departure_iso,
  strftime(strptime(departure_date, '%d/%m/%Y') + INTERVAL 1 DAY, '%d/%m/%Y') AS next_date,
  strftime(strptime(return_date, '%d/%m/%Y'), '%Y-%m-%dT00:00:00.000Z') AS return_iso
FROM requests"""))
def request_dates(spark, sf_dir):
    """Text dates of each request: DD/MM/YYYY to ISO (G14) and the next
    search day as DD/MM/YYYY (G15), parsed from the text itself."""
    r = fx.requests(spark, sf_dir)
    return r.select("request_id", tp.dmy_to_iso("departure_date").alias("departure_iso"),
                    tp.next_dmy("departure_date").alias("next_date"),
                    tp.dmy_to_iso("return_date").alias("return_iso"))


def _has(k):
    return f"json_type(j, '$.{k}') IS NOT NULL"


def _txt(k):
    return f"json_extract_string(j, '$.{k}')"


def _num(k):
    return f"CASE WHEN {_has(k)} THEN {_js_num(_txt(k))} END"


@query("request_json_rules", with_ctes(["endpoint_json"], f"""
, p AS (SELECT request_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM endpoint_json)
, n AS (SELECT *, {_num('adult')} AS a, {_num('child')} AS c, {_num('infant')} AS i FROM p)
SELECT request_id,
  CASE WHEN j IS NULL THEN 'malformed'
       WHEN NOT (coalesce({_txt('departure_airport')}, '') <> '' AND coalesce({_txt('arrival_airport')}, '') <> ''
                 AND coalesce({_txt('departure_date')}, '') <> '') THEN 'missing'
       WHEN {_txt('trip_type')} = 'roundtrip' AND coalesce({_txt('return_date')}, '') = '' THEN 'return'
       WHEN a IS NULL OR a < 1 THEN 'adult' WHEN c IS NULL OR c < 0 THEN 'child'
       WHEN i IS NULL OR i < 0 THEN 'infant' WHEN i > a THEN 'infant_exceeds_adult' ELSE 'ok' END AS rule
FROM n"""))
def request_json_rules(spark, sf_dir):
    """C3, C4 on raw bodies: absent counts fail, null ones are 0."""
    return ru.json_request_rules(fx.endpoint_json(spark, sf_dir)).select("request_id", "rule")


def _default(k, value):
    return f"CASE WHEN {_has(k)} THEN {_txt(k)} ELSE '{value}' END"


@query("request_json_defaults", with_ctes(["request_json"], f"""
, p AS (SELECT request_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM request_json)
SELECT request_id, {_default('adult', '1')} AS adult, {_default('child', '0')} AS child,
  {_default('search_options.trip_type', 'oneway')} AS trip_type,
  {_default('search_options.departure_date', 'today')} AS departure_date,
  {_default('search_options.find_cheapest', 'true')} AS find_cheapest
FROM p"""))
def request_json_defaults(spark, sf_dir):
    """C8 on raw JSON: a default for an absent key only, null stays null."""
    r = fx.request_json(spark, sf_dir)
    body = {k: F.get_json_object("raw", f"$.{p}") for k, p in (
        ("adult", "adult"), ("child", "child"), ("infant", "infant"), ("trip_type", "search_options.trip_type"),
        ("departure_date", "search_options.departure_date"), ("find_cheapest", "search_options.find_cheapest"))}
    return ru.request_defaults(r.withColumns(body), raw="raw").select(
        "request_id", "adult", "child", "trip_type", "departure_date", "find_cheapest")


@query("endpoint_request", with_ctes(["requests"], """
SELECT request_id, upper(departure_airport) AS departure_airport, coalesce(trip_type, 'oneway') AS trip_type,
  CASE WHEN trip_type = 'roundtrip' AND coalesce(return_date, '') <> '' THEN return_date END AS return_date,
  '2024-01-01T00:00:00.000Z' AS updated_at FROM requests"""))
def endpoint_request(spark, sf_dir):
    """C8, endpoint mode: the return date of round trips only, and the stamp."""
    d = ru.request_defaults(fx.requests(spark, sf_dir), endpoint=True, stamp="2024-01-01T00:00:00.000Z")
    return d.select("request_id", "departure_airport", "trip_type", "return_date", "updated_at")
