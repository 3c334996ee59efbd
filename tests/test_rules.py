"""Rule truth tables."""

from faresight.operators import rules as ru
from faresight.sources.airports import airports_df


def test_required_and_passenger_chain(spark):
    cols = "departure_airport string, arrival_airport string, departure_date string, " \
           "trip_type string, return_date string, adult string, child string, infant string"
    data = [
        ("SGN", None, "01/01/2025", "oneway", None, "1", "0", "0"),
        ("SGN", "HAN", "01/01/2025", "roundtrip", None, "1", "0", "0"),
        ("SGN", "HAN", "01/01/2025", "oneway", None, "0", "0", "0"),
        ("SGN", "HAN", "01/01/2025", "oneway", None, None, "0", "0"),
        ("SGN", "HAN", "01/01/2025", "oneway", None, "2", "x", "0"),
        ("SGN", "HAN", "01/01/2025", "oneway", None, "2", None, "0"),
        ("SGN", "HAN", "01/01/2025", "oneway", None, "1", "0", "-1"),
        ("SGN", "HAN", "01/01/2025", "oneway", None, "1", "0", "2"),
        ("SGN", "HAN", "01/01/2025", None, None, "1.5", "0", "1"),
    ]
    out = ru.validate_required_and_passengers(spark.createDataFrame(data, cols)).collect()
    assert [r.rule for r in out] == ["missing", "return", "adult", "adult", "child", "ok",
                                     "infant", "infant_exceeds_adult", "ok"]
    assert out[7].error == "Number of infants cannot exceed number of adults."


def test_route_known_vs_strict(spark):
    df = spark.createDataFrame([("han", "SGN"), ("SGN", "SGN"), ("XXX", "HAN"), ("SGN", None)],
                               "departure_airport string, arrival_airport string")
    a = airports_df(spark)
    loose = [(r.route_ok, r.route_error) for r in ru.validate_route(df, a).collect()]
    strict = [(r.route_ok, r.route_error) for r in ru.validate_route(df, a, strict=True).collect()]
    assert loose[0] == (True, None)
    assert strict[0][0] is False and "Departure airport 'han'" in strict[0][1]
    assert loose[1] == (False, "Departure and arrival airports cannot be the same")
    assert "not found" in loose[2][1]
    assert strict[3] == (False, "Both departure and arrival airports are required")


def test_defaults_keep_explicit_null(spark):
    raw = ['{"departure_airport":"sgn","arrival_airport":"han","child":null,'
           '"search_options":{"trip_type":"roundtrip"}}']
    df = spark.createDataFrame([(raw[0], "sgn", "han", None, "roundtrip")],
                               "raw string, departure_airport string, arrival_airport string,"
                               " child string, trip_type string")
    r = ru.request_defaults(df, endpoint=True, raw="raw").first()
    assert (r.adult, r.child, r.infant, r.trip_type, r.departure_date, r.find_cheapest) == (
        "1", None, "0", "roundtrip", "today", "false")
    assert (r.departure_airport, r.arrival_airport) == ("SGN", "HAN")


def test_json_structure_types(spark):
    data = ['{"departure_airport":"SGN","arrival_airport":"HAN"}',
            '{"departure_airport":5,"arrival_airport":" "}',
            '{"departure_airport":"SGN","arrival_airport":"HAN","search_options":{"trip_type":"multi"}}',
            '{"departure_airport":"SGN","arrival_airport":"HAN","search_options":{"find_cheapest":"yes"}}',
            '{"departure_airport":"SGN","arrival_airport":"HAN","search_options":{"find_cheapest":true,"departure_date":20250101}}']
    df = spark.createDataFrame([(x,) for x in data], "raw string")
    out = [r.structure_error for r in ru.json_type_errors(df).collect()]
    assert out[0] is None
    assert out[1].endswith("departure_airport, arrival_airport")
    assert out[2].startswith("Invalid trip_type: multi")
    assert out[3].startswith("Invalid find_cheapest")
    assert out[4].startswith("Invalid departure_date")


def test_airport_rules(spark):
    df = spark.createDataFrame([("SGN", "x", "y", "z"), ("sg1", "", "y", None)],
                               "code string, city string, airport_name string, country string")
    v = ru.validate_airports(df).collect()
    assert v[0].error is None and not v[0].code_warning
    assert v[1].missing_fields == ["city", "country"] and v[1].code_warning
    t = ru.airports_table_check(airports_df(spark)).first()
    assert (t.rows, t.invalid, t.ok) == (20, 0, True)


def test_js_number_follows_its_grammar(spark):
    from faresight.operators.rules import js_number
    inf = float("inf")
    want = {"nan": None, "NaN": None, "2d": None, "1f": None, "inf": None, "Infinity": inf, "-Infinity": -inf, "+Infinity": inf,
            "0x10": 16.0, "0X1f": 31.0, "0o17": 15.0, "0b101": 5.0, "0x": None, "+0x1": None, "0b2": None, "": 0.0, " 　﻿3\n": 3.0,
            "1e3": 1000.0, "1.": 1.0, ".5": 0.5, ".": None, "1_0": None, "١": None, "0x" + "f" * 16: float(2**64),
            "0b" + "1" * 70: float(2**70), "1e400": inf, "--1": None, "1 2": None, None: 0.0, "0" * 30 + "7": 7.0}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", js_number("t").alias("n")).collect()} == want


def test_json_booleans_are_numbers(spark):
    from faresight.operators.rules import json_request_rules
    head = '{"departure_airport":"A","arrival_airport":"B","departure_date":"d",'
    rows = [(head + '"adult":true,"child":false,"infant":"1"}',), (head + '"adult":"true","child":0,"infant":0}',),
            (head + '"adult":false,"child":0,"infant":0}',)]
    got = json_request_rules(spark.createDataFrame(rows, "raw string").coalesce(1)).collect()
    assert [r["rule"] for r in got] == ["ok", "adult", "adult"]
