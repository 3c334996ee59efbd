"""Scalar functions on the hand-written edge rows (FIXTURES.md section 4)."""

from decimal import Decimal

from pyspark.sql import functions as F

from faresight.functions import text as tx
from faresight.functions import timeparts as tp


def one(spark, expr, data, schema="x string"):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(expr.alias("y")).collect()]


def test_time_to_minutes_training_and_prediction(spark):
    data = [("08:00",), (" 8:5 ",), ("25:99",), ("-1:30",), ("08:00:00",), ("",), (None,),
            ("n/a",), ("+2:03",)]
    assert one(spark, tp.time_to_minutes("x"), data) == [480, 485, 1599, -30, None, None,
                                                         None, None, 123]
    assert one(spark, tp.time_to_minutes("x", "zero"), data) == [480, 485, 1599, -30, 0, 0,
                                                                 0, 0, 123]


def test_days_in_advance_floors(spark):
    df = spark.createDataFrame(
        [("2024-01-01 10:30:00", "2024-01-02 00:00:00"),
         ("2024-01-01 10:30:00", "2024-01-01 00:00:00"),
         ("2024-01-01 00:00:00", "2024-01-02 00:00:00"),
         ("2024-03-30 12:00:00", "2024-03-31 11:59:59")], "c string, f string")
    out = df.select(tp.days_in_advance(tp.parse_timestamp("f"), tp.parse_timestamp("c"))
                    .alias("d")).collect()
    assert [r.d for r in out] == [0, -1, 1, 0]


def test_buckets(spark):
    data = [(6,), (7,), (29,), (30,), (89,), (90,), (None,)]
    assert one(spark, tp.booking_category("x"), data, "x int") == [0, 1, 1, 2, 2, 3, 3]
    hours = [(h * 60,) for h in (5, 6, 11, 12, 17, 18, 21, 22)] + [(None,), (-30,)]
    assert one(spark, tp.time_of_day("x"), hours, "x int") == [3, 0, 0, 1, 1, 2, 2, 3, 3, 3]


def test_flight_duration_wraps_once(spark):
    df = spark.createDataFrame([(1415, 105), (480, 615), (None, 10)], "d int, a int")
    assert [r[0] for r in df.select(tp.flight_duration("d", "a")).collect()] == [130, 135, None]


def test_weekday_monday_zero(spark):
    assert one(spark, tp.weekday(tp.parse_timestamp("x")),
               [("2024-01-01 00:00:00",), ("2024-01-07 23:00:00",)]) == [0, 6]


def test_dmy_dates(spark):
    data = [("31/12/2025",), ("29/02/2024",), ("31/02/2025",), ("2025-02-01",), ("7/3/2025",),
            (None,)]
    assert one(spark, tp.next_dmy("x"), data) == ["01/01/2026", "01/03/2024", "04/03/2025",
                                                  None, "08/03/2025", None]
    assert one(spark, tp.dmy_to_iso("x"), data)[:3] == [
        "2025-12-31T00:00:00.000Z", "2024-02-29T00:00:00.000Z", "2025-03-03T00:00:00.000Z"]


def test_dmy_years_of_two_digits(spark):
    data = [("05/07/25",), ("31/12/99",), ("1/1/0",), ("1/1/0070",), ("29/02/100",), ("1/1/-5",), ("1/1/",)]
    assert one(spark, tp.dmy_to_iso("x"), data) == [
        "1925-07-05T00:00:00.000Z", "1999-12-31T00:00:00.000Z", "1900-01-01T00:00:00.000Z", "1970-01-01T00:00:00.000Z",
        "0100-03-01T00:00:00.000Z", None, None]
    assert one(spark, tp.next_dmy("x"), data)[:2] == ["06/07/1925", "01/01/2000"]


def test_fallback_flight_date(spark):
    df = spark.createDataFrame([("2025-07-05T00:00:00.000Z", "01/01/2025"),
                                (None, "28/07/2025")], "f string, s string")
    assert [r[0] for r in df.select(tp.fallback_flight_date("f", "s")).collect()] == [
        "2025-07-05T00:00:00.000Z", "2025-07-28T00:00:00.000Z"]


def test_price_text(spark):
    data = [("1,290,000 VND",), ("1,290,000₫",), ("0",), ("",), (" 2,000 VND ",), (None,)]
    assert one(spark, tx.price_text_to_decimal("x"), data) == [
        Decimal("1290000.00"), Decimal("1290000.00"), None, None, Decimal("2000.00"), None]


def test_booking_fields_and_fallback_price(spark):
    from faresight.operators.extract import booking_fields
    df = spark.createDataFrame([
        ("Chuyến đi 900,000 VND Tổng tiền 0 VJ123 08:00 - 10:15 skyboss",),
        ("Tổng tiền 1,290,000 VND VJ1170 23:35 - 01:45 Eco",),
        ("nothing here",)], "text string")
    out = booking_fields(df).collect()
    assert [(r.flight_number, r.departure_time, r.arrival_time, r.classes, r.total_price)
            for r in out] == [
        ("VJ123", "08:00", "10:15", "skyboss", Decimal("900000.00")),
        ("VJ1170", "23:35", "01:45", "Eco", Decimal("1290000.00")),
        (None, None, None, None, None)]
    assert [r.price_found for r in out] == [True, True, False]
    strict = booking_fields(df, fallback=False).collect()
    assert [r.price_found for r in strict] == [False, True, False]


def test_generic_extraction(spark):
    from faresight.operators.extract import generic_flight
    df = spark.createDataFrame([(0, "VJ1 08:00 10:15 2h 15m 1,200,000 VNĐ"),
                                (1, "  "), (2, "only 1234 and 12:30")], "i long, text string")
    out = generic_flight(df, index_col="i").collect()
    assert [(r["index"], r.price, r.times, r.duration) for r in out] == [
        (1, "1,200,000 VNĐ", ["08:00", "10:15"], "2h 15m"),
        (3, "1234", ["12:30"], None)]


def test_aircraft_name_and_month_header(spark):
    data = [("  Airbus A321 - Bay thẳng ",), ("boeing 787-9",), ("ATR 72",), (None,)]
    assert one(spark, tx.aircraft_name("x"), data) == ["Airbus A321", "boeing 787", None, None]
    m, y = tx.month_header("x")
    assert one(spark, F.struct(m, y), [("Tháng 06 2025",)]) == [(6, 2025)]


def test_page_info(spark):
    from faresight.operators.extract import page_info
    html = ("<html><head><title>Kết quả</title></head><body><div class='flight-item'>"
            "A &amp; B</div></body></html>")
    df = spark.createDataFrame([(1, "https://x", html), (2, "about:blank", "<html></html>")],
                               "page_id long, url string, html string")
    out = page_info(df).orderBy("page_id").collect()
    assert out[0].title == "Kết quả" and out[0].page_text == "A & B"
    assert out[0].has_results and out[0].valid
    assert not out[1].valid and not out[1].has_results


def test_clip_price_and_route_label(spark):
    df = spark.createDataFrame([(5.0, 1.0, 10.0), (2e8, 200000.0, 9e7), (7.0, None, None)],
                               "p double, mn double, mx double")
    # Limits cross in the first row (floor 100000 > max 10): numpy gives the upper one.
    assert [r[0] for r in df.select(tx.clip_price("p", "mn", "mx")).collect()] == [
        10.0, 5e7, 7.0]
    d = spark.createDataFrame([("SGN", "HAN"), ("SGN", None)], "a string, b string")
    assert [r[0] for r in d.select(tx.route_label("a", "b")).collect()] == [
        "SGN → HAN", "SGN → null"]


def test_text_match_modes(spark):
    assert one(spark, tx.text_match("x", "the"), [(" The ",), ("xthe",), ("no",)]) == [
        True, True, False]
    assert one(spark, tx.text_match("x", "The", exact=True, case_sensitive=True),
               [(" The ",), ("the",)]) == [True, False]


def test_utc_now_iso_shape(spark):
    v = spark.range(1).select(tp.utc_now_iso().alias("t")).first().t
    assert len(v) == 24 and v[10] == "T" and v.endswith("Z")


def test_time_to_minutes_matches_python_int_rule(spark):
    """Property: for text over digits, signs, spaces, tabs and colons, the
    Spark expression equals Python's ``map(int, s.split(':'))`` rule."""
    import random

    def py_rule(s):
        try:
            h, m = map(int, s.split(":"))
            return h * 60 + m
        except ValueError:
            return None

    rng = random.Random(11)
    alphabet = "0123456789+- \t:"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8)))
             for _ in range(2000)]
    texts += ["%d:%d" % (rng.randint(-30, 30), rng.randint(-99, 99)) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", tp.time_to_minutes("x").alias("y")).collect()}
    assert all(got[i] == py_rule(t) for i, t in enumerate(texts))


def test_quantiles_narrow_to_any_rank(spark, monkeypatch):
    import random

    import numpy as np

    from faresight.operators import stats
    r = random.Random(2)
    for values in ([5.0] * 4000 + [float(x) for x in range(300)], [r.lognormvariate(0, 20) for _ in range(5000)],
                   [r.choice([-1e300, 1e300, 0.0, 1e-300]) for _ in range(999)], [3.5], [1.0, 9.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
        want = np.quantile(np.array(values), [0.0, 0.25, 0.5, 0.75, 1.0])
        for at_once in (100_000, 20):                # ranked at once, and narrowed further
            monkeypatch.setattr(stats, "AT_ONCE", at_once)
            got = list(stats.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0]).first())
            assert np.allclose(got, want, rtol=1e-12, atol=0)
    assert stats.exact_quantiles(df.limit(0), "v", [0.5]).first()["q0"] is None


def test_only_ascii_digits_are_extracted(spark):
    from faresight.operators.extract import generic_flight
    text = "١٢:٣٤ - ١٥:٣٠ ٩٩ VND ٣h 10:20 - 11:30 500,000 VND 2h 5m"
    got = generic_flight(spark.createDataFrame([(0, text)], "pos int, text string"), "pos").first()
    assert got["times"] == ["10:20", "11:30"] and got["price"] == "500,000 VND" and got["duration"] == "2h 5m"
