"""Rows that once gave wrong answers."""

import pytest
from pyspark.sql import functions as F

from faresight import session
from faresight.functions import text as tx
from faresight.operators import features, lookup, rules
from faresight.operators.stats import retry_outcome


def test_null_and_the_text_nan_are_one_category(spark):
    rows = [("nan", 1), (None, 2), ("VJ1", 3)]
    df = spark.createDataFrame(rows, "flight_number string, k int").selectExpr(
        "flight_number", "TIMESTAMP_NTZ'2024-01-01 10:00:00' AS create_at", "TIMESTAMP_NTZ'2024-02-01 00:00:00' AS flight_date",
        "'10:00' AS departure_time", "'11:00' AS arrival_time", "'SGN' AS departure_airport", "'HAN' AS arrival_airport",
        "'Eco' AS classes", "'A321' AS type_of_plane", "CAST(k AS decimal(18,2)) AS price")
    out = features.training_features(df)
    assert out.features.count() == 3
    assert out.encoders.where("attribute = 'flight_number'").count() == 2


def test_first_airport_of_a_code_counts(spark):
    a = spark.createDataFrame([("SGN", "one", "x"), ("sgn", "two", "y")], "code string, city string, airport_name string").coalesce(1)
    f = spark.createDataFrame([("SGN", "sgn")], "departure_airport string, arrival_airport string")
    r = lookup.enrich_airports(f, a).collect()
    assert len(r) == 1 and (r[0].departure_city, r[0].arrival_city) == ("one", "one")


def test_malformed_json_labels_its_row(spark):
    r = rules.json_type_errors(spark.createDataFrame([("{bad",)], "raw string")).first()
    assert "departure_airport, arrival_airport" in r.structure_error


def test_white_space_of_any_kind_is_stripped(spark):
    df = spark.createDataFrame([("\n  Airbus A321 - Bay thẳng", "\nthe\t", "10:00\u00a0-\u00a012:30")], "a string, b string, t string")
    r = df.select(tx.aircraft_name("a").alias("a"), tx.text_match("b", "the", exact=True).alias("b"),
                  tx.booking_times("t")[1].alias("t")).first()
    assert (r.a, r.b, r.t) == ("Airbus A321", True, "12:30")


def test_failed_attempt_without_text_has_the_default_error(spark):
    df = spark.createDataFrame([(1, 1, False, None)], "request_id long, attempt int, success boolean, error string")
    assert retry_outcome(df).first().error == "Crawler failed without specific error"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_scratch_is_cleared(spark):
    import os
    session.materialize(spark.range(3), "t")
    app = os.path.join(session.ensure_checkpoint_dir(spark).replace("file:", ""), "faresight", spark.sparkContext.applicationId)
    assert os.listdir(app)
    session.clear_scratch(spark)
    assert not os.path.exists(app)


def test_lookup_is_broadcast_by_bytes(spark):
    from faresight.operators.joins import checked_small
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 2000).alias("v"))
    assert checked_small(wide, max_bytes=300_000)[1] and not checked_small(wide, max_bytes=100_000)[1]


def test_airport_names_by_gram_index(spark, monkeypatch):
    """Many names through the index are what testing each gives, short,
    empty, odd and missing names among them; no name is in the plan."""
    import random

    from faresight.operators import lookup
    r = random.Random(6)
    names = ["".join(r.choice("abcdé 日😀") for _ in range(r.randrange(0, 6))) for _ in range(400)]
    airports = [(f"C{i}", r.choice(names), r.choice([None, *names])) for i in range(300)]
    texts = [(i, None if i == 5 else "".join(r.choice("abcdé 日😀xyz") for _ in range(r.randrange(40)))) for i in range(120)]
    texts += [(7, "C17 and C18"), (7, "C17 again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame(airports, "code string, city string, airport_name string")
    want = {}
    for code, *more in airports:
        hits = {i for i, t in texts if t is not None and any(x is not None and x in t for x in (code, *more))}
        if hits:
            want[code] = (len(hits), min(hits))
    for limit in (10_000, 10):
        monkeypatch.setattr(lookup, "NAMES_AT_ONCE", limit)
        got = lookup.airport_mention(docs, table)
        assert {r["code"]: (r["n_texts"], r["first_doc_id"]) for r in got.collect()} == want
        assert "C17" not in got._jdf.queryExecution().executedPlan().toString()
