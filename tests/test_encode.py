"""Encoders: order-preserving ranks, unseen -> 0, partition independent."""

from faresight.operators.encode import apply_label_encoders, fit_label_encoders


def test_encoder_ranks(spark):
    vals = ["b", "a", None, "c", "a", "Z"] * 3
    df = spark.createDataFrame([(v,) for v in vals], "x string").repartition(5)
    enc = {r.value: r.code for r in fit_label_encoders(df, ["x"]).collect()}
    assert enc == {"Z": 0, "a": 1, "b": 2, "c": 3, "nan": 4}
    test = spark.createDataFrame([("c",), ("zzz",), (None,)], "x string")
    out = apply_label_encoders(test, fit_label_encoders(df, ["x"]), ["x"], flag_unseen=True)
    got = sorted((r.x, r.x_encoded, r.x_unseen) for r in out.collect()
                 if r.x is not None)
    assert got == [("c", 3, False), ("zzz", 0, True)]


def test_encoder_many_values(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        df = spark.range(5000).selectExpr("lpad(cast(id * 7919 % 5000 as string), 5, '0') AS x")
        codes = sorted((r.value, r.code) for r in fit_label_encoders(df, ["x"]).collect())
        assert [c for _, c in codes] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
