"""A hot key holding a third of the rows: results stay exact and the big
side is never shuffled on that key."""

import contextlib
import io

from pyspark.sql import functions as F

from faresight.operators.lookup import attach_popularity


def test_hot_route_popularity_exact_and_broadcast(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("SGN")).otherwise(
            F.concat(F.lit("A"), (F.col("id") % 97).cast("string"))).alias("departure_airport"),
        F.when(F.col("id") % 3 == 0, F.lit("HAN")).otherwise(F.lit("DAD")).alias("arrival_airport"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit("VJ")).alias("airline"))
    out = attach_popularity(df)
    hot = out.where((F.col("departure_airport") == "SGN") & (F.col("arrival_airport") == "HAN"))
    assert hot.select("route_popularity").distinct().collect()[0][0] == n // 3
    assert out.where(F.col("airline").isNull()).agg(F.max("airline_popularity")).first()[0] == 0
    assert out.where(F.col("airline") == "VJ").first().airline_popularity == n - n // 5
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    plan = buf.getvalue()
    assert plan.count("BroadcastHashJoin") == 2
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_single_popularity_joins_equal_combined(spark):
    from faresight.operators.lookup import (attach_airline_popularity,
                                            attach_route_popularity)
    df = spark.range(3000).select(
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("D"), (F.col("id") % 7).cast("string"))).alias("departure_airport"),
        F.concat(F.lit("A"), (F.col("id") % 5).cast("string")).alias("arrival_airport"),
        F.when(F.col("id") % 6 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("L"), (F.col("id") % 3).cast("string"))).alias("airline"),
        "id")
    cols = ["id", "route_popularity", "airline_popularity"]
    a = sorted(tuple(r) for r in attach_popularity(df).select(*cols).collect())
    b = sorted(tuple(r) for r in attach_airline_popularity(attach_route_popularity(df))
               .select(*cols).collect())
    assert a == b
    assert min(r[1] for r in a) == 0      # NULL departure gives 0
