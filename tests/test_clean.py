"""Cleaning stages and their properties."""

from decimal import Decimal

from faresight.operators import clean as cl
from faresight.operators import stats as st
from faresight.plans import fixtures as fx
from tests.conftest import SMOKE


def test_clean_plane_strips_unicode_space(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("\t\n",), (" A321 ",),
                                (" Airbus ",)], "type_of_plane string")
    assert sorted(r[0] for r in cl.clean_plane(df).collect()) == ["A321", "Airbus"]


def test_iqr_inclusive_and_null_dropped(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in (1, 2, 3, 4, 100)] + [(None,)],
                               "price decimal(18,2)")
    b = st.price_bounds(df).first()
    assert (b.q1, b.q3) == (2.0, 4.0)
    kept = sorted(float(r.price) for r in cl.filter_price_iqr(df).collect())
    assert kept == [1.0, 2.0, 3.0, 4.0]


def test_dedupe_idempotent_and_clean_subset(spark):
    raw = fx.fare_raw_with_copies(spark, SMOKE)
    d1 = cl.dedupe_exact(raw)
    assert d1.count() == cl.dedupe_exact(d1).count()
    c = cl.clean_fares(raw)
    n = c.fares.count()
    assert 0 < n <= c.filtered.count() <= c.deduped.count() <= raw.count()


def test_flight_date_needs_T(spark):
    df = spark.createDataFrame([("2024-03-01",), ("2024-03-01T05:00:00.000Z",), ("bad T",)],
                               "flight_date string")
    assert cl.parse_flight_dates(df).count() == 1


def test_results_stable_under_repartition(spark):
    raw = fx.fare_raw_with_copies(spark, SMOKE)
    a = sorted(map(tuple, st.route_counts(cl.clean_fares(raw).fares).collect()))
    b = sorted(map(tuple, st.route_counts(cl.clean_fares(raw.repartition(7)).fares).collect()))
    assert a == b


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    cases = [rng.integers(0, 50, 997).astype(float).tolist(),   # many duplicates
             rng.normal(0, 1, 500).tolist(),
             [3.0], [1.0, 2.0], [5.0, 5.0, 5.0, 9.0]]
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for vals in cases:
        df = spark.createDataFrame([(x,) for x in vals] + [(None,)], "p double").repartition(3)
        want = np.quantile(np.array(vals), probs)
        got = st.exact_quantiles(df, "p", probs).first()
        assert np.allclose([got[f"q{i}"] for i in range(len(probs))], want)
    empty = spark.createDataFrame([(None,)], "p double")
    assert st.exact_quantiles(empty, "p", [0.5]).first().q0 is None
