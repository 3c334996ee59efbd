"""Aggregations: price bounds and statistics, counts, crawl summaries
(E1-E13). Every aggregate is a (partial + final) hash aggregate, so a
key holding a third of the rows is combined map-side before it moves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.session import materialize

ACCURACY = 10_000         # of the sketch that narrows the search for a rank
AT_ONCE = 100_000         # distinct values that the driver ranks


def exact_quantiles(df: DataFrame, col, probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / ``quantile_cont``).

    Ranks are selected by narrowing: one aggregate counts the values and
    sketches an interval around each wanted rank, a second counts the
    intervals' values exactly, with everything between them as one count
    each. Both combine map-side, and nothing is sorted, sampled or dealt by
    ranges. An interval that still holds more than ``AT_ONCE`` distinct values is
    narrowed again; each round leaves some 4 / ``ACCURACY`` of the rows. Returns
    one row, ``q{i}`` per probability (NULL when there are no values).
    """
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    values = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    spans, n = _spans(values, probs)
    at = {p: (n - 1) * p for p in probs} if n else {}
    held = _ranked(values, n, {p: {math.floor(h), math.ceil(h)} for p, h in at.items()}, spans) if n else {}
    out = []
    for p in probs:
        lo, hi = (held[math.floor(at[p])], held[math.ceil(at[p])]) if n else (None, None)
        out.append(lo + (at[p] - math.floor(at[p])) * (hi - lo) if n else None)
    return df.sparkSession.createDataFrame([tuple(out)], ", ".join(f"q{i} double" for i in range(len(probs))))


def _spans(values: DataFrame, probs) -> tuple[dict[float, tuple[float, float]], int]:
    """For each probability two values with its rank between them, as far
    as the sketch can tell, and the number of values."""
    wide = [x for p in probs for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
    got = values.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", wide, ACCURACY).alias("s")).first()
    s = got["s"] or []
    return {p: (s[2 * i], s[2 * i + 1]) for i, p in enumerate(probs)} if s else {}, got["n"]


def _ranked(values: DataFrame, n: int, ranks: dict[float, set[int]], spans: dict) -> dict[int, float]:
    """The values at 0-based ranks, each looked for between its span's ends."""
    merged: list[list[float]] = []
    for lo, hi in sorted(spans.values()):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    # 2k + 1: inside span k; 2k: below it
    place = F.lit(2 * len(merged))
    for k in reversed(range(len(merged))):
        lo, hi = (F.lit(x) for x in merged[k])
        place = F.when(F.col("v") < lo, 2 * k).when(F.col("v") <= hi, 2 * k + 1).otherwise(place)
    inside = F.when(F.col("place") % 2 == 1, F.col("v"))
    counts = materialize(values.withColumn("place", place).groupBy("place", inside.alias("v"))
                         .agg(F.count(F.lit(1)).alias("c")), "rank_counts")
    whole = {r["place"]: (r["c"], r["values"]) for r in counts.groupBy("place").agg(
        F.sum("c").alias("c"), F.count("v").alias("values")).collect()}          # at most two a span, and one
    out, before = {}, 0
    wanted = set().union(*ranks.values())
    for k in range(2 * len(merged) + 1):
        c, distinct = whole.get(k, (0, 0))
        here = sorted(r - before for r in wanted if before <= r < before + c)
        if here:
            own = counts.where(F.col("place") == k)
            if k % 2 and distinct <= AT_ONCE:
                found, seen = {}, 0
                for r in sorted((r["v"], r["c"]) for r in own.select("v", "c").collect()):
                    found.update({h: r[0] for h in here if seen <= h < seen + r[1]})
                    seen += r[1]
            else:              # more values than are ranked at once, or a rank that the sketch missed
                part = values.withColumn("place", place).where(F.col("place") == k).select("v")
                narrower, _ = _spans(part, [h / max(1, c - 1) for h in here])
                found = _ranked(part, c, dict(zip(narrower, ({h} for h in here))), narrower)
            out.update({before + h: x for h, x in found.items()})
        before += c
    return out


def price_bounds(df: DataFrame, price: str = "price", method: str = "exact",
                 accuracy: int = 10000) -> DataFrame:
    """One row: q1, q3, iqr, lower_bound, upper_bound.

    ``exact`` is the distributed exact quantile, ``approx`` the sketch
    (``percentile_approx``).
    """
    if method == "exact":
        q = exact_quantiles(df, price, [0.25, 0.75])
        q1, q3 = F.col("q0"), F.col("q1")
    elif method == "approx":
        q = df.agg(F.percentile_approx(F.col(price).cast("double"), [0.25, 0.75], accuracy).alias("q"))
        q1, q3 = F.col("q").getItem(0), F.col("q").getItem(1)
    else:
        raise ValueError("method must be 'exact' or 'approx'")
    return q.select(
        q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
        (q1 - 1.5 * (q3 - q1)).alias("lower_bound"),
        (q3 + 1.5 * (q3 - q1)).alias("upper_bound"))


def price_stats(filtered: DataFrame, bounds: DataFrame,
                price: str = "price") -> DataFrame:
    """min, max, mean, sample std after the outlier filter, with Q1/Q3
    from before it (E2)."""
    p = F.col(price).cast("double")
    s = filtered.agg(F.min(p).alias("min"), F.max(p).alias("max"),
                     F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"))
    return s.crossJoin(bounds.select(F.col("q1").alias("Q1"),
                                     F.col("q3").alias("Q3")))


def describe_price(df: DataFrame, price: str = "price") -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max with exact percentiles."""
    p = F.col(price).cast("double")
    base = df.agg(F.count(p).alias("count"), F.avg(p).alias("mean"),
                  F.stddev_samp(p).alias("std"), F.min(p).alias("min"),
                  F.max(p).alias("max"))
    q = exact_quantiles(df, price, [0.25, 0.5, 0.75])
    return base.crossJoin(q).select(
        "count", "mean", "std", "min", F.col("q0").alias("p25"),
        F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max")


def distribution_summary(df: DataFrame, price: str = "price") -> DataFrame:
    """rows, min, max, mean, median."""
    p = F.col(price).cast("double")
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.min(p).alias("min"),
                  F.max(p).alias("max"), F.avg(p).alias("mean"))
    return base.crossJoin(exact_quantiles(df, price, [0.5]).select(
        F.col("q0").alias("median")))


def route_counts(df: DataFrame, dep: str = "departure_airport",
                 arr: str = "arrival_airport") -> DataFrame:
    """Rows per (departure, arrival); NULL keys are left out (E5)."""
    return (df.where(F.col(dep).isNotNull() & F.col(arr).isNotNull())
            .groupBy(dep, arr).agg(F.count(F.lit(1)).alias("route_count")))


def airline_counts(df: DataFrame, airline: str = "airline") -> DataFrame:
    """Rows per airline, NULL left out, largest first."""
    return (df.where(F.col(airline).isNotNull()).groupBy(airline)
            .agg(F.count(F.lit(1)).alias("airline_count"))
            .orderBy(F.desc("airline_count"), F.asc(airline)))


def popularity_stats(df: DataFrame) -> DataFrame:
    """Row-weighted mean and sample std of route / airline popularity."""
    r, a = F.col("route_popularity"), F.col("airline_popularity")
    return df.agg(F.avg(r).alias("route_mean"), F.stddev_samp(r).alias("route_std"),
                  F.avg(a).alias("airline_mean"),
                  F.stddev_samp(a).alias("airline_std"))


def aircraft_map(df: DataFrame, run: str = "run_id", pos: str = "pos",
                 flight: str = "flight_number",
                 aircraft: str = "aircraft_type") -> DataFrame:
    """Per run, flight number -> aircraft from complete pairs, last seen
    (largest position) wins (E8)."""
    return (df.where(F.col(flight).isNotNull() & F.col(aircraft).isNotNull())
            .groupBy(run, flight)
            .agg(F.max_by(aircraft, pos).alias(aircraft)))


def _distinct_with_null(col: str):
    """Distinct count where a NULL counts as one value (JavaScript Set)."""
    return (F.count_distinct(F.col(col))
            + F.max(F.col(col).isNull().cast("int"))).cast("bigint")


def daily_flight_count(df: DataFrame, keys=("search_date", "departure_airport",
                                            "arrival_airport"),
                       flight: str = "flight_number") -> DataFrame:
    """Per search day and route: price options and distinct flights."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("price_options"),
        _distinct_with_null(flight).alias("total_flights"))


def crawl_summary(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: days, price options and distinct flights over all days
    (E10). Works row by row on the nested run, so no shuffle."""
    days = F.coalesce(F.col("daily_results"), F.array())
    prices = F.flatten(F.transform(
        days, lambda d: F.coalesce(d["prices"], F.array())))
    flights = F.transform(prices, lambda p: p["flight_number"])
    return runs.select(
        run,
        F.size(days).cast("bigint").alias("total_days_crawled"),
        F.size(prices).cast("bigint").alias("total_price_options"),
        F.size(F.array_distinct(flights)).cast("bigint")
        .alias("total_unique_flights"))


def normalise_error(col) -> F.Column:
    """Error text with its trailing option index replaced by N."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"price option \d+", "price option N")


def crawl_errors(runs: DataFrame) -> DataFrame:
    """Error messages over all days, counted by normalised message."""
    days = runs.select(F.explode(F.col("daily_results")).alias("d"))
    errs = days.select(F.explode(F.col("d.errors")).alias("error"))
    return (errs.groupBy(normalise_error("error").alias("error"))
            .agg(F.count(F.lit(1)).alias("n")))


def crawl_day_errors(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Per day of a run: its error list and how many errors it has.
    A row-wise explode of the nested days; no shuffle."""
    days = runs.select(run, F.explode(F.col("daily_results")).alias("d"))
    return days.select(run, F.col("d.search_date").alias("search_date"),
                       F.col("d.departure_airport").alias("departure_airport"),
                       F.col("d.arrival_airport").alias("arrival_airport"),
                       F.coalesce(F.col("d.errors"), F.array().cast("array<string>"))
                       .alias("errors"),
                       F.coalesce(F.size("d.errors"), F.lit(0)).cast("bigint").alias("n_errors"))


def execution_stats(outcomes: DataFrame) -> DataFrame:
    """Per crawl outcome: duration and its '12.34s' text, success, step and
    screenshot counts, has-results flag, route, start and end (E12)."""
    start = F.col("metadata.startTime")
    end_ts = F.timestamp_add("MILLISECOND", F.col("duration"),
                             start.try_cast("timestamp_ntz"))
    return outcomes.select(
        "*",
        F.col("duration").alias("executionTime"),
        F.format_string("%.2fs", F.col("duration") / 1000.0)
        .alias("executionTimeFormatted"),
        F.coalesce(F.size("steps"), F.lit(0)).alias("stepsCompleted"),
        F.coalesce(F.size("screenshots"), F.lit(0)).alias("screenshotsTaken"),
        (F.col("results").isNotNull() & (F.col("results") != ""))
        .alias("hasResults"),
        start.alias("startTime"),
        F.coalesce(F.col("metadata.errorTime"),
                   F.date_format(end_ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .alias("endTime"))


# --- fixed value (the reference's error of a failed attempt without text) ---
NO_ERROR_TEXT = "Crawler failed without specific error"
# ---------------------------------------------------------------------------


def retry_outcome(attempts: DataFrame, request: str = "request_id",
                  attempt: str = "attempt", max_retries: int = 3) -> DataFrame:
    """First success among attempts 1..max_retries+1, else the last error
    (E13). The endpoint passes 3, so four attempts are allowed."""
    a = attempts.where(F.col(attempt) <= max_retries + 1)
    ok = F.col("success")
    return a.groupBy(request).agg(
        F.min(F.when(ok, F.col(attempt))).alias("success_attempt"),
        F.max(attempt).alias("attempts_made"),
        F.max_by(F.when(~ok, F.coalesce(F.col("error"), F.lit(NO_ERROR_TEXT))), F.when(~ok, F.col(attempt)))
        .alias("last_error"),
    ).select(
        request,
        F.col("success_attempt").isNotNull().alias("success"),
        F.coalesce("success_attempt", "attempts_made").alias("attempts_used"),
        F.when(F.col("success_attempt").isNull(), F.col("last_error"))
        .alias("error"))
