"""Row generation and fallback (H1-H3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.functions import timeparts as tp
from faresight.schema import SEARCH_DAYS


def expand_search_days(requests: DataFrame, date: str = "departure_date",
                       days: int = SEARCH_DAYS) -> DataFrame:
    """Each request becomes ``days`` consecutive search days (H1), with a
    0-based ``day_index``, the day as a date (``search_day``) and as
    'DD/MM/YYYY' text. A per-row generator: no shuffle, output grows
    linearly; the request date is parsed once, before the expansion."""
    reqs = requests.withColumn("__d0", tp.dmy_to_date(date))
    out = reqs.select("*", F.posexplode(F.array_repeat(F.lit(0), days))
                      .alias("day_index", "__z"))
    return (out.withColumn("search_day", F.date_add("__d0", F.col("day_index")))
            .withColumn("search_date", F.date_format("search_day", "dd/MM/yyyy"))
            .drop("__d0", "__z"))


def result_fallback(sources: list[tuple[int, str, DataFrame]],
                    request: str = "request_id") -> DataFrame:
    """Per request, keep the rows of the best source that has any: script
    rows, else generic extraction, else page info (H2).

    ``sources`` are (priority, name, frame) with a ``request`` column; the
    result has their columns by name (NULL where a source has none).
    Each source drops the requests that a better one has (their distinct
    ids, an anti join that AQE may split), so the rows of the chosen source
    are not gathered or rewritten.
    """
    out = better = None
    for prio, name, df in sorted(sources, key=lambda s: s[0]):
        rows = df.withColumns({"priority": F.lit(prio), "source": F.lit(name)})
        if better is not None:
            rows = rows.join(better, request, "left_anti")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        ids = df.select(request)
        better = ids.distinct() if better is None else better.unionByName(ids).distinct()
    return out


def history_projection(options: DataFrame, requests: DataFrame | None = None,
                       batch_ts: str | None = None, request: str = "run_id",
                       request_key: str = "request_id", keep=()) -> DataFrame:
    """Crawl price options -> history rows (H3): ``total_price`` becomes
    ``price``, a missing flight date falls back to the search day (G19),
    passengers come from the request, one stamp per batch. ``keep`` names
    further columns to pass on."""
    out = options.select(
        request, *keep,
        F.lit(batch_ts).cast("string").alias("created_at") if batch_ts else
        tp.utc_now_iso().alias("created_at"),
        "flight_number", "aircraft_type", "departure_airport", "arrival_airport",
        tp.fallback_flight_date("flight_date", "search_date").alias("flight_date"),
        "departure_time", "arrival_time", "classes",
        F.col("total_price").alias("price"))
    if requests is not None:
        p = requests.select(F.col(request_key).alias(request), "adult", "child", "infant")
        out = out.join(p, request, "left")
    return out
