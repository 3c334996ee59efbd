"""Extraction and text filters over captured text, logs and pages
(B9-B12, G10-G13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.functions import text as tx

# --- fixed values (the reference's noise lists) ---------------------------
LOG_NOISE_TERMS = ["CORS", "Failed to load resource", "net::ERR_FAILED",
                   "REACT_APP_", "JSHandle@object", "DOMNodeInserted",
                   "Retargeting", "cdn-media.vinbase.ai"]
LOG_TYPES = ["log", "error", "warning"]
URL_NOISE_TERMS = ["analytics", "tracking", "measurement", "google-analytics",
                   "gtag", "googletagmanager", "facebook.com", "doubleclick",
                   "ads", "conversion"]
# ---------------------------------------------------------------------------


def _holds_any(col: str, terms: list[str]) -> F.Column:
    """Text contains any term: one ``exists`` over a literal array."""
    return F.exists(F.array(*[F.lit(t) for t in terms]),
                    lambda t: F.instr(F.col(col), t) > 0)


def booking_fields(df: DataFrame, text: str = "text", fallback: bool = True) -> DataFrame:
    """Flight number, times, fare class and total price (normalised,
    decimal) from booking-panel text; ``price_found`` tells whether the
    option is usable (G10, G11). ``fallback=False`` drops the trip-price
    fallback, as the capture path that is actually run does."""
    dep, arr = tx.booking_times(text)
    price = tx.labelled_price(text, fallback=fallback)
    return df.withColumns({
        "flight_number": tx.booking_flight_number(text),
        "departure_time": dep, "arrival_time": arr,
        "classes": tx.booking_class(text),
        "total_price": price.try_cast("decimal(18,2)"),
        "price_found": price.isNotNull(),
    })


def generic_flight(df: DataFrame, index_col: str, text: str = "text") -> DataFrame:
    """Generic extraction from result elements (G12): 1-based index from the
    element's 0-based position on its page (``index_col``), the trimmed text, price with currency else first number, all HH:MM
    times, duration. Elements with empty text are skipped."""
    t = tx.strip(text)
    idx = F.col(index_col) + 1
    return (df.where(t != "").select(
        idx.alias("index"), t.alias("text"), tx.generic_price(text).alias("price"),
        tx.generic_times(text).alias("times"), tx.generic_duration(text).alias("duration")))


def page_info(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Url, title, first 1000 characters of body text, has-results flag,
    and capture validity (G13, B12)."""
    title = tx.page_title(html)
    valid = (~title.isin("", "about:blank") & F.col(url).isNotNull()
             & ~F.col(url).isin("", "about:blank")
             & (F.instr(F.lower(F.col(html)), "<body") > 0))
    return pages.withColumns({"title": title, "page_text": tx.page_text(html),
                              "has_results": tx.page_has_results(html),
                              "valid": valid})


def filter_log_noise(df: DataFrame, message: str = "message", kind: str = "type"
                     ) -> DataFrame:
    """Keep log / error / warning lines holding none of the noise terms."""
    return df.where(F.col(kind).isin(*LOG_TYPES) & ~_holds_any(message, LOG_NOISE_TERMS))


def filter_url_noise(df: DataFrame, url: str = "url") -> DataFrame:
    """Keep failed-request URLs holding none of the tracker terms."""
    return df.where(~_holds_any(url, URL_NOISE_TERMS))


def text_match_summary(df: DataFrame, modes, text: str = "text",
                       pos: str = "doc_id") -> DataFrame:
    """For each (name, term, exact, case_sensitive) mode: matching rows and
    the first match by position (B9). One scan and one aggregate; its
    single row is exploded into one row per mode."""
    aggs = []
    for name, term, exact, cs in modes:
        m = tx.text_match(text, term, exact, cs)
        aggs += [F.count_if(m).alias(f"{name}__n"),
                 F.min(F.when(m, F.col(pos))).alias(f"{name}__first")]
    wide = df.agg(*aggs)
    per_mode = F.array(*[F.struct(F.lit(name).alias("mode"),
                                  F.col(f"{name}__n").alias("matches"),
                                  F.col(f"{name}__first").alias("first_" + pos))
                         for name, *_ in modes])
    return wide.select(F.inline(per_mode))
