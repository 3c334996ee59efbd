"""Text scalars: price text, captured panel text, pages, labels
(G10-G13, G16-G18, G20, G21, B9 predicates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "strip", "normalise_price_text", "price_text_to_decimal", "booking_flight_number",
    "booking_times", "booking_class", "labelled_price", "aircraft_name",
    "is_direct_container", "generic_price", "generic_times",
    "generic_duration", "page_title", "page_text", "page_has_results",
    "month_header", "search_url", "route_label", "clip_price", "text_match",
]

# --- fixed values (must equal the reference's extraction rules) -----------
FLIGHT_NUMBER_RE = r"(VJ\d+)"
TIME_PAIR_RE = r"(?U)([0-9]{2}:[0-9]{2})\s*-\s*([0-9]{2}:[0-9]{2})"
FARE_CLASS_RE = r"(?i)(Skyboss|Business|Deluxe|Eco)"
TOTAL_LABEL = "Tổng tiền"
TRIP_LABEL = "Chuyến đi"
AIRCRAFT_RE = r"(?i)^(Airbus|Boeing)"
PANEL_FLIGHT_RE = r"^VJ\d{3,4}$"
DIRECT_MARKER = "Bay thẳng"
GENERIC_PRICE_CURRENCY_RE = r"(?iU)([0-9,]+\s*(?:VND|₫|VNĐ))"
GENERIC_PRICE_NUMBER_RE = r"([\d,]+)"
GENERIC_TIME_RE = r"\d{2}:\d{2}"
GENERIC_DURATION_RE = r"(?iU)([0-9]+h\s*[0-9]*m?)"
MONTH_HEADER_RE = r"tháng\s+(\d+)\s+(\d+)"
SEARCH_URL = "https://baydep.vn/flights/%s%s%s/%s/%s/%s?nearby-airport=yes"
# ---------------------------------------------------------------------------

# Amount text right after a label: digits with separators, optional currency.
_AMOUNT = r"(?U)\s*([0-9][0-9,.]*\s*(?:VND|₫)?)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Surrounding white space of any kind removed (``trim`` takes spaces
    only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normalise_price_text(x) -> Column:
    """Drop commas, 'VND' and '₫' with their spaces, trim.

    Text that ends up '0' or empty is no price (NULL).
    """
    s = F.regexp_replace(_c(x), ",", "")
    s = F.regexp_replace(s, r"(?U)\s*VND\s*", "")
    s = F.regexp_replace(s, r"(?U)\s*₫\s*", "")
    s = strip(s)
    return F.when(~s.isin("0", ""), s)


def price_text_to_decimal(x) -> Column:
    return normalise_price_text(x).try_cast("decimal(18,2)")


def _first(x, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(_c(x), pattern, group), F.lit(""))


def booking_flight_number(x) -> Column:
    return _first(x, FLIGHT_NUMBER_RE)


def booking_times(x) -> tuple[Column, Column]:
    return _first(x, TIME_PAIR_RE, 1), _first(x, TIME_PAIR_RE, 2)


def booking_class(x) -> Column:
    """First of Skyboss/Business/Deluxe/Eco in any case, kept as written."""
    return _first(x, FARE_CLASS_RE)


def labelled_price(x, fallback: bool = True) -> Column:
    """Normalised amount after 'Tổng tiền'; when that is missing or zero,
    the amount after 'Chuyến đi' (G11)."""
    total = normalise_price_text(_first(x, TOTAL_LABEL + _AMOUNT))
    if not fallback:
        return total
    trip = normalise_price_text(_first(x, TRIP_LABEL + _AMOUNT))
    return F.coalesce(total, trip)


def aircraft_name(span_text) -> Column:
    """Span text starting Airbus/Boeing -> part before '-', trimmed."""
    t = strip(span_text)
    return F.when(t.rlike(AIRCRAFT_RE), strip(F.split(t, "-").getItem(0)))


def is_direct_container(container_text, flight_number) -> Column:
    """Container holds the direct-flight marker and the flight number, and
    the flight number is VJ + 3-4 digits."""
    fn = strip(flight_number)
    return (fn.rlike(PANEL_FLIGHT_RE) & _c(container_text).contains(DIRECT_MARKER)
            & (F.instr(_c(container_text), fn) > 0))


def generic_price(x) -> Column:
    """Price with currency, else the first number."""
    return F.coalesce(_first(x, GENERIC_PRICE_CURRENCY_RE),
                      _first(x, GENERIC_PRICE_NUMBER_RE))


def generic_times(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(GENERIC_TIME_RE), 0)


def generic_duration(x) -> Column:
    return _first(x, GENERIC_DURATION_RE)


def page_title(html) -> Column:
    return F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_text(html, n: int = 1000) -> Column:
    """Text content of <body>: tags removed, common entities decoded,
    first ``n`` characters (G13)."""
    body = F.regexp_extract(_c(html), r"(?is)<body[^>]*>(.*)</body>", 1)
    t = F.regexp_replace(body, r"<[^>]*>", "")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.substring(t, 1, n)


def page_has_results(html) -> Column:
    """Some element's class attribute contains 'flight' (case-sensitive)."""
    return _c(html).rlike(r"""(?i:class)\s*=\s*["'][^"']*flight""")


def month_header(x) -> tuple[Column, Column]:
    """'tháng MM YYYY' (any case) -> (month 1-12 as written, year)."""
    low = F.lower(_c(x))
    return (F.regexp_extract(low, MONTH_HEADER_RE, 1).try_cast("int"),
            F.regexp_extract(low, MONTH_HEADER_RE, 2).try_cast("int"))


def _js(x) -> Column:
    """Template-literal text of a value: NULL prints as 'null'."""
    return F.coalesce(_c(x).cast("string"), F.lit("null"))


def search_url(dep, arr, departure_date, adult, child, infant, base: str = SEARCH_URL) -> Column:
    """Search URL: route + date without slashes, then passengers.
    ``base``: the URL with %s for each part."""
    date = F.replace(_c(departure_date), F.lit("/"), F.lit(""))
    parts = [_js(dep), _js(arr), _js(date), _js(adult), _js(child), _js(infant)]
    pieces = base.split("%s")
    out = [F.lit(pieces[0])]
    for p, lit in zip(parts, pieces[1:]):
        out += [p, F.lit(lit)]
    return F.concat(*out)


def route_label(dep, arr) -> Column:
    """'SGN → HAN' (G21)."""
    return F.concat(_js(dep), F.lit(" → "), _js(arr))


def clip_price(pred, price_min, price_max) -> Column:
    """Clip to [max(min, 100000), min(max, 50000000)]; as numpy does, the
    upper limit wins when the limits cross; no stats -> unchanged (G20)."""
    from faresight.schema import CLIP_CEILING, CLIP_FLOOR
    lo = F.greatest(_c(price_min).cast("double"), F.lit(float(CLIP_FLOOR)))
    hi = F.least(_c(price_max).cast("double"), F.lit(float(CLIP_CEILING)))
    clipped = F.least(hi, F.greatest(lo, _c(pred)))
    return F.when(_c(price_min).isNull() | _c(price_max).isNull(), _c(pred)) \
        .otherwise(clipped)


def text_match(text, term: str, exact: bool = False,
               case_sensitive: bool = False) -> Column:
    """Text contains / equals ``term`` (B9). Exact mode trims the text."""
    t = _c(text)
    if exact:
        t = strip(t)
        return t == F.lit(term) if case_sensitive else F.lower(t) == F.lit(term.lower())
    if case_sensitive:
        return F.instr(t, term) > 0
    return F.instr(F.lower(t), term.lower()) > 0
