"""Time and date scalars.

Fare stamps are UTC wall-clock times. They are parsed to
``timestamp_ntz`` so hours, weekdays and day differences never depend
on the session time zone or its daylight-saving rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "parse_timestamp", "parse_flight_date", "weekday", "days_in_advance",
    "is_weekend", "booking_category", "time_to_minutes", "flight_duration",
    "time_of_day", "airline_code", "dmy_parts", "dmy_to_date", "dmy_to_iso",
    "next_dmy", "fallback_flight_date", "iso_millis", "date_to_iso", "utc_now_iso",
]

MICROS_PER_DAY = 86_400_000_000

# H:M with optional spaces and signs around each part, as Python's int()
# accepts them; hour and minute are not range checked.
_TIME_PATTERN = r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$"
# parseInt: optional sign and leading digits, trailing junk ignored.
_PARSE_INT = r"^\s*([+-]?\d+)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_timestamp(x) -> Column:
    """Text -> timestamp_ntz; anything unparsable becomes NULL."""
    return _c(x).try_cast("timestamp_ntz")


def parse_flight_date(x) -> Column:
    """Only text holding 'T' is parsed, everything else is NULL."""
    c = _c(x)
    return F.when(c.contains("T"), c.try_cast("timestamp_ntz"))


def weekday(x) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(x))


def days_in_advance(flight_date, create_at) -> Column:
    """Floor of elapsed 24-hour periods; negative when booked after.

    Calendar-day counts (datediff) and truncating diffs differ from the
    floor of the elapsed time for fares seen later on the same day.
    """
    micros = F.timestamp_diff("MICROSECOND", _c(create_at), _c(flight_date))
    return F.floor(micros / F.lit(MICROS_PER_DAY))


def is_weekend(day_of_week) -> Column:
    return (_c(day_of_week) >= 5).cast("int")


def booking_category(days) -> Column:
    """<7 -> 0, <30 -> 1, <90 -> 2, else (NULL included) 3."""
    d = _c(days)
    return (F.when(d < 7, 0).when(d < 30, 1).when(d < 90, 2).otherwise(3)
            .cast("int"))


def time_to_minutes(x, on_bad: str = "null") -> Column:
    """'H:M' -> H*60+M (G6). Bad text is NULL (training) or 0 (prediction)."""
    c = _c(x)
    h = F.regexp_extract(c, _TIME_PATTERN, 1).try_cast("bigint")
    m = F.regexp_extract(c, _TIME_PATTERN, 2).try_cast("bigint")
    minutes = h * 60 + m
    if on_bad == "zero":
        return F.coalesce(minutes, F.lit(0).cast("bigint"))
    if on_bad != "null":
        raise ValueError("on_bad must be 'null' or 'zero'")
    return minutes


def flight_duration(departure_minutes, arrival_minutes) -> Column:
    """Arrival minus departure, one day added when negative."""
    d = _c(arrival_minutes) - _c(departure_minutes)
    return F.when(d < 0, d + 1440).otherwise(d)


def time_of_day(minutes) -> Column:
    """Hours 6-11 -> 0, 12-17 -> 1, 18-21 -> 2, else (NULL too) 3."""
    h = F.floor(_c(minutes) / 60)
    return (F.when((h >= 6) & (h < 12), 0).when((h >= 12) & (h < 18), 1)
            .when((h >= 18) & (h < 22), 2).otherwise(3).cast("int"))


def airline_code(flight_number) -> Column:
    """First two characters of the flight number."""
    return F.substring(_c(flight_number), 1, 2)


def dmy_parts(x) -> tuple[Column, Column, Column, Column]:
    """Split 'DD/MM/YYYY' into (valid, day, month, year) like parseInt; the
    years 0 to 99 are 1900 to 1999, as in JavaScript's dates."""
    parts = F.split(_c(x), "/")
    ok3 = F.size(parts) == 3

    def num(i):
        return F.regexp_extract(F.get(parts, i), _PARSE_INT, 1).try_cast("int")

    d, m, y = num(0), num(1), num(2)
    y = F.when(y.between(0, 99), y + 1900).otherwise(y)
    valid = (ok3 & y.between(1, 9999) & m.between(-12000, 12000)
             & d.between(-400000, 400000))
    return valid, d, m, y


def dmy_to_date(x) -> Column:
    """'DD/MM/YYYY' -> date with JavaScript roll-over (31/02 -> 03/03)."""
    valid, d, m, y = dmy_parts(x)
    # Parts are replaced by harmless values where invalid, so ANSI mode
    # never raises inside the unused branch.
    safe = lambda c, v: F.when(valid, c).otherwise(F.lit(v))
    base = F.make_date(safe(y, 2000), F.lit(1), F.lit(1))
    return F.when(valid, F.date_add(F.add_months(base, safe(m, 1) - 1), safe(d, 1) - 1))


def date_to_iso(d) -> Column:
    """date -> ISO text of its UTC midnight."""
    return F.date_format(_c(d), "yyyy-MM-dd'T'00:00:00.000'Z'")


def dmy_to_iso(x) -> Column:
    """'DD/MM/YYYY' -> ISO text of UTC midnight; bad input NULL."""
    return date_to_iso(dmy_to_date(x))


def next_dmy(x) -> Column:
    """'DD/MM/YYYY' plus one day, written back as 'DD/MM/YYYY' (G15)."""
    return F.date_format(F.date_add(dmy_to_date(x), 1), "dd/MM/yyyy")


def fallback_flight_date(flight_date, search_date) -> Column:
    """The row's own ISO date, else the search day's UTC midnight."""
    return F.coalesce(_c(flight_date), dmy_to_iso(search_date))


def utc_now_iso() -> Column:
    """The current instant as UTC ISO text, whatever the session zone."""
    now = F.convert_timezone(None, F.lit("UTC"),
                             F.current_timestamp().cast("timestamp_ntz"))
    return iso_millis(now)


def iso_millis(ts) -> Column:
    """timestamp -> 'yyyy-MM-ddTHH:mm:ss.SSSZ' (JavaScript toISOString)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
