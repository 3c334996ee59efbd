"""Data-quality rules as columns (C1-C10). A failing row is kept and
labelled; callers filter on the rule column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faresight.functions.text import strip
from faresight.functions.timeparts import utc_now_iso
from faresight.operators.joins import checked_small

# --- fixed values (the reference's rule messages) -------------------------
MSG_MISSING = ("Missing required parameters: departure_airport, arrival_airport, "
               "departure_date")
MSG_RETURN = "return_date is required when trip_type is roundtrip"
MSG_ADULT = "Adult count must be a positive integer and at least 1."
MSG_CHILD = "Child count must be a non-negative integer."
MSG_INFANT = "Infant count must be a non-negative integer."
MSG_INFANT_ADULT = "Number of infants cannot exceed number of adults."
MSG_STRUCT_FIELDS = "Missing or invalid required fields in flight config: "
MSG_TRIP_TYPE = "Invalid trip_type: {}. Must be 'oneway' or 'roundtrip'"
MSG_FIND_CHEAPEST = "Invalid find_cheapest: {}. Must be boolean"
MSG_DEPARTURE_DATE = "Invalid departure_date: {}. Must be string"
MSG_DEP_UNKNOWN = "Departure airport '{}' not found in airports database"
MSG_ARR_UNKNOWN = "Arrival airport '{}' not found in airports database"
MSG_SAME = "Departure and arrival airports cannot be the same"
MSG_BOTH_REQUIRED = "Both departure and arrival airports are required"
MSG_AIRPORT_FIELDS = "Airport at index {} missing required fields: "
TRIP_TYPES = ["oneway", "roundtrip"]
AIRPORT_FIELDS = ["code", "city", "airport_name", "country"]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _truthy_text(x) -> Column:
    """JavaScript truthiness of a text value: non-NULL and non-empty."""
    return _c(x).isNotNull() & (_c(x) != "")


def _blank(x) -> Column:
    return _c(x).isNull() | (strip(x) == "")


# White space and numbers of JavaScript's Number() (fixed values of the language).
_JS_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_JS_DECIMAL = r"^[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"
_JS_BASES = {16: r"^0[xX][0-9a-fA-F]+$", 8: r"^0[oO][0-7]+$", 2: r"^0[bB][01]+$"}
_EXACT_DIGITS = {16: 15, 8: 20, 2: 63}         # of that base, in 63 bits


def js_number(x) -> Column:
    """JavaScript Number() of a text: NULL (null) and blank -> 0, a decimal,
    ``Infinity`` or a 0x / 0o / 0b number -> its value, anything else NaN
    (here NULL). Only texts of that grammar are cast: Spark's cast takes more
    ('nan', '2d', 'inf')."""
    c = F.btrim(_c(x), F.lit(_JS_SPACE))
    out = F.when(c.isNull() | (c == ""), F.lit(0.0)).when(c.rlike(_JS_DECIMAL), c.try_cast("double"))
    for base, grammar in _JS_BASES.items():
        digits = F.substring(c, 3, 1 << 30)
        long = F.aggregate(F.transform(F.split(digits, ""), lambda d: F.conv(d, base, 10).cast("double")),
                           F.lit(0.0), lambda a, d: a * base + d)
        value = F.when(F.length(c) <= _EXACT_DIGITS[base] + 2, F.conv(digits, base, 10).cast("double")).otherwise(long)
        out = out.when(c.rlike(grammar), value)
    return out


def validate_airports(airports: DataFrame, index: str | None = None) -> DataFrame:
    """Per airport row: missing required fields and the error text; a
    code that is not three capital letters is a warning only (C1)."""
    missing = F.filter(F.array(*[F.when(_blank(f), F.lit(f)) for f in AIRPORT_FIELDS]),
                       lambda x: x.isNotNull())
    idx = F.col(index).cast("string") if index else F.lit("?")
    return airports.withColumns({
        "missing_fields": missing,
        "error": F.when(F.size(missing) > 0, F.concat(
            F.lit(MSG_AIRPORT_FIELDS.split("{}")[0]), idx, F.lit(MSG_AIRPORT_FIELDS.split("{}")[1]),
            F.array_join(missing, ", "))),
        "code_warning": ~F.coalesce(F.col("code"), F.lit("")).rlike("^[A-Z]{3}$"),
    })


def airports_table_check(airports: DataFrame) -> DataFrame:
    """One row: rows, invalid rows, warnings, and ok (non-empty, no
    invalid row) for the whole table (C1)."""
    v = validate_airports(airports)
    return v.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("error").isNotNull()).alias("invalid"),
                 F.count_if("code_warning").alias("warnings")).withColumn(
        "ok", (F.col("rows") > 0) & (F.col("invalid") == 0))


def validate_request_structure(df: DataFrame, dep="departure_airport",
                               arr="arrival_airport", trip="trip_type",
                               find_cheapest: str | None = None,
                               departure_date="departure_date") -> DataFrame:
    """Structure check of a request (C2): both codes non-blank text;
    trip_type, when set, oneway or roundtrip; find_cheapest, when
    present, boolean; departure_date, when set, text. First error wins.

    Columns are typed, so 'text' and 'boolean' hold by schema; for raw
    JSON use ``json_type_errors``.
    """
    bad = F.filter(F.array(F.when(_blank(dep), F.lit(dep)),
                           F.when(_blank(arr), F.lit(arr))), lambda x: x.isNotNull())
    t = _c(trip)
    err = (F.when(F.size(bad) > 0, F.concat(F.lit(MSG_STRUCT_FIELDS), F.array_join(bad, ", ")))
           .when(_truthy_text(t) & ~t.isin(*TRIP_TYPES),
                 F.format_string(MSG_TRIP_TYPE.replace("{}", "%s"), t)))
    if find_cheapest is not None:
        fc = _c(find_cheapest)
        err = err.when(fc.isNotNull() & ~fc.isin("true", "false"),
                       F.format_string(MSG_FIND_CHEAPEST.replace("{}", "%s"), fc))
    return df.withColumn("structure_error", err)


def json_type_errors(df: DataFrame, raw: str = "raw") -> DataFrame:
    """C2 on raw request JSON, telling absent from null and text from
    other JSON types (VARIANT)."""
    def typ(path):
        x = F.expr(f"variant_get(try_parse_json({raw}), '{path}')")
        return F.when(x.isNull(), F.lit("absent")).otherwise(F.schema_of_variant(x))

    dep_t, arr_t = typ("$.departure_airport"), typ("$.arrival_airport")
    dep_v = F.get_json_object(F.col(raw), "$.departure_airport")
    arr_v = F.get_json_object(F.col(raw), "$.arrival_airport")
    bad = F.filter(F.array(
        F.when((dep_t != "STRING") | _blank(dep_v), F.lit("departure_airport")),
        F.when((arr_t != "STRING") | _blank(arr_v), F.lit("arrival_airport"))),
        lambda x: x.isNotNull())
    so_t = typ("$.search_options")
    trip_v = F.get_json_object(F.col(raw), "$.search_options.trip_type")
    fc_t = typ("$.search_options.find_cheapest")
    fc_v = F.get_json_object(F.col(raw), "$.search_options.find_cheapest")
    dd_t = typ("$.search_options.departure_date")
    dd_v = F.get_json_object(F.col(raw), "$.search_options.departure_date")
    has_so = so_t.startswith("OBJECT")
    truthy_dd = dd_v.isNotNull() & ~dd_v.isin("", "0", "false")
    err = (F.when(F.size(bad) > 0, F.concat(F.lit(MSG_STRUCT_FIELDS), F.array_join(bad, ", ")))
           .when(has_so & _truthy_text(trip_v) & ~trip_v.isin(*TRIP_TYPES),
                 F.format_string(MSG_TRIP_TYPE.replace("{}", "%s"), trip_v))
           .when(has_so & (fc_t != "absent") & (fc_t != "BOOLEAN"),
                 F.format_string(MSG_FIND_CHEAPEST.replace("{}", "%s"),
                                 F.coalesce(fc_v, F.lit("null"))))
           .when(has_so & truthy_dd & (dd_t != "STRING"),
                 F.format_string(MSG_DEPARTURE_DATE.replace("{}", "%s"), dd_v)))
    return df.withColumn("structure_error", err)


def validate_required_and_passengers(df: DataFrame, dep="departure_airport",
                                     arr="arrival_airport",
                                     date="departure_date", ret="return_date",
                                     trip="trip_type", adult="adult", child="child",
                                     infant="infant") -> DataFrame:
    """Endpoint checks, first failing rule wins (C3 + C4): required
    parameters, return date for round trips, then passenger counts as
    JavaScript numbers (non-integers pass, as in the reference)."""
    # each number once: the rule and its message both ask for them
    df = df.withColumns({"__a": js_number(adult), "__c": js_number(child), "__i": js_number(infant)})
    a, c, i = F.col("__a"), F.col("__c"), F.col("__i")
    trip_c = F.coalesce(_c(trip), F.lit("oneway"))
    rule = (F.when(~(_truthy_text(dep) & _truthy_text(arr) & _truthy_text(date)), "missing")
            .when((trip_c == "roundtrip") & ~_truthy_text(ret), "return")
            .when(a.isNull() | (a < 1), "adult")
            .when(c.isNull() | (c < 0), "child")
            .when(i.isNull() | (i < 0), "infant")
            .when(i > a, "infant_exceeds_adult")
            .otherwise("ok"))
    msg = (F.when(rule == "missing", MSG_MISSING).when(rule == "return", MSG_RETURN)
           .when(rule == "adult", MSG_ADULT).when(rule == "child", MSG_CHILD)
           .when(rule == "infant", MSG_INFANT)
           .when(rule == "infant_exceeds_adult", MSG_INFANT_ADULT))
    return df.withColumns({"rule": rule, "error": msg}).drop("__a", "__c", "__i")


def json_request_rules(df: DataFrame, raw: str = "raw") -> DataFrame:
    """C3 + C4 on the raw JSON body of a request, where an absent key and an
    explicit null differ: an absent count is no number and fails, a null
    counts as 0, true as 1 and false as 0. Text that is no JSON object gets the rule 'malformed'."""
    keys = F.json_object_keys(F.col(raw))

    def value(k):
        return F.get_json_object(F.col(raw), f"$.{k}")

    def number(k):
        kind = F.expr(f"schema_of_variant(try_variant_get(try_parse_json({raw}), '$.{k}', 'variant'))")
        own = F.when(kind == "BOOLEAN", (value(k) == "true").cast("double")).otherwise(js_number(value(k)))
        return F.when(F.array_contains(keys, k), own)

    df = df.withColumns({"__a": number("adult"), "__c": number("child"), "__i": number("infant")})
    a, c, i = F.col("__a"), F.col("__c"), F.col("__i")
    trip = F.when(F.array_contains(keys, "trip_type"), value("trip_type")).otherwise(F.lit("oneway"))
    need = _truthy_text(value("departure_airport")) & _truthy_text(value("arrival_airport")) & _truthy_text(
        value("departure_date"))
    rule = (F.when(F.expr(f"try_parse_json({raw})").isNull() | keys.isNull(), "malformed")
            .when(~need, "missing")
            .when((trip == "roundtrip") & ~_truthy_text(value("return_date")), "return")
            .when(a.isNull() | (a < 1), "adult").when(c.isNull() | (c < 0), "child")
            .when(i.isNull() | (i < 0), "infant").when(i > a, "infant_exceeds_adult").otherwise("ok"))
    return df.withColumn("rule", rule).drop("__a", "__c", "__i")


def _codes(airports: DataFrame, upper: bool) -> DataFrame:
    c = F.upper("code") if upper else F.col("code")
    return airports.where(F.col("code").isNotNull()).select(c.alias("__k")).distinct()


def validate_route(df: DataFrame, airports: DataFrame, strict: bool = False,
                   dep="departure_airport", arr="arrival_airport",
                   airport_bound: int | None = None) -> DataFrame:
    """Both codes in the airport list and not the same airport.

    ``strict=False`` (C5): codes match case-insensitively and sameness is
    judged on the matched airports. ``strict=True`` (C6): both codes
    required, exact match, sameness on the raw text. The code list is
    broadcast behind a size check.
    """
    codes, small = checked_small(_codes(airports, upper=not strict), bound=airport_bound)
    kd = codes.select(F.col("__k").alias("__dq"), F.lit(True).alias("__dhit"))
    ka = codes.select(F.col("__k").alias("__aq"), F.lit(True).alias("__ahit"))
    if small:
        kd, ka = F.broadcast(kd), F.broadcast(ka)
    key = (lambda c: F.col(c)) if strict else (lambda c: F.upper(c))
    j = (df.withColumns({"__dq": key(dep), "__aq": key(arr)})
         .join(kd, "__dq", "left").join(ka, "__aq", "left"))
    dfound = F.coalesce("__dhit", F.lit(False))
    afound = F.coalesce("__ahit", F.lit(False))
    same = F.coalesce((F.col(dep) == F.col(arr)) if strict
                      else (F.col("__dq") == F.col("__aq")), F.lit(False))

    def shown(c):
        return F.coalesce(F.col(c), F.lit("null"))

    err = F.when(F.lit(False), F.lit(None).cast("string"))
    if strict:
        err = err.when(~(_truthy_text(dep) & _truthy_text(arr)), F.lit(MSG_BOTH_REQUIRED))
    err = (err.when(~dfound, F.format_string(MSG_DEP_UNKNOWN.replace("{}", "%s"), shown(dep)))
           .when(~afound, F.format_string(MSG_ARR_UNKNOWN.replace("{}", "%s"), shown(arr)))
           .when(same, F.lit(MSG_SAME)))
    return (j.withColumns({"route_error": err, "route_ok": dfound & afound & ~same})
            .drop("__dq", "__aq", "__dhit", "__ahit"))


def route_supported(df: DataFrame, airports: DataFrame, dep="departure_airport",
                    arr="arrival_airport", airport_bound: int | None = None) -> DataFrame:
    """Boolean: both codes known (case-insensitive), different airports."""
    v = validate_route(df, airports, strict=False, dep=dep, arr=arr,
                       airport_bound=airport_bound)
    return v.withColumn("route_supported", F.col("route_ok")).drop("route_ok", "route_error")


def request_defaults(df: DataFrame, endpoint: bool = False,
                     raw: str | None = None, stamp: str | None = None) -> DataFrame:
    """Fill missing request values (C8): adult 1, child 0, infant 0,
    trip oneway, departure date 'today', find_cheapest true (config file)
    or false (endpoint, which also upper-cases the codes, keeps a return
    date for round trips only and adds ``updated_at``: ``stamp`` or the
    current instant). With ``raw``
    JSON, a default applies only where the key is absent, keeping an
    explicit null as the reference's object merge does."""
    defaults = {"adult": "1", "child": "0", "infant": "0", "trip_type": "oneway",
                "departure_date": "today",
                "find_cheapest": "false" if endpoint else "true"}
    out = df
    if raw is not None:
        keys = F.json_object_keys(F.col(raw))
        so_keys = F.json_object_keys(F.get_json_object(F.col(raw), "$.search_options"))
    for k, v in defaults.items():
        if k not in out.columns:
            out = out.withColumn(k, F.lit(None).cast("string"))
        if raw is None:
            out = out.withColumn(k, F.coalesce(F.col(k).cast("string"), F.lit(v)))
        else:
            ks = so_keys if k in ("trip_type", "departure_date", "find_cheapest") else keys
            absent = ~F.coalesce(F.array_contains(ks, k), F.lit(False))
            out = out.withColumn(k, F.when(absent, F.lit(v)).otherwise(F.col(k).cast("string")))
    if endpoint:
        out = out.withColumns({"departure_airport": F.upper("departure_airport"),
                               "arrival_airport": F.upper("arrival_airport"),
                               "updated_at": F.lit(stamp) if stamp else utc_now_iso()})
        if "return_date" in out.columns:
            out = out.withColumn("return_date", F.when(
                (F.col("trip_type") == "roundtrip") & _truthy_text("return_date"), F.col("return_date")))
    return out


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count per column, one aggregate pass, one row per column."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "null_count")


def row_accounting(raw: DataFrame, deduped: DataFrame, bounds: DataFrame,
                   price: str = "price") -> DataFrame:
    """Rows in, duplicates, outliers, unparsable rows and rows out (C10):
    one count over the raw rows and one flagged aggregate (``count_if``)
    over the deduped rows -- two scans, one job."""
    from faresight.operators.clean import parse_ok
    from faresight.operators.joins import cross_one_row
    n_in = raw.agg(F.count(F.lit(1)).alias("rows_in"))
    p = F.col(price).cast("double")
    b = bounds.select(F.col("lower_bound").alias("__lo"), F.col("upper_bound").alias("__hi"))
    inb = F.coalesce(~F.isnan(p) & p.between(F.col("__lo"), F.col("__hi")), F.lit(False))
    flags = cross_one_row(deduped, b).agg(
        F.count(F.lit(1)).alias("__d"),
        F.count_if(~inb).alias("outliers"),
        F.count_if(inb & ~parse_ok()).alias("unparsable"),
        F.count_if(inb & parse_ok()).alias("rows_out"))
    return n_in.crossJoin(flags).select(
        "rows_in", (F.col("rows_in") - F.col("__d")).alias("duplicates"),
        "outliers", "unparsable", "rows_out")
