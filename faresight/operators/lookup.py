"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.operators.joins import BROADCAST_BYTE_LIMIT, ROW_BYTES, checked_small, lookup_join
from faresight.operators.stats import route_counts
from faresight.session import materialize_counted


def enrich_airports(df: DataFrame, airports: DataFrame,
                    dep: str = "departure_airport",
                    arr: str = "arrival_airport",
                    airport_bound: int | None = None) -> DataFrame:
    """Add city and airport name for departure and arrival.

    Codes match case-insensitively, as the reference's lookup does.
    """
    # The first airport of a code counts, in the list's order.
    a = (airports.withColumn("__pos", F.monotonically_increasing_id())
         .groupBy(F.upper("code").alias("__code"))
         .agg(F.min_by(F.struct("city", "airport_name"), "__pos").alias("a"))
         .select("__code", "a.city", "a.airport_name"))
    d = a.select(F.col("__code").alias("__dep"),
                 F.col("city").alias("departure_city"),
                 F.col("airport_name").alias("departure_airport_name"))
    r = a.select(F.col("__code").alias("__arr"),
                 F.col("city").alias("arrival_city"),
                 F.col("airport_name").alias("arrival_airport_name"))
    out = df.withColumn("__dep", F.upper(dep)).withColumn("__arr", F.upper(arr))
    out = lookup_join(out, d, "__dep", bound=airport_bound)
    out = lookup_join(out, r, "__arr", bound=airport_bound)
    return out.drop("__dep", "__arr")


def airports_by_country(airports: DataFrame, country: str) -> DataFrame:
    """Airports of a country, compared case-insensitively; NULL country
    never matches (B8)."""
    return airports.where(F.col("country").isNotNull()
                          & (F.lower("country") == F.lower(F.lit(country))))


def attach_route_popularity(df: DataFrame, dep: str = "departure_airport",
                            arr: str = "arrival_airport",
                            out: str = "route_popularity") -> DataFrame:
    """Each row gets the row count of its route; a NULL key gives 0.

    Counted with a partial aggregate and joined back through a checked
    broadcast, so a route holding a third of the rows is never one task.
    """
    counts = route_counts(df, dep, arr).withColumnRenamed("route_count", out)
    j = lookup_join(df, counts, [dep, arr])
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("bigint"))


def attach_airline_popularity(df: DataFrame, airline: str = "airline",
                              out: str = "airline_popularity") -> DataFrame:
    """Each row gets its airline's row count; NULL airline gives 0 (D3)."""
    counts = (df.where(F.col(airline).isNotNull()).groupBy(airline)
              .agg(F.count(F.lit(1)).alias(out)))
    j = lookup_join(df, counts, airline)
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("bigint"))


def grouping_id_of(cols: list[str], group: list[str]) -> int:
    """``grouping_id()`` of a grouping set: one bit per column left out,
    the first column being the most significant bit."""
    n = len(cols)
    return sum(1 << (n - 1 - i) for i, c in enumerate(cols) if c not in group)


def group_counts(df: DataFrame, sets: list[list[str]]) -> tuple[DataFrame, int, list[str]]:
    """Row counts for several grouping sets in one aggregation pass,
    written once to the shared folder with its row count observed.

    Returns (table with the grouping columns, ``__n`` and ``__g``, its row
    count, the column order that ``grouping_id_of`` needs).
    """
    cols = list(dict.fromkeys(c for g in sets for c in g))
    combos = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    g = (combos.groupingSets(sets, *cols)
         .agg(F.sum("__n").alias("__n"), F.grouping_id().alias("__g")))
    counts, n = materialize_counted(g, "group_counts")
    return counts, n, cols


def join_popularity(df: DataFrame, counts: DataFrame, cols: list[str], small: bool,
                    dep: str = "departure_airport", arr: str = "arrival_airport",
                    airline: str = "airline") -> DataFrame:
    """Attach route and airline counts from a ``group_counts`` table;
    NULL keys are not counted and give 0."""
    routes = (counts.where((F.col("__g") == grouping_id_of(cols, [dep, arr]))
                           & F.col(dep).isNotNull() & F.col(arr).isNotNull())
              .select(dep, arr, F.col("__n").alias("route_popularity")))
    airlines = (counts.where((F.col("__g") == grouping_id_of(cols, [airline]))
                             & F.col(airline).isNotNull())
                .select(airline, F.col("__n").alias("airline_popularity")))
    if small:
        routes, airlines = F.broadcast(routes), F.broadcast(airlines)
    out = df.join(routes, [dep, arr], "left").join(airlines, airline, "left")
    return out.withColumns({
        "route_popularity": F.coalesce("route_popularity", F.lit(0)).cast("bigint"),
        "airline_popularity": F.coalesce("airline_popularity", F.lit(0)).cast("bigint")})


def attach_popularity(df: DataFrame, dep: str = "departure_airport",
                      arr: str = "arrival_airport", airline: str = "airline") -> DataFrame:
    """D2 and D3 together: route and airline counts from one aggregation
    pass (grouping sets), one checked lookup table, two broadcast joins.
    NULL keys are not counted and give 0."""
    counts, n, cols = group_counts(df, [[dep, arr], [airline]])
    return join_popularity(df, counts, cols, n * ROW_BYTES <= BROADCAST_BYTE_LIMIT, dep, arr, airline)


def aircraft_lookup(df: DataFrame, base_map: DataFrame, current_map: DataFrame,
                    keys=("run_id", "flight_number"),
                    aircraft: str = "aircraft_type") -> DataFrame:
    """Aircraft of each row's flight: the map taken at price time wins over
    the one taken at page start; unknown stays NULL (D4). The two maps become
    one lookup with the winner chosen, and one join."""
    keys = list(keys)
    both = (base_map.select(*keys, F.lit(1).alias("__p"), F.col(aircraft).alias("__a"))
            .unionByName(current_map.select(*keys, F.lit(0).alias("__p"), F.col(aircraft).alias("__a")))
            .where(F.col("__a").isNotNull()))
    one = both.groupBy(*keys).agg(F.min_by("__a", "__p").alias(aircraft))
    return df.drop(aircraft).join(one, keys, "left")       # AQE picks the join


def aircraft_at(rows: DataFrame, at_start, at_price, keys=("run_id", "flight_number"),
                pos: str = "pos", aircraft: str = "aircraft_type") -> DataFrame:
    """D4 where both maps come from the same captured rows: ``at_start`` and
    ``at_price`` say which rows each capture saw; the last of a flight wins
    in each. One grouping, one join."""
    keys = list(keys)
    known = F.col(aircraft).isNotNull()
    last = [F.max_by(F.when(seen & known, F.col(aircraft)), F.when(seen & known, F.col(pos)))
            for seen in (at_price, at_start)]
    one = rows.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.coalesce(*last).alias("__a"))
    return rows.join(one, keys, "left").withColumn(aircraft, F.col("__a")).drop("__a")


def airport_mention(texts: DataFrame, airports: DataFrame,
                    text: str = "text", pos: str = "doc_id") -> DataFrame:
    """Per airport: how many texts name it by code, city or airport name
    (substring), and the first such text by position (D6).

    Up to ``NAMES_AT_ONCE`` names are broadcast and every text is tested for each.
    More names are joined through a gram index: each is filed under the one
    of its runs of ``GRAM`` characters that the fewest texts hold, texts are
    joined on their distinct runs, and only those pairs are tested, so the
    cost follows the matches and not texts times names. A name shorter than
    that is its own key. The test and its result are the same either way.
    """
    names, n = materialize_counted(airports.select("code", F.explode(F.array("code", "city", "airport_name")).alias("name"))
                                   .where("name IS NOT NULL").distinct(), "airport_names")
    rows = texts.select(pos, text).where(F.col(text).isNotNull())
    found = F.contains(F.col(text), F.col("name"))
    if n <= NAMES_AT_ONCE:
        pairs = rows.join(F.broadcast(names), found)
    else:
        filed, small = checked_small(_file_names(rows, names, text))
        held = _with_grams(rows, names, text)
        pairs = held.join(F.broadcast(filed) if small else filed, "gram").where(found).select("code", pos).unionByName(
            rows.join(names.where("name = ''").select("code"), F.lit(True), "cross").select("code", pos))
    # A text with several names of an airport counts once.
    once = pairs.groupBy("code", pos).agg(F.lit(1).alias("one"))
    return once.groupBy("code").agg(F.count(F.lit(1)).alias("n_texts"), F.min(pos).alias("first_" + pos))


NAMES_AT_ONCE = 256
GRAM = 3                  # characters


def _grams(c: str, n: int) -> F.Column:
    """The distinct runs of n characters."""
    return F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _with_grams(rows: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """``rows`` once for each distinct run of theirs; runs shorter than
    ``GRAM`` only where names are that short."""
    short = [r["n"] for r in names.select(F.length("name").alias("n")).where(f"n > 0 AND n < {GRAM}").distinct().collect()]
    every = F.concat(*[_grams(text, n) for n in (*short, GRAM)])
    return rows.withColumn("__grams", every).select(*rows.columns, F.explode("__grams").alias("gram"))


def _file_names(rows: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """(code, name, gram): each name under its run that the fewest texts
    hold; names none of whose runs is in any text are left out."""
    whole = F.length("name") < GRAM
    keys = names.where("name <> ''").select("code", "name", F.explode(
        F.when(whole, F.array("name")).otherwise(_grams("name", GRAM))).alias("gram"))
    keys, small = checked_small(keys)
    wanted = keys.select("gram").distinct()
    counts = (_with_grams(rows, names, text).select("gram").join(F.broadcast(wanted) if small else wanted, "gram", "left_semi")
              .groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    runs = F.when(whole, F.lit(1)).otherwise(F.size(_grams("name", GRAM)))
    best = keys.join(counts, "gram").groupBy("code", "name").agg(F.min(F.struct("n", "gram")).alias("k"), F.count(F.lit(1)).alias("seen"))
    return best.where(F.col("seen") == runs).select("code", "name", F.col("k.gram").alias("gram"))
