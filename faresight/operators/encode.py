"""Label encoders (F1) and encoder lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.operators.joins import checked_small
from faresight.session import materialize, materialize_counted


def category_text(col) -> F.Column:
    """Category value as text; NULL becomes the text 'nan'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("nan"))


def vocabulary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct (attribute, value) over ``cols``: one scan and one
    aggregation, a grouping set per column. NULL and the text 'nan' are one
    value."""
    g = df.groupingSets([[c] for c in cols], *cols).agg(F.grouping_id().alias("__g"))
    n = len(cols)
    own = [F.when(F.col("__g") == (1 << n) - 1 - (1 << (n - 1 - i)),
                  F.struct(F.lit(c).alias("attribute"), category_text(c).alias("value")))
           for i, c in enumerate(cols)]
    return g.select(F.coalesce(*own).alias("x")).select("x.*").distinct()


def fit_label_encoders(df: DataFrame, cols: list[str], with_size: bool = False):
    """Encoder table (attribute, value, code): code = 0-based rank of the
    value among the attribute's sorted distinct texts (F1).

    Only distinct values reach the ranking; each value's rank is its
    position inside its range partition plus the sizes of all lower ranges,
    so no task holds a whole vocabulary. ``with_size`` also returns the
    table's row count, which callers pass on as a broadcast bound.
    """
    vals, n = materialize_counted(vocabulary(df, cols), "vocab")
    enc = rank_vocabulary(vals)
    return (enc, n) if with_size else enc


def rank_vocabulary(vals: DataFrame) -> DataFrame:
    """Codes for a distinct (attribute, value) table, written once: each
    encoded column reads its slice (a pushed filter)."""
    return materialize(_ranged_codes(vals), "encoders")


def _ranged_codes(vals: DataFrame) -> DataFrame:
    """Codes without a window over a whole attribute."""
    n = max(1, int(vals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Materialized once: both branches below must see the same ranges.
    ranged = materialize(vals.repartitionByRange(n, "attribute", "value")
                         .withColumn("__pid", F.spark_partition_id()), "vocab_ranges")
    local = ranged.withColumn(
        "__rn", F.row_number().over(
            Window.partitionBy("__pid", "attribute").orderBy("value")))
    sizes = ranged.groupBy("__pid", "attribute").agg(F.count(F.lit(1)).alias("__n"))
    # One row per (partition, attribute): tiny, ranked in one task.
    offsets = sizes.withColumn(
        "__off", F.coalesce(F.sum("__n").over(
            Window.partitionBy("attribute").orderBy("__pid")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offsets.drop("__n")), ["__pid", "attribute"])
            .select("attribute", "value",
                    (F.col("__off") + F.col("__rn") - 1).cast("int").alias("code")))


def apply_label_encoders(df: DataFrame, encoders: DataFrame, cols: list[str],
                         unseen_code: int = 0, suffix: str = "_encoded",
                         flag_unseen: bool = False, bound: int | None = None) -> DataFrame:
    """Add ``<col>_encoded`` by lookup; unseen values get ``unseen_code``
    (0, the same code as the first class, as the reference does) (D5).
    ``bound`` is the encoder table's known size (from the fit)."""
    encoders, small = checked_small(encoders, bound=bound)
    out = df
    for c in cols:
        e = (encoders.where(F.col("attribute") == c)
             .select(F.col("value").alias("__v"), F.col("code").alias(c + suffix)))
        e = F.broadcast(e) if small else e
        out = (out.withColumn("__v", category_text(c)).join(e, "__v", "left")
               .drop("__v"))
        if flag_unseen:
            out = out.withColumn(c + "_unseen", F.col(c + suffix).isNull())
        out = out.withColumn(c + suffix, F.coalesce(F.col(c + suffix),
                                                    F.lit(unseen_code)))
    return out
