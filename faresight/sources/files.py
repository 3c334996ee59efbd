"""File scans and sinks: fare history CSV in both layouts, airports CSV,
search-request and crawl-run JSON, history append, reports, model store
side tables (A1-A9, A11)."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faresight.functions.text import strip
from faresight.functions.timeparts import utc_now_iso
from faresight.schema import (AIRPORT_SCHEMA, FARE_COLUMNS,
                              FARE_RAW_SCHEMA, RUN_FILE_SCHEMA, SEARCH_REQUEST, WRITER10_COLUMNS,
                              WRITER10_SCHEMA, WRITER13_COLUMNS, WRITER13_SCHEMA,
                              WRITER_RENAMES)
from faresight.session import materialize

__all__ = [
    "scan_fare_history", "coerce_fare_types", "scan_fare_layouts",
    "reconcile_layouts", "scan_airports", "scan_search_requests",
    "scan_crawl_runs", "runs_of_texts", "corrupt_records", "flatten_runs", "append_fare_history",
    "append_crawl_runs", "write_report", "read_report",
]


def scan_fare_history(spark: SparkSession, path: str) -> DataFrame:
    """The analysis read: ten fixed names by position, the file's own
    header skipped (A1). Types are coerced per row afterwards."""
    return (spark.read.schema(FARE_RAW_SCHEMA).option("header", True)
            .option("enforceSchema", True).option("mode", "PERMISSIVE")
            .csv(path))


def coerce_fare_types(df: DataFrame) -> DataFrame:
    """Price text -> decimal(18,2); unparsable prices become NULL."""
    return df.withColumn("price", F.col("price").try_cast("decimal(18,2)"))


def scan_fare_layouts(spark: SparkSession, path13: str | None = None,
                      path10: str | None = None) -> DataFrame:
    """Read 13-column and 10-column history files, each under its own
    header, and reunite them under the analysis names (A2)."""
    parts = []
    if path13:
        parts.append(spark.read.schema(WRITER13_SCHEMA).option("header", True)
                     .option("enforceSchema", True).csv(path13))
    if path10:
        parts.append(spark.read.schema(WRITER10_SCHEMA).option("header", True)
                     .option("enforceSchema", True).csv(path10))
    return reconcile_layouts(*parts)


def reconcile_layouts(*frames: DataFrame) -> DataFrame:
    """Rename writer columns to analysis names and union by name;
    passenger counts missing in the 10-column layout stay NULL (A2)."""
    renamed = [f.withColumnsRenamed({k: v for k, v in WRITER_RENAMES.items()
                                     if k in f.columns}) for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
    for c in ("adult", "child", "infant"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("int"))
    return out


def scan_airports(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV; every value trimmed, a missing value is '' (A3)."""
    df = spark.read.option("header", True).schema(AIRPORT_SCHEMA).csv(path)
    return df.select(*[F.coalesce(strip(c), F.lit("")).alias(c)
                       for c in df.columns])


def scan_search_requests(spark: SparkSession, path: str,
                         keep_raw: bool = True, wholetext: bool = True) -> DataFrame:
    """Nested JSON search requests (A4). The raw text is kept beside the
    parsed struct so absent and explicit-null fields stay apart. A file is
    one request, or with ``wholetext=False`` each of its lines."""
    raw = spark.read.text(path, wholetext=wholetext)
    parsed = raw.select(F.col("value").alias("raw"),
                        F.from_json("value", SEARCH_REQUEST).alias("r"))
    cols = [F.col("r.*")] + ([F.col("raw")] if keep_raw else [])
    return parsed.select(*cols)


RUNS_WITH_CORRUPT = T.StructType(RUN_FILE_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])


#: A line that opens an array or an object and does not close it starts a
#: pretty-printed file.
OPENS = r"^\s*\[\s*(\{[^}]*)?$|^\s*\{\s*$"
#: The same of a whole text: any of its lines does.
_PRETTY = r"(?:\A|[\r\n])[^\S\r\n]*+(?:\[[^\S\r\n]*+(?:\{[^}\r\n]*+)?|\{[^\S\r\n]*+)[\x85\u2028\u2029]?(?:[\r\n]|\z)"


#: A JSON string; it never spans lines, so the depth of each line is its own.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Where a value ends and the next one begins, outside strings.
_NEXT = r"(?<=[}\]])(?=\s*,?\s*[{\[])"


def _segments(line) -> F.Column:
    """A line cut after each value that another follows, the last piece with
    its line end; most lines are one segment."""
    cut = F.split(F.regexp_replace(line, f"({_STRING})|{_NEXT}", "$1\n"), "\n")
    parts = F.when(line.rlike(r"[}\]]\s*,?\s*[{\[]"), cut).otherwise(F.array(line))
    return F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(F.element_at(parts, -1), F.lit("\n"))))


def _depth(text) -> F.Column:
    """Opening less closing braces and brackets outside strings."""
    bare = F.regexp_replace(text, _STRING, "")
    return F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))


def _pretty_pieces(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(value): the texts of the records of pretty-printed files, whose lines
    are read by byte ranges (blocks). A range's lines get their depth from
    the sums of the ranges before it; the records that begin in a range are
    put together there, and only the text before a range's first record and
    its last record meet those of the next ranges.

    lines: file, block, at (increasing in a block), value; blocks: file,
    block, before (depth where it begins), level (depth of the records)."""
    block = Window.partitionBy("file", "block")
    along = block.orderBy("at", "part")
    rows = lines.select("file", "block", "at", F.posexplode(_segments(F.col("value"))).alias("part", "text"))
    rows = rows.withColumn("d", _depth(F.col("text"))).join(blocks, ["file", "block"])
    rows = rows.withColumn("after", F.col("before") + F.sum("d").over(along))
    start = F.when(F.col("after") - F.col("d") <= F.col("level"), F.struct("at", "part"))
    rows = (rows.withColumn("start", start)
            .withColumns({"first": F.last("start", ignorenulls=True).over(along), "last": F.max("start").over(block)}))
    # a record's own lines; the two aggregates need no further shuffle
    pieces = rows.groupBy("file", "block", "first").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part", "text"))), lambda x: x["text"]), "").alias("text"),
        F.min(F.struct("at", "part", (F.col("after") - F.col("d")).alias("depth")))["depth"].alias("opens"),
        F.max(F.struct("at", "part", "after"))["after"].alias("closes"),
        F.first("level").alias("level"), F.first("last").alias("last"))
    inner = F.col("first").isNotNull() & (F.col("first") != F.col("last"))
    files = Window.partitionBy("file").orderBy("block", F.col("first").asc_nulls_first())
    # at most two pieces of each range: those that may go on
    edges = (pieces.where(~F.coalesce(inner, F.lit(False)))
             .withColumn("record", F.sum(F.col("first").isNotNull().cast("long")).over(files))
             .groupBy("file", "record").agg(
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", F.col("first").isNotNull(), "text"))),
                                          lambda x: x["text"]), "").alias("text"),
                 F.min(F.struct("block", F.col("first").isNotNull(), "opens"))["opens"].alias("opens"),
                 F.max(F.struct("block", F.col("first").isNotNull(), "closes"))["closes"].alias("closes"),
                 F.first("level").alias("level")))
    both = pieces.where(inner).select("text", "opens", "closes", "level").unionByName(
        edges.select("text", "opens", "closes", "level"))
    array, text = F.col("level") == 1, strip("text")
    text = F.when(array & (F.col("opens") <= 0), F.regexp_replace(text, r"^\[\s*", "")).otherwise(text)
    text = F.when(array, F.regexp_replace(text, r"^,\s*|\s*,$", "")).otherwise(text)
    text = F.when(array & (F.col("closes") <= 0), F.regexp_replace(text, r"\s*\]$", "")).otherwise(text)
    return both.select(text.alias("value")).where("value <> ''")


def scan_crawl_runs(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """Run summaries with their days and price options (A5), from files of
    JSON lines (as ``append_crawl_runs`` writes them; a line may also hold a
    whole array) and pretty-printed files of an array or an object.

    ``layout``: "lines" or "array" for folders of one kind; "auto" looks at
    the lines first and reads each file in its own way, lines split between
    tasks and a pretty-printed file by one; "ranges" also splits
    pretty-printed files (see ``_by_ranges``), for those too large for a task.
    Text that does not parse lands in ``_corrupt_record``; it is kept and
    reported, never silently replaced.
    """
    def read(files, multi):
        return (spark.read.schema(RUNS_WITH_CORRUPT).option("multiLine", multi).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(files))

    if layout in ("lines", "array"):
        return read(path, layout == "array")
    if layout == "ranges":
        return _by_ranges(spark, path)
    if layout != "auto":
        raise ValueError("layout must be 'auto', 'lines', 'array' or 'ranges'")
    opens = F.col("value").rlike(OPENS)        # only file names come back
    names = (spark.read.text(path).select("_metadata.file_path", opens.alias("o")).groupBy("file_path")
             .agg(F.max("o").alias("o")).collect())
    kinds = {k: [unquote(r["file_path"]) for r in names if bool(r["o"]) == k] for k in (False, True)}
    parts = [read(files, multi) for multi, files in kinds.items() if files]
    if not parts:
        return spark.createDataFrame([], RUNS_WITH_CORRUPT)
    return reduce(DataFrame.unionByName, parts)


def _by_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Runs of files of any size, all split between tasks by byte ranges: one
    pass sums each range's braces and finds the kind of each file, a small
    table (a row a range) that stays on the executors; the records of a
    pretty-printed file are then put together from its lines. A row for each
    line is shuffled and sorted, so this costs many times a plain read.

    A file may hold several values in turn. Text that does not parse is
    corrupt a line or a record at a time; braces that do not match make the
    rest of their file corrupt, as one text or many. A compressed file, one
    on one long line and a record are each one task's. An empty folder gives
    no row."""
    lines = (spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value").where(strip("value") != ""))
    pretty = F.max(F.col("value").rlike(OPENS))
    sums = lines.groupBy("file", "block").agg(
        pretty.alias("pretty"), F.sum(_depth(F.col("value"))).alias("d"),
        F.min(F.struct("at", F.substring(strip("value"), 1, 1).alias("c")))["c"].alias("c"))
    before, whole = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file")
    blocks = materialize(sums.select(
        "file", "block", F.max("pretty").over(whole).alias("pretty"),
        (F.sum("d").over(before) - F.col("d")).alias("before"),
        F.when(F.first("c").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "[", 1)
        .otherwise(0).alias("level")), "run_blocks")
    plain = lines.join(blocks.where("NOT pretty").select("file", "block"), ["file", "block"], "left_semi").select("value")
    records = _pretty_pieces(lines, blocks.where("pretty").drop("pretty"))
    return plain.unionByName(records).select(F.inline(_parse_runs(F.col("value"))))


def _json_runs(piece) -> F.Column:
    return F.from_json(piece, T.ArrayType(RUN_FILE_SCHEMA), {"mode": "PERMISSIVE"})


def _parse_runs(piece, got=None) -> F.Column:
    """The runs of a JSON text as an array; one that does not parse is an
    element with ``_corrupt_record``. ``got`` is read many times: a column
    that holds ``_json_runs`` already spares as many parses."""
    got = _json_runs(piece) if got is None else got
    bad = F.array(_corrupt_run(piece))
    good = F.transform(got, lambda r: F.struct(*[r[f.name].alias(f.name) for f in RUN_FILE_SCHEMA],
                                               F.lit(None).cast("string").alias("_corrupt_record")))
    empty = got.isNull() | F.forall(got, lambda r: r.isNull())
    return F.when(empty & ~strip(piece).rlike(r"^\[\s*\]$"), bad).otherwise(good)


def _corrupt_run(text) -> F.Column:
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in RUN_FILE_SCHEMA], text.alias("_corrupt_record"))


def runs_of_texts(texts: DataFrame) -> DataFrame:
    """Runs in the whole texts of files (``value``), by the layout that
    ``scan_crawl_runs`` finds: with a line that opens a value and does not
    close it the text is one array or object, else each line is parsed on its
    own. What does not parse is a row with ``_corrupt_record``; so is a
    pretty-printed text that goes on after its value.

    Row for row, so it serves streams too. A line is a row before it is
    parsed, once: no task holds the runs of all lines of a file."""
    value, pretty, piece, got = (F.col(c) for c in ("value", "pretty", "piece", "got"))
    cut = F.when(pretty, F.array(value)).otherwise(F.split(value, r"[\r\n]+"))
    pieces = (texts.select(value, value.rlike(_PRETTY).alias("pretty")).select(pretty, F.explode_outer(cut).alias("piece"))
              .where(piece.rlike(r"(?U)\S")))
    parsed = pieces.select(pretty, piece, _json_runs(piece).alias("got")).select(pretty, piece, _parse_runs(piece, got).alias("runs"))
    runs = F.col("runs")
    # in brackets, text after the first value is an error and is not passed over
    more = (pretty & ~F.exists(runs, lambda r: r["_corrupt_record"].isNotNull())
            & F.try_parse_json(F.concat(F.lit("["), piece, F.lit("]"))).isNull())
    runs = F.when(more, F.concat(runs, F.array(_corrupt_run(piece)))).otherwise(runs)
    # an outer generator, of which Spark infers no filter that would build the arrays twice
    return parsed.select(F.explode_outer(runs).alias("r")).where("r IS NOT NULL").select("r.*")


def corrupt_records(runs: DataFrame) -> DataFrame:
    """Unparsable run texts, for reporting. A parsed column is read along
    with the corrupt-record column, which Spark requires of raw JSON."""
    # A corrupt row has every parsed field NULL; testing one of them keeps
    # a parsed column in the scan, which Spark requires of raw JSON.
    return (runs.where(F.col("_corrupt_record").isNotNull()
                       & F.col("total_days_crawled").isNull())
            .select("_corrupt_record"))


def flatten_runs(runs: DataFrame, keep=("run_id",)) -> DataFrame:
    """All days' price options when ``daily_results`` is non-empty, else
    the top-level ``prices``, else nothing (A11)."""
    days = F.coalesce(F.col("daily_results"), F.array())
    from_days = F.flatten(F.transform(
        days, lambda d: F.transform(
            F.coalesce(d["prices"], F.array()),
            lambda p: F.struct(p.alias("p"), d["search_date"].alias("search_date")))))
    top = (F.transform(F.col("prices"),
                       lambda p: F.struct(p.alias("p"),
                                          F.lit(None).cast("string").alias("search_date")))
           if "prices" in runs.columns else F.lit(None))
    chosen = F.when(F.size(days) > 0, from_days).otherwise(top)
    keep = [k for k in keep if k in runs.columns]
    return (runs.select(*keep, F.explode(chosen).alias("x"))
            .select(*keep, "x.search_date", "x.p.*"))


def append_fare_history(df: DataFrame, path: str, batch_ts=None,
                        partition_by: str | None = "flight_day",
                        fmt: str = "parquet") -> None:
    """Append history rows (A6): one ``created_at`` stamp per batch, a
    row's own ``created_at`` wins, the folder is created when missing.
    Parquet (default) is partitioned by the flight day so reads prune by
    date; ``fmt='csv'`` writes the 13-column layout with a header in each
    new file set, readable by ``scan_fare_layouts``."""
    stamp = F.lit(batch_ts) if batch_ts is not None else utc_now_iso()
    cols = [c for c in WRITER13_COLUMNS if c in df.columns or c == "created_at"]
    own = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("string")
    out = df.withColumn("created_at", F.coalesce(own, stamp)).select(
        *cols, *([F.substring(F.col("flight_date").cast("string"), 1, 10)
                  .alias(partition_by)] if partition_by else []))
    if partition_by:
        # One task a day and not a file for each task and day; AQE splits a
        # day that is too large for one task.
        out = out.hint("rebalance", F.col(partition_by))
    w = out.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")


def append_crawl_runs(runs: DataFrame, path: str) -> None:
    """Append run summaries as new JSON files; nothing is rewritten."""
    runs.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """Write any result as JSON lines, replacing the folder."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# Writer layouts are also exported for tests.
LAYOUTS = {"13": WRITER13_COLUMNS, "10": WRITER10_COLUMNS, "analysis": FARE_COLUMNS}
