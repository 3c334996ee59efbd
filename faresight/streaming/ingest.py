"""New crawl batches keep arriving as JSON files; each micro-batch is
flattened and projected into history rows and appended (A10).

The same DataFrame functions as the batch path are used, so stream output
equals batch output for the same files, in the same layout as
``append_fare_history`` writes: batch and stream history share a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faresight.operators.expand import history_projection
from faresight.operators.rules import route_supported
from faresight.schema import WRITER13_COLUMNS
from faresight.sources.airports import AIRPORT_ROWS, airports_df
from faresight.sources.files import flatten_runs, runs_of_texts


def stream_runs(spark: SparkSession, source_dir: str,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming run rows from files of JSON lines and of arrays alike, with
    ``_corrupt_record`` for what does not parse. A file is read whole: one
    arriving batch, not the history."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return runs_of_texts(r.text(source_dir, wholetext=True))


def stream_history_rows(spark: SparkSession, source_dir: str,
                        max_files_per_trigger: int | None = None,
                        check_routes: bool = True, requests: DataFrame | None = None,
                        batch_ts: str | None = None, corrupt: bool = False) -> DataFrame:
    """Streaming history rows from run files in ``source_dir``; passengers
    come from ``requests`` by a stream-static join.

    Each row also carries ``run_id`` and, with ``check_routes``,
    ``route_supported`` (C7): a stream-static join with the fixed airport
    list, broadcast, so the stream is not shuffled. With ``corrupt``, texts
    that do not parse are rows too, empty but for ``_corrupt_record``.
    """
    runs = stream_runs(spark, source_dir, max_files_per_trigger)
    lost = F.col("_corrupt_record").isNotNull()
    if corrupt:
        nothing = F.array(F.lit(None).cast(runs.schema["prices"].dataType.elementType))
        runs = runs.withColumn("prices", F.when(lost, nothing).otherwise(F.col("prices")))
    else:
        runs = runs.where(~lost)
    more = ("_corrupt_record",) if corrupt else ()
    rows = history_projection(flatten_runs(runs, keep=("run_id", *more)), requests, batch_ts=batch_ts, keep=more)
    if check_routes:
        rows = route_supported(rows, airports_df(spark), airport_bound=AIRPORT_ROWS)
    return rows


def append_once(rows: DataFrame, staged: str, folder: str, partition_by: str | None = None) -> None:
    """Append ``rows`` to ``folder`` such that a repeated call with the same
    ``staged`` adds nothing again: they are written to ``staged`` first and
    marked there, and only marked files are moved, each once. Both folders
    must be in one file system."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = path(staged, "_WRITTEN")
    if not fs.exists(mark):
        w = rows.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(staged)
        fs.create(mark).close()
    root, files = fs.makeQualified(path(staged)).toString(), fs.listFiles(path(staged), True)
    moves = []
    while files.hasNext():                            # names of one batch's files
        own = files.next().getPath()
        if not own.getName().startswith(("_", ".")):
            moves.append((own, path(folder, own.toString()[len(root):].lstrip("/"))))
    for parent in {to.getParent().toString() for _, to in moves}:
        fs.mkdirs(path(parent))
    for own, to in moves:
        if not fs.rename(own, to):
            raise OSError(f"cannot move {own} to {to}")


def ingest_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                  checkpoint_dir: str, dedupe_watermark: str | None = None,
                  available_now: bool = True, requests: DataFrame | None = None,
                  batch_ts: str | None = None, keep=(), corrupt_dir: str | None = None,
                  max_files_per_trigger: int | None = None):
    """Run the ingest: append history rows as parquet in the history's
    layout, partitioned by flight day (``keep``: further columns, such as
    ``run_id`` or ``route_supported``), and texts that do not parse to
    ``corrupt_dir`` (``<sink_dir>_corrupt`` by default). ``available_now``
    processes everything present and stops (scheduled runs); otherwise the
    query keeps running.

    One query reads each file once and writes both; a batch that is tried
    again after a failure, also one between the two writes, adds nothing
    twice (``append_once``, keyed by the batch's number below the checkpoint).
    With ``dedupe_watermark`` (e.g. '1 day'), repeated rows (and repeated
    corrupt texts) within the watermark are dropped; the reference itself
    never dedupes on write, so it is off by default."""
    rows = stream_history_rows(spark, source_dir, max_files_per_trigger, check_routes="route_supported" in keep,
                               requests=requests, batch_ts=batch_ts, corrupt=True)
    if dedupe_watermark:
        rows = (rows.withColumn("__ts", F.col("created_at").try_cast("timestamp"))
                .withWatermark("__ts", dedupe_watermark)
                .dropDuplicatesWithinWatermark(
                    ["flight_number", "departure_airport", "arrival_airport",
                     "flight_date", "departure_time", "classes", "price", "_corrupt_record"])
                .drop("__ts"))
    rows = rows.select(*[c for c in WRITER13_COLUMNS if c in rows.columns], *keep, "_corrupt_record",
                       F.substring("flight_date", 1, 10).alias("flight_day"))
    staging = checkpoint_dir.rstrip("/") + "/batches"
    corrupt_dir = corrupt_dir or sink_dir.rstrip("/") + "_corrupt"

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()                       # parsed once for both
        try:
            # one task a day, as in append_fare_history: few files to write and move
            good = batch.where("_corrupt_record IS NULL").drop("_corrupt_record").hint("rebalance", F.col("flight_day"))
            append_once(good, f"{staging}/{number}/history", sink_dir, "flight_day")
            append_once(batch.where("_corrupt_record IS NOT NULL").select("_corrupt_record"),
                        f"{staging}/{number}/corrupt", corrupt_dir)
        finally:
            batch.unpersist()
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{staging}/{number - 1}")      # committed before this one
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    w = rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint_dir)
    q = w.trigger(**({"availableNow": True} if available_now else {"processingTime": "1 minute"})).start()
    if available_now:
        q.awaitTermination()
    return q
