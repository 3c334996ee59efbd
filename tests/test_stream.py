"""Stream result equals batch result for the same files."""

from pyspark.sql import functions as F

from faresight.operators.expand import history_projection
from faresight.operators.rules import route_supported
from faresight.sources.airports import AIRPORT_ROWS, airports_df
from faresight.plans import fixtures as fx
from faresight.sources.files import flatten_runs
from faresight.streaming.ingest import ingest_stream
from tests.conftest import SMOKE


def test_stream_equals_batch(spark, tmp_path):
    runs = fx.runs(spark, SMOKE)
    src, sink, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (0, 1):
        runs.where(F.col("run_id") % 2 == part).write.mode("append").json(src)
        ingest_stream(spark, src, sink, ck, keep=("run_id", "route_supported"))
    streamed = spark.read.parquet(sink)
    batch = route_supported(history_projection(flatten_runs(runs), None, batch_ts="x"),
                            airports_df(spark), airport_bound=AIRPORT_ROWS)
    cols = ["run_id", "flight_number", "flight_date", "departure_time", "classes",
            "route_supported"]
    def key(t):
        return tuple("" if x is None else str(x) for x in t)

    a = sorted((tuple(r) for r in streamed.select(*cols).collect()), key=key)
    b = sorted((tuple(r) for r in batch.select(*cols).collect()), key=key)
    assert a == b and len(a) > 0


def test_stream_watermark_dedupe(spark, tmp_path):
    runs = fx.runs(spark, SMOKE).where(F.col("run_id") < 4)
    src, sink, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    runs.write.mode("append").json(src)
    runs.write.mode("append").json(src)          # the same batch arrives twice
    ingest_stream(spark, src, sink, ck, dedupe_watermark="1 day")
    out = spark.read.parquet(sink)
    keys = ["flight_number", "departure_airport", "arrival_airport", "flight_date",
            "departure_time", "classes", "price"]
    assert out.count() == out.dropDuplicates(keys).count() > 0


def test_stream_keeps_every_line(spark, tmp_path):
    import json

    from faresight.sources.files import scan_crawl_runs

    def run(i):
        return {"run_id": i, "daily_results": [{"search_date": "01/08/2025", "prices": [
            {"flight_number": f"VJ{i}", "total_price": "10"}]}]}

    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    cut = json.dumps(run(3))[:40]
    (tmp_path / "in" / "cut.json").write_text("\n".join([json.dumps(run(1)), json.dumps(run(2)), cut]))
    (tmp_path / "in" / "arrays.json").write_text("\n".join(json.dumps([run(i), run(i + 1)]) for i in (4, 6)))
    (tmp_path / "in" / "pretty.json").write_text(json.dumps([run(8), run(9)], indent=2))
    ingest_stream(spark, src, sink, ck, keep=("run_id",))
    batch = scan_crawl_runs(spark, src)
    want = sorted(r.run_id for r in batch.where("_corrupt_record IS NULL").collect())
    assert sorted(r.run_id for r in spark.read.parquet(sink).collect()) == want == [1, 2, 4, 5, 6, 7, 8, 9]
    assert [r[0] for r in spark.read.parquet(sink + "_corrupt").collect()] == [cut]
    assert [r[0] for r in batch.where("_corrupt_record IS NOT NULL").select("_corrupt_record", "run_id").collect()] == [cut]


def test_a_batch_that_fails_half_way_adds_nothing_twice(spark, tmp_path, monkeypatch):
    """A failure between the two writes, and one between two moves."""
    import json

    import pytest
    from pyspark.errors import StreamingQueryException

    from faresight.streaming import ingest

    def run(i):
        return json.dumps({"run_id": i, "daily_results": [{"search_date": f"0{i}/08/2025", "prices": [
            {"flight_number": f"VJ{i}", "total_price": "10"}]}]})

    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join([run(2 * k + 1), run(2 * k + 2), "{cut"]))
    real, calls = ingest.append_once, []

    def failing(rows, staged, folder, partition_by=None):
        calls.append(staged)
        if len(calls) == 2:
            raise OSError("between the writes")
        if len(calls) == 5:                            # written and marked, but only some files moved
            real(rows, staged, folder, partition_by)
            raise OSError("after the moves")
        real(rows, staged, folder, partition_by)

    monkeypatch.setattr(ingest, "append_once", failing)
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            ingest_stream(spark, src, sink, ck, keep=("run_id",), max_files_per_trigger=1)
    q = ingest_stream(spark, src, sink, ck, keep=("run_id",), max_files_per_trigger=1)
    assert not q.isActive and len([p for p in q.recentProgress if p["numInputRows"]]) >= 1
    assert sorted(r.run_id for r in spark.read.parquet(sink).collect()) == [1, 2, 3, 4, 5, 6]
    assert [r[0] for r in spark.read.parquet(sink + "_corrupt").collect()] == ["{cut"] * 3
    ingest_stream(spark, src, sink, ck, keep=("run_id",))          # nothing new
    assert spark.read.parquet(sink).count() == 6


def test_a_text_is_parsed_once(spark, tmp_path):
    """A line is a row before it is parsed, and its runs are parsed once."""
    from faresight.streaming.ingest import stream_runs

    (tmp_path / "runs.json").write_text('{"run_id": 1}\n{"run_id": 2}\n')
    asked = stream_runs(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert asked.count("from_json(") == 1

    from faresight.sources.files import runs_of_texts
    runs = runs_of_texts(spark.read.text(str(tmp_path), wholetext=True))
    assert runs._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert sorted(r.run_id for r in runs.collect()) == [1, 2]


def test_odd_texts_lose_no_line(spark, tmp_path):
    """Blank lines, empty arrays and what goes on after a pretty-printed value."""
    texts = ['{"run_id": 1}\r\n \t\n\u00a0[]\r{"run_id": 2}\n[]\n[{"run_id": 3}, {"run_id": 4}]\nnull\n7',
             '[\n]', '[\n {"run_id": 5}\n] x', '\n\n[ {\n"run_id": 6},\n{"run_id": 7}]\n', ' {\n"run_id": 8\n}', "", '{\n"run_id"']
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_bytes(t.encode())
    src, sink, ck = str(tmp_path), str(tmp_path / "_out"), str(tmp_path / "_ck")
    from faresight.streaming.ingest import stream_runs
    q = stream_runs(spark, src).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    got = spark.read.parquet(sink).collect()
    assert sorted(r.run_id for r in got if r._corrupt_record is None) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert sorted(r._corrupt_record for r in got if r._corrupt_record is not None) == sorted(["null", "7", texts[2], texts[6]])
