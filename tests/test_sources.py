"""File sources and sinks in a private temporary folder."""

import json
import os

from pyspark.sql import functions as F

from faresight.sources import files as fl

H13 = "created_at,flight_number,aircraft_type,departure_airport,arrival_airport,flight_date," \
      "departure_time,arrival_time,classes,price,adult,child,infant"
H10 = ",".join(H13.split(",")[:10])
R13 = "2025-07-11T18:04:07.428Z,VJ1170,Airbus A321,SGN,HAN,2025-07-05T17:00:00.000Z," \
      "23:35,01:45,Eco,1500000,2,2,1"
R10 = "2025-07-11T18:04:07.428Z,VJ198,,SGN,DAD,2025-07-06T00:00:00.000Z,08:00,09:20,Deluxe,900000"


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_fare_layouts_reunited(spark, tmp_path):
    p13, p10 = str(tmp_path / "a13.csv"), str(tmp_path / "a10.csv")
    _write(p13, [H13, R13])
    _write(p10, [H10, R10])
    df = fl.scan_fare_layouts(spark, p13, p10)
    got = {r.flight_number: r for r in df.collect()}
    assert got["VJ1170"].create_at.startswith("2025-07-11") and got["VJ1170"].adult == 2
    assert got["VJ198"].adult is None and got["VJ198"].type_of_plane is None
    assert "type_of_plane" in df.columns and "create_at" in df.columns


def test_positional_scan(spark, tmp_path):
    p = str(tmp_path / "h.csv")
    _write(p, ["whatever,header,names,a,b,c,d,e,f,g", R10])
    df = fl.coerce_fare_types(fl.scan_fare_history(spark, p))
    r = df.first()
    assert r.create_at.startswith("2025") and r.type_of_plane is None and float(r.price) == 900000


def test_airports_csv_trimmed(spark, tmp_path):
    p = str(tmp_path / "airports.csv")
    _write(p, ["code,city,airport_name,country", " SGN , Tp. Hồ Chí Minh ,Tân Sơn Nhất,Việt Nam",
               "HAN,Hà Nội,,Việt Nam"])
    rows = fl.scan_airports(spark, p).collect()
    assert rows[0].code == "SGN" and rows[0].city == "Tp. Hồ Chí Minh"
    assert rows[1].airport_name == ""


def test_request_json(spark, tmp_path):
    p = str(tmp_path / "req.json")
    with open(p, "w") as f:
        json.dump({"departure_airport": "SGN", "arrival_airport": "HAN",
                   "search_options": {"trip_type": "oneway", "find_cheapest": False,
                                      "departure_date": "28/07/2025"},
                   "adult": 2, "child": 2, "infant": 1,
                   "updated_at": "2025-07-11T18:04:07.428Z"}, f, indent=2)
    r = fl.scan_search_requests(spark, p).first()
    assert r.search_options.departure_date == "28/07/2025" and r.adult == "2"
    assert r.search_options.find_cheapest is False and '"infant": 1' in r.raw


def test_runs_json_and_flatten(spark, tmp_path):
    run = {"total_days_crawled": 2, "total_price_options": 2, "total_unique_flights": 1,
           "daily_results": [
               {"search_date": "01/08/2025", "prices": [{"flight_number": "VJ1", "total_price": "10"}],
                "errors": []},
               {"search_date": "02/08/2025", "prices": [{"flight_number": "VJ1", "total_price": "11"}],
                "errors": ["Failed to click price option 3."]}]}
    flat_only = {"prices": [{"flight_number": "VJ9", "total_price": "5"}]}
    d = tmp_path / "runs"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([run, flat_only]))
    (d / "b.json").write_text("{not json")
    df = fl.scan_crawl_runs(spark, str(d))
    assert fl.corrupt_records(df).count() == 1
    flat = fl.flatten_runs(df.where(F.col("_corrupt_record").isNull()), keep=())
    assert sorted((r.flight_number, r.total_price) for r in flat.collect()) == [
        ("VJ1", "10"), ("VJ1", "11"), ("VJ9", "5")]


def test_append_history_twice(spark, tmp_path):
    p = str(tmp_path / "hist")
    df = spark.createDataFrame(
        [(None, "VJ1", "A321", "SGN", "HAN", "2025-07-05T00:00:00.000Z", "08:00", "10:00",
          "Eco", "100", "1", "0", "0")],
        "created_at string, flight_number string, aircraft_type string, departure_airport string,"
        " arrival_airport string, flight_date string, departure_time string, arrival_time string,"
        " classes string, price string, adult string, child string, infant string")
    fl.append_fare_history(df, p, batch_ts="2025-07-11T00:00:00.000Z")
    fl.append_fare_history(df.withColumn("created_at", F.lit("own")), p, batch_ts="x")
    back = spark.read.parquet(p)
    assert sorted(r.created_at for r in back.collect()) == ["2025-07-11T00:00:00.000Z", "own"]
    assert "flight_day" in back.columns


def test_report_round_trip(spark, tmp_path):
    p = str(tmp_path / "rep")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    fl.write_report(df, p)
    fl.write_report(df, p)
    assert [tuple(r) for r in fl.read_report(spark, p, "k long, v string").collect()] == [(1, "a")]


def test_appended_runs_are_read_back(spark, tmp_path):
    from faresight.plans import fixtures as fx
    from tests.conftest import SMOKE
    runs, folder = fx.runs(spark, SMOKE), str(tmp_path / "runs")
    fl.append_crawl_runs(runs, folder)
    fl.append_crawl_runs(runs, folder)
    (tmp_path / "runs" / "pretty.json").write_text(json.dumps([{"run_id": 7, "prices": []}], indent=2))
    (tmp_path / "runs" / "bad.json").write_text("{not json\n")
    back = fl.scan_crawl_runs(spark, folder).cache()
    assert fl.corrupt_records(back).count() == 1
    assert back.where("run_id IS NOT NULL").count() == 2 * runs.count() + 1
    assert fl.flatten_runs(back).count() == 2 * fl.flatten_runs(runs).count()
    assert fl.scan_crawl_runs(spark, folder, layout="lines").where("daily_results IS NOT NULL").count() == 2 * runs.count()


def test_history_is_one_file_a_day(spark, tmp_path):
    from faresight.plans import fixtures as fx
    from faresight.operators.expand import history_projection
    from tests.conftest import SMOKE
    rows = history_projection(fx.run_rows(spark, SMOKE).repartition(8), None, batch_ts="x")
    fl.append_fare_history(rows, str(tmp_path / "h"), batch_ts="x")
    days = [d for d in os.listdir(tmp_path / "h") if d.startswith("flight_day=")]
    files = sum(len([f for f in os.listdir(tmp_path / "h" / d) if f.endswith(".parquet")]) for d in days)
    assert len(days) <= files <= 1.2 * len(days) + 2


def test_append_history_csv_reads_back_as_layout(spark, tmp_path):
    p = str(tmp_path / "hist_csv")
    df = spark.createDataFrame(
        [(None, "VJ1", "A321", "SGN", "HAN", "2025-07-05T00:00:00.000Z", "08:00", "10:00",
          "Eco", "100", "2", "1", "0")],
        "created_at string, flight_number string, aircraft_type string, departure_airport string,"
        " arrival_airport string, flight_date string, departure_time string, arrival_time string,"
        " classes string, price string, adult string, child string, infant string")
    fl.append_fare_history(df, p, batch_ts="2025-07-11T00:00:00.000Z", partition_by=None,
                           fmt="csv")
    back = fl.scan_fare_layouts(spark, path13=p).first()
    assert (back.create_at, back.type_of_plane, back.adult) == (
        "2025-07-11T00:00:00.000Z", "A321", 2)


def test_history_date_filter_prunes_partitions(spark, tmp_path):
    import contextlib
    import io
    p = str(tmp_path / "hist_pruned")
    rows = [(None, f"VJ{i}", "A321", "SGN", "HAN", f"2025-07-0{1 + i % 3}T00:00:00.000Z",
             "08:00", "10:00", "Eco", "100", "1", "0", "0") for i in range(9)]
    df = spark.createDataFrame(
        rows, "created_at string, flight_number string, aircraft_type string,"
        " departure_airport string, arrival_airport string, flight_date string,"
        " departure_time string, arrival_time string, classes string, price string,"
        " adult string, child string, infant string")
    fl.append_fare_history(df, p, batch_ts="2025-07-11T00:00:00.000Z")
    q = spark.read.parquet(p).where(F.col("flight_day") == "2025-07-02").select("flight_number")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        q.explain()
    assert "PartitionFilters: [isnotnull(flight_day" in buf.getvalue()
    assert q.count() == 3


HARD = ['plain', '}, {', 'a "quoted" ] end', '[{', 'back\\slash "}', '', 'Tân Sơn Nhất {']


def _runs(n):
    return [{"run_id": i, "total_days_crawled": i % 3, "prices": [
        {"flight_number": f"VJ{i}-{j} {HARD[(i + j) % len(HARD)]}", "total_price": str(j)} for j in range(i % 4)]} for i in range(n)]


def _seen(df):
    return sorted((r.run_id, r.total_days_crawled, tuple((p.flight_number, p.total_price) for p in r.prices)) for r in df.collect())


def _as_seen(runs):
    return sorted((r["run_id"], r["total_days_crawled"], tuple((p["flight_number"], p["total_price"]) for p in r["prices"])) for r in runs)


def test_one_pretty_array_is_read_by_many_tasks(spark, tmp_path):
    runs = _runs(2000)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "indented.json").write_text(json.dumps(runs, indent=2))
    values = ",\n".join(json.dumps(r) for r in runs)          # a record a line, in one array
    (tmp_path / "b" / "rows.json").write_text("[\n" + values + "\n]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        for folder in ("a", "b"):
            assert spark.read.text(str(tmp_path / folder)).rdd.getNumPartitions() > 20
            got = fl.scan_crawl_runs(spark, str(tmp_path / folder), layout="ranges")
            assert _seen(got) == _as_seen(runs)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ranges_smaller_than_a_record(spark, tmp_path):
    runs = _runs(60)
    for name, text in {"py": json.dumps(runs, indent=4), "tight": json.dumps(runs, indent=1, separators=(",", ":")),
                       "java": json.dumps(runs, indent=2).replace("[\n  {", "[ {").replace("},\n  {", "}, {").replace("}\n]", "} ]"),
                       "turn": "\n".join(json.dumps(r, indent=2) for r in runs)}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        try:
            assert _seen(fl.scan_crawl_runs(spark, str(tmp_path / name), layout="ranges")) == _as_seen(runs), name
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_kinds_of_files_and_broken_ones(spark, tmp_path):
    runs = _runs(9)
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "lines.json").write_text("\n".join(json.dumps(r) for r in runs[:3]) + "\n\n{broken\n")
    (d / "line.json").write_text(json.dumps(runs[3:5]))
    (d / "object.json").write_text(json.dumps(runs[5], indent=2))
    (d / "empty.json").write_text("")
    (d / "none.json").write_text("[\n]\n")
    cut = json.dumps(runs[6:], indent=2)
    (d / "cut.json").write_text(cut[:cut.rindex('"prices"')])          # ends within its last record
    got = fl.scan_crawl_runs(spark, str(d), layout="ranges").cache()
    assert _seen(got.where("run_id IS NOT NULL")) == _as_seen(runs[:8])
    bad = sorted(r[0].strip() for r in fl.corrupt_records(got).collect())
    assert len(bad) == 2 and "{broken" in bad and any('"run_id": 8' in b for b in bad)
    (tmp_path / "void").mkdir()
    (tmp_path / "void" / "x.json").write_text("")
    assert fl.scan_crawl_runs(spark, str(tmp_path / "void"), layout="ranges").count() == 0
