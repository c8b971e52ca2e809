"""Files in and out, schema drift, and incremental ingestion."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonehour.schemas import BIKE_ALIASES, BIKE_TRIP, trip_schema
from zonehour.sources import files, footers, sinks
from zonehour.streaming.ingest import hourly_counts, ingest_available


def test_trips_of_two_generations(spark, tmp_path):
    t = dt.datetime(2024, 1, 5, 10)
    base = "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int, trip_distance double, passenger_count double, fare_amount double"
    spark.createDataFrame([(t, t, 1, 2, 3.0, 1.0, 9.0, 1.25)], base + ", airport_fee double").write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([(t, t, 1, 2, 3.0, 200.0, 9.0, 2.5)], base + ", Airport_fee double").write.parquet(f"{tmp_path}/new")
    x = files.read_trips(spark, [f"{tmp_path}/old", f"{tmp_path}/new"], "yellow", "2024-01-01", "2024-02-01")
    assert [f.name for f in trip_schema("yellow").fields] == x.columns
    assert sorted((r.airport_fee, r.passenger_count) for r in x.collect()) == [(1.25, 1), (2.5, None)]
    assert files.read_trips(spark, [f"{tmp_path}/old"], "yellow", "2024-02-01").count() == 0
    d = footers.drift(footers.footers(spark, [f"{tmp_path}/new", f"{tmp_path}/old"]).where("n_rows > 0"))
    assert sorted((r.column, r.change) for r in d.collect()) == [("Airport_fee", "removed"), ("airport_fee", "added")]


def test_csv_generations(spark, tmp_path):
    (tmp_path / "a.csv").write_text('starttime,stoptime,start station id,usertype\n2014-01-01 00:00:01,2014-01-01 00:10:01,7,Subscriber\n')
    (tmp_path / "b.csv").write_text('started_at,ended_at,start_station_id,member_casual\n2024-01-01 00:00:01,x,007,casual\n')
    r = files.read_csv_generations(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], BIKE_ALIASES, BIKE_TRIP).orderBy("source_file").collect()
    assert [(x.start_station_id, x.member_casual, x.ended_at is None, x.source_file) for x in r] == [("7", "Subscriber", False, "a.csv"), ("007", "casual", True, "b.csv")]


def test_mixed_csv_folder(spark, tmp_path):
    """Generations lie side by side and below one another; fields are quoted, headers of any case, rows short."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text('"StartTime","stoptime","Start Station ID","User Type"\n"2014-01-01 00:00:01","2014-01-01 00:10:01","7, ""A""","Subscriber"\n\n')
    (tmp_path / "sub" / "b.csv").write_text('started_at,ended_at,start_station_id,member_casual,rideable_type\n2024-01-01 00:00:01,,007,casual\n2024-01-02 00:00:01,2024-01-02 00:05:00,008,member,electric_bike\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "only_header.csv").write_text("started_at,ended_at\n")
    r = files.read_csv_generations(spark, str(tmp_path), BIKE_ALIASES, BIKE_TRIP).orderBy("started_at").collect()
    assert [(x.start_station_id, x.member_casual, x.rideable_type, x.ended_at is None, x.source_file) for x in r] == [('7, "A"', "Subscriber", None, False, "a.csv"), ("007", "casual", None, True, "b.csv"), ("008", "member", "electric_bike", False, "b.csv")]


def test_columns_from_paths(spark, tmp_path):
    for name in ("isd_725030_2021.csv", "isd_725030_2022.csv", "isd_744860_2021.csv"):
        (tmp_path / name).write_text("DATE,TMP\n2021-01-01T00:51:00,\"+0011,1\"\n")
    s = T.StructType().add("DATE", T.StringType()).add("TMP", T.StringType())
    r = files.read_csv_named(spark, f"{tmp_path}/isd_*_2021.csv", s, r"isd_(\d+)_(\d{4})", {"STATION": "string", "year": "int"}).orderBy("STATION").collect()
    assert [tuple(x) for x in r] == [("2021-01-01T00:51:00", "+0011,1", "725030", 2021), ("2021-01-01T00:51:00", "+0011,1", "744860", 2021)]


def test_typed_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "isd_s_2021.csv").write_text('k,v\n061,1\n100,x\n')
    s = T.StructType().add("k", T.StringType()).add("v", T.DoubleType())
    assert [(r.k, r.v, r.file) for r in files.read_csv_typed(spark, str(tmp_path), s, ["k", "v"], "file").orderBy("k").collect()] == [("061", 1.0, "isd_s_2021.csv"), ("100", None, "isd_s_2021.csv")]
    (tmp_path / "x.json").write_text('{"k":"1","v":2}\n{"k":"2"}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/x.json", s).count() == 2
    names = files.list_files(spark, str(tmp_path), "*.csv").select(F.element_at(F.split("file_name", "/"), -1).alias("file_name"))
    assert files.prune_files_by_year(names, 2021).count() == 1 and files.prune_files_by_year(names, 2022).count() == 0
    assert files.prune_files_by_year(names, 2021, exclude_prefixes=["isd"]).count() == 0


def test_header_json(spark):
    doc = json.dumps([["NAME", "state", "county"], ["a", "36", "061"], ["b", "36", "005"]])
    df = spark.createDataFrame([(doc,), (json.dumps([["state", "NAME", "county"], ["36", "c", "047"]]),)], "j string")
    assert sorted((r.NAME, r.county) for r in files.table_from_header_json(df, "j", ["NAME", "state", "county"]).collect()) == [("a", "061"), ("b", "005"), ("c", "047")]


def test_geojson(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    doc = {"type": "FeatureCollection", "features": [{"properties": {"LocationID": "4"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"LocationID": "5"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "z.json").write_text(json.dumps(doc))
    r = files.read_polygons(spark, f"{tmp_path}/z.json", "LocationID").collect()
    assert sorted(x.zone_id for x in r) == ["4", "5", "5"] and r[0].coords == [ring]


def test_partitions_are_replaced_alone(spark, tmp_path):
    p = f"{tmp_path}/panel"
    df = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], "x int, year int, month int")
    sinks.write_partitioned(df, p, by=("year", "month"))
    sinks.write_partitioned(spark.createDataFrame([(9, 2024, 2)], "x int, year int, month int"), p, by=("year", "month"))
    assert sorted((r.x, r.month) for r in spark.read.parquet(p).collect()) == [(1, 1), (9, 2)]
    f = footers.footers(spark, p).withColumn("month", F.regexp_extract("file_name", r"month=(\d+)", 1).cast("int"))
    e = footers.expected(f, spark.createDataFrame([(1,), (2,), (3,)], "month int"), ["month"]).orderBy("month").collect()
    assert [(r.exists, r.n_files, r.n_rows) for r in e] == [(True, 1, 1), (True, 1, 1), (False, None, None)]


def test_report_resumes(spark, tmp_path):
    t = {"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")}
    assert sinks.save_report(t, str(tmp_path), "csv") == ["a", "b"] and sinks.save_report(t, str(tmp_path), "csv") == []
    sinks.write_csv(t["a"], f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 3


def test_ingest_each_file_once(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))
    s = T.StructType().add("x", T.LongType())
    run = lambda: ingest_available(spark, src, out, s, ck, lambda d: d.where("x % 2 = 0")).awaitTermination()
    spark.range(100).toDF("x").write.parquet(src)
    run()
    assert spark.read.parquet(out).count() == 50
    run()
    assert spark.read.parquet(out).count() == 50
    spark.range(10).toDF("x").write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() == 55


def test_hourly_counts_of_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10, 5)
    df = spark.createDataFrame([(1, 2, t), (1, 2, t + dt.timedelta(minutes=20)), (1, 2, t + dt.timedelta(days=9))], "PULocationID int, DOLocationID int, pickup_datetime timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = hourly_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.trip_count for r in spark.table("hours").collect()) == [1, 2] == sorted(r.trip_count for r in hourly_counts(df).collect())


def test_header_generations(spark, tmp_path):
    for name, text in (("a", 'TripDuration,"Start Time"\n1,x\n'), ("b", "start station id,started_at\n1,x\n"), ("c", "ride_id,START_LAT\n1,2\n"), ("d", "p,q\n1,2\n"), ("e", "")):
        (tmp_path / f"{name}.csv").write_text(text)
    heads = files.csv_headers(spark, str(tmp_path))
    got = sorted((r.file_name[-5], r.header, r.generation, r.changed) for r in files.generation_changes(heads).collect())
    # A file without a row has no header; a column of the old files goes before one of the new.
    assert got == [("a", ["TripDuration", "Start Time"], "old", False), ("b", ["start station id", "started_at"], "old", False), ("c", ["ride_id", "START_LAT"], "new", True), ("d", ["p", "q"], "unknown", True)]


def test_lookup_types_are_inferred(spark, tmp_path):
    (tmp_path / "z.csv").write_text("id,name,share\n1,x,0.5\n2,,\n")
    x = files.read_lookup(spark, f"{tmp_path}/z.csv")
    assert x.dtypes == [("id", "int"), ("name", "string"), ("share", "double")]
    assert sorted(map(tuple, x.collect()), key=str) == [(1, "x", 0.5), (2, None, None)]
