"""Tables kept by streams, many footers, and the plans of joins: what is read again, exchanged, split and left alone."""

import datetime as dt
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from zonehour.operators import flows as fl
from zonehour.sources import footers, sinks
from zonehour.streaming import maintain

TRIPS = "pickup_datetime timestamp_ntz, zone int, n int"


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def panel(trips):
    return trips.groupBy("year", "month", "zone").agg(F.sum("n").alias("n"), F.count("*").alias("trips"))


def test_panel_is_rebuilt_by_touched_months(spark, tmp_path):
    schema = spark.createDataFrame([], TRIPS).schema
    at = lambda m, d, z, n: (dt.datetime(2024, m, d), z, n)

    def feed(rows):
        spark.createDataFrame(rows, TRIPS).write.mode("append").parquet(f"{tmp_path}/in")
        maintain.maintain_panel(spark, f"{tmp_path}/in", f"{tmp_path}/trips", f"{tmp_path}/panel", schema, f"{tmp_path}/state", lambda d: d.where("n > 0"), panel).awaitTermination()
        return files_of(f"{tmp_path}/panel")

    first = feed([at(1, 3, 7, 1), at(2, 3, 7, 2), at(3, 3, 8, 4), at(3, 4, 8, 0)])
    time.sleep(1.1)
    second = feed([at(2, 9, 7, 5), at(4, 1, 9, 6)])
    month = lambda fs, m: {k: v for k, v in fs.items() if f"month={m}" in k}
    assert month(first, 1) == month(second, 1) and month(first, 3) == month(second, 3)
    assert month(first, 2) != month(second, 2) and month(second, 4)
    got = sorted((r.month, r.zone, r.n, r.trips) for r in spark.read.parquet(f"{tmp_path}/panel").collect())
    assert got == [(1, 7, 1, 1), (2, 7, 7, 2), (3, 8, 4, 1), (4, 9, 6, 1)]
    # A call without new files, and one whose files hold nothing, leave all as it is.
    assert feed([at(5, 1, 1, 0)]) == second


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    """As after a failure between the batch's work and its commit: the commit is lost, the batch comes again."""
    schema = spark.createDataFrame([], TRIPS).schema
    run = lambda: maintain.maintain_panel(spark, f"{tmp_path}/in", f"{tmp_path}/trips", f"{tmp_path}/panel", schema, f"{tmp_path}/state", lambda d: d, panel).awaitTermination()
    spark.createDataFrame([(dt.datetime(2024, 1, 1), 1, 3)], TRIPS).write.parquet(f"{tmp_path}/in")
    run()
    for f in (f"{tmp_path}/state/commits/0", f"{tmp_path}/state/commits/.0.crc"):
        os.remove(f)
    run()
    assert [(r.n, r.trips) for r in spark.read.parquet(f"{tmp_path}/panel").collect()] == [(3, 1)]


def test_stream_is_taken_up_with_its_open_hours(spark, tmp_path):
    s = "ts timestamp, k string"
    t = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)

    def feed(rows):
        spark.createDataFrame(rows, s).write.mode("append").parquet(f"{tmp_path}/in")
        maintain.hourly_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", spark.createDataFrame([], s).schema, f"{tmp_path}/state", "ts", ["k"], "1 day").awaitTermination()
        return sorted((r.k, r.hour_start.day, r.hour_start.hour, r.trip_count) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert feed([(t(1, 5), "a"), (t(1, 5, 30), "a"), (t(2, 9), "a")]) == [("a", 1, 5, 2)]
    # 1st 5:00 is closed, what comes for it is dropped; the 2nd is open since the first call, and gets its late row.
    assert feed([(t(1, 5, 45), "a"), (t(2, 9, 10), "a"), (t(4, 0), "b")]) == [("a", 1, 5, 2), ("a", 2, 9, 2)]


def test_obsolete_partitions_are_written_anew(spark, tmp_path):
    p = f"{tmp_path}/out"
    rows = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, "y", 3)], "v int, kind string, new int")
    sinks.write_partitioned(rows.where("kind = 'x'").drop("new"), p, by=["kind"])
    sinks.write_partitioned(rows.where("kind = 'y'"), p, by=["kind"])
    before = files_of(p)
    assert [r.kind for r in maintain.rewrite_obsolete(spark, p, "new", ["kind"], lambda k: rows.join(k, "kind", "left_semi")).collect()] == ["x"]
    after = files_of(p)
    assert {f: m for f, m in before.items() if "kind=y" in f}.items() <= after.items() and not any(f in after for f in before if "kind=x" in f)
    assert maintain.lacking(spark, p, "new", ["kind"]).collect() == []
    assert maintain.rewrite_obsolete(spark, p, "new", ["kind"], lambda k: pytest.fail("nothing to rebuild")).collect() == [] and files_of(p) == after


def test_footers_of_many_files(spark, tmp_path):
    for k in range(600):
        os.makedirs(f"{tmp_path}/m={k % 6}", exist_ok=True)
        pq.write_table(pa.table({"a": pa.array([1] * (k % 3), pa.int64()), **({"b": pa.array(["x"] * (k % 3), pa.string())} if k % 6 == 4 else {})}), f"{tmp_path}/m={k % 6}/f{k:04}.parquet")
    month = F.regexp_extract("file_name", r"/m=(\d)/", 1).cast("int").alias("m")
    f = footers.footers(spark, str(tmp_path)).select("*", month)
    got = {r.m: (r.n_files, r.n_rows) for r in footers.inventory_of(f, ["m"]).collect()}
    assert got == {m: (100, 100 * (m % 3)) for m in range(6)}
    d = footers.drift(f).groupBy(month, "column", "change").count().collect()
    assert [tuple(r) for r in d] == [(4, "b", "added", 100)]
    assert footers.drift(f, ["m"]).count() == 0


# --- joins of flows ---------------------------------------------------------------


def context_rows(spark, hot=4000):
    day = dt.date(2024, 1, 1)
    e = [(1, day, 8, "c", float(k)) for k in range(hot)] + [(s, day, h, "c", 1.0) for s in range(2, 40) for h in range(5)] + [(99, day, 8, "c", 1.0)]
    w = [(s, 2024, 1, "Monday", h, d, 0.25) for s in range(1, 40) for h in (*range(5), 8) for d in range(4)]
    e = spark.createDataFrame(e, "station int, date date, hour int, fare_class string, ridership double")
    return e, spark.createDataFrame(w, "origin int, year int, month int, dow string, hour int, dest int, weight double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_hot_context_is_dealt_out(spark, no_broadcast):
    e, w = context_rows(spark)
    key = ["origin", "dest", "hour", "ridership", "flow"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*key).fillna(-1).collect())
    plain, salted = fl.estimate_flows(e, w, hot_rows=None), fl.estimate_flows(e, w, hot_rows=100)
    assert rows(plain) == rows(salted) and plain.count() == 4 * (4000 + 38 * 5) + 1
    per = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(per(plain)) >= 16_000 and max(per(salted)) < 3 * sum(per(salted)) / 16


def test_bucketed_flows_join_without_exchange(spark, no_broadcast):
    e, w = context_rows(spark, 50)
    e = sinks.write_bucketed(fl.with_calendar(e), "bucketed_entries", ["station", *fl.CONTEXT[1:]], 6)
    w = sinks.write_bucketed(w, "bucketed_weights", fl.CONTEXT, 6)
    x = fl.estimate_flows(e, w, whole_months=False, hot_rows=None)
    assert "SortMergeJoin" in plan(x) and "Exchange" not in plan(x) and x.count() == 4 * (50 + 38 * 5) + 1
    for t in ("bucketed_entries", "bucketed_weights"):
        spark.sql(f"DROP TABLE {t}")


def test_months_prune_files(spark, tmp_path):
    x = spark.range(120).selectExpr("id", "cast(2020 + id % 5 as int) as year", "cast(1 + id % 12 as int) as month")
    sinks.write_partitioned(x, str(tmp_path), by=["year", "month"])
    w = spark.createDataFrame([(2021, 2, 1.0), (2021, 2, 0.5), (2022, 3, 0.0)], "year int, month int, weight double")
    y = fl.months_with_od(spark.read.parquet(str(tmp_path)), w)
    assert "dynamicpruning" in plan(y).lower()
    assert {(r.year, r.month) for r in y.collect()} == {(2021, 2)} and y.count() == 2
