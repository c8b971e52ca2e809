"""Operators on small tables: expected rows and properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonehour.operators import flows as fl
from zonehour.operators import panel as pn
from zonehour.operators import spatial as sp
from zonehour.operators import tables as tb
from zonehour.plans import analytics as an
from zonehour.plans import pipelines as pp


def trips(spark, rows):
    """rows: (minutes, distance, hail type)"""
    return spark.createDataFrame([(1, 2, dt.date(2024, 1, 1), 8, "yellow", h, float(m), d, 1) for m, d, h in rows], "PULocationID int, DOLocationID int, date date, hour int, dataset string, hail_type string, duration_min double, trip_distance double, passenger_count int")


def test_panel_percentiles(spark):
    r = pn.zone_hour_panel(trips(spark, [(1, 1.0, "other"), (2, 1.0, "other"), (4, 1.0, "other"), (10, 1.0, "other")])).first()
    assert (r.trip_count, r.median_duration_min, r.p10_duration_min, r.p90_duration_min) == (4, 3.0, pytest.approx(1.3), pytest.approx(8.2))


def test_panel_keeps_null_groups_and_single_trips(spark):
    p = pn.zone_hour_panel(trips(spark, [(5, 1.0, None), (7, None, None)])).collect()
    assert len(p) == 1 and p[0].trip_count == 1 and p[0].std_duration_min == pytest.approx(2**0.5)
    assert pn.zone_hour_panel(trips(spark, [(5, 1.0, None)])).first().std_duration_min is None
    assert pn.zone_hour_panel(trips(spark, [(5, None, None)]), distance=None).first().trip_count == 1


def test_panel_does_not_depend_on_partitions(spark):
    t = trips(spark, [(k % 7 + 1, float(k % 5), "other") for k in range(60)])
    got = [pn.zone_hour_panel(t.repartition(n)).collect() for n in (1, 8)]
    assert got[0] == got[1]


def test_weights(spark):
    od = spark.createDataFrame([("a", 2024, 1, "Monday", 8, d, v) for d, v in (("x", 1.0), ("y", 3.0), ("z", 0.0), ("w", -2.0))], "origin string, year int, month int, dow string, hour int, dest string, avg_ridership double")
    w = fl.conditional_weights(od)
    assert {r.dest: r.weight for r in w.collect()} == {"x": 0.25, "y": 0.75}
    c = fl.weight_check(w).first()
    assert c.n_contexts == 1 and c.max_deviation < 1e-12


def test_flows_keep_unmatched_and_add_up(spark):
    e = spark.createDataFrame([(1, dt.date(2024, 1, 1), 8, "full", 10.0), (2, dt.date(2024, 1, 1), 8, "full", 5.0), (1, dt.date(2024, 3, 1), 8, "full", 7.0)], "station int, date date, hour int, fare_class string, ridership double")
    w = spark.createDataFrame([(1, 2024, 1, "Monday", 8, d, x) for d, x in ((3, 0.4), (4, 0.6))], "origin int, year int, month int, dow string, hour int, dest int, weight double")
    f = fl.estimate_flows(e, w).collect()
    assert sorted((r.origin, r.dest, r.flow) for r in f if r.weight) == [(1, 3, 4.0), (1, 4, 6.0)]
    assert [(r.origin, r.dest, r.flow) for r in f if r.weight is None] == [(2, -1, None)]
    assert fl.estimate_flows(e, w, whole_months=False).count() == 4


def square(x, y, s=1.0):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def edges(spark, shapes):
    return sp.polygons_to_edges(spark.createDataFrame(list(shapes.items()), "id int, rings array<array<array<double>>>"), "id", "rings")


CONCAVE = [[[0.0, 0.0], [0.0, 10.0], [5.0, 4.0], [10.0, 10.0], [10.0, 0.0], [0.0, 0.0]]]


def test_points_and_holes(spark):
    e = edges(spark, {1: [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)], 2: [square(1.0, 1.0, 2.0)], 3: [square(10.0, 0.0)]})
    p = spark.createDataFrame([(0.5, 0.5), (2.0, 2.1), (10.5, 0.5), (7.0, 0.5)], "px double, py double")
    assert {(r.px, r.py): r.zone_id for r in sp.points_within(p, e, 1.5).collect()} == {(0.5, 0.5): 1, (2.0, 2.1): 2, (10.5, 0.5): 3}
    z = {(r.px, r.py): (r.zone_id, r.how) for r in sp.zone_of_points(p, e, 1.5).collect()}
    assert z[7.0, 0.5] == (1, "nearest") and len(z) == 4
    assert sp.zone_of_points(p, e, 1.5, max_distance=2.5).count() == 3


def test_overlay_area(spark):
    ring = [[[1.0, 1.0], [1.0, 9.0], [5.0, 4.0], [9.0, 9.0], [9.0, 1.0], [1.0, 1.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 3.0], [2.0, 3.0], [2.0, 2.0]]]
    quad = [[[0.5, 2.5], [3.0, 8.0], [8.0, 7.0], [7.0, 0.5], [0.5, 2.5]]]
    a, b = edges(spark, {1: ring}), edges(spark, {2: quad})
    assert sp.overlay_area(a, b, 3.0).first().area == pytest.approx(24.49340906, abs=1e-6)
    assert sp.overlay_area(a, a, 3.0).first().area == pytest.approx(42, abs=1e-9)
    assert sp.polygon_area(a).first().area == pytest.approx(42)
    w = sp.area_weights(sp.overlay_area(edges(spark, {1: [square(0.3, 0.4)]}), edges(spark, {10 * i + j: [square(float(i), float(j))] for i in range(2) for j in range(2)})))
    assert w.agg(F.sum("area_weight")).first()[0] == pytest.approx(1) and w.count() == 4


def test_rules_and_reports(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (-3, "b")], "x int, g string")
    rules = [tb.Rule("positive", F.col("x") > 0)]
    assert [r.x for r in tb.quality_filter(df, rules).collect()] == [1]
    assert {r.g: (r.n_in, r.ok_positive, r.n_kept) for r in tb.drop_report(df, rules, ["g"]).collect()} == {"a": (2, 1, 1), "b": (1, 0, 0)}
    assert {r.column: r.n_null for r in tb.null_report(df, ["x", "g"]).collect()} == {"x": 1, "g": 0}
    assert tb.columns_like(df, ["X"]) == ["x"]


def test_conform(spark):
    s = T.StructType().add("b", T.IntegerType()).add("a", T.StringType()).add("c", T.DoubleType())
    r = tb.conform(spark.createDataFrame([("x", "7"), ("y", "z")], "a string, b string"), s, lenient=True).orderBy("a").collect()
    assert [tuple(x) for x in r] == [(7, "x", None), (None, "y", None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tb.conform(spark.createDataFrame([("x", "z")], "a string, b string"), s).collect()


def od(spark, rows):
    return spark.createDataFrame([(m, p, d, dt.date(2024, 1, 7), h, float(n)) for m, p, d, h, n in rows], "mode string, pu int, do int, date date, hour int, n double")


def test_lorenz_and_profiles(spark):
    x = od(spark, [("m", 1, 2, 8, 1), ("m", 1, 3, 8, 1), ("m", 2, 3, 9, 8)])
    r = an.lorenz(x).first()
    assert (r.n_pairs, r.pairs_for_50_pct) == (3, pytest.approx(200 / 3))
    assert an.lorenz(x, ascending=False).first().pairs_for_50_pct == 0
    p = {q.slot: q.norm for q in an.normalised_profile(x, "hour").collect()}
    assert len(p) == 24 and p[9] == 1.0 and p[8] == 0.25 and p[0] == 0.0
    f = an.fill_matrix(x, 2).orderBy("dow").collect()
    assert len(f) == 7 and f[0].h8 == 50.0 and f[1].h8 == 0.0


def test_interpolate(spark):
    g = F.array(*map(F.lit, (0.0, 10.0, 20.0)))
    df = spark.createDataFrame([(v,) for v in (-1.0, 5.0, 20.0, 30.0)], "v double")
    assert [r.p for r in df.select("v", an.interpolate(g, F.col("v")).alias("p")).orderBy("v").collect()] == [0.0, 0.25, 1.0, 1.0]


def test_census_means(spark):
    a = spark.createDataFrame([(1, 10.0, 100.0), (2, 30.0, None)], "a_id int, population double, income double")
    c = spark.createDataFrame([(1, 7, 1.0), (2, 7, 1.0)], "a_id int, b_id int, area_weight double")
    lower = sp.zone_demographics(c, a, ["population"], ["income"]).first()
    assert lower.population == 40 and lower.income == 25.0
    assert sp.zone_demographics(c, a, [], ["income"], null_safe=True).first().income == 100.0
    x = pp.clean_census(spark.createDataFrame([("-666666666", "1"), ("0", "1"), ("4", "1")], "population string, w string"), ["population", "w"], {"share": ("w", "population")}).collect()
    assert [(r.population, r.share, r.zero_population) for r in x] == [(None, None, True), (0.0, None, True), (4.0, 0.25, False)]


def test_bike_pipeline(spark):
    t = dt.datetime(2024, 5, 1, 8)
    raw = spark.createDataFrame([(t, t + dt.timedelta(minutes=m), "Subscriber", "electric_bike", 0.5, 0.5, 0.5, 1.5, "nan", "2") for m in (10, 400, -1)], "started_at timestamp_ntz, ended_at timestamp_ntz, member_casual string, rideable_type string, start_lat double, start_lng double, end_lat double, end_lng double, start_station_id string, end_station_id string")
    c = pp.clean_bikes(raw)
    assert c.count() == 3 and c.first().start_station_id is None
    z = pp.bikes_to_zones(c, edges(spark, {1: [square(0.0, 0.0)], 2: [square(1.0, 0.0)]}), project=False, cell=1.0)
    p = pp.bike_panel(z).collect()
    assert [(r.start_zone, r.end_zone, r.n_trips, r.mean_duration_min) for r in p] == [(1, 2, 1, 10.0)]


def test_entries_pipeline(spark):
    rows = [("01/05/2024 01:00:00 PM", "subway", "TRAM1", "full", 3.0, 40.0, -74.0), ("01/05/2024 01:00:00 PM", "subway", "TRAM1", "full", 4.0, 42.0, -74.0), ("bad", "subway", "S", "full", 1.0, 1.0, 1.0), ("01/05/2024 01:00:00 PM", "tram", "S", "full", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "transit_timestamp string, transit_mode string, station_complex_id string, fare_class_category string, ridership double, latitude double, longitude double")
    r = pp.clean_entries(df, "2024-01-01", "2024-12-31").collect()
    assert [(x.station, x.hour, x.ridership, x.lat) for x in r] == [("TRAM1", 13, 7.0, 41.0)]


def test_approximate_quantiles_are_near_the_exact_ones(spark):
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    x = spark.range(200_000).selectExpr("cast(id * 7919 % 200000 as double) as v", "id % 2 as g")
    exact = {r.g: r.q for r in an.with_quantiles(x, "g", "v", qs).collect()}
    near = {r.g: r.q for r in an.with_quantiles(x, "g", "v", qs, exact=False, accuracy=1000).collect()}
    # The rank is off by a 1000th of the group at most; values of a group are two apart.
    assert len(exact) == 2 and all(abs(a - b) <= 2 * 100_000 / 1000 + 2 for g in exact for a, b in zip(exact[g], near[g], strict=True))


def test_route_triples_order_and_ties(spark):
    x = spark.createDataFrame([("a", 1, 2, 5), ("a", 1, 1, 5), ("a", 3, 3, 9), ("b", 1, 1, 1)], "m string, o int, d int, n int")
    got = {r.m: r.triples for r in an.route_triples(x, ["m"], "o", "d", "n").collect()}
    assert got == {"a": [[3, 3, 9], [1, 1, 5], [1, 2, 5]], "b": [[1, 1, 1]]}


def test_shares_and_intensities(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0)], "g string, v double")
    s = tb.with_share(x, "v")
    assert sorted(r.share for r in s.collect()) == pytest.approx([1 / 11, 3 / 11, 7 / 11])
    assert "Window" not in s._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.intensity for r in tb.with_intensity(x, "v", log=False).collect()) == pytest.approx([0, 1 / 3, 1])
    assert sorted(r.intensity for r in tb.with_intensity(x, "v", ["g"], log=False).collect()) == [0, 1, 1]
    assert [r.intensity for r in tb.with_intensity(x.where("v = 7"), "v").collect()] == [1.0]


def test_temporal_sensitivity_keys(spark):
    """An unknown date and an unknown hour are cells of their own; the key of a cell has no text but the mode."""
    od = spark.createDataFrame([("a", 1, 2, "2024-01-03", None, 6.0), ("a", 1, 2, None, 3, 5.0), ("a", 1, 2, "2024-01-03", 7, 4.0), ("a", 1, 2, "2024-01-03", 8, 1.0), ("a", 1, 2, "2024-01-10", 7, 6.0)], "mode string, pu int, do int, date string, hour int, n double").withColumn("date", F.col("date").cast("date"))
    out = an.temporal_sensitivity(od)
    got = {r.granularity: (r.n_cells, r.ge10_pct) for r in out.collect()}
    assert got == {"hour x date": (5, 0.0), "dow x hour": (4, 25.0), "block x date": (4, 0.0)}
    assert "concat" not in out._jdf.queryExecution().optimizedPlan().toString()
