"""Queries that write the tables as the files that sources read and sinks write, and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonehour import schemas
from zonehour.bindings import END, START, Views
from zonehour.operators import flows as fl
from zonehour.operators import panel as pn
from zonehour.operators import spatial as sp
from zonehour.plans import analytics as an
from zonehour.plans import pipelines as pp
from zonehour.queries import _FLOWS, _LOCAL, _PK, _STAMP, _TRACTS, _overlay_sql, _utc_sql, B, PANEL_SQL, R, query
from zonehour.shared import new_path, staged
from zonehour.sources import files, footers, sinks
from zonehour.streaming import maintain

# --- trips by mode -----------------------------------------------------------

#: The fares that the files of each mode below carry, as columns of the trip binding.
_FARES = {
    "yellow": {"fare_amount": "fare_amount", "tip_amount": "tip_amount"},
    "green": {"fare_amount": "fare_amount", "tip_amount": "tip_amount", "mta_tax": "tax_amount"},
    "hvfhv": {"base_passenger_fare": "fare_amount", "tips": "tip_amount", "sales_tax": "tax_amount"},
    "fhv": {},
}
#: Trips without distance and fare are dispatched ones: the yellow trips again.
_OF = {"fhv": "yellow"}


def _raw_files(v: Views, trips: DataFrame, mode: str) -> list[str]:
    """A mode's trips under its own column names, in two generations of files."""
    m, at = schemas.MODES[mode], new_path(v.spark, f"raw-{mode}")
    rows = trips.where(F.col("dataset") == _OF.get(mode, mode))
    early = F.col("pickup_datetime") < F.lit("1998-01-01").cast("timestamp_ntz")
    drop = "dropOff_datetime" if mode == "fhv" else m.dropoff
    zones = ("PUlocationID", "DOlocationID") if mode == "fhv" else ("PULocationID", "DOLocationID")
    cols = [F.col("pickup_datetime").alias(m.pickup), F.col("dropoff_datetime").alias(drop), F.col("PULocationID").alias(zones[0]), F.col("DOLocationID").alias(zones[1])]
    cols += [F.col("trip_distance").alias(m.distance)] if m.distance else []
    # Whole numbers came as fractions at first.
    old = [F.col(m.passengers).cast("double").alias(m.passengers)] if m.passengers else []
    new = [F.col(m.passengers)] if m.passengers else []
    cols += [F.col(c) for c in m.extra] + [F.col(c).alias(n) for n, c in _FARES[mode].items()]
    new += [F.col("tax_amount").alias("Airport_fee")] if mode == "yellow" else []
    rows.where(early).select(*cols, *old).write.parquet(f"{at}/1")
    rows.where(~early).select(*cols, *new).write.parquet(f"{at}/2")
    return [f"{at}/1", f"{at}/2"]


def _modes(v: Views) -> dict[str, DataFrame]:
    trips = staged(v.trips, "trips")
    return {m: pp.clean_mode(v.spark, _raw_files(v, trips, m), m, START, END) for m in schemas.MODES}


def _real(x: str) -> str:
    return f"CAST(CAST({x} AS REAL) AS DOUBLE)"


_TIMES = f"pickup_datetime >= TIMESTAMP '{START}' AND pickup_datetime < TIMESTAMP '{END}' AND dropoff_datetime > pickup_datetime"
_MODES_SQL = f""", md AS (
  SELECT dataset AS mode, pickup_datetime, date_diff('microsecond', pickup_datetime, dropoff_datetime) / 60000000.0 AS duration_min, PULocationID, DOLocationID, {_real('trip_distance')} AS distance,
    CASE WHEN dataset <> 'hvfhv' AND passenger_count BETWEEN 1 AND 9 THEN passenger_count END AS pax, hvfhs_license_num, payment_type, RatecodeID, CASE WHEN dataset = 'green' THEN trip_type END AS trip_type,
    {_real('fare_amount')} + {_real('tip_amount')} + CASE WHEN dataset = 'yellow' AND pickup_datetime < TIMESTAMP '1998-01-01' THEN 0 ELSE coalesce({_real('tax_amount')}, 0) END AS total
  FROM trips WHERE {_TIMES} AND trip_distance > 0 AND fare_amount > 0
  UNION ALL
  SELECT 'fhv', pickup_datetime, date_diff('microsecond', pickup_datetime, dropoff_datetime) / 60000000.0, PULocationID, DOLocationID, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM trips WHERE {_TIMES} AND dataset = 'yellow'),
mk AS (SELECT *, CAST(pickup_datetime AS DATE) AS date, CAST(hour(pickup_datetime) AS INT) AS hour,
  CASE WHEN mode <> 'hvfhv' THEN mode WHEN hvfhs_license_num = 'HV0002' THEN 'juno' WHEN hvfhs_license_num = 'HV0003' THEN 'uber' WHEN hvfhs_license_num = 'HV0004' THEN 'via' WHEN hvfhs_license_num = 'HV0005' THEN 'lyft' ELSE 'hvfhv_other' END AS dataset,
  CASE WHEN mode IN ('yellow', 'green') THEN CASE WHEN payment_type = 0 THEN 'flex_fare' WHEN RatecodeID = 1 THEN 'standard_meter' WHEN RatecodeID IN (2, 3) THEN 'airport' WHEN RatecodeID = 5 THEN 'negotiated' ELSE 'other' END END AS hail_type FROM md)"""


@query("pip1_clean_modes", _MODES_SQL + f" SELECT mode AS dataset, {B('year(pickup_datetime)')} AS year, {B('count(*)')} AS n, {B('count(distance)')} AS n_distance, {B('count(pax)')} AS n_pax, {R('sum(duration_min)')} AS minutes, {R('sum(distance)')} AS distance, {R('sum(total)')} AS total FROM md GROUP BY mode, year(pickup_datetime)")
def _(v):
    """Raw files of the four modes, each in two generations, to clean trips."""
    parts = [x.withColumn("total", F.lit(None).cast("double") if not schemas.FARES[m] else reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in schemas.FARES[m]))).select("dataset", "pickup_datetime", "trip_distance", "passenger_count", "duration_min", "total") for m, x in _modes(v).items()]
    x = reduce(DataFrame.unionByName, parts).withColumn("year", F.year("pickup_datetime"))
    return x.groupBy("dataset", "year").agg(F.count("*").alias("n"), F.count("trip_distance").alias("n_distance"), F.count("passenger_count").alias("n_pax"), F.sum("duration_min").alias("minutes"), F.sum("trip_distance").alias("distance"), F.sum("total").alias("total"))


@query("pip2_mode_panels", _MODES_SQL + f""" SELECT {B('PULocationID')} AS PULocationID, {B('DOLocationID')} AS DOLocationID, date, {B('hour')} AS hour, dataset, hail_type,
  {B("CASE WHEN mode = 'fhv' THEN count(*) ELSE count(distance) END")} AS trip_count, {R(_real('avg(distance)'))} AS avg_distance, {R(_real('avg(duration_min)'))} AS avg_duration_min, {R(_real('quantile_cont(duration_min, 0.5)'))} AS median_duration_min,
  {R(_real('avg(pax)'))} AS avg_passengers, {R(_real('avg(total)'))} AS avg_total, CASE WHEN mode = 'green' THEN avg(CASE WHEN trip_type = 1 THEN 1.0 ELSE 0.0 END) >= 0.5 END AS is_street_hail
  FROM mk GROUP BY PULocationID, DOLocationID, date, hour, mode, dataset, hail_type""")
def _(v):
    """The panels of the four modes from their raw files."""
    parts = [pp.mode_panel(x, m) for m, x in _modes(v).items()]
    cols = ["PULocationID", "DOLocationID", "date", "hour", "dataset", "hail_type", "trip_count", "avg_distance", "avg_duration_min", "median_duration_min", "avg_passengers", "avg_total", "is_street_hail"]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*cols)


# --- CSV, JSON and polygons --------------------------------------------------

@query("pip3_clean_entries", f""", x AS (SELECT user_id % 10 AS station, date_trunc('second', ts) AS t, event_type AS fare_class, floor(value) AS ridership, user_id / 30.0 AS lat, value / 100 AS lng FROM ev WHERE user_id % 5 <> 0),
  w AS (SELECT * FROM x WHERE t BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'), c AS (SELECT station, median(lat) AS lat, median(lng) AS lng FROM w GROUP BY station)
  SELECT {B('station')} AS station, CAST(t AS DATE) AS date, {B('hour(t)')} AS hour, fare_class, {R('sum(ridership)')} AS ridership, {R('any_value(c.lat)')} AS lat, {R('any_value(c.lng)')} AS lng FROM w JOIN c USING (station) GROUP BY station, CAST(t AS DATE), hour(t), fare_class""")
def _(v):
    """Entries written as CSV, read under their schema, cleaned."""
    at = new_path(v.spark, "entries")
    sinks.write_csv(v.events.select(F.date_format("ts", "MM/dd/yyyy hh:mm:ss a").alias("transit_timestamp"), F.when(F.col("user_id") % 5 == 0, "tram").otherwise("subway").alias("transit_mode"), (F.col("user_id") % 10).cast("string").alias("station_complex_id"), F.col("event_type").alias("fare_class_category"), F.floor("value").cast("double").alias("ridership"), (F.col("user_id") / 30.0).alias("latitude"), (F.col("value") / 100).alias("longitude")), at)
    x = pp.clean_entries(files.read_csv_typed(v.spark, at, schemas.ENTRIES_CSV), "2024-01-05", "2024-01-20 12:00:00")
    return x.withColumn("station", F.col("station").cast("long"))


@query("pip4_od_weights", f" SELECT {B('origin')} AS origin, {B('dest')} AS dest, {B('year')} AS year, {B('month')} AS month, dow, {B('hour')} AS hour, {R('avg_ridership')} AS avg_ridership, {R('weight')} AS weight FROM weights")
def _(v):
    """Destination estimates written as CSV, read under their schema, made weights."""
    at = new_path(v.spark, "od")
    names = {"origin": "Origin Station Complex ID", "dest": "Destination Station Complex ID", "year": "Year", "month": "Month", "dow": "Day of Week", "hour": "Hour of Day", "avg_ridership": "Estimated Average Ridership"}
    x = v.od_raw.select(*[F.col(c).alias(n) for c, n in names.items()])
    # Files have all columns of the schema, in its order.
    sinks.write_csv(x.select(*[F.col(f"`{f.name}`") if f.name in x.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.OD_CSV]), at)
    w = pp.od_weights(files.read_csv_typed(v.spark, at, schemas.OD_CSV))
    return w.withColumns({"origin": F.col("origin").cast("long"), "dest": F.col("dest").cast("long")})


def _bike_files(v: Views) -> str:
    """Bike trips as CSV of three generations: two old headers, then the new one with a column more."""
    at = new_path(v.spark, "bikes")
    new = {"started_at": F.col("started_at").cast("string"), "ended_at": F.col("ended_at").cast("string"), "start_lat": F.col("start_lat"), "start_lng": F.col("start_lng"), "end_lat": F.col("end_lat"), "end_lng": F.col("end_lng"), "start_station_id": F.col("start_station_id"), "member_casual": F.col("usertype")}
    for k in range(3):
        rows = v.bikes.where(F.col("event_id") % 3 == k)
        old = [c.alias(schemas.BIKE_ALIASES[n][2 - k]) for n, c in new.items()]
        sinks.write_csv(rows.select(*old, *([F.col("rideable_type")] if k == 2 else [])), f"{at}/{k + 1}")
    return at


@query("src7_header_generations", f""" SELECT CAST(started_at AS DATE) AS date, member_casual, CASE WHEN event_id % 3 = 2 THEN rideable_type ELSE 'unknown' END AS rideable_type, {B('count(*)')} AS n, {B('count(CASE WHEN CAST(round((start_lat - 0.00731) * 30) AS BIGINT) % 9 <> 0 THEN 1 END)')} AS n_station,
  {R('sum(date_diff(' + chr(39) + 'microsecond' + chr(39) + ', started_at, ended_at) / 60000000.0)')} AS minutes, {B('sum(CAST(round(start_lat * 1000000) AS BIGINT))')} AS lat_micro FROM bikes WHERE member_casual IS NOT NULL AND start_lat <> 0 AND start_lng <> 0 AND end_lat <> 0 AND end_lng <> 0 GROUP BY 1, 2, 3""")
def _(v):
    """Bike files of three header generations, told apart by their headers, read as one table and cleaned."""
    at = _bike_files(v)
    x = pp.clean_bikes(files.read_csv_generations(v.spark, at, schemas.BIKE_ALIASES, schemas.BIKE_TRIP))
    minutes = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("ended_at")) / 60_000_000.0
    return x.groupBy(F.to_date("started_at").alias("date"), "member_casual", "rideable_type").agg(F.count("*").alias("n"), F.count("start_station_id").alias("n_station"), F.sum(minutes).alias("minutes"), F.sum(F.round(F.col("start_lat") * 1000000).cast("long")).alias("lat_micro"))


@query("str_header_generations", f"SELECT CAST(event_id % 3 + 1 AS STRING) AS folder, CASE WHEN event_id % 3 = 2 THEN 'new' ELSE 'old' END AS generation, event_id % 3 = 2 AS changed, {B('count(*)')} AS n FROM events GROUP BY event_id % 3", views=False)
def _(v):
    """The generation of each folder of bike files by its header, where it changes, and the rows there."""
    at = _bike_files(v)
    folder = lambda c: F.element_at(F.split(c, "/"), -2).alias("folder")
    heads = files.csv_headers(v.spark, at).select(folder(F.col("file_name")), "header").distinct()
    gens = files.generation_changes(heads, name="folder").select("folder", "generation", "changed")
    rows = v.spark.read.option("header", True).option("recursiveFileLookup", True).csv(at).select(folder(F.col("_metadata.file_path"))).groupBy("folder").agg(F.count("*").alias("n"))
    return gens.join(rows, "folder")


@query("src14_inferred_lookup", f"SELECT {B('n_nationkey')} AS n_nationkey, n_name, {B('n_regionkey')} AS n_regionkey, {B('n_nationkey + n_regionkey')} AS key_sum FROM nation", views=False)
def _(v):
    at = new_path(v.spark, "lookup")
    sinks.write_csv(v.table("nation"), at)
    x = files.read_lookup(v.spark, at)
    numbers = [n for n, t in x.dtypes if t == "int"]
    return x.select("n_nationkey", "n_name", "n_regionkey", reduce(lambda a, b: a + b, map(F.col, numbers)).alias("key_sum"))


@query("src11_json_lines", f"SELECT event_type, {B('count(*)')} AS n, {B('min(event_id)')} AS first_id, {R('sum(value)')} AS total FROM events GROUP BY event_type", views=False)
def _(v):
    at = new_path(v.spark, "lines")
    x = v.table("events").drop("props")
    x.write.json(at)
    return files.read_jsonl(v.spark, at, x.drop("ts").schema).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum("value").alias("total"))


@query("src12_polygons", f", g AS (SELECT DISTINCT CAST(floor(px) AS BIGINT) AS i, CAST(floor(py) AS BIGINT) AS j FROM points) SELECT 'c' || i || '_' || j AS zone_id, {B('CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END')} AS n_polygons, {B('CASE WHEN i % 2 = 0 THEN 6 ELSE 4 END')} AS n_edges, {R('1.0')} AS area FROM g")
def _(v):
    """The grid cells that hold points as GeoJSON, whole or as two triangles, read as polygons and edges."""
    at = new_path(v.spark, "zones")
    g = v.points.selectExpr("cast(floor(px) as bigint) as i", "cast(floor(py) as bigint) as j").distinct()
    geometry = "case when i % 2 = 0 then struct('MultiPolygon' as type, array(array(array(array(i, j), array(i + 1, j), array(i + 1, j + 1), array(i, j))), array(array(array(i, j), array(i + 1, j + 1), array(i, j + 1), array(i, j)))) as coordinates) end"
    square = "case when i % 2 <> 0 then struct('Polygon' as type, array(array(array(i, j), array(i + 1, j), array(i + 1, j + 1), array(i, j + 1), array(i, j))) as coordinates) end"
    props = "struct('c' || i || '_' || j as LocationID)"
    docs = g.selectExpr(f"coalesce(to_json(struct('Feature' as type, {props} as properties, {geometry} as geometry)), '') as m", f"to_json(struct('Feature' as type, {props} as properties, {square} as geometry)) as s", "i % 2 = 0 as many", "i")
    # A file and collection per column of cells.
    each = docs.groupBy("i").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(F.when(F.col("many"), F.col("m")).otherwise(F.col("s"))), ","), F.lit("]}")).alias("value"))
    each.write.partitionBy("i").text(at)
    polygons = files.read_polygons(v.spark, at, "LocationID")
    e = sp.polygons_to_edges(polygons.withColumn("part", F.monotonically_increasing_id()).withColumn("id", F.struct("zone_id", "part")), "id", "coords")
    part = e.groupBy("zone_id").agg(F.count("*").alias("n"), F.abs(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") + F.col("y1")) / 2)).alias("area"))
    return part.groupBy(F.col("zone_id.zone_id").alias("zone_id")).agg(F.count("*").alias("n_polygons"), F.sum("n").alias("n_edges"), F.sum("area").alias("area"))


@query("src5_tree_scan", f"SELECT {B('year(o_orderdate)')} AS year, {B('count(*)')} AS n, {R('sum(o_totalprice)')} AS total FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1997 AND o_orderstatus <> 'P' GROUP BY 1", views=False)
def _(v):
    """A tree of files by status and year, listed, pruned by prefix and year, and read."""
    at = new_path(v.spark, "tree")
    sinks.write_partitioned(v.table("orders").select("o_orderdate", "o_totalprice", F.concat("o_orderstatus", F.lit("_orders")).alias("kind"), F.year("o_orderdate").alias("y")), at, by=["kind", "y"])
    inside = lambda c: F.regexp_extract(c, "(kind=.*)$", 1)
    found = files.list_files(v.spark, at, "*.parquet").select(inside(F.col("file_name")).alias("file_name"), F.regexp_extract("file_name", r"/y=(\d{4})/", 1).alias("name"))
    kept = files.prune_files_by_year(files.prune_files_by_year(found, 1994, 1997, name="name"), 0, exclude_prefixes=("kind=P_",))
    x = v.spark.read.parquet(at).withColumn("file_name", inside(F.col("_metadata.file_path"))).join(kept.select("file_name"), "file_name", "left_semi")
    return x.groupBy(F.col("y").alias("year")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


# --- sinks -------------------------------------------------------------------

@query("snk1_partition_overwrite", f"SELECT mode, {B('count(*)')} AS n_cells, {R('sum(n)')} AS total FROM od WHERE mode <> 'green' OR hour < 12 GROUP BY mode")
def _(v):
    """The panel by mode; then one mode's partition is written again, and only that is replaced."""
    at = new_path(v.spark, "panel")
    sinks.write_partitioned(v.od, at, by=["mode"])
    sinks.write_partitioned(v.od.where("mode = 'green' and hour < 12"), at, by=["mode"])
    return v.spark.read.parquet(at).groupBy("mode").agg(F.count("*").alias("n_cells"), F.sum("n").alias("total"))


@query("snk5_report", f"SELECT 'priority' AS report, o_orderpriority AS k, {B('count(*)')} AS n FROM orders GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, {B('count(*)')} FROM orders GROUP BY 2", views=False)
def _(v):
    """A report of two tables as CSV, begun with one of them and then taken up again."""
    at, o = new_path(v.spark, "report"), v.table("orders")
    tables = {n: o.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")) for n, c in (("priority", "o_orderpriority"), ("status", "o_orderstatus"))}
    sinks.save_report({"priority": tables["priority"]}, at, "csv")
    again = sinks.save_report(tables, at, "csv")
    assert again == ["status"], again
    return reduce(DataFrame.unionByName, [files.read_csv_typed(v.spark, f"{at}/{n}", t.schema).select(F.lit(n).alias("report"), "k", "n") for n, t in tables.items()])


@query("jsn_route_triples", ", q AS (SELECT mode, year(date) AS y, quarter(date) AS q, pu, do, CAST(sum(n) AS BIGINT) AS n FROM od GROUP BY ALL), t AS (SELECT mode, y, q, '[' || string_agg('[' || pu || ',' || do || ',' || n || ']', ',' ORDER BY n DESC, pu, do) || ']' AS t FROM q GROUP BY mode, y, q), y AS (SELECT mode, y, '{' || string_agg('\"' || q || '\":' || t, ',' ORDER BY q) || '}' AS d FROM t GROUP BY mode, y) SELECT mode, '{' || string_agg('\"' || y || '\":' || d, ',' ORDER BY y) || '}' AS doc FROM y GROUP BY mode")
def _(v):
    """Per mode a document {year: {quarter: [[origin, destination, n], ...]}}, the largest routes first."""
    q = v.od.groupBy("mode", F.year("date").alias("year"), F.quarter("date").alias("quarter"), "pu", "do").agg(F.sum("n").cast("long").alias("n"))
    return an.nested_json(an.route_triples(q, ["mode", "year", "quarter"], "pu", "do", "n"), ["mode", "year", "quarter"], "triples")


# --- tables that streams and buckets keep --------------------------------------

#: A row arrives with its third of the month; each tenth comes one wave late.
_WAVES = "least(3, 1 + (CASE WHEN ts >= TIMESTAMP '2024-01-11 00:00:00' THEN 1 ELSE 0 END) + (CASE WHEN ts >= TIMESTAMP '2024-01-21 00:00:00' THEN 1 ELSE 0 END) + (CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END))"


@query("str2_hourly_stream", f"""WITH w AS (SELECT *, {_WAVES} AS wave, date_trunc('hour', ts) AS h FROM events),
 m AS (SELECT wave, max(max(ts)) OVER (ORDER BY wave) - INTERVAL 1 DAY AS mark FROM w GROUP BY wave)
 SELECT event_type, CAST(h AS DATE) AS day, {B('hour(h)')} AS hour, {B('count(*)')} AS trip_count FROM w WHERE (wave = 1 OR h + INTERVAL 1 HOUR > (SELECT mark FROM m WHERE m.wave = w.wave - 1)) AND h + INTERVAL 1 HOUR <= (SELECT max(mark) FROM m) GROUP BY 1, 2, 3""", views=False)
def _(v):
    """Events as files of a stream in three waves; the stream ends with each and is taken up from its checkpoint. Late rows are in it while their hour is open."""
    at = new_path(v.spark, "hours")
    x = v.table("events").select("event_id", "event_type", "ts").withColumn("wave", F.expr(_WAVES)).withColumn("ts", F.col("ts").cast("timestamp"))
    x = staged(x, "waves")
    for wave in (1, 2, 3):
        x.where(F.col("wave") == wave).drop("wave").write.mode("append").parquet(f"{at}/in")
        maintain.hourly_stream(v.spark, f"{at}/in", f"{at}/out", x.drop("wave").schema, f"{at}/state", "ts", ["event_type"]).awaitTermination()
    y = v.spark.read.schema("event_type string, hour_start timestamp, trip_count long").parquet(f"{at}/out")
    return y.select("event_type", F.to_date("hour_start").alias("day"), F.hour("hour_start").alias("hour"), "trip_count")


_MONTHLY = ["year", "month", "PULocationID", "dataset"]


def _month_panel(trips: DataFrame) -> DataFrame:
    return pn.zone_hour_panel(trips, _MONTHLY)


@query("snk2_incremental_panel", f"SELECT {B('year(pickup_datetime)')} AS year, {B('month(pickup_datetime)')} AS month, {B('PULocationID')} AS \"PULocationID\", dataset, {PANEL_SQL} FROM clean GROUP BY year(pickup_datetime), month(pickup_datetime), PULocationID, dataset")
def _(v):
    """Trip files arrive in two waves, the second with later months and with trips of months that were done; the panel's months that they touch are made anew."""
    at = new_path(v.spark, "monthly")
    trips = staged(v.trips.withColumn("second", (F.col("pickup_datetime") >= F.lit("1998-06-01").cast("timestamp_ntz")) | ((F.col("PULocationID") == 3) & (F.year("pickup_datetime") == 1997))), "trips")
    clean = lambda d: pn.clean_trips(d, START, END)
    for second in (False, True):
        trips.where(F.col("second") == second).drop("second").write.mode("append").parquet(f"{at}/in")
        maintain.maintain_panel(v.spark, f"{at}/in", f"{at}/trips", f"{at}/panel", trips.drop("second").schema, f"{at}/state", clean, _month_panel).awaitTermination()
    return v.spark.read.parquet(f"{at}/panel").select(*_MONTHLY, "trip_count", "avg_distance", "avg_duration_min", "std_duration_min", "median_duration_min", "p10_duration_min", "p90_duration_min", "avg_passengers")


@query("dq4_rewritten_output", f"SELECT mode, {B('count(*)')} AS n_cells, {R('sum(n)')} AS total, {B('sum(hour // 12)')} AS afternoons, true AS was_obsolete FROM od WHERE mode IN ('green', 'via') GROUP BY mode UNION ALL SELECT mode, {B('count(*)')}, {R('sum(n)')}, {B('sum(hour // 12)')}, false FROM od WHERE mode NOT IN ('green', 'via') GROUP BY mode")
def _(v):
    """An output by mode of which two partitions lack a column that is written today: those are found by their footers and written anew."""
    at = new_path(v.spark, "output")
    today = v.od.withColumn("half", F.expr("hour div 12"))
    old = F.col("mode").isin("green", "via")
    sinks.write_partitioned(today.where(old).drop("half"), at, by=["mode"])
    sinks.write_partitioned(today.where(~old), at, by=["mode"])
    done = maintain.rewrite_obsolete(v.spark, at, "half", ["mode"], lambda modes: today.join(modes, "mode", "left_semi"))
    x = v.spark.read.option("mergeSchema", True).parquet(at).groupBy("mode").agg(F.count("*").alias("n_cells"), F.sum("n").alias("total"), F.sum("half").alias("afternoons"))
    return x.join(done.withColumn("was_obsolete", F.lit(True)), "mode", "left").withColumn("was_obsolete", F.coalesce("was_obsolete", F.lit(False)))


@query("jon3_bucketed_flows", _FLOWS + f"SELECT {B('origin')} AS origin, {B('dest')} AS dest, {B('count(*)')} AS n, {R('sum(flow)')} AS flow FROM flows GROUP BY origin, dest")
def _(v):
    """Entries and weights bucketed by their context, and joined bucket by bucket."""
    name = new_path(v.spark, "flows").rpartition("-")[2]
    n = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    e = fl.months_with_od(fl.with_calendar(v.entries), v.weights)
    tables = [f"zonehour_entries_{name}", f"zonehour_weights_{name}"]
    e = sinks.write_bucketed(e, tables[0], ["station", *fl.CONTEXT[1:]], n)
    w = sinks.write_bucketed(v.weights, tables[1], fl.CONTEXT, n)
    x = staged(fl.estimate_flows(e, w, whole_months=False, hot_rows=None).groupBy("origin", "dest").agg(F.count("*").alias("n"), F.sum("flow").alias("flow")), "flows")
    for t in tables:
        v.spark.sql(f"DROP TABLE {t}")
    return x


@query("src3_pruned_months", f", big AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'P') SELECT mode, {B('count(*)')} AS n_cells, {R('sum(n)')} AS total FROM od WHERE EXISTS (SELECT 1 FROM big WHERE y = year(date) AND m = month(date)) GROUP BY mode")
def _(v):
    """A panel by year and month, of which those months are read that another table asks for."""
    at = new_path(v.spark, "by-month")
    sinks.write_partitioned(v.od.withColumns({"year": F.year("date"), "month": F.month("date")}), at, by=["year", "month"])
    o = v.table("orders").where("o_totalprice > 400000 AND o_orderstatus = 'P'").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.lit(1.0).alias("weight"))
    return fl.months_with_od(v.spark.read.parquet(at), o).groupBy("mode").agg(F.count("*").alias("n_cells"), F.sum("n").alias("total"))


_YEARLY = "y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)"


def _yearly_orders(v: Views) -> str:
    """Orders as a file a year, in two generations: a column goes, one comes, one changes its type."""
    at = new_path(v.spark, "yearly")
    o = v.table("orders").withColumn("y", F.year("o_orderdate")).repartition("y")
    o.where("y < 1998").select("y", "o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("float").alias("price")).write.partitionBy("y").parquet(at)
    o.where("y >= 1998").select("y", "o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus").write.mode("append").partitionBy("y").parquet(at)
    return at


@query("dq3_yearly_drift", f"WITH {_YEARLY} SELECT {B('y')} AS y, c AS \"column\", t AS change FROM y, (VALUES ('o_orderpriority', 'removed'), ('price', 'type changed'), ('o_orderstatus', 'added')) k(c, t) WHERE y >= 1998", views=False)
def _(v):
    """The files of each year against the first of all, by their footers."""
    f = footers.footers(v.spark, _yearly_orders(v))
    return footers.drift(f).select(F.regexp_extract("file_name", r"/y=(\d+)/", 1).cast("long").alias("y"), "column", "change").distinct()


@query("dq8_inventory", f"WITH {_YEARLY} SELECT {B('w')} AS y, n IS NOT NULL AS \"exists\", CASE WHEN n IS NOT NULL THEN 1 END AS n_files, {B('n')} AS n_rows FROM range(1990, 2001) r(w) LEFT JOIN y ON w = y", views=False)
def _(v):
    """Which years' files are there and how many rows they hold, by their footers."""
    f = footers.footers(v.spark, _yearly_orders(v)).withColumn("y", F.regexp_extract("file_name", r"/y=(\d+)/", 1).cast("int"))
    years = v.spark.range(1990, 2001).select(F.col("id").cast("int").alias("y"))
    return footers.expected(f, years, ["y"]).select("y", "exists", "n_files", "n_rows")


@query("src8_station_files", _LOCAL + f", u AS (SELECT *, {_utc_sql('local', 'event_id % 2 = 0')} AS at_utc FROM wall WHERE trim(REPORT_TYPE) IN ('FM-15', 'FM-16') AND event_id % 2 = 0) SELECT STATION, 2021 AS file_year, strftime(at_utc, {_STAMP}) AS at, {_PK} FROM u WHERE at_utc IS NOT NULL")
def _(v):
    """Hourly reports as CSV files by station and year; those of one year found by glob, station and year taken from the path, cleaned."""
    at = new_path(v.spark, "stations")
    x = v.weather.withColumn("DATE", F.concat(F.when(F.col("event_id") % 2 == 0, "2021-03-14").otherwise("2020-11-07"), F.date_format("ts", "'T'HH:mm:ss"))).drop("ts", "event_id")
    x = x.withColumn("file", F.concat("STATION", F.lit("_"), F.substring("DATE", 1, 4))).drop("STATION")
    x.write.partitionBy("file").option("header", True).option("escape", '"').csv(at)
    y = files.read_csv_named(v.spark, f"{at}/file=*_2021", x.drop("file").schema, r"/file=([^/_]+)_(\d{4})/", {"STATION": "string", "file_year": "int"})
    y = pp.clean_weather(y, more=["file_year"])
    return y.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("pip9_census_to_zones", _TRACTS + f", o AS {_overlay_sql('tract_edges', 'edges')}, c AS (SELECT *, area / sum(area) OVER (PARTITION BY a_id) AS w FROM o) SELECT {B('b_id')} AS b_id, {B('round_even(sum(population * w), 0)')} AS population, {B('round_even(sum(workers * w), 0)')} AS workers, {R('sum(income * population * w) / nullif(sum(CASE WHEN income IS NOT NULL THEN population * w END), 0)')} AS income FROM c JOIN tracts USING (a_id) GROUP BY b_id")
def _(v):
    """Census figures of tracts as CSV, read as text, cleaned, and dealt out to zones by the areas that tracts share with them."""
    at = new_path(v.spark, "census")
    sinks.write_csv(v.tracts, at)
    raw = files.read_csv_typed(v.spark, at, v.tracts.schema)
    figures = pp.clean_census(raw, ["population", "income", "workers"], {"worker_share": ("workers", "population")})
    return sp.zone_demographics(pp.crosswalk(v.tract_edges, v.edges, 1.0), figures, ["population", "workers"], ["income"], null_safe=True)
