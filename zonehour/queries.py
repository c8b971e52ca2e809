"""The registered queries of the engine, each with the SQL that says the same where SQL can.

Whole numbers come out as bigint and fractions rounded to four places, half up
with a hair's help, by the same arithmetic on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonehour import schemas
from zonehour.bindings import SQL, ZONES, Views
from zonehour.functions import clean as fc
from zonehour.functions import geo, time as ft, weather as fw
from zonehour.operators import flows as fl
from zonehour.operators import panel as pn
from zonehour.operators import spatial as sp
from zonehour.operators import tables as tb
from zonehour.plans import analytics as an
from zonehour.plans import pipelines as pp
from zonehour.shared import new_path
from zonehour.sources import files, footers
from zonehour.streaming.ingest import hourly_counts, ingest_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Spark's floor is a long, in which NaN is 0 and large values are cut off; SQL's stays a double.
            x = c.cast("double") * 10000 + 0.500001
            down = F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0)
            return (down / 10000).alias(f.name)
        return c

    return df.select(*map(one, df.schema.fields))


def R(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.500001) / 10000"


def B(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def query(name: str, sql: str | None = None, views: bool = True):
    """Registers a function of Views; sql follows the views' common table expressions."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(f(Views(spark, sf_dir)))
        if sql:
            # DuckDB reserves a word that names a column here.
            ORACLE_SQL[name] = re.sub(r"(?<![\w\"'])do(?![\w\"'])", '"do"', (SQL + sql) if views else sql)
        return f

    return add


PANEL_SQL = f"""{B('count(trip_distance)')} AS trip_count, {R('avg(trip_distance)')} AS avg_distance, {R('avg(duration_min)')} AS avg_duration_min, {R('stddev_samp(duration_min)')} AS std_duration_min,
 {R('quantile_cont(duration_min, 0.5)')} AS median_duration_min, {R('quantile_cont(duration_min, 0.1)')} AS p10_duration_min, {R('quantile_cont(duration_min, 0.9)')} AS p90_duration_min, {R('avg(passenger_count)')} AS avg_passengers"""
FARES = ["fare_amount", "tip_amount", "tax_amount"]
KEYS_SQL = f"{B('PULocationID')} AS PULocationID, {B('DOLocationID')} AS DOLocationID, date, {B('hour')} AS hour, dataset, hail_type"

# --- panel -------------------------------------------------------------------


@query("agg1_trip_panel", f"SELECT {KEYS_SQL}, {PANEL_SQL}, {', '.join(f'{R(f'avg({c})')} AS avg_{c}' for c in FARES)}, {R('avg(' + ' + '.join(f'coalesce({c}, 0)' for c in FARES) + ')')} AS avg_total FROM keyed GROUP BY PULocationID, DOLocationID, date, hour, dataset, hail_type")
def _(v):
    return pn.zone_hour_panel(v.keyed, fares=FARES)


@query("agg2_fare_means", f"SELECT dataset, {', '.join(f'{R(f'avg({c})')} AS avg_{c}' for c in FARES)} FROM keyed GROUP BY dataset")
def _(v):
    return v.keyed.groupBy("dataset").agg(*[F.avg(c).alias(f"avg_{c}") for c in FARES])


@query("agg3_street_hail", f"SELECT {B('PULocationID')} AS PULocationID, date, {B('count(trip_distance)')} AS trip_count, avg(CASE WHEN trip_type = 1 THEN 1.0 ELSE 0.0 END) >= 0.5 AS is_street_hail FROM keyed WHERE dataset = 'green' GROUP BY PULocationID, date")
def _(v):
    p = pn.zone_hour_panel(v.keyed.where("dataset = 'green'"), ["PULocationID", "date"], street_hail="trip_type")
    return p.select("PULocationID", "date", "trip_count", "is_street_hail")


@query("agg4_provider_panels", f"SELECT dataset, {B('hour')} AS hour, {PANEL_SQL} FROM keyed WHERE dataset NOT IN ('yellow', 'green') GROUP BY dataset, hour")
def _(v):
    return pn.zone_hour_panel(v.keyed.where(~F.col("dataset").isin("yellow", "green")), ["dataset", "hour"])


@query("agg5_station_coords", f"SELECT {B('user_id % 10')} AS station, {R('median(user_id / 30.0)')} AS lat, {R('median(value)')} AS lng FROM events GROUP BY user_id % 10", views=False)
def _(v):
    return fl.station_coords(v.events.select((F.col("user_id") % 10).alias("station"), (F.col("user_id") / 30.0).alias("lat"), F.col("value").alias("lng")))


@query("agg6_hourly_entries", f"SELECT {B('station')} AS station, date, {B('hour')} AS hour, fare_class, {R('ridership')} AS ridership FROM entries")
def _(v):
    return v.entries


@query("agg7_context_totals", f"SELECT {B('origin')} AS origin, {B('year')} AS year, {B('month')} AS month, dow, {B('hour')} AS hour, {R('sum(avg_ridership)')} AS total FROM od_raw WHERE avg_ridership > 0 GROUP BY ALL")
def _(v):
    return fl.context_totals(v.od_raw)


_FLOWS = """, covered AS (SELECT e.*, CAST(month(date) AS INT) AS month, dayname(date) AS dow FROM entries e WHERE EXISTS (SELECT 1 FROM weights w WHERE w.year = year(e.date) AND w.month = month(e.date))),
flows AS (SELECT e.date, e.hour, e.fare_class, e.month, coalesce(w.origin, e.station) AS origin, coalesce(w.dest, -1) AS dest, e.ridership, w.weight, e.ridership * w.weight AS flow
  FROM covered e LEFT JOIN weights w ON e.station = w.origin AND year(e.date) = w.year AND e.month = w.month AND e.dow = w.dow AND e.hour = w.hour),
zf AS (SELECT f.*, o.LocationID AS PULocationID, d.LocationID AS DOLocationID FROM flows f JOIN zones o ON f.origin + 1 = o.LocationID JOIN zones d ON f.dest + 1 = d.LocationID WHERE f.dest >= 0)
"""


def _lookup(v):
    return v.zones.select((F.col("LocationID") - 1).alias("station"), F.col("LocationID").alias("zone"))


@query("jon3_estimated_flows", _FLOWS + f"SELECT date, {B('hour')} AS hour, fare_class, {B('month')} AS month, {B('origin')} AS origin, {B('dest')} AS dest, {R('ridership')} AS ridership, {R('weight')} AS weight, {R('flow')} AS flow FROM flows")
def _(v):
    return fl.estimate_flows(v.entries, v.weights)


@query("jon4_months_with_od", f"SELECT {B('month(date)')} AS month, {B('count(*)')} AS n FROM entries e WHERE EXISTS (SELECT 1 FROM weights w WHERE w.year = year(e.date) AND w.month = month(e.date)) GROUP BY 1")
def _(v):
    return fl.months_with_od(fl.with_calendar(v.entries), v.weights).groupBy("month").agg(F.count("*").alias("n"))


@query("jon5_flows_to_zones", _FLOWS + f"SELECT {B('PULocationID')} AS PULocationID, {B('DOLocationID')} AS DOLocationID, {B('count(*)')} AS n, {R('sum(flow)')} AS flow FROM zf GROUP BY 1, 2")
def _(v):
    z = fl.flows_to_zones(fl.estimate_flows(v.entries, v.weights), _lookup(v))
    return z.groupBy("PULocationID", "DOLocationID").agg(F.count("*").alias("n"), F.sum("flow").alias("flow"))


@query("agg8_flow_panel", _FLOWS + f"SELECT {B('PULocationID')} AS PULocationID, {B('DOLocationID')} AS DOLocationID, date, {B('hour')} AS hour, fare_class, {R('sum(flow)')} AS trip_count FROM zf GROUP BY PULocationID, DOLocationID, date, hour, fare_class")
def _(v):
    return fl.flow_panel(fl.flows_to_zones(fl.estimate_flows(v.entries, v.weights), _lookup(v)))


@query("pip6_zone_flows", _FLOWS + f"SELECT {B('PULocationID')} AS PULocationID, {B('DOLocationID')} AS DOLocationID, date, {B('hour')} AS hour, {R('sum(flow)')} AS trip_count FROM zf GROUP BY PULocationID, DOLocationID, date, hour")
def _(v):
    return pp.zone_flows(v.entries, v.weights, _lookup(v), keep_fare_class=False)


@query("prj14_conform_flows", _FLOWS + f"SELECT dataset, hail_type, {B('sum(n)')} AS n, {R('sum(trip_count)')} AS trip_count FROM (SELECT 'mta' AS dataset, fare_class AS hail_type, 1 AS n, sum(flow) AS trip_count FROM zf GROUP BY PULocationID, DOLocationID, date, hour, fare_class) GROUP BY dataset, hail_type")
def _(v):
    p = fl.conform_flows(fl.flow_panel(fl.flows_to_zones(fl.estimate_flows(v.entries, v.weights), _lookup(v))))
    return p.groupBy("dataset", "hail_type").agg(F.count("*").alias("n"), F.sum("trip_count").alias("trip_count"))


@query("dq6_match_report", _FLOWS + f"SELECT {B('month')} AS month, {B('count(*)')} AS n_rows, {B('count(*) FILTER (weight IS NULL)')} AS n_unmatched, {R('sum(flow)')} AS flow FROM flows GROUP BY month")
def _(v):
    return fl.match_report(fl.estimate_flows(v.entries, v.weights))


@query("win1_conditional_weights", f"SELECT {B('origin')} AS origin, {B('year')} AS year, {B('month')} AS month, dow, {B('hour')} AS hour, {B('dest')} AS dest, {R('avg_ridership')} AS avg_ridership, {R('weight')} AS weight FROM weights")
def _(v):
    return v.weights


@query("dq1_weight_check", f"SELECT {B('count(*)')} AS n_contexts, {R('max(abs(s - 1))')} AS max_deviation FROM (SELECT sum(weight) AS s FROM weights GROUP BY origin, year, month, dow, hour)")
def _(v):
    return fl.weight_check(v.weights)


_BIKE = """, bk AS (SELECT *, CAST(started_at AS DATE) AS date, CAST(hour(started_at) AS INT) AS hour, date_diff('microsecond', started_at, ended_at) / 60000000.0 AS duration_min,
  2 * 6371.0 * asin(sqrt(least(power(sin(radians(end_lat - start_lat) / 2), 2) + cos(radians(start_lat)) * cos(radians(end_lat)) * power(sin(radians(end_lng - start_lng) / 2), 2), 1.0))) AS km FROM bikes WHERE member_casual IS NOT NULL)
"""


def _bikes(v):
    return pp.clean_bikes(v.bikes.withColumnRenamed("usertype", "member_casual"), 2021, 2025)


@query("mth_haversine", _BIKE + f"SELECT started_at, {R('start_lat')} AS start_lat, {R('end_lat')} AS end_lat, {R('km')} AS km FROM bk")
def _(v):
    return sp.trip_km(_bikes(v), "km").select("started_at", "start_lat", "end_lat", "km")


def _distance(points: str, edges: str) -> str:
    """(px, py, zone_id, distance) of points and edges, all against all."""
    return f"""(SELECT px, py, zone_id, sqrt((px - x1 - t * ex) * (px - x1 - t * ex) + (py - y1 - t * ey) * (py - y1 - t * ey)) AS distance
 FROM (SELECT *, greatest(0.0, least(1.0, ((px - x1) * ex + (py - y1) * ey) / (ex * ex + ey * ey))) AS t FROM (SELECT p.*, e.*, x2 - x1 AS ex, y2 - y1 AS ey FROM {points} p, {edges} e)))"""


def _first(zones: str) -> str:
    """The nearest zone of each point of _distance; borders less than 1e-9 apart are a tie."""
    return f"(SELECT px, py, min_by(zone_id, [floor(distance * 1000000000 + 0.5), zone_id]) AS zone_id, min(distance) AS distance FROM {zones} GROUP BY px, py)"


_PLACES = f""", places AS (SELECT start_lng AS px, start_lat AS py FROM bk UNION SELECT end_lng, end_lat FROM bk),
 inside AS (SELECT px, py, min(zone_id) AS zone_id FROM (SELECT px, py, zone_id FROM places, edges WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL),
 zoned AS (SELECT * FROM inside UNION ALL SELECT px, py, zone_id FROM {_first(_distance('(SELECT * FROM places ANTI JOIN inside USING (px, py))', 'edges'))})
"""


@query("agg9_bike_panel", _BIKE + _PLACES + f"""SELECT {B('s.zone_id')} AS start_zone, {B('e.zone_id')} AS end_zone, date, {B('hour')} AS hour, member_casual, rideable_type, {B('count(km)')} AS n_trips, {R('avg(km)')} AS avg_distance_km, {R('avg(duration_min)')} AS mean_duration_min,
  {R('stddev_samp(duration_min)')} AS std_duration_min, {R('quantile_cont(duration_min, 0.1)')} AS p10_duration_min, {R('quantile_cont(duration_min, 0.5)')} AS median_duration_min, {R('quantile_cont(duration_min, 0.9)')} AS p90_duration_min
  FROM bk JOIN zoned s ON s.px = start_lng AND s.py = start_lat JOIN zoned e ON e.px = end_lng AND e.py = end_lat WHERE duration_min > 0 AND duration_min <= 300 AND rideable_type <> 'unknown' AND s.zone_id > 0 AND e.zone_id > 0 GROUP BY s.zone_id, e.zone_id, date, hour, member_casual, rideable_type""")
def _(v):
    return pp.bike_panel(pp.bikes_to_zones(_bikes(v), v.edges, project=False, cell=1.0))


@query("agg10_merge_summaries", f", part AS (SELECT dataset, hour, count(*) AS n_trips, avg(duration_min) AS mean_min, median(duration_min) AS median_min, stddev_samp(duration_min) AS std_min, quantile_cont(duration_min, 0.1) AS p10_min, quantile_cont(duration_min, 0.9) AS p90_min FROM keyed GROUP BY dataset, hour) SELECT dataset, {B('sum(n_trips)')} AS n_trips, {R('sum(mean_min * n_trips) / sum(n_trips)')} AS mean_min, {R('avg(median_min)')} AS median_min, {R('avg(std_min)')} AS std_min, {R('min(p10_min)')} AS p10_min, {R('max(p90_min)')} AS p90_min FROM part GROUP BY dataset")
def _(v):
    d = "duration_min"
    part = v.keyed.groupBy("dataset", "hour").agg(F.count("*").alias("n_trips"), F.avg(d).alias("mean_min"), F.median(d).alias("median_min"), F.stddev_samp(d).alias("std_min"), F.percentile(d, 0.1).alias("p10_min"), F.percentile(d, 0.9).alias("p90_min"))
    return pn.merge_summaries(part, ["dataset"])


# --- scans, sinks, projections -------------------------------------------------


@query("src1_select_existing", f"SELECT {B('l_orderkey')} AS id, {R('l_quantity')} AS quantity FROM lineitem", views=False)
def _(v):
    return tb.select_existing(v.table("lineitem"), ["id", "quantity", "absent"], {"id": ("order_id", "l_orderkey"), "quantity": ("L_QUANTITY", "l_quantity")})


@query("src3_pushed_filter", f"SELECT {B('o_orderkey')} AS o_orderkey, {R('o_totalprice')} AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01' AND o_orderstatus = 'O'", views=False)
def _(v):
    x = v.table("orders").where((F.col("o_orderdate") >= F.lit("1996-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-04-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O"))
    return x.select("o_orderkey", "o_totalprice")


@query("src6_one_per_month", "SELECT 'trips_' || strftime(o_orderdate, '%Y-%m') || '_' || min(strftime(o_orderdate, '%d')) || '.csv' AS file_name, strftime(o_orderdate, '%Y-%m') AS month_key FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY strftime(o_orderdate, '%Y-%m')", views=False)
def _(v):
    names = v.table("orders").select(F.concat(F.lit("trips_"), F.date_format("o_orderdate", "yyyy-MM_dd"), F.lit(".csv")).alias("file_name")).distinct()
    return files.one_per_month(files.prune_files_by_year(names, 1997, exclude_prefixes=("JC", "__MACOSX")))


@query("src10_header_json", f"SELECT lpad(CAST(s_nationkey AS STRING), 2, '0') || '000' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS GEOID, {B('s_suppkey')} AS tract FROM supplier", views=False)
def _(v):
    s = v.table("supplier").select(F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("state"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("tract"))
    rows = s.groupBy("state").agg(F.collect_list(F.array("state", F.lit("000"), "tract")).alias("rows"))
    doc = rows.select(F.to_json(F.concat(F.array(F.array(F.lit("state"), F.lit("county"), F.lit("tract"))), "rows")).alias("doc"))
    t = files.table_from_header_json(doc, "doc", ["tract", "state", "county"])
    return t.select(F.concat("state", "county", "tract").alias("GEOID"), F.col("tract").try_cast("long").alias("tract"))


@query("src13_sql_scan", f"SELECT l_returnflag, l_linestatus, {B('count(*)')} AS n, {R('sum(l_quantity)')} AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus", views=False)
def _(v):
    return v.spark.sql(f"SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM parquet.`{v.dir}/lineitem.parquet` GROUP BY l_returnflag, l_linestatus")


@query("src15_head_sample", f"SELECT {B('o_orderkey')} AS o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20", views=False)
def _(v):
    return tb.preview(v.table("orders"), ["o_orderkey", "o_orderpriority"], limit=20, order=["o_orderkey"])


@query("src16_unify_modes", f"SELECT mode, {B('pu')} AS pu, {B('do')} AS do, date, {B('hour')} AS hour, {R('n')} AS n FROM od WHERE n > 0")
def _(v):
    return v.od


@query("set1_union_modes", f", b AS (SELECT 'bike' AS mode, CAST(started_at AS DATE) AS date, 1 AS n FROM bikes WHERE member_casual IS NOT NULL) SELECT mode, {B('count(*)')} AS n_cells, {R('sum(n)')} AS total FROM (SELECT mode, n FROM od UNION ALL SELECT mode, n FROM b) GROUP BY mode")
def _(v):
    b = _bikes(v).select(F.lit(1).alias("pu"), F.lit(1).alias("do"), F.to_date("started_at").alias("date"), F.hour("started_at").alias("hour"), F.lit(1).alias("n"))
    x = v.od.unionByName(pn.unify_modes([pn.ModeSource("bike", b, "pu", "do", "n")]))
    return x.groupBy("mode").agg(F.count("*").alias("n_cells"), F.sum("n").alias("total"))


@query("snk6_nested_json", ", z AS (SELECT mode, CAST(hour AS STRING) AS hour, CAST(pu AS STRING) AS pu, CAST(sum(n) AS BIGINT) AS n FROM od GROUP BY mode, hour, pu), h AS (SELECT mode, hour, '{' || string_agg('\"' || pu || '\":' || n, ',' ORDER BY pu) || '}' AS d FROM z GROUP BY mode, hour) SELECT mode, '{' || string_agg('\"' || hour || '\":' || d, ',' ORDER BY hour) || '}' AS doc FROM h GROUP BY mode")
def _(v):
    x = v.od.groupBy("mode", "hour", "pu").agg(F.sum("n").cast("long").alias("n"))
    return an.nested_json(x, ["mode", "hour", "pu"], "n")


@query("prj1_aliases", f"SELECT {B('c_custkey')} AS id, c_name AS name FROM customer", views=False)
def _(v):
    return tb.apply_aliases(v.table("customer"), {"c_custkey": "id", "c_name": "name", "nope": "x"}).select("id", "name")


@query("prj4_conform", f"SELECT {B('s_suppkey')} AS s_suppkey, CAST(s_nationkey AS STRING) AS s_nationkey, CAST(NULL AS DOUBLE) AS rating FROM supplier", views=False)
def _(v):
    return tb.conform(v.table("supplier"), T.StructType().add("s_suppkey", T.IntegerType()).add("s_nationkey", T.StringType()).add("rating", T.FloatType()))


@query("prj5_try_num", f"SELECT {B('o_orderkey')} AS id, {R('TRY_CAST(left(o_orderpriority, 1) AS DOUBLE)')} AS priority, TRY_CAST(o_orderpriority AS DOUBLE) AS none FROM orders", views=False)
def _(v):
    p = F.col("o_orderpriority")
    return v.table("orders").select(F.col("o_orderkey").alias("id"), fc.try_num(F.substring(p, 1, 1)).alias("priority"), fc.try_num(p).alias("none"))


@query("prj6_null_outside", f"SELECT {B('passenger_count')} AS passenger_count, {B('count(*)')} AS n FROM clean GROUP BY passenger_count")
def _(v):
    return v.clean.groupBy("passenger_count").agg(F.count("*").alias("n"))


@query("prj7_sentinels", f"SELECT {B('event_id')} AS event_id, {B('CASE WHEN user_id NOT IN (13, 77) THEN user_id END')} AS user_id FROM events", views=False)
def _(v):
    return v.events.select("event_id", fc.null_if_in(F.col("user_id"), [13, 77]).alias("user_id"))


@query("prj9_value_map", f"SELECT member_casual, {B('count(*)')} AS n FROM bikes GROUP BY member_casual")
def _(v):
    return v.bikes.select(fc.map_values(F.lower(F.trim("usertype")), schemas.MEMBERS).alias("member_casual")).groupBy("member_casual").agg(F.count("*").alias("n"))


@query("prj10_providers", f"SELECT dataset, {B('count(*)')} AS n FROM keyed GROUP BY dataset")
def _(v):
    return v.keyed.groupBy("dataset").agg(F.count("*").alias("n"))


@query("prj11_whitelist", f"SELECT rideable_type, {B('count(*)')} AS n FROM bikes GROUP BY rideable_type")
def _(v):
    return v.bikes.select(fc.whitelist(F.col("rideable_type"), schemas.RIDEABLES).alias("rideable_type")).groupBy("rideable_type").agg(F.count("*").alias("n"))


@query("prj12_hail_type", f"SELECT hail_type, {B('count(*)')} AS n FROM keyed GROUP BY hail_type")
def _(v):
    return v.keyed.groupBy("hail_type").agg(F.count("*").alias("n"))


@query("prj13_row_total", f"SELECT dataset, {R('sum(fare_amount + tip_amount + coalesce(tax_amount, 0))')} AS total FROM keyed GROUP BY dataset")
def _(v):
    return v.keyed.groupBy("dataset").agg(F.sum(fc.row_total([F.col(c) for c in FARES])).alias("total"))


_TRACTS = """, raw AS (SELECT a_id, count(*) AS p, sum(CAST(floor(c_acctbal) AS BIGINT)) AS i FROM homes GROUP BY 1),
tracts AS (SELECT a_id, CASE WHEN a_id % 11 = 3 THEN 0.0 WHEN a_id % 11 = 4 THEN NULL ELSE CAST(p AS DOUBLE) END AS population, CASE WHEN a_id % 7 IN (2, 3) THEN NULL ELSE CAST(i AS DOUBLE) END AS income, CAST(p % 17 AS DOUBLE) AS workers FROM raw)
"""


def _census(v):
    return pp.clean_census(v.tracts, ["population", "income", "workers"], {"worker_share": ("workers", "population")})


@query("prj15_census_shares", _TRACTS + f"SELECT {B('a_id')} AS a_id, {R('population')} AS population, {R('income')} AS income, {R('workers')} AS workers, {R('workers / nullif(population, 0)')} AS worker_share, coalesce(population, 0) = 0 AS zero_population FROM tracts")
def _(v):
    return _census(v)


@query("prj17_string_ids", f"SELECT {B('event_id')} AS event_id, CASE WHEN user_id % 9 <> 0 THEN CAST(user_id AS STRING) END AS station FROM events", views=False)
def _(v):
    return v.bikes.select("event_id", F.nullif("start_station_id", F.lit("nan")).alias("station"))


# --- filters -----------------------------------------------------------------


@query("flt_trip_rules", f"""SELECT dataset, {B('count(*)')} AS n_in, {B('count(*)')} AS ok_times, {B("count(*) FILTER (pickup_datetime >= TIMESTAMP '1996-01-01' AND pickup_datetime < TIMESTAMP '2001-01-01')")} AS ok_window, {B('count(*) FILTER (dropoff_datetime > pickup_datetime)')} AS ok_duration,
  {B('count(*) FILTER (trip_distance > 0)')} AS ok_distance, {B('count(*) FILTER (fare_amount > 0)')} AS ok_fare, {B("count(*) FILTER (pickup_datetime >= TIMESTAMP '1996-01-01' AND pickup_datetime < TIMESTAMP '2001-01-01' AND dropoff_datetime > pickup_datetime AND trip_distance > 0 AND fare_amount > 0)")} AS n_kept,
  {R("100.0 * count(*) FILTER (pickup_datetime >= TIMESTAMP '1996-01-01' AND pickup_datetime < TIMESTAMP '2001-01-01' AND dropoff_datetime > pickup_datetime AND trip_distance > 0 AND fare_amount > 0) / count(*)")} AS kept_pct FROM trips GROUP BY dataset""")
def _(v):
    return tb.drop_report(v.trips, pn.trip_rules(v.trips, "1996-01-01", "2001-01-01"), ["dataset"])


@query("flt3_closed_window", f"SELECT {B('event_id')} AS event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-05 18:00:00'", views=False)
def _(v):
    return v.events.where(F.col("ts").between(F.lit("2024-01-03 06:00:00").cast("timestamp_ntz"), F.lit("2024-01-05 18:00:00").cast("timestamp_ntz"))).select("event_id")


@query("flt7_bike_filter", _BIKE + f"SELECT member_casual, {B('count(*)')} AS n FROM bk WHERE duration_min > 0 AND duration_min <= 300 AND rideable_type <> 'unknown' GROUP BY member_casual")
def _(v):
    d = ft.duration_min(F.col("started_at"), F.col("ended_at"))
    x = tb.quality_filter(_bikes(v), [tb.Rule("duration", (d > 0) & (d <= 300)), tb.Rule("vehicle", F.col("rideable_type") != "unknown")])
    return x.groupBy("member_casual").agg(F.count("*").alias("n"))


@query("flt9_report_types", f"SELECT STATION, {B('count(*)')} AS n FROM weather WHERE trim(REPORT_TYPE) IN ('FM-15', 'FM-16') GROUP BY STATION")
def _(v):
    return v.weather.where(F.trim("REPORT_TYPE").isin("FM-15", "FM-16")).groupBy("STATION").agg(F.count("*").alias("n"))


@query("flt13_no_loops", f"SELECT mode, {B('count(*)')} AS n FROM od WHERE pu <> do AND pu NOT IN (264, 265, 3) AND do NOT IN (264, 265, 3) GROUP BY mode")
def _(v):
    return an.between_zones(v.od, (264, 265, 3)).groupBy("mode").agg(F.count("*").alias("n"))


@query("flt15_populated_tracts", _TRACTS + f"SELECT {B('a_id')} AS a_id FROM tracts WHERE a_id IN (1, 2, 3, 4, 14, 15, 20, 25, 26, 37) AND coalesce(population, 0) > 0")
def _(v):
    return _census(v).where(F.col("a_id").isin(1, 2, 3, 4, 14, 15, 20, 25, 26, 37) & ~F.coalesce("zero_population", F.lit(True))).select("a_id")


@query("flt16_preview", f"SELECT {B('p_partkey')} AS p_partkey, p_brand, {B('p_size')} AS p_size FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')", views=False)
def _(v):
    return tb.preview(v.table("part"), ["p_partkey", "p_brand", "p_size"], ranges={"p_size": (5, 15)}, isin={"p_brand": ["Brand#11", "Brand#12", "Brand#23"]})


@query("flt17_any_nonzero", f"SELECT {B('l_linenumber')} AS l_linenumber, {B('count(*)')} AS n FROM lineitem WHERE l_tax <> 0 OR l_discount <> 0 GROUP BY l_linenumber", views=False)
def _(v):
    return v.table("lineitem").where(fc.any_nonzero([F.col("l_tax"), F.col("l_discount")])).groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query("flt18_drop_null", f"SELECT {B('count(*)')} AS n FROM bikes WHERE member_casual IS NOT NULL")
def _(v):
    return v.bikes.withColumn("member_casual", fc.map_values(F.lower(F.trim("usertype")), schemas.MEMBERS)).dropna(subset=["started_at", "member_casual"]).agg(F.count("*").alias("n"))


# --- joins -------------------------------------------------------------------


@query("jon1_left_dim", f"SELECT {B('station')} AS station, {B('count(*)')} AS n, {R('max(lat)')} AS lat FROM entries LEFT JOIN (SELECT user_id % 10 AS s, median(user_id / 30.0) AS lat FROM events WHERE user_id % 10 < 7 GROUP BY 1) ON station = s GROUP BY station")
def _(v):
    c = fl.station_coords(v.events.where("user_id % 10 < 7").select((F.col("user_id") % 10).cast("int").alias("station"), (F.col("user_id") / 30.0).alias("lat"), F.col("value").alias("lng")))
    return v.entries.join(c, "station", "left").groupBy("station").agg(F.count("*").alias("n"), F.max("lat").alias("lat"))


@query("jon11_zone_names", f"SELECT {B('pu')} AS pu, zone, borough, {R('sum(n)')} AS total FROM od LEFT JOIN zones ON pu = LocationID GROUP BY pu, zone, borough")
def _(v):
    t = v.od.groupBy("pu").agg(F.sum("n").alias("total"))
    return tb.attach_dim(t, v.zones, "LocationID", {"pu": ""})


@query("jon12_two_roles", f"SELECT a.borough AS pu_borough, b.borough AS do_borough, {R('sum(n)')} AS total FROM od LEFT JOIN zones a ON pu = a.LocationID LEFT JOIN zones b ON do = b.LocationID GROUP BY a.borough, b.borough")
def _(v):
    x = tb.attach_dim(v.od, v.zones.select("LocationID", "borough"), "LocationID", {"pu": "pu_", "do": "do_"})
    return x.groupBy("pu_borough", "do_borough").agg(F.sum("n").alias("total"))


@query("jon14_missing_files", "SELECT m AS month FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders) WHERE m NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_totalprice > (SELECT 0.99 * max(o_totalprice) FROM orders))", views=False)
def _(v):
    o = v.table("orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    present = o.where(F.col("o_totalprice") > 0.99 * o.agg(F.max("o_totalprice")).first()[0]).select("month").distinct()
    return tb.missing_of(o.select("month").distinct(), present, ["month"])


# --- space -------------------------------------------------------------------


@query("geo1_edges", f"SELECT {B('zone_id')} AS zone_id, {R('x1')} AS x1, {R('y1')} AS y1, {R('x2')} AS x2, {R('y2')} AS y2, {B('s')} AS s FROM edges")
def _(v):
    return v.edges.drop("ring")


_G = geo
_EPSG = f"""SELECT {B('event_id')} AS event_id, {R(f'({_G.FALSE_EAST!r} + rho * sin(theta)) / {_G.FOOT!r}')} AS x, {R(f'({_G.RHO0!r} - rho * cos(theta)) / {_G.FOOT!r}')} AS y FROM (SELECT event_id, {_G.SCALE!r} * power(tan({_G.math.pi / 4!r} - p / 2) / power((1 - es) / (1 + es), {_G.E1 / 2!r}), {_G.N!r}) AS rho, {_G.N!r} * (radians(lng) - ({_G.LAM0!r})) AS theta
 FROM (SELECT event_id, radians(40 + user_id / 150.0) AS p, {_G.E1!r} * sin(radians(40 + user_id / 150.0)) AS es, -74.5 + value / 490 AS lng FROM events))"""


@query("geo2_projection", _EPSG, views=False)
def _(v):
    x, y = geo.to_epsg2263(40 + F.col("user_id") / 150.0, -74.5 + F.col("value") / 490)
    return v.events.select("event_id", x.alias("x"), y.alias("y"))


@query("geo3_point_in_polygon", f"SELECT {B('event_id')} AS event_id, {B('zone_id')} AS zone_id FROM points JOIN within USING (px, py)")
def _(v):
    return v.points.join(sp.points_within(v.points, v.edges), ["px", "py"]).select("event_id", "zone_id")


_NEAR = f""", few AS (SELECT * FROM edges WHERE zone_id % 7 <> 0), inside AS (SELECT px, py, zone_id FROM (SELECT DISTINCT px, py FROM points), few WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
nearest AS {_first(_distance('(SELECT DISTINCT px, py FROM points ANTI JOIN inside USING (px, py))', 'few'))}
"""


@query("geo4_nearest_zone", _NEAR + f"SELECT {R('px')} AS px, {R('py')} AS py, {B('zone_id')} AS zone_id, {R('distance')} AS distance FROM nearest")
def _(v):
    some = v.edges.where("zone_id % 7 <> 0")
    rest = v.points.select("px", "py").distinct().join(sp.points_within(v.points, some), ["px", "py"], "left_anti")
    return sp.nearest_zone(rest, some)


@query("jon8_nearest_within", _NEAR + f"SELECT {R('px')} AS px, {R('py')} AS py, {B('zone_id')} AS zone_id, {R('distance')} AS distance FROM nearest WHERE distance <= 0.2")
def _(v):
    some = v.edges.where("zone_id % 7 <> 0")
    rest = v.points.select("px", "py").distinct().join(sp.points_within(v.points, some), ["px", "py"], "left_anti")
    return sp.nearest_zone(rest, some, max_distance=0.2)


def _overlay_sql(a: str, b: str) -> str:
    return f"""(SELECT a_id, b_id, sum(sa * sb * CASE WHEN d0 * d1 < 0 THEN w * (t * (least(a0, b0) + a0 + t * (a1 - a0)) / 2 + (1 - t) * (a0 + t * (a1 - a0) + least(a1, b1)) / 2) ELSE w * (least(a0, b0) + least(a1, b1)) / 2 END) AS area
 FROM (SELECT *, hi - lo AS w, a0 - b0 AS d0, a1 - b1 AS d1, (a0 - b0) / nullif((a0 - b0) - (a1 - b1), 0) AS t FROM (SELECT a_id, b_id, sa, sb, lo, hi, ay1 + (ay2 - ay1) * (lo - ax1) / (ax2 - ax1) AS a0, ay1 + (ay2 - ay1) * (hi - ax1) / (ax2 - ax1) AS a1, by1 + (by2 - by1) * (lo - bx1) / (bx2 - bx1) AS b0, by1 + (by2 - by1) * (hi - bx1) / (bx2 - bx1) AS b1
 FROM (SELECT a.zone_id AS a_id, b.zone_id AS b_id, a.s AS sa, b.s AS sb, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, greatest(least(a.x1, a.x2), least(b.x1, b.x2)) AS lo, least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) AS hi FROM {a} a, {b} b WHERE a.x1 <> a.x2 AND b.x1 <> b.x2) WHERE lo < hi)) GROUP BY a_id, b_id HAVING area > 0.000001)"""


@query("geo5_overlay", f", o AS {_overlay_sql('tract_edges', 'edges')} SELECT {B('a_id')} AS a_id, {B('b_id')} AS b_id, {R('area')} AS area, {R('area / sum(area) OVER (PARTITION BY a_id)')} AS area_weight FROM o")
def _(v):
    return sp.area_weights(sp.overlay_area(v.tract_edges, v.edges))


@query("pip9_crosswalk", f", o AS {_overlay_sql('tract_edges', 'edges')} SELECT {B('a_id')} AS a_id, {B('b_id')} AS b_id, {R('area')} AS area, {R('area / sum(area) OVER (PARTITION BY a_id)')} AS area_weight, {R('sum(area) OVER (PARTITION BY a_id) / 0.0625')} AS coverage FROM o")
def _(v):
    return pp.crosswalk(v.tract_edges, v.edges, 1.0)


@query("agg11_zone_demographics", _TRACTS + f", o AS {_overlay_sql('tract_edges', 'edges')}, c AS (SELECT *, area / sum(area) OVER (PARTITION BY a_id) AS w FROM o) SELECT {B('b_id')} AS b_id, {B('round_even(sum(workers * w), 0)')} AS workers, {R('sum(income * population * w) / nullif(sum(population * w), 0)')} AS income FROM c JOIN tracts USING (a_id) GROUP BY b_id")
def _(v):
    return sp.zone_demographics(sp.area_weights(sp.overlay_area(v.tract_edges, v.edges)), _census(v), ["workers"], ["income"])


@query("agg12_null_safe_means", _TRACTS + f", o AS {_overlay_sql('tract_edges', 'edges')}, c AS (SELECT *, area / sum(area) OVER (PARTITION BY a_id) AS w FROM o) SELECT {B('b_id')} AS b_id, {R('sum(income * population * w) / nullif(sum(CASE WHEN income IS NOT NULL THEN population * w END), 0)')} AS income FROM c JOIN tracts USING (a_id) GROUP BY b_id")
def _(v):
    return sp.zone_demographics(sp.area_weights(sp.overlay_area(v.tract_edges, v.edges)), _census(v), [], ["income"], null_safe=True)


@query("geo6_distinct_points", f"SELECT {B('zone_id')} AS zone_id, {B('count(*)')} AS n FROM points JOIN within USING (px, py) GROUP BY zone_id")
def _(v):
    x = sp.assign_zones(v.points, {"zone_id": ("px", "py")}, v.edges, nearest=False)
    return x.where("zone_id is not null").groupBy("zone_id").agg(F.count("*").alias("n"))


@query("set3_distinct_places", f"SELECT {B('count(*)')} AS n FROM (SELECT start_lat AS lat, start_lng AS lng FROM bikes UNION SELECT end_lat, end_lng FROM bikes)")
def _(v):
    a = v.bikes.select(F.col("start_lat").alias("lat"), F.col("start_lng").alias("lng"))
    return a.union(v.bikes.select("end_lat", "end_lng")).distinct().agg(F.count("*").alias("n"))


@query("win9_first_seen", f"SELECT {B('user_id % 10')} AS station, {R('min(value)')} AS lat FROM events WHERE event_type = 'click' GROUP BY user_id % 10", views=False)
def _(v):
    x = v.events.select((F.col("user_id") % 10).alias("station"), F.col("value").alias("lat"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("p"))
    return fl.first_seen(x, "station", ["lat"], F.col("p"))


# --- scalars -----------------------------------------------------------------


@query("dat_parts", f"SELECT {B('event_id')} AS event_id, date, {B('hour')} AS hour, {B('year(ts)')} AS year, {B('month(ts)')} AS month, {B('quarter(ts)')} AS quarter, dayname(ts) AS day, {B('dayofweek(ts)')} AS dow, CASE WHEN hour BETWEEN 6 AND 8 THEN 'Morning' WHEN hour BETWEEN 9 AND 14 THEN 'Midday' WHEN hour BETWEEN 15 AND 17 THEN 'Evening' ELSE 'Night' END AS block, year(ts) || ' Q' || quarter(ts) AS yq, strftime(ts, '%Y-%m') AS ym FROM ev")
def _(v):
    d = F.col("ts")
    return v.events.select("event_id", "date", "hour", F.year(d).alias("year"), F.month(d).alias("month"), F.quarter(d).alias("quarter"), ft.dow_name(d).alias("day"), ft.dow0(d).alias("dow"), ft.time_block(F.col("hour")).alias("block"), ft.year_quarter(d).alias("yq"), ft.year_month(d).alias("ym"))


@query("dat_duration", f"SELECT {B('count(*)')} AS n, {R('min(duration_min)')} AS least, {R('avg(duration_min)')} AS mean, {R('max(duration_min)')} AS most FROM clean")
def _(v):
    return v.clean.agg(F.count("*").alias("n"), F.min("duration_min").alias("least"), F.avg("duration_min").alias("mean"), F.max("duration_min").alias("most"))


@query("dat_parse_ampm", f"SELECT {B('event_id')} AS event_id, date, {B('hour')} AS hour FROM ev")
def _(v):
    x = v.events.select("event_id", F.date_format("ts", "MM/dd/yyyy hh:mm:ss a").alias("t"))
    x = x.withColumn("ts", ft.parse_ts(F.col("t"), "MM/dd/yyyy hh:mm:ss a"))
    return x.select("event_id", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"))


def _utc_sql(local: str, even: str) -> str:
    """New York wall time of the two days of 2021 when its clock changes as UTC: an hour skipped, an hour seen twice."""
    spring = f"CASE WHEN hour({local}) < 2 THEN {local} + INTERVAL 5 HOUR WHEN hour({local}) > 2 THEN {local} + INTERVAL 4 HOUR END"
    autumn = f"CASE WHEN hour({local}) < 1 THEN {local} + INTERVAL 4 HOUR WHEN hour({local}) > 1 THEN {local} + INTERVAL 5 HOUR END"
    return f"CASE WHEN {even} THEN {spring} ELSE {autumn} END"


_LOCAL = ", wall AS (SELECT *, (CASE WHEN event_id % 2 = 0 THEN DATE '2021-03-14' ELSE DATE '2021-11-07' END) + CAST(date_trunc('second', ts) AS TIME) AS local FROM weather)"
_STAMP = "'%Y-%m-%d %H:%M:%S'"


@query("dat_local_to_utc", _LOCAL + f" SELECT {B('event_id')} AS event_id, strftime(local, {_STAMP}) AS local, strftime({_utc_sql('local', 'event_id % 2 = 0')}, {_STAMP}) AS utc FROM wall")
def _(v):
    x = v.events.select("event_id", F.to_timestamp_ntz(F.concat_ws(" ", F.when(F.col("event_id") % 2 == 0, "2021-03-14").otherwise("2021-11-07"), F.date_format("ts", "HH:mm:ss"))).alias("local"))
    u = ft.local_to_utc_strict(F.col("local"), "America/New_York")
    return x.select("event_id", F.date_format("local", "yyyy-MM-dd HH:mm:ss").alias("local"), F.date_format(u, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("dat_month_bounds", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_first FROM orders", views=False)
def _(v):
    a, b = ft.month_bounds(F.col("o_orderdate"))
    return v.table("orders").select(a.alias("first_day"), b.alias("next_first")).distinct()


_PK = ", ".join(f"{R(x)} AS {n}" for n, x in {
    "temp_c": "CASE WHEN CAST(split_part(TMP, ',', 1) AS DOUBLE) <> 9999 THEN CAST(split_part(TMP, ',', 1) AS DOUBLE) / 10 END",
    "dew_c": "CASE WHEN CAST(split_part(DEW, ',', 1) AS DOUBLE) <> 9999 THEN CAST(split_part(DEW, ',', 1) AS DOUBLE) / 10 END",
    "slp_hpa": "CASE WHEN CAST(split_part(SLP, ',', 1) AS DOUBLE) <> 99999 THEN CAST(split_part(SLP, ',', 1) AS DOUBLE) / 10 END",
    "wind_dir": "CASE WHEN CAST(split_part(WND, ',', 1) AS DOUBLE) <> 999 THEN CAST(split_part(WND, ',', 1) AS DOUBLE) END",
    "wind_speed": "CASE WHEN CAST(split_part(WND, ',', 4) AS DOUBLE) <> 9999 THEN CAST(split_part(WND, ',', 4) AS DOUBLE) / 10 END",
    "visibility_m": "CASE WHEN CAST(split_part(VIS, ',', 1) AS DOUBLE) < 999999 THEN CAST(split_part(VIS, ',', 1) AS DOUBLE) END",
    "ceiling_raw": "CASE WHEN CAST(split_part(CIG, ',', 1) AS DOUBLE) < 99999 THEN CAST(split_part(CIG, ',', 1) AS DOUBLE) END",
    "precip_mm": "CASE WHEN TRY_CAST(split_part(AA1, ',', 2) AS DOUBLE) < 9999 THEN TRY_CAST(split_part(AA1, ',', 2) AS DOUBLE) / 10 END",
    "snow_cm": "CASE WHEN CAST(split_part(AJ1, ',', 1) AS DOUBLE) < 9999 THEN CAST(split_part(AJ1, ',', 1) AS DOUBLE) END",
}.items())


@query("pkd_weather_fields", f"SELECT {B('event_id')} AS event_id, {_PK} FROM weather")
def _(v):
    return v.weather.select("event_id", *[f(F.col(c)).alias(n) for n, (c, f) in fw.REPORT.items()])


@query("pip8_clean_weather", _LOCAL + f", u AS (SELECT *, {_utc_sql('local', 'event_id % 2 = 0')} AS at_utc FROM wall WHERE trim(REPORT_TYPE) IN ('FM-15', 'FM-16')) SELECT STATION, strftime(at_utc, {_STAMP}) AS at, {_PK} FROM u WHERE at_utc IS NOT NULL")
def _(v):
    x = v.weather.withColumn("DATE", F.concat(F.when(F.col("event_id") % 2 == 0, "2021-03-14").otherwise("2021-11-07"), F.date_format("ts", "'T'HH:mm:ss")))
    return pp.clean_weather(x.drop("ts")).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("str_functions", f"SELECT {B('event_id')} AS event_id, {B('regexp_extract(props, ' + chr(39) + '[0-9]+' + chr(39) + ')')} AS k, trim(lower('  ' || upper(event_type) || ' ')) AS kind, contains(lower(event_type), 'ic') AS has, lpad(CAST(user_id AS STRING), 5, '0') AS padded FROM events", views=False)
def _(v):
    return v.events.select("event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"), F.trim(F.lower(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))).alias("kind"), F.contains(F.lower("event_type"), F.lit("ic")).alias("has"), F.lpad(F.col("user_id").cast("string"), 5, "0").alias("padded"))


@query("mth_interpolate", f""", g AS (SELECT quantile_cont(value, {[k / 20 for k in range(1, 20)]}) AS q FROM events), x AS (SELECT event_id, value, q, len(list_filter(q, lambda a: a <= value)) AS below FROM events, g)
 SELECT {B('event_id')} AS event_id, {R('CASE WHEN below = 0 THEN 0.0 WHEN below >= 19 THEN 1.0 ELSE (below - 1 + (value - q[below]) / (q[below + 1] - q[below])) / 18 END')} AS p FROM x""")
def _(v):
    grid = v.events.agg(F.percentile("value", F.array(*[F.lit(k / 20) for k in range(1, 20)]))).first()[0]
    return v.events.select("event_id", an.interpolate(F.array(*map(F.lit, grid)), F.col("value")).alias("p"))


@query("mth_bround", f"SELECT {B('l_orderkey')} AS k, {B('l_linenumber')} AS line, {B('round_even(l_quantity / 4, 0)')} AS q FROM lineitem", views=False)
def _(v):
    return v.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.bround(F.col("l_quantity") / 4, 0).cast("long").alias("q"))


# --- windows, top-k, sets ------------------------------------------------------


@query("win7_duplicates", f"SELECT {B('o_custkey')} AS o_custkey, CAST(o_orderdate AS DATE) AS d, {B('count(*)')} AS n FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1", views=False)
def _(v):
    return tb.duplicates(v.table("orders").select("o_custkey", F.to_date("o_orderdate").alias("d")), ["o_custkey", "d"])


@query("win8_changed", f"SELECT {B('event_id')} AS event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS changed FROM events", views=False)
def _(v):
    return v.events.select("event_id", tb.changed(F.col("event_type"), ["user_id"], ["event_id"]).alias("changed"))


@query("top3_largest", f"SELECT {B('c_custkey')} AS c_custkey, {R('c_acctbal')} AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5", views=False)
def _(v):
    return v.table("customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(5).select("c_custkey", "c_acctbal")


@query("top6_distinct_values", "SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part) ORDER BY p_brand LIMIT 100", views=False)
def _(v):
    return v.table("part").select("p_brand").distinct().orderBy("p_brand").limit(100)


@query("top7_periods", f"SELECT DISTINCT {B('year(date)')} AS year, {B('quarter(date)')} AS quarter, year(date) || ' Q' || quarter(date) AS label FROM od")
def _(v):
    return an.periods(v.od)


@query("set4_column_sets", "WITH c AS (SELECT table_name AS t, split_part(column_name, '_', 2) AS c FROM information_schema.columns WHERE table_name IN ('customer', 'supplier', 'nation')), k AS (SELECT c, list_sort(list(DISTINCT t)) AS tables FROM c GROUP BY c) SELECT c AS \"column\", array_to_string(tables, ',') AS tables, CAST(3 - len(tables) AS BIGINT) AS n_missing FROM k WHERE len(tables) < 3", views=False)
def _(v):
    """Columns, without their table's prefix, that not all of the tables have, as their files say."""
    paths = {t: f"{v.dir}/{t}.parquet" for t in ("customer", "supplier", "nation")}
    found = footers.column_table(footers.footers(v.spark, list(paths.values()))).select(F.regexp_extract("file_name", r"([^/]+)\.parquet", 1).alias("t"), F.element_at(F.split("column", "_"), 2).alias("c"))
    k = found.groupBy(F.col("c").alias("column")).agg(F.array_sort(F.collect_set("t")).alias("tables")).where(F.size("tables") < len(paths))
    return k.select("column", F.array_join("tables", ",").alias("tables"), (len(paths) - F.size("tables")).alias("n_missing"))


# --- analyses ------------------------------------------------------------------


def _Q(c: str, qs: tuple[float, ...]) -> str:
    return ", ".join(f"{R(f'quantile_cont({c}, {q})')} AS p{round(100 * q)}" for q in qs)


GE = ", ".join(f"{R(f'100.0 * count(*) FILTER (tot >= {t}) / count(*)')} AS ge{t}_pct" for t in an.THRESHOLDS)


@query("ana1_sparsity", f"SELECT mode, {B('count(*)')} AS observed_cells, {B(f'count(DISTINCT date) * {ZONES * ZONES * 24}')} AS possible_cells, {R('avg(n)')} AS mean_demand, {R('sum(n)')} AS total_demand, {R(f'100.0 * count(*) / (count(DISTINCT date) * {ZONES * ZONES * 24})')} AS fill_rate_pct, {_Q('n', (0.05, 0.25, 0.5, 0.75, 0.9, 0.99))} FROM od WHERE n > 0 GROUP BY mode")
def _(v):
    return an.sparsity(v.od, ZONES)


@query("ana2_temporal_sensitivity", f""", c AS (SELECT mode, 'hour x date' AS granularity, sum(n) AS tot FROM od GROUP BY mode, pu, do, date, hour UNION ALL SELECT mode, 'dow x hour', sum(n) FROM od GROUP BY mode, pu, do, dayofweek(date), hour
  UNION ALL SELECT mode, 'block x date', sum(n) FROM od GROUP BY mode, pu, do, date, CASE WHEN hour BETWEEN 6 AND 8 THEN 1 WHEN hour BETWEEN 9 AND 14 THEN 2 WHEN hour BETWEEN 15 AND 17 THEN 3 ELSE 4 END) SELECT mode, granularity, {B('count(*)')} AS n_cells, {GE} FROM c GROUP BY mode, granularity""")
def _(v):
    return an.temporal_sensitivity(v.od)


@query("ana3_spatial_sensitivity", f""", x AS (SELECT o.*, dayofweek(date) AS dow, a.borough AS pb, b.borough AS db FROM od o LEFT JOIN zones a ON pu = a.LocationID LEFT JOIN zones b ON do = b.LocationID),
  c AS (SELECT mode, 'OD full' AS spatial, sum(n) AS tot FROM x GROUP BY mode, pu, do, dow, hour UNION ALL SELECT mode, 'origin only', sum(n) FROM x GROUP BY mode, pu, dow, hour UNION ALL SELECT mode, 'borough OD', sum(n) FROM x GROUP BY mode, pb, db, dow, hour) SELECT mode, spatial, {B('count(*)')} AS n_cells, {GE} FROM c GROUP BY mode, spatial""")
def _(v):
    return an.spatial_sensitivity(v.od, v.zones)


@query("ana4_copresence", f", c AS (SELECT count(DISTINCT mode) AS n_modes FROM od GROUP BY pu, do, dayofweek(date), hour) SELECT {B('n_modes')} AS n_modes, {B('count(*)')} AS n_cells, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS share_pct FROM c GROUP BY n_modes")
def _(v):
    return an.copresence(v.od)


@query("ana4_presence_by_mode", f", c AS (SELECT DISTINCT mode, pu, do, dayofweek(date) AS dow, hour FROM od), t AS (SELECT count(*) AS total FROM (SELECT DISTINCT pu, do, dow, hour FROM c)) SELECT mode, {B('count(*)')} AS cells_present, {B('max(total)')} AS total_cells, {R('100.0 * count(*) / max(total)')} AS presence_pct FROM c, t GROUP BY mode")
def _(v):
    return an.presence_by_mode(v.od)


_LORENZ = """, p AS (SELECT mode, pu, do, sum(n) AS tot FROM od GROUP BY mode, pu, do), l AS (SELECT mode, pu, do, tot, row_number() OVER (PARTITION BY mode ORDER BY tot {0}, pu, do) AS rank, sum(tot) OVER (PARTITION BY mode ORDER BY tot {0}, pu, do ROWS UNBOUNDED PRECEDING) / sum(tot) OVER (PARTITION BY mode) AS cum FROM p)
"""


@query("ana5_lorenz", _LORENZ.format("") + f"SELECT mode, {B('count(*)')} AS n_pairs, {', '.join(f'{R(f'100.0 * count(*) FILTER (cum < {t / 100}) / count(*)')} AS pairs_for_{t}_pct' for t in (50, 80, 95))} FROM l GROUP BY mode")
def _(v):
    return an.lorenz(v.od)


@query("ana5_lorenz_largest", _LORENZ.format("DESC") + f"SELECT mode, {B('count(*)')} AS n_pairs, {', '.join(f'{R(f'100.0 * count(*) FILTER (cum < {t / 100}) / count(*)')} AS pairs_for_{t}_pct' for t in (50, 80, 95))} FROM l GROUP BY mode")
def _(v):
    return an.lorenz(v.od, ascending=False)


@query("win4_lorenz_curve", _LORENZ.format("") + f"SELECT mode, {B('pu')} AS pu, {B('do')} AS do, {R('tot')} AS tot, {B('rank')} AS rank, {R('rank / count(*) OVER (PARTITION BY mode)')} AS cum_pairs, {R('cum')} AS cum_demand FROM l")
def _(v):
    return an.lorenz_curve(v.od)


_TOT = f"{R('sum(n)')} AS total_demand, {R('avg(n)')} AS avg_per_cell, {B('count(*)')} AS n_cells"


@query("ana6_hourly_profile", f"SELECT mode, {B('hour')} AS hour, {_TOT} FROM od GROUP BY mode, hour")
def _(v):
    return an.hourly_profile(v.od)


@query("ana7_dow_profile", f"SELECT mode, {B('dayofweek(date)')} AS dow, {_TOT} FROM od GROUP BY mode, dayofweek(date)")
def _(v):
    return an.dow_profile(v.od)


_ENDS = ", ends AS (SELECT mode, date, 'origin' AS direction, pu AS zone, n FROM od UNION ALL SELECT mode, date, 'destination', do, n FROM od) "


@query("ana8_top_zones", _ENDS + f", t AS (SELECT mode, direction, zone, sum(n) AS total, count(*) AS cells FROM ends GROUP BY mode, direction, zone) SELECT mode, direction, {B('zone')} AS zone, {R('total')} AS total_demand, {B('cells')} AS n_cells, {B('row_number() OVER (PARTITION BY mode, direction ORDER BY total DESC, zone)')} AS rank FROM t QUALIFY rank <= 20")
def _(v):
    return an.top_zones(v.od)


@query("ana9_monthly_trend", f"SELECT mode, strftime(date, '%Y-%m') AS year_month, {R('sum(n)')} AS total_demand, {B('count(*)')} AS n_cells FROM od GROUP BY mode, strftime(date, '%Y-%m')")
def _(v):
    return an.monthly_trend(v.od)


@query("ana10_price_distribution", f"SELECT dataset, {R('avg(fare_amount)')} AS mean_fare, {R('stddev_samp(fare_amount)')} AS std_fare, {B('count(*)')} AS n_cells, {_Q('fare_amount', (0.05, 0.25, 0.5, 0.75, 0.9, 0.95))} FROM keyed WHERE fare_amount > 0 AND fare_amount < 60 GROUP BY dataset")
def _(v):
    return an.price_distribution(v.keyed, "fare_amount", hi=60)


@query("ana11_demand_cdf", f", d AS (SELECT mode, date, sum(n) AS n FROM od GROUP BY mode, date), q AS (SELECT mode, quantile_cont(n, {[k / 200 for k in range(1, 200)]}) AS v FROM d GROUP BY mode) SELECT mode, {B('k')} AS k, {R('v[k]')} AS n FROM q, range(1, 200) r(k)")
def _(v):
    return an.demand_cdf(v.od.groupBy("mode", "date").agg(F.sum("n").alias("n")))


@query("ana12_fill_matrix", f", x AS (SELECT DISTINCT mode, pu, do, date, dayofweek(date) AS dow, hour FROM od), days AS (SELECT mode, dow, count(DISTINCT date) AS days FROM x GROUP BY mode, dow) SELECT m.mode, {B('m.dow')} AS dow, " + ", ".join(f"{R(f'coalesce(100.0 * (count(x.pu) FILTER (x.hour = {h})) / ({ZONES * ZONES}.0 * max(days)), 0)')} AS h{h}" for h in range(24)) + " FROM (SELECT mode, d AS dow FROM (SELECT DISTINCT mode FROM od), range(7) r(d)) m LEFT JOIN x ON m.mode = x.mode AND m.dow = x.dow LEFT JOIN days ON m.mode = days.mode AND m.dow = days.dow GROUP BY m.mode, m.dow")
def _(v):
    return an.fill_matrix(v.od, ZONES)


for _slot, _expr, _lo, _hi in (("hour", "hour", 0, 23), ("dow", "dayofweek(date)", 0, 6), ("month", "month(date)", 1, 12)):

    @query(f"ana13_profile_{_slot}", f", t AS (SELECT mode, {_expr} AS slot, sum(n) AS total FROM od GROUP BY 1, 2), s AS (SELECT mode, k AS slot FROM (SELECT DISTINCT mode FROM od), range({_lo}, {_hi + 1}) r(k)), y AS (SELECT s.mode, s.slot, coalesce(total, 0) AS total FROM s LEFT JOIN t ON s.mode = t.mode AND s.slot = t.slot) SELECT mode, {B('slot')} AS slot, {R('total')} AS total, {R('total / nullif(max(total) OVER (PARTITION BY mode), 0)')} AS norm FROM y")
    def _(v, slot=_slot):
        return an.normalised_profile(v.od, slot)


@query("ana14_box_stats", f"SELECT dataset, {_Q('fare_amount', (0.05, 0.25, 0.5, 0.75, 0.95))} FROM keyed GROUP BY dataset")
def _(v):
    return an.box_stats(v.keyed, "fare_amount")


@query("ana15_zone_quarter", _ENDS + f"SELECT mode, direction, {B('year(date)')} AS year, {B('quarter(date)')} AS quarter, {B('zone')} AS zone, {R('sum(n)')} AS total FROM ends GROUP BY mode, direction, year(date), quarter(date), zone")
def _(v):
    return an.zone_quarter(v.od)


_ODQ = ", q AS (SELECT mode, year(date) AS year, quarter(date) AS quarter, pu, do, sum(n) AS total FROM od WHERE pu <> do AND pu NOT IN (264, 265) AND do NOT IN (264, 265) GROUP BY ALL) "


@query("ana16_top_od_quarter", _ODQ + f"SELECT mode, {B('year')} AS year, {B('quarter')} AS quarter, {B('pu')} AS pu, {B('do')} AS do, {R('total')} AS total, {B('row_number() OVER (PARTITION BY mode, year, quarter ORDER BY total DESC, pu, do)')} AS rank FROM q QUALIFY rank <= 100")
def _(v):
    return an.top_od_quarter(v.od)


_PICK = "mode IN ('yellow', 'uber', 'lyft') AND year(date) * 4 + quarter(date) BETWEEN 1997 * 4 + 2 AND 1999 * 4 + 3"


@query("ana17_zone_explorer", _ENDS + f", z AS (SELECT zone, sum(n) AS total FROM ends WHERE direction = 'origin' AND {_PICK} GROUP BY zone) SELECT {B('zone')} AS zone, {R('total')} AS total, {R('CASE WHEN max(ln(1 + total)) OVER () = min(ln(1 + total)) OVER () THEN 1.0 ELSE (ln(1 + total) - min(ln(1 + total)) OVER ()) / (max(ln(1 + total)) OVER () - min(ln(1 + total)) OVER ()) END')} AS intensity FROM z")
def _(v):
    return an.zone_explorer(v.od, "origin", ["yellow", "uber", "lyft"], (1997, 2), (1999, 3))


@query("agg22_zone_card", _ENDS + f", z AS (SELECT zone, sum(n) AS total FROM ends WHERE direction = 'destination' GROUP BY zone) SELECT {B('count(*)')} AS n_zones, {R('sum(total)')} AS total, {B('(SELECT zone FROM z ORDER BY total DESC, zone LIMIT 1)')} AS top_zone, {R('max(total)')} AS top_total FROM z")
def _(v):
    return an.zone_card(an.zone_explorer(v.od, "destination"))


@query("ana18_route_explorer", f", r AS (SELECT pu, do, sum(n) AS total FROM od WHERE pu <> do AND {_PICK} GROUP BY pu, do ORDER BY total DESC, pu, do LIMIT 15) SELECT {B('pu')} AS pu, {B('do')} AS do, {R('total')} AS total, {R('100.0 * total / max(total) OVER ()')} AS bar_pct FROM r")
def _(v):
    return an.route_explorer(v.od, ["yellow", "uber", "lyft"], (1997, 2), (1999, 3))


@query("win3_share_of_total", f"SELECT mode, {B('count(*)')} AS n, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM od GROUP BY mode")
def _(v):
    return tb.with_share(v.od.groupBy("mode").agg(F.count("*").alias("n")), "n")


# --- data quality --------------------------------------------------------------


@query("agg19_value_counts", f"SELECT member_casual AS value, {B('count(*)')} AS n FROM bikes GROUP BY member_casual")
def _(v):
    return tb.value_counts(v.bikes.withColumn("m", fc.map_values(F.lower(F.trim("usertype")), schemas.MEMBERS)), "m")


@query("agg20_diagnostics", f"SELECT {B('count(DISTINCT station)')} AS n_stations, min(date) AS first, max(date) AS last, {R('avg(ridership)')} AS mean, {R('sum(ridership)')} AS total FROM entries")
def _(v):
    return v.entries.agg(F.count_distinct("station").alias("n_stations"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg("ridership").alias("mean"), F.sum("ridership").alias("total"))


@query("agg16_distinct_cells", f"SELECT mode, {B('count(*)')} AS n FROM (SELECT DISTINCT mode, pu, do, hour FROM od) GROUP BY mode")
def _(v):
    return v.od.select("mode", "pu", "do", "hour").distinct().groupBy("mode").agg(F.count("*").alias("n"))


@query("dq2_profile", " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {R(f'100.0 * count({c}) / count(*)')} AS non_null_pct, {R(f'min({c})')} AS min, {R(f'max({c})')} AS max, {R(f'avg({c})')} AS mean, {R(f'100.0 * count(*) FILTER ({c} <> 0) / count(*)')} AS non_zero_pct FROM trips)" for c in ("trip_distance", "fare_amount", "tax_amount", "RatecodeID")))
def _(v):
    return tb.profile(v.trips, ["trip_distance", "fare_amount", "tax_amount", "RatecodeID"])


_OK = {
    "times": "started_at IS NOT NULL AND ended_at IS NOT NULL",
    "years": "started_at >= TIMESTAMP '2021-01-01' AND started_at < TIMESTAMP '2026-01-01'",
    "user": "member_casual IS NOT NULL",
    "places": "coalesce(start_lat, 0) <> 0 AND coalesce(start_lng, 0) <> 0 AND coalesce(end_lat, 0) <> 0 AND coalesce(end_lng, 0) <> 0",
}
_KEPT = "count(*) FILTER (" + " AND ".join(_OK.values()) + ")"


@query("dq5_drop_report", ", b AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN started_at - INTERVAL 5 YEAR ELSE started_at END AS started_at, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ended_at END AS ended_at, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 17 = 0 THEN NULL ELSE end_lat END AS end_lat) FROM bikes) " + f"SELECT {B('count(*)')} AS n_in, {', '.join(f'{B(f'count(*) FILTER ({c})')} AS ok_{n}' for n, c in _OK.items())}, {B(_KEPT)} AS n_kept, {R(f'100.0 * {_KEPT} / count(*)')} AS kept_pct FROM b")
def _(v):
    x = v.bikes.withColumn("member_casual", fc.map_values(F.lower(F.trim("usertype")), schemas.MEMBERS))
    x = x.withColumns({"started_at": F.expr("case when event_id % 7 = 0 then started_at - make_ym_interval(5, 0) else started_at end"), "ended_at": F.expr("case when event_id % 11 = 0 then null else ended_at end"), "end_lat": F.expr("case when event_id % 13 = 0 then 0 when event_id % 17 = 0 then null else end_lat end")})
    return tb.drop_report(x, pp.bike_rules(2021, 2025))


@query("dq7_coverage_calendar", """, m AS (SELECT DISTINCT dataset, year(pickup_datetime) AS y, month(pickup_datetime) AS m FROM keyed WHERE fare_amount > 100), e AS (SELECT dataset, y, k AS m FROM (SELECT DISTINCT dataset, year(pickup_datetime) AS y FROM keyed), range(1, 13) r(k) WHERE y < 2000)
  SELECT e.dataset, CAST(e.y AS BIGINT) AS year, """ + ", ".join(f"max(CASE WHEN e.m = {k} THEN CASE WHEN m.m IS NULL THEN 'missing' ELSE 'OK' END END) AS \"{k}\"" for k in range(1, 13)) + " FROM e LEFT JOIN m ON e.dataset = m.dataset AND e.y = m.y AND e.m = m.m GROUP BY e.dataset, e.y")
def _(v):
    x = v.keyed.withColumns({"year": F.year("pickup_datetime"), "month": F.month("pickup_datetime")})
    expected = x.select("dataset", "year").distinct().where("year < 2000").withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return tb.coverage_calendar(expected, x.where("fare_amount > 100"), ["dataset", "year"])


@query("dq9_file_coverage", f"SELECT l_returnflag AS file, {B('min(l_orderkey)')} AS first, {B('max(l_orderkey)')} AS last, {B('count(*)')} AS n FROM lineitem GROUP BY l_returnflag", views=False)
def _(v):
    return tb.file_coverage(v.table("lineitem"), "l_orderkey", F.col("l_returnflag"))


@query("dq10_null_report", " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {B(f'count(*) FILTER ({c} IS NULL)')} AS n_null FROM trips)" for c in ("trip_distance", "tax_amount", "RatecodeID", "fare_amount")))
def _(v):
    return tb.null_report(v.trips, ["trip_distance", "tax_amount", "RatecodeID", "fare_amount"])


_TYPES = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END"


@query("dq11_describe", f"SELECT column_name AS \"column\", {_TYPES} AS type, (SELECT {B('count(*)')} FROM lineitem) AS n_rows FROM information_schema.columns WHERE table_name = 'lineitem'", views=False)
def _(v):
    return tb.describe(v.table("lineitem"))


@query("prj18_columns_like", f"WITH c AS (SELECT {B('count(l_shipdate)')} AS l_shipdate, {B('count(l_extendedprice)')} AS l_extendedprice FROM lineitem) SELECT \"column\", n FROM c UNPIVOT (n FOR \"column\" IN (l_shipdate, l_extendedprice))", views=False)
def _(v):
    """The columns whose names hold one of the words, and how many values they have."""
    x = v.table("lineitem")
    names = tb.columns_like(x, ["DATE", "price"])
    one = x.agg(*[F.count(n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("n")) for n in names])).alias("c")).select("c.*")


_COLUMNS = "c AS (SELECT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN ('customer', 'nation', 'supplier'))"


@query("dq3_schema_drift", f"WITH {_COLUMNS} SELECT t || '.parquet' AS file, c AS \"column\", 'added' AS change FROM c WHERE t <> 'customer' AND c NOT IN (SELECT c FROM c WHERE t = 'customer') UNION ALL SELECT o.t || '.parquet', b.c, 'removed' FROM c b, (SELECT DISTINCT t FROM c WHERE t <> 'customer') o WHERE b.t = 'customer' AND b.c NOT IN (SELECT c FROM c WHERE c.t = o.t)", views=False)
def _(v):
    found = footers.footers(v.spark, [f"{v.dir}/{t}.parquet" for t in ("customer", "supplier", "nation")])
    return footers.drift(found).select(F.concat(F.regexp_extract("file_name", r"([^/]+)\.parquet", 1), F.lit(".parquet")).alias("file"), "column", "change").distinct()


@query("str2_hour_bucket", f"SELECT {B('PULocationID')} AS PULocationID, CAST(date_trunc('hour', pickup_datetime) AS DATE) AS day, {B('hour(pickup_datetime)')} AS hour, {B('count(*)')} AS trip_count FROM clean GROUP BY PULocationID, CAST(date_trunc('hour', pickup_datetime) AS DATE), hour(pickup_datetime)")
def _(v):
    x = hourly_counts(v.clean, keys=("PULocationID",))
    return x.select("PULocationID", F.to_date("hour_start").alias("day"), F.hour("hour_start").alias("hour"), "trip_count")


@query("jsn_props", f"SELECT {B('json_extract(props, ' + chr(39) + '$.k' + chr(39) + ')')} AS k, {B('count(*)')} AS n FROM events GROUP BY 1", views=False)
def _(v):
    return v.events.select(F.from_json("props", "k int").k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# --- the remaining single steps -------------------------------------------------


@query("prj2_first_alias", f"SELECT {B('c_custkey')} AS station_id, c_name AS name FROM customer", views=False)
def _(v):
    return tb.select_existing(v.table("customer"), ["station_id", "name"], {"station_id": ("start_station_id", "c_custkey", "c_nationkey"), "name": ("Name", "c_name")})


@query("prj3_missing_columns", f"SELECT {B('s_suppkey')} AS s_suppkey, CAST(NULL AS BIGINT) AS cbd_congestion_fee FROM supplier", views=False)
def _(v):
    return tb.conform(v.table("supplier"), T.StructType().add("s_suppkey", T.LongType()).add("cbd_congestion_fee", T.LongType()))


@query("prj8_provenance", f"SELECT strftime(o_orderdate, '%Y') || '/orders.csv' AS source_file, 'orders' AS dataset, {B('count(*)')} AS n FROM orders GROUP BY 1", views=False)
def _(v):
    """Files of a folder per year, read back with the folder they come from; Spark names the files themselves."""
    at = new_path(v.spark, "provenance")
    v.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("y")).write.partitionBy("y").option("header", True).csv(at)
    folder = F.regexp_extract(F.col("path"), r"/y=(\d+)/", 1)
    x = v.spark.read.schema("o_orderkey long").option("header", True).csv(f"{at}/*").select(F.col("_metadata.file_path").alias("path"), F.lit("orders").alias("dataset"))
    return x.groupBy(F.concat(folder, F.lit("/orders.csv")).alias("source_file"), "dataset").agg(F.count("*").alias("n"))


@query("prj16_roles", f"SELECT {B('pu')} AS zone, {B('count(*)')} AS n, {R('sum(n)')} AS total FROM od WHERE mode = 'uber' GROUP BY pu")
def _(v):
    cells = v.keyed.groupBy(F.col("dataset").alias("provider"), F.col("PULocationID").alias("o_zone"), F.col("DOLocationID").alias("d_zone"), "date", "hour").agg(F.count("trip_distance").alias("rides"))
    x = pn.unify_modes([pn.ModeSource("uber", cells, "o_zone", "d_zone", "rides", keep=F.col("provider") == "uber")])
    return x.groupBy(F.col("pu").alias("zone")).agg(F.count("*").alias("n"), F.sum("n").alias("total"))


@query("flt4_year_window", f"SELECT {B('count(*)')} AS n FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999", views=False)
def _(v):
    at = F.col("o_orderdate")
    return v.table("orders").where((at >= F.lit("1997-01-01").cast("timestamp_ntz")) & (at < F.lit("2000-01-01").cast("timestamp_ntz"))).agg(F.count("*").alias("n"))


@query("flt8_category", f"SELECT {B('event_id')} AS event_id FROM events WHERE event_type = 'purchase'", views=False)
def _(v):
    return v.events.where(F.col("event_type") == "purchase").select("event_id")


@query("flt10_positive_measure", f"SELECT {B('count(*)')} AS n, {R('sum(avg_ridership)')} AS total FROM od_raw WHERE avg_ridership > 0")
def _(v):
    return v.od_raw.where("avg_ridership > 0").agg(F.count("*").alias("n"), F.sum("avg_ridership").alias("total"))


@query("flt11_places", f"SELECT {B('event_id')} AS event_id FROM events WHERE user_id <> 0 AND value <> 0", views=False)
def _(v):
    x, y = F.col("user_id"), F.col("value")
    return tb.quality_filter(v.events, [tb.Rule("x", x.isNotNull() & (x != 0)), tb.Rule("y", y.isNotNull() & (y != 0))]).select("event_id")


@query("flt12_no_sentinel_zone", _FLOWS + f"SELECT {B('count(*)')} AS n FROM flows WHERE dest <> -1")
def _(v):
    return fl.estimate_flows(v.entries, v.weights).where("dest <> -1").agg(F.count("*").alias("n"))


@query("set2_concatenated_files", f"SELECT {B('count(*)')} AS n, {R('sum(value)')} AS total FROM (SELECT value FROM events UNION ALL SELECT value FROM events)", views=False)
def _(v):
    p = f"{v.dir}/events.parquet"
    return v.spark.read.parquet(p, p).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("jon10_attributes", _TRACTS + f"SELECT {B('zone_id')} AS zone_id, {B('count(*)')} AS n_edges, {R('max(workers)')} AS workers FROM edges LEFT JOIN tracts ON zone_id = a_id GROUP BY zone_id")
def _(v):
    x = v.edges.join(_census(v).select(F.col("a_id").alias("zone_id"), "workers"), "zone_id", "left")
    return x.groupBy("zone_id").agg(F.count("*").alias("n_edges"), F.max("workers").alias("workers"))


@query("agg17_quantile_grid", f"SELECT dataset, {_Q('duration_min', (0.05, 0.25, 0.5, 0.75, 0.95))} FROM keyed GROUP BY dataset")
def _(v):
    return an.box_stats(v.keyed, "duration_min")


@query("agg18_threshold_shares", f", c AS (SELECT mode, pu, do, sum(n) AS tot FROM od GROUP BY mode, pu, do) SELECT mode, {GE} FROM c GROUP BY mode")
def _(v):
    return v.od.groupBy("mode", "pu", "do").agg(F.sum("n").alias("tot")).groupBy("mode").agg(*an.threshold_shares())


@query("agg21_zone_counts", _ENDS + f"SELECT {B('zone')} AS zone, {R('sum(n)')} AS total FROM ends WHERE direction = 'destination' AND mode IN ('green', 'via') AND year(date) BETWEEN 1998 AND 1999 GROUP BY zone")
def _(v):
    return an.zone_explorer(v.od, "destination", ["green", "via"], (1998, 1), (1999, 4)).select("zone", "total")


@query("win2_top_per_group", f", t AS (SELECT mode, pu, sum(n) AS total FROM od GROUP BY mode, pu) SELECT mode, {B('pu')} AS pu, {R('total')} AS total, {B('row_number() OVER (PARTITION BY mode ORDER BY total DESC, pu)')} AS rank FROM t QUALIFY rank <= 3")
def _(v):
    return tb.top_n(v.od.groupBy("mode", "pu").agg(F.sum("n").alias("total")), ["mode"], [F.desc("total"), F.col("pu")], 3)


@query("pip5_flow_totals", _FLOWS + f"SELECT date, {R('sum(flow)')} AS flow, {B('count(*)')} AS n FROM flows GROUP BY date")
def _(v):
    return fl.estimate_flows(v.entries, v.weights).groupBy("date").agg(F.sum("flow").alias("flow"), F.count("*").alias("n"))


@query("str1_ingested_events", f"SELECT event_type, {B('count(*)')} AS n FROM events WHERE value > 100 GROUP BY event_type", views=False)
def _(v):
    """The events ingested as a stream of files into the shared folder, then read back."""
    at = new_path(v.spark, "ingest")
    schema = v.table("events").schema
    single = "events.parquet"
    source, glob = (f"{v.dir}/{single}", None) if files.is_folder(v.spark, f"{v.dir}/{single}") else (v.dir, single)
    ingest_available(v.spark, source, f"{at}/out", schema, f"{at}/state", lambda d: d.where("value > 100"), glob=glob).awaitTermination()
    return v.spark.read.schema(schema).parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))


from zonehour import queries_files  # noqa: E402, F401 - registers the queries that write and read files
