"""The driver's tables seen as trips, entries, OD estimates, bikes, weather, census and zones.

Every view is built by the engine's operators where one fits; `SQL` has the same
views as common table expressions for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.operators import flows as fl
from zonehour.operators import panel as pn
from zonehour.operators import spatial as sp

#: The pickup window of clean trips.
START, END = "1996-01-01", "2001-01-01"
#: Zones of the trip binding: nations.
ZONES = 25

#: Packed weather columns, in SQL that both engines read.
WEATHER = {
    "STATION": "'S' || cast(user_id % 3 as string)",
    "REPORT_TYPE": "case when event_id % 5 = 0 then 'SOD  ' when event_id % 5 = 1 then 'FM-16' else 'FM-15 ' end",
    "TMP": "case when event_id % 17 = 0 then '+9999,9' else (case when event_id % 3 = 0 then '-' else '+' end) || lpad(cast(event_id % 400 as string), 4, '0') || ',5' end",
    "DEW": "case when event_id % 13 = 0 then null else '+' || lpad(cast(event_id % 200 as string), 4, '0') || ',5' end",
    "SLP": "case when event_id % 19 = 0 then '99999,9' else lpad(cast(9500 + event_id % 1000 as string), 5, '0') || ',5' end",
    "WND": "case when event_id % 23 = 0 then '999,9,N,9999,9' else lpad(cast(user_id % 360 as string), 3, '0') || ',5,N,' || lpad(cast(event_id % 300 as string), 4, '0') || ',5' end",
    "VIS": "case when event_id % 29 = 0 then '999999,9,N,9' else lpad(cast(event_id * 37 % 20000 as string), 6, '0') || ',5,N,5' end",
    "CIG": "case when event_id % 31 = 0 then '99999,9,M,N' else lpad(cast(event_id * 7 % 22000 as string), 5, '0') || ',5,M,N' end",
    "AA1": "case when event_id % 4 = 0 then null when event_id % 4 = 1 then 'a,b' else '01,' || lpad(cast(event_id % 50 as string), 4, '0') || ',9,5' end",
    "AJ1": "case when event_id % 7 = 0 then '9999,9,9,999999,9,9' else lpad(cast(event_id % 60 as string), 4, '0') || ',1,9,999999,9,9' end",
}

_TRIPS = """
  SELECT o_orderdate + to_hours(CAST(l_orderkey % 24 AS INT)) AS pickup_datetime,
    o_orderdate + to_hours(CAST(l_orderkey % 24 AS INT)) + to_minutes(CAST(l_partkey % 97 - 3 AS INT)) AS dropoff_datetime,
    CAST(s_nationkey + 1 AS INT) AS PULocationID, CAST(c_nationkey + 1 AS INT) AS DOLocationID,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity - 1 END AS trip_distance,
    l_extendedprice / 1000 - 1 AS fare_amount, l_discount * 10 AS tip_amount, nullif(l_tax, 0) * 10 AS tax_amount,
    CAST(l_partkey % 12 AS INT) AS passenger_count, CAST(l_linenumber % 5 AS INT) AS payment_type,
    CAST(nullif(l_partkey % 7, 0) AS INT) AS RatecodeID, CAST(1 + l_suppkey % 2 AS INT) AS trip_type,
    'HV000' || CAST(l_linenumber AS STRING) AS hvfhs_license_num,
    CASE l_returnflag WHEN 'A' THEN 'yellow' WHEN 'N' THEN 'green' ELSE 'hvfhv' END AS dataset
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""

_HAIL = "CASE WHEN payment_type = 0 THEN 'flex_fare' WHEN RatecodeID = 1 THEN 'standard_meter' WHEN RatecodeID IN (2, 3) THEN 'airport' WHEN RatecodeID = 5 THEN 'negotiated' ELSE 'other' END"

_EDGES = """
  SELECT CAST(20 * j + 2 * i + k AS INT) AS zone_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, CAST(-sign(x2 - x1) AS INT) AS s
  FROM (SELECT i, j, k, CASE e WHEN 0 THEN i WHEN 1 THEN i + 1 ELSE i + 1 - k END AS x1, CASE e WHEN 0 THEN j WHEN 1 THEN j + k ELSE j + 1 END AS y1,
               CASE e WHEN 0 THEN i + 1 WHEN 1 THEN i + 1 - k ELSE i END AS x2, CASE e WHEN 0 THEN j + k WHEN 1 THEN j + 1 ELSE j END AS y2
        FROM (SELECT DISTINCT CAST(floor(value / 100 + 0.0137) AS BIGINT) AS i, CAST(floor(user_id / 30.0 + 0.00731) AS BIGINT) AS j FROM events WHERE event_type = 'purchase'), range(2) c(k), range(3) d(e))"""

#: Where a customer lives, and the tract of that: squares of a quarter.
_HOMES = "SELECT floor((c_acctbal + 1000) / 2200.0 * 4) AS i, floor(c_custkey % 150 / 30.0 * 4) AS j, c_acctbal FROM customer"

#: The views for the oracle.
SQL = f"""WITH trips AS ({_TRIPS}),
clean AS (SELECT * REPLACE (CASE WHEN passenger_count BETWEEN 1 AND 9 THEN passenger_count END AS passenger_count), date_diff('microsecond', pickup_datetime, dropoff_datetime) / 60000000.0 AS duration_min
  FROM trips WHERE pickup_datetime >= TIMESTAMP '{START}' AND pickup_datetime < TIMESTAMP '{END}' AND dropoff_datetime > pickup_datetime AND trip_distance > 0 AND fare_amount > 0),
keyed AS (SELECT * REPLACE (CASE WHEN dataset <> 'hvfhv' THEN dataset WHEN hvfhs_license_num = 'HV0002' THEN 'juno' WHEN hvfhs_license_num = 'HV0003' THEN 'uber' WHEN hvfhs_license_num = 'HV0004' THEN 'via' WHEN hvfhs_license_num = 'HV0005' THEN 'lyft' ELSE 'hvfhv_other' END AS dataset),
  CAST(pickup_datetime AS DATE) AS date, CAST(hour(pickup_datetime) AS INT) AS hour, CASE WHEN dataset IN ('yellow', 'green') THEN {_HAIL} END AS hail_type FROM clean),
od AS (SELECT dataset AS mode, PULocationID AS pu, DOLocationID AS do, date, hour, CAST(count(trip_distance) AS DOUBLE) AS n FROM keyed GROUP BY ALL),
zones AS (SELECT CAST(n_nationkey + 1 AS INT) AS LocationID, n_name AS zone, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey),
ev AS (SELECT *, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour FROM events),
entries AS (SELECT CAST(user_id % 10 AS INT) AS station, date, hour, event_type AS fare_class, CAST(sum(floor(value)) AS DOUBLE) AS ridership FROM ev GROUP BY ALL),
od_raw AS (SELECT CAST(o_custkey % 10 AS INT) AS origin, CAST((o_orderkey // 24) % 13 AS INT) AS dest, 2024 AS year, CAST(month(o_orderdate) AS INT) AS month, dayname(o_orderdate) AS dow, CAST(o_orderkey % 24 AS INT) AS hour, sum(CAST(floor(o_totalprice / 1000) AS DOUBLE)) AS avg_ridership FROM orders GROUP BY ALL),
weights AS (SELECT *, avg_ridership / sum(avg_ridership) OVER (PARTITION BY origin, year, month, dow, hour) AS weight FROM od_raw WHERE avg_ridership > 0),
points AS (SELECT event_id, user_id, value / 100 + 0.0137 AS px, user_id / 30.0 + 0.00731 AS py FROM events),
edges AS ({_EDGES}),
homes AS (SELECT CAST(1000 * i + j AS INT) AS a_id, i / 4.0 + 0.1 AS x, j / 4.0 + 0.15 AS y, c_acctbal FROM ({_HOMES})),
tract_edges AS (SELECT a_id AS zone_id, x + CASE WHEN e IN (1, 2) THEN 0.25 ELSE 0.0 END AS x1, y + CASE WHEN e IN (2, 3) THEN 0.25 ELSE 0.0 END AS y1, x + CASE WHEN e IN (0, 1) THEN 0.25 ELSE 0.0 END AS x2, y + CASE WHEN e IN (1, 2) THEN 0.25 ELSE 0.0 END AS y2, CASE e WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT a_id, x, y FROM homes), range(4) d(e)),
within AS (SELECT px, py, min(zone_id) AS zone_id FROM (SELECT px, py, zone_id FROM (SELECT DISTINCT px, py FROM points), edges
  WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL),
bikes AS (SELECT event_id, ts AS started_at, ts + to_minutes(CAST(event_id % 400 - 5 AS INT)) AS ended_at, CASE WHEN event_type IN ('signup', 'purchase') THEN 'member' WHEN event_type IN ('view', 'click') THEN 'casual' END AS member_casual,
  CASE WHEN user_id % 4 = 0 THEN 'classic_bike' WHEN user_id % 4 = 1 THEN 'electric_bike' ELSE 'unknown' END AS rideable_type,
  user_id / 30.0 + 0.00731 AS start_lat, value / 100 + 0.0137 AS start_lng, (149 - user_id) / 30.0 + 0.00731 AS end_lat, value / 100 + 0.0137 AS end_lng FROM events),
weather AS (SELECT event_id, ts, {', '.join(f'{v} AS {k}' for k, v in WEATHER.items())} FROM events)
"""


class Views:
    """The views as DataFrames, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def trips(self) -> DataFrame:
        l, o = self.table("lineitem"), self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        c, s = self.table("customer").select("c_custkey", "c_nationkey"), self.table("supplier").select("s_suppkey", "s_nationkey")
        j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
        e = F.expr
        pickup = "o_orderdate + make_dt_interval(0, cast(l_orderkey % 24 as int), 0, 0)"
        return j.select(
            e(pickup).alias("pickup_datetime"), e(f"{pickup} + make_dt_interval(0, 0, cast(l_partkey % 97 - 3 as int), 0)").alias("dropoff_datetime"),
            e("cast(s_nationkey + 1 as int)").alias("PULocationID"), e("cast(c_nationkey + 1 as int)").alias("DOLocationID"),
            e("case when l_linenumber = 7 then null else l_quantity - 1 end").alias("trip_distance"),
            e("l_extendedprice / 1000 - 1").alias("fare_amount"), e("l_discount * 10").alias("tip_amount"), e("nullif(l_tax, 0) * 10").alias("tax_amount"),
            e("cast(l_partkey % 12 as int)").alias("passenger_count"), e("cast(l_linenumber % 5 as int)").alias("payment_type"),
            e("cast(nullif(l_partkey % 7, 0) as int)").alias("RatecodeID"), e("cast(1 + l_suppkey % 2 as int)").alias("trip_type"),
            e("'HV000' || cast(l_linenumber as string)").alias("hvfhs_license_num"),
            e("case l_returnflag when 'A' then 'yellow' when 'N' then 'green' else 'hvfhv' end").alias("dataset"),
        )

    @cached_property
    def clean(self) -> DataFrame:
        return pn.clean_trips(self.trips, START, END)

    @cached_property
    def keyed(self) -> DataFrame:
        return pn.with_provider(pn.with_panel_keys(self.clean, F.col("dataset").isin("yellow", "green")))

    @cached_property
    def od(self) -> DataFrame:
        cells = self.keyed.groupBy("dataset", "PULocationID", "DOLocationID", "date", "hour").agg(F.count("trip_distance").alias("trip_count"))
        return pn.unify_modes([pn.ModeSource("trips", cells, by_column="dataset")])

    @cached_property
    def zones(self) -> DataFrame:
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return n.select((F.col("n_nationkey") + 1).cast("int").alias("LocationID"), F.col("n_name").alias("zone"), F.col("r_name").alias("borough"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})

    @cached_property
    def entries(self) -> DataFrame:
        x = self.events.select((F.col("user_id") % 10).cast("int").alias("station"), "date", "hour", F.col("event_type").alias("fare_class"), F.floor("value").cast("double").alias("ridership"))
        return fl.hourly_entries(x)

    @cached_property
    def od_raw(self) -> DataFrame:
        e = F.expr
        x = self.table("orders").select(
            e("cast(o_custkey % 10 as int)").alias("origin"), e("cast((o_orderkey div 24) % 13 as int)").alias("dest"), F.lit(2024).alias("year"), F.month("o_orderdate").alias("month"),
            F.date_format("o_orderdate", "EEEE").alias("dow"), e("cast(o_orderkey % 24 as int)").alias("hour"), e("cast(floor(o_totalprice / 1000) as double)").alias("r"),
        )
        return x.groupBy("origin", "dest", "year", "month", "dow", "hour").agg(F.sum("r").alias("avg_ridership"))

    @cached_property
    def weights(self) -> DataFrame:
        return fl.conditional_weights(self.od_raw)

    @cached_property
    def points(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", (F.col("value") / 100 + 0.0137).alias("px"), (F.col("user_id") / 30.0 + 0.00731).alias("py"))

    @cached_property
    def rings(self) -> DataFrame:
        """The unit cells where something was bought, cut into triangles, as polygons."""
        g = self.table("events").where("event_type = 'purchase'").selectExpr("cast(floor(value / 100 + 0.0137D) as double) as i", "cast(floor(user_id / 30.0D + 0.00731D) as double) as j").distinct()
        g = g.selectExpr("i", "j", "explode(array(0, 1)) as k")
        return g.selectExpr("cast(20 * j + 2 * i + k as int) as zone_id", "array(case when k = 0 then array(array(i, j), array(i + 1, j), array(i + 1, j + 1), array(i, j)) else array(array(i, j), array(i + 1, j + 1), array(i, j + 1), array(i, j)) end) as coords")

    @cached_property
    def edges(self) -> DataFrame:
        return sp.polygons_to_edges(self.rings, "zone_id", "coords")

    @cached_property
    def homes(self) -> DataFrame:
        """Customers by tract, a square of a quarter: (a_id, x, y) of its corner."""
        x = self.table("customer").selectExpr("floor((c_acctbal + 1000) / 2200.0D * 4) as i", "floor(c_custkey % 150 / 30.0D * 4) as j", "c_acctbal")
        return x.selectExpr("cast(1000 * i + j as int) as a_id", "i / 4.0D + 0.1D as x", "j / 4.0D + 0.15D as y", "c_acctbal")

    @cached_property
    def tract_rings(self) -> DataFrame:
        g = self.homes.select("a_id", "x", "y").distinct()
        return g.selectExpr("a_id as zone_id", "array(array(array(x, y), array(x + 0.25D, y), array(x + 0.25D, y + 0.25D), array(x, y + 0.25D), array(x, y))) as coords")

    @cached_property
    def tract_edges(self) -> DataFrame:
        return sp.polygons_to_edges(self.tract_rings, "zone_id", "coords")

    @cached_property
    def bikes(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id", "ts as started_at", "ts + make_dt_interval(0, 0, cast(event_id % 400 - 5 as int), 0) as ended_at",
            "case when event_type in ('signup', 'purchase') then 'Subscriber' when event_type in ('view', 'click') then ' customer' else event_type end as usertype",
            "case when user_id % 4 = 0 then ' Classic_Bike' when user_id % 4 = 1 then 'electric_bike' else 'scooter' end as rideable_type",
            "user_id / 30.0D + 0.00731D as start_lat", "value / 100 + 0.0137D as start_lng", "(149 - user_id) / 30.0D + 0.00731D as end_lat", "value / 100 + 0.0137D as end_lng",
            "case when user_id % 9 = 0 then 'nan' else cast(user_id as string) end as start_station_id", "cast(149 - user_id as string) as end_station_id",
        )

    @cached_property
    def weather(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", *[F.expr(v).alias(k) for k, v in WEATHER.items()])

    @cached_property
    def tracts(self) -> DataFrame:
        """Census figures as text, a row per tract."""
        x = self.homes.groupBy("a_id").agg(F.count("*").alias("p"), F.sum(F.floor("c_acctbal").cast("long")).alias("i"))
        return x.selectExpr("a_id", "case when a_id % 11 = 3 then '0' when a_id % 11 = 4 then '-666666666' else cast(p as string) end as population", "case when a_id % 7 = 2 then '-666666666' when a_id % 7 = 3 then 'x' else cast(i as string) end as income", "cast(p % 17 as string) as workers")
