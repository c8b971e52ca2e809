"""End-to-end pipelines: raw tables to panels and zone tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.functions.clean import map_values, null_if_in, safe_share, try_num, whitelist
from zonehour.functions.geo import to_epsg2263
from zonehour.functions.time import duration_min, local_to_utc_strict, parse_ts
from zonehour.functions.weather import REPORT
from zonehour.operators import flows as fl
from zonehour.operators import panel as pn
from zonehour.operators import spatial as sp
from zonehour.operators.tables import Rule, conform, quality_filter
from zonehour.schemas import BIKE_TRIP, MEMBERS, MODES, RIDEABLES, panel_schema, trip_schema
from zonehour.sources.files import read_trips

#: Codes that stand for a missing census figure.
CENSUS_MISSING = (-666666666, -888888888, -222222222, -333333333, -555555555)


def clean_mode(spark: SparkSession, paths: Sequence[str], mode: str, start: str, end: str) -> DataFrame:
    """A mode's raw files, one path per schema generation -> its clean trips in their canonical schema.

    Rules on distance and fare hold where the mode records these.
    """
    m = MODES[mode]
    raw = read_trips(spark, paths, mode, start, end)
    return conform(pn.clean_trips(raw, start, end, m.fare, "trip_distance" if m.distance else None), trip_schema(mode))


def mode_panel(trips: DataFrame, mode: str) -> DataFrame:
    """A mode's clean trips -> its zone-hour panel in its canonical schema; ride-hail trips by provider."""
    m = MODES[mode]
    x = pn.with_panel_keys(trips, F.lit(mode in ("yellow", "green")))
    x = pn.with_provider(x) if mode == "hvfhv" else x
    panel = pn.zone_hour_panel(x, fares=m.fares, distance="trip_distance" if m.distance else None, street_hail="trip_type" if mode == "green" else None)
    return conform(panel, panel_schema(mode))


def clean_entries(df: DataFrame, start: str, end: str, mode: str = "subway") -> DataFrame:
    """Raw station entries -> (station, date, hour, fare_class, ridership, lat, lng), summed over the whole table."""
    ts = parse_ts(F.col("transit_timestamp"), "MM/dd/yyyy hh:mm:ss a")
    x = df.where(F.col("transit_mode") == mode).withColumn("ts", ts).where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    x = x.select(F.col("station_complex_id").alias("station"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.col("fare_class_category").alias("fare_class"), "ridership", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return fl.hourly_entries(x).join(fl.station_coords(x), "station", "left")


def od_weights(df: DataFrame) -> DataFrame:
    """Raw OD estimates -> conditional destination weights."""
    x = df.select(F.col("Origin Station Complex ID").alias("origin"), F.col("Year").alias("year"), F.col("Month").alias("month"), F.col("Day of Week").alias("dow"), F.col("Hour of Day").alias("hour"), F.col("Destination Station Complex ID").alias("dest"), F.col("Estimated Average Ridership").alias("avg_ridership"))
    return fl.conditional_weights(x)


def zone_flows(entries: DataFrame, weights: DataFrame, lookup: DataFrame, keep_fare_class: bool = True) -> DataFrame:
    """Entries to the flow panel. Weights go to zones before the fan-out, which the panel doesn't need by station."""
    by_zone = fl.weights_to_zones(weights, lookup)
    f = fl.estimate_flows(entries, by_zone).where("dest > 0")
    o = lookup.select(F.col("station").alias("origin"), F.col("zone").alias("PULocationID"))
    return fl.flow_panel(f.join(o, "origin").withColumnRenamed("dest", "DOLocationID"), keep_fare_class)


def bike_rules(first_year: int, last_year: int) -> list[Rule]:
    at = F.col("started_at")
    lo, hi = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (first_year, last_year + 1))
    places = [F.col(c) for c in ("start_lat", "start_lng", "end_lat", "end_lng")]
    known = F.lit(True)
    for p in places:
        known = known & p.isNotNull() & (p != 0)
    return [Rule("times", at.isNotNull() & F.col("ended_at").isNotNull()), Rule("years", (at >= lo) & (at < hi)), Rule("user", F.col("member_casual").isNotNull()), Rule("places", known)]


def clean_bikes(df: DataFrame, first_year: int = 2021, last_year: int = 2025) -> DataFrame:
    x = df.withColumn("member_casual", map_values(F.lower(F.trim("member_casual")), MEMBERS))
    x = x.withColumn("rideable_type", whitelist(F.col("rideable_type"), RIDEABLES) if "rideable_type" in df.columns else F.lit("unknown"))
    x = x.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("nan")) for c in ("start_station_id", "end_station_id") if c in x.columns})
    return conform(quality_filter(x, bike_rules(first_year, last_year)), BIKE_TRIP)


def bikes_to_zones(df: DataFrame, edges: DataFrame, project: bool = True, cell: float = 2000.0, nearest: bool = True, max_distance: float | None = None) -> DataFrame:
    """Adds start_zone and end_zone: distinct places are looked up once. edges in the same system as the places."""
    for end in ("start", "end"):
        lat, lng = F.col(f"{end}_lat"), F.col(f"{end}_lng")
        x, y = to_epsg2263(lat, lng) if project else (lng, lat)
        df = df.withColumns({f"__{end}_x": x, f"__{end}_y": y})
    out = sp.assign_zones(df, {"start_zone": ("__start_x", "__start_y"), "end_zone": ("__end_x", "__end_y")}, edges, cell, nearest, max_distance)
    return out.where((F.col("start_zone") > 0) & (F.col("end_zone") > 0)).drop("__start_x", "__start_y", "__end_x", "__end_y")


def bike_panel(df: DataFrame, cap_min: float = 300.0) -> DataFrame:
    """Bike trips by zones, date, hour, user and vehicle, with exact percentiles."""
    x = sp.trip_km(df.withColumn("duration_min", duration_min(F.col("started_at"), F.col("ended_at"))))
    x = x.where((F.col("duration_min") > 0) & (F.col("duration_min") <= cap_min) & (F.col("rideable_type") != "unknown"))
    x = x.withColumns({"date": F.to_date("started_at"), "hour": F.hour("started_at")})
    p = pn.zone_hour_panel(x, ["start_zone", "end_zone", "date", "hour", "member_casual", "rideable_type"], distance="distance_km")
    return p.withColumnsRenamed({"trip_count": "n_trips", "avg_distance": "avg_distance_km", "avg_duration_min": "mean_duration_min"})


def clean_weather(df: DataFrame, tz: str = "America/New_York", kinds: Sequence[str] = ("FM-15", "FM-16"), more: Sequence[str] = ()) -> DataFrame:
    """Packed hourly reports -> measures in UTC, and the columns `more`; wall times that a clock change makes unclear are left out."""
    x = df.where(F.trim("REPORT_TYPE").isin(*kinds)).withColumn("at", local_to_utc_strict(parse_ts(F.col("DATE")), tz)).where("at is not null")
    def one(packed: str, read) -> Column:
        return read(F.col(packed)) if packed in df.columns else F.lit(None).cast("double")

    return x.select("STATION", *more, "at", *[one(p, f).alias(n) for n, (p, f) in REPORT.items()])


def clean_census(df: DataFrame, figures: Sequence[str], shares: dict[str, tuple[str, str]], population: str = "population") -> DataFrame:
    """Figures as numbers without codes for missing, shares with a zero-safe division, and a flag for empty tracts."""
    x = df.withColumns({c: null_if_in(try_num(F.col(c)), CENSUS_MISSING) for c in figures})
    x = x.withColumns({n: safe_share(F.col(a), F.col(b)) for n, (a, b) in shares.items()})
    return x.withColumn("zero_population", F.coalesce(F.col(population), F.lit(0.0)) == 0)


def crosswalk(tracts: DataFrame, zones: DataFrame, cell: float = 5000.0) -> DataFrame:
    """(a_id, b_id, area, area_weight, coverage): tract areas dealt out to zones; coverage is the tract's share in any zone."""
    w = sp.area_weights(sp.overlay_area(tracts, zones, cell))
    whole = sp.polygon_area(tracts).select(F.col("zone_id").alias("a_id"), F.col("area").alias("whole"))
    covered = w.groupBy("a_id").agg(F.sum("area").alias("covered"))
    return w.join(covered, "a_id").join(whole, "a_id").select("a_id", "b_id", "area", "area_weight", (F.col("covered") / F.col("whole")).alias("coverage"))
