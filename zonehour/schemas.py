"""Canonical schemas and the registry of travel modes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Fare components by mode, in the order of their files.
FARES = {
    "yellow": ["fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "congestion_surcharge", "airport_fee", "cbd_congestion_fee"],
    "green": ["fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "congestion_surcharge", "cbd_congestion_fee"],
    "hvfhv": ["base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "tips", "driver_pay", "cbd_congestion_fee"],
    "fhv": [],
}
#: Licence numbers of the ride-hail providers.
PROVIDERS = {"HV0002": "juno", "HV0003": "uber", "HV0004": "via", "HV0005": "lyft"}
#: The zone numbers that stand for no place in the city.
NO_ZONES = (264, 265)


@dataclass(frozen=True)
class Mode:
    """How one mode's trip files name things; None where they have no such column."""

    name: str
    pickup: str
    dropoff: str
    distance: str | None
    passengers: str | None
    fare: str | None
    extra: tuple[str, ...] = ()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def fares(self) -> list[str]:
        return FARES[self.name]


MODES = {
    m.name: m
    for m in (
        Mode("yellow", "tpep_pickup_datetime", "tpep_dropoff_datetime", "trip_distance", "passenger_count", "fare_amount", ("payment_type", "RatecodeID"), {"airport_fee": ("airport_fee", "Airport_fee")}),
        Mode("green", "lpep_pickup_datetime", "lpep_dropoff_datetime", "trip_distance", "passenger_count", "fare_amount", ("payment_type", "RatecodeID", "trip_type")),
        Mode("hvfhv", "pickup_datetime", "dropoff_datetime", "trip_miles", None, "base_passenger_fare", ("hvfhs_license_num",)),
        Mode("fhv", "pickup_datetime", "dropoff_datetime", None, None, None, (), {"PULocationID": ("PULocationID", "PUlocationID"), "DOLocationID": ("DOLocationID", "DOlocationID"), "dropoff_datetime": ("dropoff_datetime", "dropOff_datetime")}),
    )
}


def trip_schema(mode: str) -> T.StructType:
    """One clean trip of a mode."""
    s = T.StructType()
    for n in ("pickup_datetime", "dropoff_datetime"):
        s = s.add(n, T.TimestampNTZType())
    for n in ("PULocationID", "DOLocationID"):
        s = s.add(n, T.IntegerType())
    s = s.add("trip_distance", T.FloatType()).add("duration_min", T.FloatType()).add("passenger_count", T.ByteType())
    s = s.add("dataset", T.StringType()).add("hvfhs_license_num", T.StringType())
    for n in ("payment_type", "RatecodeID", "trip_type"):
        s = s.add(n, T.ByteType())
    for n in FARES[mode]:
        s = s.add(n, T.FloatType())
    return s


def panel_schema(mode: str) -> T.StructType:
    """One cell of the zone-hour panel."""
    s = T.StructType().add("PULocationID", T.IntegerType()).add("DOLocationID", T.IntegerType()).add("date", T.DateType()).add("hour", T.ByteType())
    s = s.add("dataset", T.StringType()).add("hail_type", T.StringType()).add("trip_count", T.IntegerType())
    for n in ("avg_distance", "avg_duration_min", "median_duration_min", "std_duration_min", "p10_duration_min", "p90_duration_min", "avg_passengers"):
        s = s.add(n, T.FloatType())
    for n in FARES[mode]:
        s = s.add(f"avg_{n}", T.FloatType())
    if FARES[mode]:
        s = s.add("avg_total", T.FloatType())
    return s.add("is_street_hail", T.BooleanType()) if mode == "green" else s


FLOW = T.StructType().add("PULocationID", T.IntegerType()).add("DOLocationID", T.IntegerType()).add("date", T.DateType()).add("hour", T.ByteType()).add("dataset", T.StringType()).add("fare_class_category", T.StringType()).add("trip_count", T.DoubleType())

BIKE_TRIP = T.StructType().add("started_at", T.TimestampNTZType()).add("ended_at", T.TimestampNTZType())
for _n in ("start_lat", "start_lng", "end_lat", "end_lng"):
    BIKE_TRIP = BIKE_TRIP.add(_n, T.DoubleType())
for _n in ("start_station_id", "end_station_id", "member_casual", "rideable_type", "source_file"):
    BIKE_TRIP = BIKE_TRIP.add(_n, T.StringType())

ENTRIES_CSV = T.StructType()
for _n in ("transit_timestamp", "transit_mode", "station_complex_id", "fare_class_category"):
    ENTRIES_CSV = ENTRIES_CSV.add(_n, T.StringType())
for _n in ("ridership", "latitude", "longitude"):
    ENTRIES_CSV = ENTRIES_CSV.add(_n, T.DoubleType())

OD_CSV = T.StructType().add("Year", T.IntegerType()).add("Month", T.IntegerType()).add("Day of Week", T.StringType()).add("Hour of Day", T.IntegerType())
for _n in ("Origin Station Complex ID", "Destination Station Complex ID"):
    OD_CSV = OD_CSV.add(_n, T.StringType())
for _n in ("Estimated Average Ridership", "Origin Latitude", "Origin Longitude", "Destination Latitude", "Destination Longitude"):
    OD_CSV = OD_CSV.add(_n, T.DoubleType())

#: Names of bike columns, oldest and newest files first and last.
BIKE_ALIASES = {
    "started_at": ("started_at", "starttime", "Start Time"),
    "ended_at": ("ended_at", "stoptime", "Stop Time"),
    "start_station_id": ("start_station_id", "start station id", "Start Station ID"),
    "end_station_id": ("end_station_id", "end station id", "End Station ID"),
    "start_lat": ("start_lat", "start station latitude", "Start Station Latitude"),
    "start_lng": ("start_lng", "start station longitude", "Start Station Longitude"),
    "end_lat": ("end_lat", "end station latitude", "End Station Latitude"),
    "end_lng": ("end_lng", "end station longitude", "End Station Longitude"),
    "member_casual": ("member_casual", "usertype", "User Type"),
    "rideable_type": ("rideable_type",),
}
#: What user types are called.
MEMBERS = {"subscriber": "member", "customer": "casual", "member": "member", "casual": "casual"}
RIDEABLES = ("classic_bike", "electric_bike", "docked_bike")
