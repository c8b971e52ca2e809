"""Trips to the zone-hour panel, and panels of all modes as one table of cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonehour.functions.clean import hail_type, map_values, null_outside, row_total
from zonehour.functions.time import duration_min
from zonehour.operators.tables import Rule, quality_filter
from zonehour.schemas import PROVIDERS

KEYS = ("PULocationID", "DOLocationID", "date", "hour", "dataset", "hail_type")


def trip_rules(df: DataFrame, start: str, end: str, fare: str | None = "fare_amount", distance: str | None = "trip_distance") -> list[Rule]:
    """Both times valid, pickup in [start, end), some duration, and a distance and a fare where the mode has them."""
    pu, do = F.col("pickup_datetime"), F.col("dropoff_datetime")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    rules = [Rule("times", pu.isNotNull() & do.isNotNull()), Rule("window", (pu >= lo) & (pu < hi)), Rule("duration", do > pu)]
    rules += [Rule(n, F.col(c) > 0) for n, c in (("distance", distance), ("fare", fare)) if c and c in df.columns]
    return rules


def clean_trips(df: DataFrame, start: str, end: str, fare: str | None = "fare_amount", distance: str | None = "trip_distance") -> DataFrame:
    """Trips that meet the rules, with their minutes; passenger counts other than 1 to 9 become NULL."""
    x = quality_filter(df, trip_rules(df, start, end, fare, distance))
    x = x.withColumn("duration_min", duration_min(F.col("pickup_datetime"), F.col("dropoff_datetime")))
    return x.withColumn("passenger_count", null_outside(F.col("passenger_count"), 1, 9).cast("byte")) if "passenger_count" in x.columns else x


def with_panel_keys(trips: DataFrame, hailed: Column | None = None) -> DataFrame:
    """Adds date, hour and hail_type. hailed: for which rows a hail type is defined."""
    kind = hail_type(F.col("payment_type"), F.col("RatecodeID"))
    if hailed is not None:
        kind = F.when(hailed, kind)
    return trips.withColumns({"date": F.to_date("pickup_datetime"), "hour": F.hour("pickup_datetime"), "hail_type": kind})


def with_provider(trips: DataFrame, label: str = "hvfhv") -> DataFrame:
    """Ride-hail trips get their provider as dataset."""
    return trips.withColumn("dataset", F.when(F.col("dataset") == label, map_values(F.col("hvfhs_license_num"), PROVIDERS, "hvfhv_other")).otherwise(F.col("dataset")))


def zone_hour_panel(trips: DataFrame, keys: Sequence[str] = KEYS, fares: Sequence[str] = (), pct: Sequence[float] = (0.1, 0.5, 0.9), duration: str = "duration_min", distance: str | None = "trip_distance", street_hail: str | None = None) -> DataFrame:
    """One row per key: trips, means, exact percentiles and deviation of the duration, fare means.

    trip_count counts trips with a distance, or all where the mode records none.
    A NULL key value is a group of its own. street_hail: a trip type whose
    majority (half or more ones) sets the flag.
    """
    aggs = [F.count(distance).alias("trip_count") if distance else F.count("*").alias("trip_count")]
    if distance:
        aggs.append(F.avg(distance).alias("avg_distance"))
    aggs += [F.avg(duration).alias("avg_duration_min"), F.stddev_samp(duration).alias("std_duration_min"), F.percentile(duration, F.array(*map(F.lit, pct))).alias("__pct")]
    if "passenger_count" in trips.columns:
        aggs.append(F.avg("passenger_count").alias("avg_passengers"))
    aggs += [F.avg(f).alias(f"avg_{f}") for f in fares]
    if fares:
        aggs.append(F.avg(row_total([F.col(f) for f in fares])).alias("avg_total"))
    if street_hail:
        aggs.append((F.avg(F.when(F.col(street_hail) == 1, 1.0).otherwise(0.0)) >= 0.5).alias("is_street_hail"))
    out = trips.groupBy(*keys).agg(*aggs)
    names = [("median" if p == 0.5 else f"p{round(100 * p)}") + "_" + duration for p in pct]
    return out.withColumns({n: F.col("__pct")[k] for k, n in enumerate(names)}).drop("__pct")


def merge_summaries(df: DataFrame, keys: Sequence[str], n: str = "n_trips") -> DataFrame:
    """Partial panels as one: weighted means, means of medians and deviations, least p10, largest p90.

    Means are exact, the others are what can be had of summaries alone; the panel itself never needs them.
    """
    rules = {"avg": lambda c: F.sum(F.col(c) * F.col(n)) / F.sum(n), "mean": lambda c: F.sum(F.col(c) * F.col(n)) / F.sum(n), "median": F.avg, "std": F.avg, "p10": F.min, "p90": F.max}
    cols = [c for c in df.columns if c.split("_")[0] in rules]
    return df.groupBy(*keys).agg(F.sum(n).alias(n), *[rules[c.split("_")[0]](c).alias(c) for c in cols])


@dataclass(frozen=True)
class ModeSource:
    """A mode's panel: its table and which columns mean what."""

    mode: str
    df: DataFrame
    pu: str = "PULocationID"
    do: str = "DOLocationID"
    n: str = "trip_count"
    keep: Column | None = None
    by_column: str | None = None


def unify_modes(sources: Sequence[ModeSource]) -> DataFrame:
    """(mode, pu, do, date, hour, n) of all sources, cells with demand only. by_column: a column that names the mode."""
    parts = []
    for s in sources:
        df = s.df if s.keep is None else s.df.where(s.keep)
        mode = F.col(s.by_column) if s.by_column else F.lit(s.mode)
        parts.append(df.select(mode.alias("mode"), F.col(s.pu).cast("int").alias("pu"), F.col(s.do).cast("int").alias("do"), "date", F.col("hour").cast("int").alias("hour"), F.col(s.n).cast("double").alias("n")).where("n > 0"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
