"""Station entries, conditional destination weights, and the flows they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonehour.operators.tables import conform
from zonehour.schemas import FLOW
from zonehour.shared import staged

CONTEXT = ("origin", "year", "month", "dow", "hour")


def hourly_entries(df: DataFrame, keys: Sequence[str] = ("station", "date", "hour", "fare_class"), value: str = "ridership") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def station_coords(df: DataFrame, station: str = "station", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """A station's place: the medians of what its rows say."""
    return df.groupBy(station).agg(F.median(lat).alias(lat), F.median(lng).alias(lng))


def first_seen(df: DataFrame, station: str, value: Sequence[str], priority: Column) -> DataFrame:
    """One place per station: of the least priority, then the least values."""
    v = F.struct(*value)
    return df.groupBy(station).agg(F.min_by(v, F.struct(priority.alias("p"), *value)).alias("v")).select(station, "v.*")


def context_totals(df: DataFrame, context: Sequence[str] = CONTEXT, value: str = "avg_ridership") -> DataFrame:
    return df.where(F.col(value) > 0).groupBy(*context).agg(F.sum(value).alias("total"))


def conditional_weights(df: DataFrame, context: Sequence[str] = CONTEXT, dest: str = "dest", value: str = "avg_ridership") -> DataFrame:
    """weight = value over its context's total; rows without a positive value go first. One shuffle, no self-join."""
    x = df.where(F.col(value) > 0)
    return x.select(*context, dest, value, (F.col(value) / F.sum(value).over(W.partitionBy(*context))).alias("weight"))


def weight_check(df: DataFrame, context: Sequence[str] = CONTEXT, w: str = "weight") -> DataFrame:
    """How many contexts there are, and how far their weights' sum is from 1 at most."""
    s = df.groupBy(*context).agg(F.sum(w).alias("s"))
    return s.agg(F.count("*").alias("n_contexts"), F.max(F.abs(F.col("s") - 1)).alias("max_deviation"))


def months_with_od(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Entries of months that the weights cover. Of files by year and month only those months' are read."""
    months = weights.where(F.col("weight") > 0).select("year", "month").distinct()
    return entries.join(F.broadcast(months), ["year", "month"], "left_semi")  # twelve rows a year


def with_calendar(entries: DataFrame, date: str = "date") -> DataFrame:
    """Adds year, month and the day's name, the keys of the weights."""
    return entries.withColumns({"year": F.year(date), "month": F.month(date), "dow": F.date_format(date, "EEEE")})


#: Entries of one context that meet its weights in one task.
HOT_ROWS = 100_000


def _salted(e: DataFrame, w: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: contexts of more entries than hot_rows get one per that many, and their weights come once for each."""
    of = dict(zip(CONTEXT, ("station", *CONTEXT[1:]), strict=True))
    hot = e.groupBy(*of.values()).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = staged(hot.select(*[F.col(c).alias(f"h_{k}") for k, c in of.items()], F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")), "hot-contexts")

    def known(df: DataFrame, name) -> DataFrame:
        on = [F.col(name(k)) == F.col(f"h_{k}") for k in CONTEXT]
        return df.join(hot, on, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).drop(*[f"h_{k}" for k in CONTEXT])

    e = known(e, lambda k: of[k]).withColumn("salt", F.pmod(F.xxhash64(*e.columns), F.col("salts")).cast("int")).drop("salts")
    w = known(w, lambda k: f"w_{k}").withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return e, w


def estimate_flows(entries: DataFrame, weights: DataFrame, whole_months: bool = True, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """entries(station, date, hour, ...) fanned out over the destinations of their context.

    Entries without weights stay, with dest -1 and their own station as origin,
    and a NULL weight and flow. whole_months: months that the weights lack are
    left out. Contexts are counted at once; one of more entries than hot_rows is dealt to several tasks,
    each with its weights. hot_rows=None: no context is, for tables that are bucketed by context.
    """
    e = entries if {"year", "month", "dow"} <= set(entries.columns) else with_calendar(entries)
    if whole_months:
        e = months_with_od(e, weights)
    w = weights.select(*[F.col(c).alias(f"w_{c}") for c in CONTEXT], F.col("dest").alias("w_dest"), "weight")
    on = (F.col("station") == F.col("w_origin")) & (F.col("year") == F.col("w_year")) & (F.col("month") == F.col("w_month")) & (F.col("dow") == F.col("w_dow")) & (F.col("hour") == F.col("w_hour"))
    if hot_rows is not None:
        e, w = _salted(e, w, hot_rows)
        on = on & (F.col("salt") == F.col("w_salt"))
    x = e.join(w, on, "left")
    return x.select("date", "hour", "fare_class", "month", F.coalesce("w_origin", "station").alias("origin"), F.coalesce("w_dest", F.lit(-1)).alias("dest"), "ridership", "weight", (F.col("ridership") * F.col("weight")).alias("flow"))


def match_report(flows: DataFrame, by: Sequence[str] = ("month",)) -> DataFrame:
    return flows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col("weight").isNull()).alias("n_unmatched"), F.sum("flow").alias("flow"))


def flows_to_zones(flows: DataFrame, lookup: DataFrame, how: str = "inner") -> DataFrame:
    """Both ends' zones from lookup(station, zone); rows without a destination drop out."""
    o = lookup.select(F.col("station").alias("origin"), F.col("zone").alias("PULocationID"))
    d = lookup.select(F.col("station").alias("dest"), F.col("zone").alias("DOLocationID"))
    return flows.join(o, "origin", how).join(d, "dest", how)


def weights_to_zones(weights: DataFrame, lookup: DataFrame) -> DataFrame:
    """Weights summed to destination zones: where only the panel is wanted, entries fan out over zones, not stations."""
    z = lookup.select(F.col("station").alias("dest"), F.col("zone"))
    return weights.join(z, "dest").groupBy(*CONTEXT, "zone").agg(F.sum("weight").alias("weight")).withColumnRenamed("zone", "dest")


def flow_panel(flows: DataFrame, keep_fare_class: bool = True, as_int: bool = False) -> DataFrame:
    """Flows summed to zone pair, date, hour and fare class, over all of the table at once."""
    keys = ["PULocationID", "DOLocationID", "date", "hour", *(["fare_class"] if keep_fare_class else [])]
    total = F.sum("flow")
    return flows.where((F.col("PULocationID") > 0) & (F.col("DOLocationID") > 0)).groupBy(*keys).agg((total.cast("int") if as_int else total).alias("trip_count"))


def conform_flows(df: DataFrame, mode: str = "mta") -> DataFrame:
    """A flow panel in the trip panel's terms: the fare class stands where taxis have the hail type."""
    x = conform(df.withColumnRenamed("fare_class", "fare_class_category").withColumn("dataset", F.lit(mode)), FLOW)
    return x.withColumnRenamed("fare_class_category", "hail_type")
