"""Market-thickness analyses over od_cells(mode, pu, do, date, hour, n)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonehour.functions.time import block_number, dow0, year_month
from zonehour.operators.ordered import exact_quantiles, running, same
from zonehour.operators.tables import attach_dim, norm_to_max, top_n, with_intensity
from zonehour.schemas import NO_ZONES

THRESHOLDS = (1, 5, 10, 30)


def threshold_shares(c: str = "tot") -> list[Column]:
    return [(100.0 * F.count_if(F.col(c) >= t) / F.count("*")).alias(f"ge{t}_pct") for t in THRESHOLDS]


def with_quantiles(df: DataFrame, by: str, value: str, qs: Sequence[float], aggs: Sequence[Column] = (), exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """(by, aggs, q): q has the quantiles of each group, a group of any size.

    Exact ones come from ranges of the values, which no task holds whole; approximate
    ones from sketches in one pass, off by the rank of one in `accuracy` at most.
    """
    if not exact:
        return df.groupBy(by).agg(*aggs, F.percentile_approx(F.col(value).cast("double"), list(qs), accuracy).alias("q"))
    q = exact_quantiles(df, [by], value, qs)
    stats = df.groupBy(by).agg(*aggs) if aggs else df.select(by).distinct()
    return stats.alias("s").join(q.alias("t"), same("s", "t", [by]), "left").select("s.*", "t.q")


def sparsity(od: DataFrame, zones: int, exact: bool = True) -> DataFrame:
    """Per mode: cells seen of all possible, and how demand is spread over them."""
    cells = od.groupBy("mode", "pu", "do", "date", "hour").agg(F.sum("n").alias("n"))
    qs = (0.05, 0.25, 0.5, 0.75, 0.9, 0.99)
    aggs = [F.count("*").alias("observed_cells"), (F.count_distinct("date") * zones * zones * 24).alias("possible_cells"), F.avg("n").alias("mean_demand"), F.sum("n").alias("total_demand")]
    out = with_quantiles(cells, "mode", "n", qs, aggs, exact)
    out = out.withColumn("fill_rate_pct", 100.0 * F.col("observed_cells") / F.col("possible_cells"))
    return out.select("*", *[F.col("q")[k].alias(f"p{round(100 * q)}") for k, q in enumerate(qs)]).drop("q")


def temporal_sensitivity(od: DataFrame) -> DataFrame:
    """Cells and shares of cells above thresholds, by how coarse time is: one scan for the three.

    Days and their parts are small numbers in the key, not text, of which a task would hold more: every cell is there for each granularity.
    """
    grain = [("hour x date", F.unix_date("date"), F.col("hour")), ("dow x hour", dow0(F.col("date")), F.col("hour")), ("block x date", F.unix_date("date"), block_number(F.col("hour")))]
    key = F.array(*[F.struct(F.lit(k).cast("int").alias("grain"), day.cast("int").alias("day"), part.cast("int").alias("part")) for k, (_, day, part) in enumerate(grain)])
    cells = od.select("mode", "pu", "do", "n", F.explode(key).alias("k")).groupBy("mode", "k.grain", "pu", "do", "k.day", "k.part").agg(F.sum("n").alias("tot"))
    out = cells.groupBy("mode", "grain").agg(F.count("*").alias("n_cells"), *threshold_shares())
    names = F.array(*[F.lit(name) for name, *_ in grain])
    return out.select("mode", names[F.col("grain")].alias("granularity"), "n_cells", *[f"ge{t}_pct" for t in THRESHOLDS])


def spatial_sensitivity(od: DataFrame, zones: DataFrame) -> DataFrame:
    """The same by how coarse space is: zone pairs, origins, borough pairs; time is day of week and hour."""
    x = attach_dim(od.withColumn("dow", dow0(F.col("date"))), zones.select("LocationID", "borough"), "LocationID", {"pu": "pu_", "do": "do_"})
    grain = [("OD full", ["pu", "do"]), ("origin only", ["pu"]), ("borough OD", ["pu_borough", "do_borough"])]
    key = F.array(*[F.struct(F.lit(n).alias("spatial"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("place")) for n, cols in grain])
    cells = x.select("mode", "dow", "hour", "n", F.explode(key).alias("k")).groupBy("mode", "k.spatial", "k.place", "dow", "hour").agg(F.sum("n").alias("tot"))
    return cells.groupBy("mode", "spatial").agg(F.count("*").alias("n_cells"), *threshold_shares())


def _present(od: DataFrame) -> DataFrame:
    return od.select("mode", "pu", "do", dow0(F.col("date")).alias("dow"), "hour").distinct()


def copresence(od: DataFrame) -> DataFrame:
    """Cells by the number of modes present."""
    n = _present(od).groupBy("pu", "do", "dow", "hour").agg(F.count("*").alias("n_modes"))
    h = n.groupBy("n_modes").agg(F.count("*").alias("n_cells"))
    return h.withColumn("share_pct", 100.0 * F.col("n_cells") / F.sum("n_cells").over(W.partitionBy()))


def presence_by_mode(od: DataFrame) -> DataFrame:
    """Share of all cells that each mode is present in."""
    sets = _present(od).groupBy("pu", "do", "dow", "hour").agg(F.collect_set("mode").alias("modes"))
    # Every cell also counts once for all modes together.
    marks = F.concat(F.transform("modes", lambda m: F.struct(m.alias("mode"), F.lit(False).alias("every"))), F.array(F.struct(F.lit(None).cast("string").alias("mode"), F.lit(True).alias("every"))))
    by = sets.select(F.explode(marks).alias("k")).groupBy("k.mode", "k.every").agg(F.count("*").alias("cells_present"))
    by = by.withColumn("total_cells", F.max(F.when(F.col("every"), F.col("cells_present"))).over(W.partitionBy())).where(~F.col("every"))
    return by.select("mode", "cells_present", "total_cells", (100.0 * F.col("cells_present") / F.col("total_cells")).alias("presence_pct"))


def lorenz_curve(od: DataFrame, ascending: bool = True) -> DataFrame:
    """(mode, pu, do, tot, rank, cum_pairs, cum_demand): pairs by demand, and the running shares."""
    v = od.groupBy("mode", "pu", "do").agg(F.sum("n").alias("tot"))
    first = F.col("tot").asc() if ascending else F.col("tot").desc()
    x = running(v, ["mode"], [first, "pu", "do"], {"rank": F.lit(1), "demand": F.col("tot")})
    return x.select("mode", "pu", "do", "tot", "rank", (F.col("rank") / F.col("rank_total")).alias("cum_pairs"), (F.col("demand") / F.col("demand_total")).alias("cum_demand"))


def lorenz(od: DataFrame, targets: Sequence[float] = (0.5, 0.8, 0.95), ascending: bool = True) -> DataFrame:
    """Share of pairs, from the smallest (or the largest) on, before the target share of demand is reached."""
    c = lorenz_curve(od, ascending)
    return c.groupBy("mode").agg(F.count("*").alias("n_pairs"), *[(100.0 * F.count_if(F.col("cum_demand") < t) / F.count("*")).alias(f"pairs_for_{round(100 * t)}_pct") for t in targets])


def _totals(od: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    return od.groupBy("mode", *keys).agg(F.sum("n").alias("total_demand"), F.avg("n").alias("avg_per_cell"), F.count("*").alias("n_cells"))


def hourly_profile(od: DataFrame) -> DataFrame:
    return _totals(od, ["hour"])


def dow_profile(od: DataFrame) -> DataFrame:
    return _totals(od, [dow0(F.col("date")).alias("dow")])


def monthly_trend(od: DataFrame) -> DataFrame:
    return _totals(od, [year_month(F.col("date")).alias("year_month")]).drop("avg_per_cell")


def _both_ends(od: DataFrame, *more: str) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.lit("origin").alias("direction"), F.col("pu").alias("zone")), F.struct(F.lit("destination").alias("direction"), F.col("do").alias("zone"))))
    return od.select("mode", "n", *more, ends.alias("e")).select("mode", "n", *more, "e.*")


def top_zones(od: DataFrame, n: int = 20) -> DataFrame:
    t = _both_ends(od).groupBy("mode", "direction", "zone").agg(F.sum("n").alias("total_demand"), F.count("*").alias("n_cells"))
    return top_n(t, ["mode", "direction"], [F.desc("total_demand"), F.col("zone")], n)


def price_distribution(df: DataFrame, fare: str, by: str = "dataset", lo: float = 0, hi: float = 500, exact: bool = True) -> DataFrame:
    """Fares between the limits, by mode."""
    qs = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95)
    aggs = [F.avg(fare).alias("mean_fare"), F.stddev_samp(fare).alias("std_fare"), F.count("*").alias("n_cells")]
    x = with_quantiles(df.where((F.col(fare) > lo) & (F.col(fare) < hi)), by, fare, qs, aggs, exact)
    return x.select("*", *[F.col("q")[k].alias(f"p{round(100 * q)}") for k, q in enumerate(qs)]).drop("q")


def box_stats(df: DataFrame, value: str, by: str = "dataset", exact: bool = True) -> DataFrame:
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    x = with_quantiles(df.where(F.col(value).isNotNull()), by, value, qs, exact=exact)
    return x.select(by, *[F.col("q")[k].alias(f"p{round(100 * q)}") for k, q in enumerate(qs)])


def demand_cdf(od: DataFrame, points: int = 199, exact: bool = True) -> DataFrame:
    """(mode, q, n): that many quantiles of a cell's demand."""
    qs = [k / (points + 1) for k in range(1, points + 1)]
    x = with_quantiles(od, "mode", "n", qs, exact=exact)
    return x.select("mode", F.posexplode("q").alias("k", "n")).select("mode", (F.col("k") + 1).alias("k"), "n")


def interpolate(grid: Column, value: Column) -> Column:
    """Place of a value in a sorted array of quantiles, between 0 and 1, linear between them."""
    n = F.size(grid)
    below = F.size(F.filter(grid, lambda g: g <= value))
    a, b = F.try_element_at(grid, below), F.try_element_at(grid, below + 1)
    return F.when(below == 0, 0.0).when(below >= n, 1.0).otherwise((below - 1 + (value - a) / (b - a)) / (n - 1))


def fill_matrix(od: DataFrame, zones: int, per_date: bool = True) -> DataFrame:
    """Per mode and day of the week a column h0 ... h23: percent of possible cells seen; 0 where there are none.

    per_date: possible cells count each date of that day of the week; else one date's.
    """
    x = od.select("mode", "pu", "do", "date", dow0(F.col("date")).alias("dow"), "hour").distinct()
    dates = od.select("mode", "date", dow0(F.col("date")).alias("dow")).distinct().groupBy("mode", "dow").agg(F.count("*").alias("days"))
    seen = x.groupBy("mode", "dow").pivot("hour", list(range(24))).agg(F.count(F.lit(1)))
    spine = od.select("mode").distinct().select("mode", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow"))
    y = spine.join(seen, ["mode", "dow"], "left").join(dates, ["mode", "dow"], "left")
    possible = F.lit(float(zones * zones)) * (F.col("days") if per_date else F.lit(1))
    return y.select("mode", "dow", *[F.coalesce(100.0 * F.col(f"`{h}`") / possible, F.lit(0.0)).alias(f"h{h}") for h in range(24)])


def normalised_profile(od: DataFrame, slot: str = "hour") -> DataFrame:
    """(mode, slot, total, share of the mode's largest), with zeros where a mode has no demand. slot: hour, dow or month."""
    value, spine = {"hour": (F.col("hour"), (0, 23)), "dow": (dow0(F.col("date")), (0, 6)), "month": (F.month("date"), (1, 12))}[slot]
    t = od.groupBy("mode", value.cast("int").alias("slot")).agg(F.sum("n").alias("total"))
    s = od.select("mode").distinct().select("mode", F.explode(F.sequence(F.lit(spine[0]), F.lit(spine[1]))).alias("slot"))
    x = s.join(t, ["mode", "slot"], "left").select("mode", "slot", F.coalesce("total", F.lit(0.0)).alias("total"))
    return x.withColumn("norm", norm_to_max(F.col("total"), ["mode"]))


def zone_quarter(od: DataFrame) -> DataFrame:
    """Demand by mode, direction, year, quarter and zone: one scan for both directions."""
    x = _both_ends(od, "date").withColumns({"year": F.year("date"), "quarter": F.quarter("date")})
    return x.groupBy("mode", "direction", "year", "quarter", "zone").agg(F.sum("n").alias("total"))


def between_zones(od: DataFrame, drop_zones: Sequence[int] = NO_ZONES) -> DataFrame:
    """Cells of two different zones, none of them a place outside."""
    return od.where((F.col("pu") != F.col("do")) & ~F.col("pu").isin(*drop_zones) & ~F.col("do").isin(*drop_zones))


def od_quarter(od: DataFrame, drop_zones: Sequence[int] = NO_ZONES) -> DataFrame:
    """Demand of zone pairs by quarter, without trips within a zone or to no place."""
    return between_zones(od, drop_zones).groupBy("mode", F.year("date").alias("year"), F.quarter("date").alias("quarter"), "pu", "do").agg(F.sum("n").alias("total"))


def top_od_quarter(od: DataFrame, n: int = 100) -> DataFrame:
    return top_n(od_quarter(od), ["mode", "year", "quarter"], [F.desc("total"), F.col("pu"), F.col("do")], n)


def _picked(df: DataFrame, modes: Sequence[str] | None, first: tuple[int, int] | None, last: tuple[int, int] | None) -> DataFrame:
    at = F.col("year") * 4 + F.col("quarter")
    conds = [F.col("mode").isin(*modes)] if modes else []
    conds += [at >= first[0] * 4 + first[1]] if first else []
    conds += [at <= last[0] * 4 + last[1]] if last else []
    return reduce(lambda d, c: d.where(c), conds, df)


def zone_explorer(od: DataFrame, direction: str = "origin", modes: Sequence[str] | None = None, first: tuple[int, int] | None = None, last: tuple[int, int] | None = None) -> DataFrame:
    """Demand per zone over the picked modes and quarters, and its intensity."""
    z = _picked(zone_quarter(od).where(F.col("direction") == direction), modes, first, last).groupBy("zone").agg(F.sum("total").alias("total"))
    return with_intensity(z, "total")


def zone_card(zones: DataFrame) -> DataFrame:
    """One row about a zone_explorer result."""
    return zones.agg(F.count("*").alias("n_zones"), F.sum("total").alias("total"), F.min_by("zone", F.struct(-F.col("total"), F.col("zone"))).alias("top_zone"), F.max("total").alias("top_total"))


def route_explorer(od: DataFrame, modes: Sequence[str] | None = None, first: tuple[int, int] | None = None, last: tuple[int, int] | None = None, n: int = 15) -> DataFrame:
    """The largest routes over all data of the picked modes and quarters, and their share of the largest."""
    r = _picked(od_quarter(od), modes, first, last).groupBy("pu", "do").agg(F.sum("total").alias("total")).orderBy(F.desc("total"), "pu", "do").limit(n)
    return r.withColumn("bar_pct", 100.0 * F.col("total") / F.max("total").over(W.partitionBy()))


def periods(od: DataFrame) -> DataFrame:
    p = od.select(F.year("date").alias("year"), F.quarter("date").alias("quarter")).distinct().orderBy("year", "quarter")
    return p.withColumn("label", F.concat(F.col("year").cast("string"), F.lit(" Q"), F.col("quarter").cast("string")))


def nested_json(df: DataFrame, keys: Sequence[str], value: str, doc: str = "doc") -> DataFrame:
    """One row per first key: a JSON document of maps down the other keys. Keys sort as text."""
    x = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value).alias("v"))
    for depth in range(len(keys) - 1, 0, -1):
        entry = F.struct(F.col(keys[depth]).alias("key"), F.col("v").alias("value"))
        x = x.groupBy(*keys[:depth]).agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).alias("v"))
    return x.select(keys[0], F.to_json("v").alias(doc))


def route_triples(routes: DataFrame, keys: Sequence[str], o: str, d: str, n: str, triples: str = "triples") -> DataFrame:
    """One row per keys with an array of [o, d, n], the largest n first, ties by o and d. A group is at most all pairs of zones."""
    t = F.struct((-F.col(n)).alias("v"), F.col(o).alias("o"), F.col(d).alias("d"))
    listed = F.transform(F.array_sort(F.collect_list(t)), lambda r: F.array(r["o"].cast("long"), r["d"].cast("long"), -r["v"].cast("long")))
    return routes.groupBy(*keys).agg(listed.alias(triples))
