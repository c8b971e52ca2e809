"""Running sums, ranks and exact quantiles of groups of any size: no task holds a group.

Rows are dealt by ranges of their group and order into a table, so that a large group is
many chunks. What the chunks before one add up to is known from a table of a row
per chunk and group; within its chunk a row looks at its own rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonehour.shared import staged

PART = "__part"


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "ordered") -> DataFrame:
    """df as a table with the column __part: parts ascend with the group, then the order, each sorted."""
    keys = [*by, *order]
    return staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id()), name)


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """The columns of two aliases are equal, a null as a value of its own."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def chunks(ranged: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """(by, __part, name, name_before, name_total) of each sum: in a chunk, in those before it, and in the group.

    A row per part and group that has rows in it: parts, and one more for each group.
    """
    t = ranged.groupBy(*by, PART).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before, every = W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    more = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums] + [F.sum(n).over(every).alias(f"{n}_total") for n in sums]
    return t.select("*", *more)


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column]) -> DataFrame:
    """Adds per name the running sum up to and with the row, as `name`, and the group's sum, as `name_total`.

    `sums` are columns by name, F.lit(1) for a rank. The order should tell all
    rows of a group apart: rows alike in it go to one task, in any order. A null
    counts nothing; a null group is one of its own. A table is written at once.
    """
    ranged = in_ranges(df, by, order)
    offsets = chunks(ranged, by, sums)
    w = W.partitionBy(*by, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.select(*df.columns, PART, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__{n}") for n, c in sums.items()])
    x = local.alias("r").join(offsets.alias("o"), same("r", "o", [*by, PART]))
    added = [c for n in sums for c in ((F.col(f"r.__{n}") + F.col(f"o.{n}_before")).alias(n), F.col(f"o.{n}_total"))]
    return x.select(*[F.col(f"r.{c}") for c in df.columns], *added)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], name: str = "q") -> DataFrame:
    """(by, name): the quantiles of each group, linear between neighbours, as an array in the order of qs.

    Equal values are counted before they meet. Chunks' counts say in which of them a wanted
    rank lies; only those are looked into. Nulls don't count; a group without a value has
    no row. A table is written at once.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranged = in_ranges(v, by, ["__v"], "values")
    c = chunks(ranged, by, {"n": F.col("__n")})
    place = F.transform(F.array(*map(F.lit, map(float, qs))), lambda q: q * (F.col("n_total") - 1))
    wanted = F.array_distinct(F.concat(F.transform(place, lambda p: F.floor(p)), F.transform(place, lambda p: F.ceil(p))))
    wanted = F.filter(wanted, lambda r: (r >= F.col("n_before")) & (r < F.col("n_before") + F.col("n")))
    c = c.withColumn("wanted", wanted).where(F.size("wanted") > 0)
    x = ranged.alias("r").join(c.alias("c"), same("r", "c", [*by, PART]))
    x = x.select(*[F.col(f"r.{b}").alias(b) for b in by], F.col(f"r.{PART}").alias(PART), "__v", "__n", "n_before", "n_total", "wanted")
    last = F.col("n_before") + F.sum("__n").over(W.partitionBy(*by, PART).orderBy("__v"))
    x = x.withColumn("last", last).select(*by, "n_total", "__v", F.explode(F.filter("wanted", lambda r: (r < F.col("last")) & (r >= F.col("last") - F.col("__n")))).alias("rank"))
    # Two ranks a quantile at most meet here.
    g = x.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("__v").cast("double")))).alias("at"), F.first("n_total").alias("n"))
    p = F.transform(F.array(*map(F.lit, map(float, qs))), lambda q: q * (F.col("n") - 1))
    value_at = lambda rank: F.element_at("at", rank)
    return g.select(*by, F.transform(p, lambda x: value_at(F.floor(x)) + (value_at(F.ceil(x)) - value_at(F.floor(x))) * (x - F.floor(x))).alias(name))
