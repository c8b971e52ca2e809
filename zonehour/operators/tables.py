"""Renames, typing, filters and small reports on any table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """A named condition that rows must meet; NULL counts as not met."""

    name: str
    keep: Column

    @property
    def ok(self) -> Column:
        return F.coalesce(self.keep, F.lit(False))


def select_existing(df: DataFrame, wanted: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The wanted columns that df has, each under the first of its aliases that exists. Names are matched by case."""
    have, out = set(df.columns), []
    for w in wanted:
        found = next((a for a in (aliases or {}).get(w, (w,)) if a in have), None)
        if found:
            out.append(F.col(f"`{found}`").alias(w))
    return df.select(*out)


def apply_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Renames old -> new the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})


def conform(df: DataFrame, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Columns of the schema in its order and types; missing ones are NULL. lenient: what can't be cast becomes NULL."""
    have = set(df.columns)

    def one(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`")
        return (c.try_cast(f.dataType) if lenient else c.cast(f.dataType)).alias(f.name)

    return df.select(*map(one, schema.fields))


def columns_like(df: DataFrame, keywords: Iterable[str]) -> list[str]:
    """Columns whose name has a keyword, whatever the case."""
    return [c for c in df.columns if any(k.lower() in c.lower() for k in keywords)]


def quality_filter(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    return reduce(lambda d, r: d.where(r.keep), rules, df)


def drop_report(df: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """Rows in, met per rule, and kept by all rules, in one pass."""
    every = reduce(lambda a, b: a & b, (r.ok for r in rules), F.lit(True))
    return df.groupBy(*by).agg(F.count("*").alias("n_in"), *[F.count_if(r.ok).alias(f"ok_{r.name}") for r in rules], F.count_if(every).alias("n_kept")).withColumn("kept_pct", 100.0 * F.col("n_kept") / F.col("n_in"))


def preview(df: DataFrame, cols: Sequence[str] | None = None, ranges: Mapping[str, tuple] | None = None, isin: Mapping[str, Sequence] | None = None, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Some columns and rows of a table, as a user picks them."""
    for c, (lo, hi) in (ranges or {}).items():
        df = df.where(F.col(c).between(lo, hi))
    for c, values in (isin or {}).items():
        df = df.where(F.col(c).isin(*values))
    df = df.orderBy(*order) if order else df
    df = df.select(*cols) if cols else df
    return df if limit is None else df.limit(limit)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows by value, NULL too."""
    return df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))


def null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_null) in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column", "n_null")


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: non-null and non-zero shares, min, max, mean, in one pass."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    measures = {
        "non_null_pct": lambda c: 100.0 * F.count(c) / F.count("*"),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "mean": lambda c: F.avg(c),
        "non_zero_pct": lambda c: 100.0 * F.count_if(c != 0) / F.count("*"),
    }
    one = df.agg(*[F.struct(F.lit(c).alias("column"), *[f(F.col(c)).alias(m) for m, f in measures.items()]).alias(f"c{k}") for k, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[f"c{k}" for k in range(len(cols))])).alias("c")).select("c.*")


def describe(df: DataFrame) -> DataFrame:
    """(column, type, n_rows); a pass for the count, which columnar files have at hand."""
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in df.dtypes])
    return df.agg(F.count("*").alias("n_rows")).select(F.explode(rows).alias("c"), "n_rows").select("c.*", "n_rows")


def file_coverage(df: DataFrame, ts: str, by: Column) -> DataFrame:
    return df.groupBy(by.alias("file")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank. The limit is taken before the shuffle, too."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def with_share(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Adds a row's part of the whole column; the sum is a query of its own, so that no task sees all rows."""
    return df.withColumn(name, F.col(value) / df.agg(F.sum(value)).scalar())


def norm_to_max(c: Column, by: Sequence[str]) -> Column:
    return c / F.nullif(F.max(c).over(W.partitionBy(*by)), F.lit(0))


def with_intensity(df: DataFrame, value: str, by: Sequence[str] = (), log: bool = True, name: str = "intensity") -> DataFrame:
    """Adds where a value lies between the smallest and the largest, 0 to 1; 1 where all are equal.

    Limits of groups come from a window by group, those of the whole table from a query of its own.
    """
    v = F.log1p(F.col(value)) if log else F.col(value).cast("double")
    if by:
        lo, hi = F.min(v).over(W.partitionBy(*by)), F.max(v).over(W.partitionBy(*by))
    else:
        lo, hi = df.agg(F.min(v)).scalar(), df.agg(F.max(v)).scalar()
    return df.withColumn(name, F.when(hi == lo, 1.0).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0))))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def changed(c: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """Whether a value differs from the row before; the first row counts as changed."""
    return ~c.eqNullSafe(F.lag(c).over(W.partitionBy(*by).orderBy(*order)))


def attach_dim(df: DataFrame, dim: DataFrame, key: str, roles: Mapping[str, str], how: str = "left") -> DataFrame:
    """Joins a dimension once per role: {column of df: prefix of the dimension's columns there}."""
    for col, prefix in roles.items():
        d = dim.select(*[F.col(c).alias(f"{prefix}{c}") for c in dim.columns])
        df = df.join(d, F.col(col) == F.col(f"{prefix}{key}"), how).drop(f"{prefix}{key}")
    return df


def missing_of(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present, list(keys), "left_anti")


def coverage_calendar(expected: DataFrame, present: DataFrame, keys: Sequence[str], months: Sequence[int] = range(1, 13)) -> DataFrame:
    """expected(keys..., month) against present, a column per month: OK, missing, or NULL where nothing is expected."""
    p = present.select(*keys, "month").distinct().withColumn("there", F.lit(True))
    state = F.when(F.coalesce(F.col("there"), F.lit(False)), "OK").otherwise("missing")
    return expected.join(p, [*keys, "month"], "left").groupBy(*keys).pivot("month", list(months)).agg(F.first(state))
