"""Column functions on dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_min(a: Column, b: Column) -> Column:
    """Minutes from a to b."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(60_000_000.0)


def dow0(d: Column) -> Column:
    """Day of the week, Sunday 0."""
    return F.dayofweek(d) - 1


def dow_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def block_number(hour: Column) -> Column:
    return F.when(hour.between(6, 8), 0).when(hour.between(9, 14), 1).when(hour.between(15, 17), 2).otherwise(3)


def time_block(hour: Column) -> Column:
    """Four uneven blocks of the day."""
    return F.array(*map(F.lit, ("Morning", "Midday", "Evening", "Night")))[block_number(hour)]


def year_quarter(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit(" Q"), F.quarter(d).cast("string"))


def year_month(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(F.month(d).cast("string"), 2, "0"))


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def parse_ts(c: Column, fmt: str | None = None) -> Column:
    """A timestamp, or NULL where the text is none."""
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def month_bounds(d: Column) -> tuple[Column, Column]:
    """First day of the month, and of the next."""
    a = F.trunc(d, "MM")
    return a.cast("date"), F.add_months(a, 1)


def local_to_utc_strict(ts: Column, tz: str) -> Column:
    """Local wall time as UTC; NULL where the clock skips it or shows it twice."""
    t = ts.cast("timestamp")
    u = F.to_utc_timestamp(t, tz)
    hour = F.expr("INTERVAL 1 HOUR")
    same = lambda x: F.from_utc_timestamp(x, tz) == t
    return F.when(same(u) & ~same(u + hour) & ~same(u - hour), u)
