"""Column functions that clean and classify values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_num(c: Column, kind: str = "double") -> Column:
    """The number, or NULL where it isn't one."""
    return c.try_cast(kind)


def null_outside(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.between(lo, hi), c)


def null_if_in(c: Column, sentinels: Iterable) -> Column:
    return F.when(~c.isin(*sentinels), c)


def map_values(c: Column, mapping: Mapping, default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items())), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def whitelist(c: Column, allowed: Iterable[str], other: str = "unknown") -> Column:
    """The trimmed, lower-cased value if it is allowed."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(*allowed), v).otherwise(other)


def hail_type(pay: Column, rate: Column) -> Column:
    """How a taxi trip was hailed: an app fare goes before any rate code; what matches nothing, NULL too, is other."""
    return F.when(pay == 0, "flex_fare").when(rate == 1, "standard_meter").when(rate.isin(2, 3), "airport").when(rate == 5, "negotiated").otherwise("other")


def row_total(cols: Iterable[Column]) -> Column:
    """Sum over a row, NULL as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))


def safe_share(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def any_nonzero(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(0)) != 0 for c in cols), F.lit(False))
