"""Fields of packed hourly weather reports: comma-separated, with a value that means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(c: Column, i: int) -> Column:
    """The i-th field (from 1), NULL if there is none."""
    return F.try_element_at(F.split(c, ","), F.lit(i))


def _number(c: Column, i: int) -> Column:
    return field(c, i).try_cast("double")


def _unless(raw: Column, missing: float, scale: float = 1.0) -> Column:
    return F.when(raw != missing, raw / scale if scale != 1.0 else raw)


def _below(raw: Column, missing: float, scale: float = 1.0) -> Column:
    return F.when(raw < missing, raw / scale if scale != 1.0 else raw)


def isd_temp(c: Column) -> Column:
    """Degrees Celsius; air temperature and dew point are written alike."""
    return _unless(_number(c, 1), 9999, 10.0)


def isd_slp(c: Column) -> Column:
    return _unless(_number(c, 1), 99999, 10.0)


def isd_wind_dir(c: Column) -> Column:
    return _unless(_number(c, 1), 999)


def isd_wind_speed(c: Column) -> Column:
    return _unless(_number(c, 4), 9999, 10.0)


def isd_vis(c: Column) -> Column:
    return _below(_number(c, 1), 999999)


def isd_ceiling(c: Column) -> Column:
    return _below(_number(c, 1), 99999)


def isd_precip(c: Column) -> Column:
    return _below(_number(c, 2), 9999, 10.0)


def isd_snow(c: Column) -> Column:
    return _below(_number(c, 1), 9999)


#: Measure -> packed column and how it is read.
REPORT = {
    "temp_c": ("TMP", isd_temp),
    "dew_c": ("DEW", isd_temp),
    "slp_hpa": ("SLP", isd_slp),
    "wind_dir": ("WND", isd_wind_dir),
    "wind_speed": ("WND", isd_wind_speed),
    "visibility_m": ("VIS", isd_vis),
    "ceiling_raw": ("CIG", isd_ceiling),
    "precip_mm": ("AA1", isd_precip),
    "snow_cm": ("AJ1", isd_snow),
}
