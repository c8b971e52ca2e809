"""Column functions on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from zonehour.functions import clean as fc
from zonehour.functions import geo, time as ft, weather as fw
from zonehour.schemas import PROVIDERS


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_hail_type(spark):
    rows = [(0, 1), (1, 1), (1, 2), (1, 3), (1, 5), (1, 99), (None, None), (1, 4), (0, None)]
    assert values(spark, rows, "p int, r int", fc.hail_type(F.col("p"), F.col("r"))) == ["flex_fare", "standard_meter", "airport", "airport", "negotiated", "other", "other", "other", "flex_fare"]


def test_row_total_and_shares(spark):
    assert values(spark, [(1.0, None), (None, None)], "a double, b double", fc.row_total([F.col("a"), F.col("b")])) == [1.0, 0.0]
    assert values(spark, [(1.0, 2.0), (1.0, 0.0), (None, 2.0)], "a double, b double", fc.safe_share(F.col("a"), F.col("b"))) == [0.5, None, None]


def test_cleaning(spark):
    assert values(spark, [0, 1, 9, 10, None], "x int", fc.null_outside(F.col("x"), 1, 9)) == [None, 1, 9, None, None]
    assert values(spark, ["7", "x", None], "x string", fc.try_num(F.col("x"))) == [7.0, None, None]
    assert values(spark, [" Electric_Bike", "x", None], "x string", fc.whitelist(F.col("x"), ["electric_bike"])) == ["electric_bike", "unknown", "unknown"]
    assert values(spark, ["HV0003", "HV0009", None], "x string", fc.map_values(F.col("x"), PROVIDERS, "hvfhv_other")) == ["uber", "hvfhv_other", "hvfhv_other"]
    assert values(spark, [(0, None), (None, 2), (None, None)], "a int, b int", fc.any_nonzero([F.col("a"), F.col("b")])) == [False, True, False]


def test_packed_weather(spark):
    cases = [
        (fw.isd_temp, ["+0067,5", "+9999,9", "-0015,5", None], [6.7, None, -1.5, None]),
        (fw.isd_slp, ["10028,5", "99999,9"], [1002.8, None]),
        (fw.isd_wind_dir, ["200,5,N,0036,5", "999,9,N,9999,9"], [200.0, None]),
        (fw.isd_wind_speed, ["200,5,N,0036,5", "999,9,N,9999,9", "a,b"], [3.6, None, None]),
        (fw.isd_vis, ["016093,5,N,5", "999999,9,N,9"], [16093.0, None]),
        (fw.isd_ceiling, ["01494,5,M,N", "99999,9,M,N"], [1494.0, None]),
        (fw.isd_precip, ["01,0005,9,5", "01,9999,9,9", "a,b"], [0.5, None, None]),
        (fw.isd_snow, ["0012,1,9,999999,9,9", "9999,9,9,999999,9,9"], [12.0, None]),
    ]
    for read, given, wanted in cases:
        assert values(spark, given, "x string", read(F.col("x"))) == wanted


def test_days_and_blocks(spark):
    days = [dt.date(2024, 1, 7), dt.date(2024, 1, 8)]
    assert values(spark, days, "d date", ft.dow0(F.col("d"))) == [0, 1]
    hours = [5, 6, 8, 9, 14, 15, 17, 18]
    assert values(spark, hours, "h int", ft.time_block(F.col("h"))) == ["Night", "Morning", "Morning", "Midday", "Midday", "Evening", "Evening", "Night"]


def test_clock_changes(spark):
    local = [dt.datetime(2021, 3, 14, 2, 30), dt.datetime(2021, 11, 7, 1, 30), dt.datetime(2021, 6, 1, 12), dt.datetime(2021, 11, 7, 0, 30), dt.datetime(2021, 11, 7, 2, 30)]
    got = values(spark, local, "t timestamp_ntz", F.date_format(ft.local_to_utc_strict(F.col("t"), "America/New_York"), "MM-dd HH:mm"))
    assert got == [None, None, "06-01 16:00", "11-07 04:30", "11-07 07:30"]


def test_projection(spark):
    x, y = geo.to_epsg2263(F.col("a"), F.col("b"))
    got = values(spark, [(40 + 10 / 60, -74.0), (40.748433, -73.985656)], "a double, b double", F.struct(x.alias("x"), y.alias("y")))
    assert got[0].x == pytest.approx(984250, abs=0.01) and got[0].y == pytest.approx(0, abs=1e-6)
    assert got[1].x == pytest.approx(988224.4, abs=0.1) and got[1].y == pytest.approx(211951.3, abs=0.1)
