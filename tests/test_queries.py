"""Every registered query of the engine against its oracle SQL, on the smallest tables."""

import os

import duckdb
import pytest

from zonehour.queries import ORACLE_SQL, QUERIES, R, _plain

DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(records, names, order):
    at = [names.index(c) for c in order]
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[k]) for k in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    assert got
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        assert rows(got, df.columns, order) == rows(cur.fetchall(), names, order)


def test_fractions_beyond_a_long(spark, tmp_path):
    """Places beyond the pole have no projection (NaN, not 0), and large values are not cut off."""
    users = [0, 1499, 7499, 7500, 7501, 8999]
    e = spark.createDataFrame([(k, u, "view", 10.0 * k) for k, u in enumerate(users)], "event_id long, user_id long, event_type string, value double")
    e.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["geo2_projection"](spark, str(tmp_path)).collect()
    want = con.execute(ORACLE_SQL["geo2_projection"]).fetchall()
    assert repr(sorted((r.event_id, r.x, r.y) for r in got)) == repr(sorted(want))
    assert sum(r.x != r.x for r in got) == 2

    values = [float("nan"), float("inf"), -float("inf"), 1e20, -1e20, 0.00005, -0.00005, -0.00006, 2.5, -2.5, None]
    plain = _plain(spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)).collect()
    sql = con.execute(f"SELECT {R('v')} FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    assert repr([r.v for r in plain]) == repr([v for (v,) in sql])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
