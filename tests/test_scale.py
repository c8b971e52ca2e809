"""Operators whose work must be bounded: equal to brute force, and how much they compare or hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonehour.operators import ordered
from zonehour.operators import spatial as sp


def edges_of(spark, shapes):
    return sp.polygons_to_edges(spark.createDataFrame(list(shapes.items()), "id int, rings array<array<array<double>>>"), "id", "rings")


def star(rng, x, y, r, n):
    pts = [[x + r * (0.5 + rng.random() / 2) * math.cos(a), y + r * (0.5 + rng.random() / 2) * math.sin(a)] for a in (2 * math.pi * k / n for k in range(n))]
    return [pts + pts[:1]]


# --- overlay -------------------------------------------------------------------


def brute_overlay(a, b):
    """Signed sums over all pairs of edges, as rows (zone_id, x1, y1, x2, y2, s)."""
    out = {}
    for az, ax1, ay1, ax2, ay2, s in a:
        for bz, bx1, by1, bx2, by2, t in b:
            lo, hi = max(min(ax1, ax2), min(bx1, bx2)), min(max(ax1, ax2), max(bx1, bx2))
            if ax1 == ax2 or bx1 == bx2 or lo >= hi:
                continue
            f = lambda x: ay1 + (ay2 - ay1) * (x - ax1) / (ax2 - ax1)  # noqa: E731, B023
            g = lambda x: by1 + (by2 - by1) * (x - bx1) / (bx2 - bx1)  # noqa: E731, B023
            cuts = [lo, hi]
            d0, d1 = f(lo) - g(lo), f(hi) - g(hi)
            if d0 * d1 < 0:
                cuts.insert(1, lo + (hi - lo) * d0 / (d0 - d1))
            area = sum((q - p) * (min(f(p), g(p)) + min(f(q), g(q))) / 2 for p, q in zip(cuts, cuts[1:]))
            out[az, bz] = out.get((az, bz), 0) + s * t * area
    return {k: v for k, v in out.items() if v > 1e-9}


def rows_of(e):
    return [(r.zone_id, r.x1, r.y1, r.x2, r.y2, r.s) for r in e.collect()]


def test_overlay_against_brute_force(spark):
    rng = random.Random(1)
    a = {k: star(rng, rng.uniform(-8, 8), rng.uniform(-8, 8), rng.uniform(0.3, 4), rng.choice([3, 5, 17, 60])) for k in range(14)}
    b = {k: star(rng, rng.uniform(-8, 8), rng.uniform(-8, 8), rng.uniform(0.3, 6), rng.choice([4, 9, 31])) for k in range(12)}
    a[20] = [[[-2.0, -2.0], [-2.0, 2.0], [2.0, 2.0], [2.0, -2.0], [-2.0, -2.0]], [[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0], [-1.0, -1.0]]]
    a, b = edges_of(spark, a), edges_of(spark, b)
    want = brute_overlay(rows_of(a), rows_of(b))
    for cell in (0.7, 5.0, 100.0):
        got = {(r.a_id, r.b_id): r.area for r in sp.overlay_area(a, b, cell).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def wavy(rng, x, y, n):
    """A border that a vertical line crosses a few times, however many edges it is drawn with."""
    r = [5 * (0.8 + 0.2 * math.sin(18 * math.pi * k / n)) + rng.random() / n for k in range(n)]
    pts = [[x + r[k] * math.cos(2 * math.pi * k / n), y + r[k] * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [pts + pts[:1]]


def test_overlay_compares_few_edges(spark):
    """Twice the edges, some twice the comparisons, not four times; and an edge meets a handful."""
    n = {}
    for m in (200, 400, 800):
        rng = random.Random(m)
        a, b = edges_of(spark, {1: wavy(rng, 0, 0, m)}), edges_of(spark, {2: wavy(rng, 0.3, 0.2, m)})
        n[m] = sp.overlay_pieces(a, b, 4.0).count()
        assert n[m] < 60 * m < m * m
    assert n[800] < 2.6 * n[400] < 7 * n[200]


# --- nearest border --------------------------------------------------------------


def brute_nearest(points, edges):
    z, x1, y1, x2, y2, _ = (np.array(c) for c in zip(*edges, strict=True))
    out = {}
    for x, y in points:
        ex, ey = x2 - x1, y2 - y1
        t = np.clip(((x - x1) * ex + (y - y1) * ey) / np.maximum(ex * ex + ey * ey, 1e-300), 0, 1)
        d = np.sqrt((x - x1 - t * ex) ** 2 + (y - y1 - t * ey) ** 2)
        r = np.floor(d / sp.TIE + 0.5)
        out[x, y] = (int(z[r == r.min()].min()), d.min())
    return out


def shapes(rng, n):
    return {k: star(rng, rng.uniform(0, 50), rng.uniform(0, 20), rng.uniform(0.2, 2), rng.choice([3, 8, 25])) for k in range(1, n)}


def test_nearest_against_brute_force(spark):
    rng = random.Random(4)
    e = edges_of(spark, shapes(rng, 60))
    pts = [(rng.uniform(-10, 60), rng.uniform(-10, 30)) for _ in range(400)]
    pts += [(rng.choice([-1, 1]) * 10 ** rng.uniform(2, 9), rng.choice([-1, 1]) * 10 ** rng.uniform(0, 9)) for _ in range(200)]
    df = spark.createDataFrame([*pts, (float("nan"), 1.0), (None, 2.0), (float("inf"), 0.0)], "px double, py double")
    want = brute_nearest(pts, rows_of(e))
    got = {(r.px, r.py): (r.zone_id, r.distance) for r in sp.nearest_zone(df, e).collect()}
    assert set(got) == set(want)
    for k, (z, d) in want.items():
        assert got[k][1] == pytest.approx(d, rel=1e-12)
        # Very far away many borders are as near as rounding can tell.
        assert got[k][0] == z or d > 1e5
    near = {(r.px, r.py) for r in sp.nearest_zone(df, e, max_distance=3.0).collect()}
    assert near == {k for k, (_, d) in want.items() if d <= 3.0}


def test_nearest_ties_and_none(spark):
    e = edges_of(spark, {2: [[[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]], 1: [[[1.0, 0.0], [1.0, 1.0], [2.0, 1.0], [2.0, 0.0], [1.0, 0.0]]]})
    p = spark.createDataFrame([(1.0, 1.5), (-1.0, 0.5), (5.0, 0.5)], "px double, py double")
    assert {r.px: r.zone_id for r in sp.nearest_zone(p, e).collect()} == {1.0: 1, -1.0: 2, 5.0: 1}
    assert sp.nearest_zone(p, e.limit(0)).collect() == [] and sp.nearest_zone(p.limit(0), e).collect() == []
    one = spark.createDataFrame([(7, 1.0, 1.0, 1.0, 1.0)], "zone_id int, x1 double, y1 double, x2 double, y2 double")
    assert sp.nearest_zone(p, one).where("zone_id = 7").count() == 3


def test_nearest_measures_few_edges(spark):
    """Candidates of a point's cell stay a few, whatever the edges; those of all leaves grow with the edges."""
    total = {}
    for n in (60, 240):
        rng = random.Random(n)
        e = edges_of(spark, {k: star(rng, rng.uniform(0, 50), rng.uniform(0, 20), 1.0, 20) for k in range(n)})
        tree = sp.EdgeTree(e)
        pts = tree.keyed(spark.createDataFrame([(rng.uniform(-10, 60), rng.uniform(-10, 30)) for _ in range(300)], "px double, py double"), F.col("px"), F.col("py"))
        per = pts.join(sp.nearest_candidates(pts, tree), ["cx", "cy"]).groupBy("px", "py").agg(F.count("*").alias("n"), F.count_distinct("zone_id", "x1", "y1", "x2", "y2").alias("d"))
        r = per.agg(F.avg("n").alias("mean"), F.max("n").alias("most"), F.max(F.col("n") - F.col("d")).alias("twice"), F.count("*").alias("points")).first()
        assert r.points == 300 and r.mean <= sp.NEAREST_EDGES and r.most <= 6 * sp.NEAREST_EDGES and r.twice == 0
        total[n] = tree.leaves(tree.cells(pts.select("cx", "cy").distinct())).count()
    assert total[240] < 6 * total[60]


def test_nearest_along_a_line(spark):
    """Edges along a line need more levels than as many in a square: points far off still measure a few."""
    e = edges_of(spark, {k: [[[0.0, k + 0.0], [0.0, k + 1.0], [1.0, k + 1.0], [1.0, k + 0.0], [0.0, k + 0.0]]] for k in range(4000)})
    tree = sp.EdgeTree(e)
    pts = tree.keyed(spark.createDataFrame([(0.1 + 0.01 * k, -10.0 - 37.0 * k) for k in range(100)], "px double, py double"), F.col("px"), F.col("py"))
    per = pts.join(sp.nearest_candidates(pts, tree), ["cx", "cy"]).groupBy("px", "py").count().collect()
    assert len(per) == 100 and max(r["count"] for r in per) <= sp.NEAREST_EDGES


def test_nearest_sorts_no_pairs(spark):
    e = edges_of(spark, shapes(random.Random(5), 10))
    near = sp.nearest_zone(spark.createDataFrame([(0.5, -1.5), (99.0, 3.0)], "px double, py double"), e)
    assert near.count() == 2 and "SortAggregate" not in near._jdf.queryExecution().toString()


# --- running sums and quantiles ---------------------------------------------------


@pytest.fixture
def many_parts(spark):
    """As with more data: twelve parts, that aren't made one because they are small."""
    new = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_running_sums_of_a_large_group(spark, many_parts):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), k, float(rng.randrange(100)) if k % 17 else None) for k in range(6000)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(5)
    got = {r.k: r for r in ordered.running(df, ["g"], [F.col("k").desc()], {"rank": F.lit(1), "s": F.col("v")}).collect()}
    assert len(got) == 6000
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        s = 0
        for i, (_, k, v) in enumerate(mine):
            s += v or 0
            assert (got[k].rank, got[k].rank_total, got[k].s) == (i + 1, len(mine), s)
        assert got[mine[0][1]].s_total == s
    # The large group is many chunks: no window holds it.
    sizes = ordered.in_ranges(df, ["g"], ["k"]).where("g = 'a'").groupBy(ordered.PART).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 1500


def test_exact_quantiles(spark, many_parts):
    rng = random.Random(3)
    rows = [(g, v) for g, vs in {"ties": [float(rng.randrange(5)) for _ in range(3000)], "own": [rng.gauss(0, 50) for _ in range(4000)], "one": [7.5], "two": [1.0, 2.0], None: [float(k) for k in range(10)], "none": [None]}.items() for v in vs]
    qs = [0.0, 0.05, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.g: r.q for r in ordered.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", qs).collect()}
    assert set(got) == {"ties", "own", "one", "two", None}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([v for h, v in rows if h == g], qs).tolist(), abs=1e-9)
    assert ordered.exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", qs).collect() == []
