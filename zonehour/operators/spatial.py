"""Points and polygons by joins and arithmetic: no geometry library, no Python in the tasks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonehour.functions.geo import haversine_km, micro
from zonehour.shared import staged


def polygons_to_edges(df: DataFrame, id_col: str, coords_col: str) -> DataFrame:
    """Rings array<array<array<double>>> -> (zone_id, ring, x1, y1, x2, y2, s).

    The first ring is the shell, others are holes. s is the edge's sign for
    overlays: +1 if the edge goes left to right on a clockwise shell or a
    counter-clockwise hole, as it comes out for either orientation of the input.
    """
    r = df.select(F.col(id_col).alias("zone_id"), F.posexplode(coords_col).alias("ring", "pts"))
    e = r.select("zone_id", "ring", F.explode(F.transform(F.sequence(F.lit(1), F.size("pts") - 1), lambda i: F.struct(F.element_at("pts", i).alias("a"), F.element_at("pts", i + 1).alias("b")))).alias("e"))
    e = e.select("zone_id", "ring", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))
    area = F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") + F.col("y1")) / 2).over(W.partitionBy("zone_id", "ring"))
    turn = F.signum(area) * F.when(F.col("ring") == 0, 1).otherwise(-1)
    return e.withColumn("s", (F.signum(F.col("x2") - F.col("x1")) * turn).cast("int"))


def boxes(edges: DataFrame, *more: Column) -> DataFrame:
    return edges.groupBy("zone_id").agg(*more, F.min(F.least("x1", "x2")).alias("xmin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("y1", "y2")).alias("ymax"))


def _cells(lo: str, hi: str, cell: float) -> Column:
    return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))


def edge_rows(edges: DataFrame, cell: float) -> DataFrame:
    """Every edge in each grid row (of height `cell`) that it spans."""
    return edges.withColumn("gy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))


def _finite(c: Column) -> Column:
    return c.isNotNull() & (F.abs(c) < float("inf"))


def distinct_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct points that are a place: no coordinate is NULL, NaN or infinite."""
    return points.select(*keys).where(_finite(F.col(keys[0])) & _finite(F.col(keys[1]))).distinct()


def points_within(points: DataFrame, edges: DataFrame, cell: float = 1.0, keys: Sequence[str] = ("px", "py")) -> DataFrame:
    """(keys, zone_id): the polygon that a point is in; the smallest id if several are, no row if none is.

    Points and boxes meet in grid cells, by an equi-join, and then only the edges
    of the point's grid row; a point is inside if a ray from it crosses an odd
    number of them. Holes need no care. Points are made distinct first, since
    many trips share one. A coordinate that is NULL, NaN or infinite is nowhere.
    """
    p = distinct_points(points, keys).withColumns({"gx": F.floor(F.col(keys[0]) / cell), "gy": F.floor(F.col(keys[1]) / cell)})
    b = boxes(edges).withColumn("gx", F.explode(_cells("xmin", "xmax", cell))).withColumn("gy", F.explode(_cells("ymin", "ymax", cell)))
    x, y = F.col(keys[0]), F.col(keys[1])
    near = p.join(b, ["gx", "gy"]).where(x.between(F.col("xmin"), F.col("xmax")) & y.between(F.col("ymin"), F.col("ymax"))).select(*keys, "zone_id", "gy")
    hit = (F.col("y1") > y) != (F.col("y2") > y)
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    odd = near.join(edge_rows(edges, cell), ["zone_id", "gy"]).groupBy(*keys, "zone_id").agg((F.count_if(hit & (x < at)) % 2).alias("odd")).where("odd = 1")
    return odd.groupBy(*keys).agg(F.min("zone_id").alias("zone_id"))


#: Edges that a cell of the search for the nearest border keeps as candidates before it is split.
NEAREST_EDGES = 16
#: The root of the search is a square of so many diagonals of the edges' box; points beyond are met by direction, of SECTORS.
NEAREST_REACH, SECTORS = 4.0, 16
#: Levels of the search that are taken at a time.
STEP = 3
#: Borders that much apart are as far as one another.
TIE = 1e-9


def edge_distance(x: Column, y: Column) -> Column:
    """Distance of a place from the edge (x1, y1, x2, y2) of the same row."""
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - F.col("x1")) * ex + (y - F.col("y1")) * ey) / F.nullif(ex * ex + ey * ey, F.lit(0.0)), F.lit(0.0))))
    dx, dy = x - F.col("x1") - t * ex, y - F.col("y1") - t * ey
    return F.sqrt(dx * dx + dy * dy)


class EdgeTree:
    """A quadtree over edges: each leaf has the edges that may be the nearest of some point in it.

    An edge is d from a cell's middle and so within d - h and d + h of each of the cell's
    points, h being half the cell's diagonal: only edges of d <= least d + 2h may be
    the nearest of any point. A cell of more than NEAREST_EDGES such edges hands them to its
    parts three levels down, which ask the same for themselves; so a part asks
    of its parent's candidates alone. Only cells that hold points are followed. Points beyond the root lie within a sixteenth of the
    directions from its middle and are nearest to what lies foremost there.
    """

    def __init__(self, edges: DataFrame):
        low, high = lambda a, b: F.min(F.least(a, b)), lambda a, b: F.max(F.greatest(a, b))
        r = edges.agg(low("x1", "x2"), high("x1", "x2"), low("y1", "y2"), high("y1", "y2"), F.count("*"), F.avg(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()
        self.n_edges = r[4]
        if not r[4]:
            return
        self.edges = edges.select("zone_id", "x1", "y1", "x2", "y2")
        self.x, self.y = (r[0] + r[1]) / 2, (r[2] + r[3]) / 2
        self.diagonal = max(math.hypot(r[1] - r[0], r[3] - r[2]), 1e-9)
        self.side = NEAREST_REACH * self.diagonal
        self.x0, self.y0 = self.x - self.side / 2, self.y - self.side / 2
        # Levels for the root's reach, for edges spread evenly in the box, and for where they are dense; along a line they are as
        # dense in a longer box, so that cells of the finest level are half a mean edge at most, to the same depth.
        even, line = 4 + math.log(max(r[4] / NEAREST_EDGES, 1), 4), 1 + math.log2(self.side / max(r[5], 1e-9 * self.diagonal))
        self.levels = STEP * math.ceil(min(22, max(even, line)) / STEP)

    def _size(self, level: int | Column) -> Column:
        return self.side / F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)

    def _judged(self, pairs: DataFrame) -> DataFrame:
        """The pairs of a cell and an edge that may be the nearest there, and how many the cell has."""
        size = self._size(F.col("level"))
        d = edge_distance(self.x0 + (F.col("gx") + 0.5) * size, self.y0 + (F.col("gy") + 0.5) * size)
        w = W.partitionBy("level", "gx", "gy")
        x = pairs.withColumn("d", d).withColumn("u", F.min("d").over(w)).where(F.col("d") <= F.col("u") + math.sqrt(2) * (1 + 1e-9) * size + 2 * TIE)
        return x.withColumn("n", F.count("*").over(w)).drop("d", "u")

    def cells(self, own: DataFrame) -> DataFrame:
        """(cx, cy, level, gx, gy): the cells of each level that cells own (cx, cy) of the finest lie in."""
        x = own.where("cx >= 0").select("cx", "cy", F.explode(F.sequence(F.lit(STEP), F.lit(self.levels), F.lit(STEP))).alias("level"))
        at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), self.levels - F.col("level")))
        return x.withColumns({"gx": at("cx"), "gy": at("cy")})

    def leaves(self, cells: DataFrame) -> DataFrame:
        """(level, gx, gy, edge) of the candidates of the leaves among cells."""
        edge, cell = ["zone_id", "x1", "y1", "x2", "y2"], ["level", "gx", "gy"]
        known = cells.select(*cell).distinct()
        side = F.sequence(F.lit(0).cast("long"), F.lit(2**STEP - 1).cast("long"))
        x = self.edges.withColumn("level", F.lit(STEP)).withColumn("gx", F.explode(side)).withColumn("gy", F.explode(side))
        # What may follow a cell: itself, where its edges are few, or the parts of it that are known.
        up = lambda c: F.floor(F.col(c) / 2**STEP).alias(c)
        here = F.struct(*cell).alias("next")
        follows = known.select(*cell, here, F.lit(False).alias("part")).unionByName(known.where(F.col("level") > STEP).select((F.col("level") - STEP).alias("level"), up("gx"), up("gy"), here, F.lit(True).alias("part")))
        # As a table its size is known: small, it is broadcast by Spark, else the pairs of a cell meet it where they are.
        follows = staged(follows, "nearest-parts")
        x = self._judged(x.join(follows.where("not part").select(*cell), cell, "left_semi"))
        for level in range(2 * STEP, self.levels + 1, STEP):
            split = (F.col("n") > NEAREST_EDGES) & (F.col("level") == level - STEP)
            x = self._judged(x.join(follows, cell).where(F.col("part") == split).select(*edge, "next.*"))
        return x.select(*cell, *edge)

    def keyed(self, points: DataFrame, x: Column, y: Column) -> DataFrame:
        """Adds (cx, cy): a point's cell of the finest level, or (-1, sector) beyond the root."""
        fine = self._size(self.levels)
        cx, cy = F.floor((x - self.x0) / fine), F.floor((y - self.y0) / fine)
        inside = cx.between(0, 2**self.levels - 1) & cy.between(0, 2**self.levels - 1)
        sector = F.floor(F.atan2(y - self.y, x - self.x) * (SECTORS / (2 * math.pi))).cast("long") % SECTORS
        return points.withColumn("cx", F.when(inside, cx).otherwise(F.lit(-1).cast("long"))).withColumn("cy", F.when(inside, cy).otherwise(F.pmod(sector, F.lit(SECTORS))))

    def foremost(self, sectors: DataFrame) -> DataFrame:
        """(cx, cy, edge) of the edges that lie far enough ahead, for sectors (cx, cy).

        Seen from the root's middle, a point p at least R away in a direction within a of the sector's has an edge with the
        place e foremost there at |p| - e at least, and at most that plus what e turns by a, and (D/2)^2 / 2 (R - D/2), D being the diagonal.
        """
        half, far = self.diagonal / 2, self.side / 2
        slack = 2 * half * math.pi / SECTORS + half * half / (2 * (far - half)) + 2 * TIE
        a = (F.col("cy") + 0.5) * (2 * math.pi / SECTORS)
        ahead = F.greatest(*[(F.col(f"x{k}") - self.x) * F.cos(a) + (F.col(f"y{k}") - self.y) * F.sin(a) for k in (1, 2)])
        every = self.edges.withColumn("cy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SECTORS - 1).cast("long"))))
        x = every.join(F.broadcast(sectors), "cy").withColumn("ahead", ahead)  # SECTORS rows at most
        return x.withColumn("most", F.max("ahead").over(W.partitionBy("cy"))).where(F.col("ahead") >= F.col("most") - slack).drop("ahead", "most")


def nearest_candidates(points: DataFrame, tree: EdgeTree) -> DataFrame:
    """(cx, cy, edge): distinct candidates of each cell or sector that has a point of `keyed`."""
    own = points.select("cx", "cy").distinct()
    cells = staged(tree.cells(own), "nearest-cells")
    inner = cells.join(tree.leaves(cells), ["level", "gx", "gy"]).drop("level", "gx", "gy")
    return inner.unionByName(tree.foremost(own.where("cx < 0")).select(inner.columns))


def nearest_zone(points: DataFrame, edges: DataFrame, keys: Sequence[str] = ("px", "py"), max_distance: float | None = None) -> DataFrame:
    """(keys, zone_id, distance): the polygon whose border is nearest, no farther than max_distance; the smallest id on a tie.

    Borders less than 1e-9 apart are a tie, so that one that two polygons share is
    as far from both. No point meets every edge, only the candidates of its leaf of an
    EdgeTree, which are found once for all points there. These are measured twice, for the least distance and for the ids at
    it: both are numbers, which aggregates hash, where a minimum of structs would sort all pairs of points and candidates.
    A coordinate that is NULL, NaN or infinite has no nearest polygon.
    """
    # Few bytes of points are much work, which adaptive execution would give to one task.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = distinct_points(points, keys).repartition(n, *keys)
    tree = EdgeTree(edges)
    if not tree.n_edges:
        return p.select(*keys, F.lit(None).cast(edges.schema["zone_id"].dataType).alias("zone_id"), F.lit(None).cast("double").alias("distance")).limit(0)
    p = staged(tree.keyed(p, F.col(keys[0]), F.col(keys[1])), "nearest-points")
    candidates = staged(nearest_candidates(p, tree), "nearest-candidates")

    def measured(points: DataFrame) -> DataFrame:
        x = points.join(candidates, ["cx", "cy"]).withColumn("d", edge_distance(F.col(keys[0]), F.col(keys[1])))
        return x if max_distance is None else x.where(F.col("d") <= max_distance)

    step = lambda c: F.floor(F.col(c) / TIE + 0.5)
    least = measured(p).groupBy("cx", "cy", *keys).agg(F.min("d").alias("distance"))
    best = measured(least).where(step("d") == step("distance")).groupBy("cx", "cy", *keys, "distance").agg(F.min("zone_id").alias("zone_id"))
    return best.select(*keys, "zone_id", "distance")


def zone_of_points(points: DataFrame, edges: DataFrame, cell: float = 1.0, keys: Sequence[str] = ("px", "py"), nearest: bool = True, max_distance: float | None = None) -> DataFrame:
    """(keys, zone_id, how): inside a polygon, or nearest to one; no row for a coordinate that is NULL, NaN or infinite."""
    inside = points_within(points, edges, cell, keys).withColumn("how", F.lit("within"))
    if not nearest:
        return inside
    inside = staged(inside, "points-within")
    rest = distinct_points(points, keys).join(inside, list(keys), "left_anti")
    return inside.unionByName(nearest_zone(rest, edges, keys, max_distance).drop("distance").withColumn("how", F.lit("nearest")))


def assign_zones(df: DataFrame, ends: Mapping[str, tuple[str, str]], edges: DataFrame, cell: float = 1.0, nearest: bool = True, max_distance: float | None = None) -> DataFrame:
    """Adds a zone column per end {zone column: (x, y)}: distinct points are looked up once and joined back by rounded place.

    With nearest, the look-up is done at once, into a table.
    """
    distinct = None
    for x, y in ends.values():
        p = df.select(F.col(x).alias("px"), F.col(y).alias("py"))
        distinct = p if distinct is None else distinct.union(p)
    distinct = distinct.where(_finite(F.col("px")) & _finite(F.col("py"))).groupBy(micro(F.col("px")).alias("kx"), micro(F.col("py")).alias("ky")).agg(F.min("px").alias("px"), F.min("py").alias("py"))
    # The look-up reads the places again and again.
    distinct = staged(distinct, "places") if nearest else distinct
    found = distinct.join(zone_of_points(distinct, edges, cell, nearest=nearest, max_distance=max_distance), ["px", "py"]).select("kx", "ky", "zone_id")
    found = staged(found, "zones-of-points") if nearest else found
    for name, (x, y) in ends.items():
        look = found.select(F.col("kx").alias("__kx"), F.col("ky").alias("__ky"), F.col("zone_id").alias(name))
        df = df.join(look, (micro(F.col(x)) == F.col("__kx")) & (micro(F.col(y)) == F.col("__ky")), "left").drop("__kx", "__ky")
    return df


#: Edges of a pair of polygons to a slab of their common range, as a mean.
SLAB_EDGES = 4


def overlay_pieces(a: DataFrame, b: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs of edges of polygons a and b that share a slab: (a_*, b_*, base, lo, hi), where lo to hi is what they share of it.

    Polygons meet by their boxes in grid cells. The common x-range of a pair is cut
    into slabs, as many as it has edges for, and edges meet slab by slab: where polygons are
    drawn finer, slabs are narrower, and edges meet a few others each, however many there
    are. Slabs begin at multiples of a power of two, so that they are told apart without rounding.
    """
    def box(e: DataFrame, p: str) -> DataFrame:
        x = boxes(e, F.count_if(F.col("x1") != F.col("x2")).alias("n")).withColumn("gx", F.explode(_cells("xmin", "xmax", cell))).withColumn("gy", F.explode(_cells("ymin", "ymax", cell)))
        return x.select(*[F.col(c).alias(c if c in ("gx", "gy") else f"{p}_{c}") for c in x.columns])

    pairs = box(a, "a").join(box(b, "b"), ["gx", "gy"]).where("a_xmin < b_xmax and b_xmin < a_xmax and a_ymin < b_ymax and b_ymin < a_ymax")
    # Boxes meet in many cells; the first that they share speaks for the pair.
    pairs = pairs.where((F.col("gx") == F.floor(F.greatest("a_xmin", "b_xmin") / cell)) & (F.col("gy") == F.floor(F.greatest("a_ymin", "b_ymin") / cell)))
    common = F.least("a_xmax", "b_xmax") - F.greatest("a_xmin", "b_xmin")
    share = F.col("a_n") * common / (F.col("a_xmax") - F.col("a_xmin")) + F.col("b_n") * common / (F.col("b_xmax") - F.col("b_xmin"))
    width = F.pow(F.lit(2.0), F.floor(F.log2(common / F.greatest(F.ceil(share / SLAB_EDGES), F.lit(1)))))
    pairs = pairs.select("a_zone_id", "b_zone_id", F.least("a_ymin", "b_ymin").alias("base"), width.alias("width"), F.greatest("a_xmin", "b_xmin").alias("from"), F.least("a_xmax", "b_xmax").alias("to"))

    def cut(e: DataFrame, p: str) -> DataFrame:
        """The edges of one side in each slab of each pair that they reach."""
        e = e.where("x1 <> x2").select(F.col("zone_id").alias(f"{p}_zone_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2", "s")])
        left, right = F.least(f"{p}_x1", f"{p}_x2"), F.greatest(f"{p}_x1", f"{p}_x2")
        x = e.join(pairs, f"{p}_zone_id").where((left < F.col("to")) & (right > F.col("from")))
        x = x.withColumn("slab", F.explode(F.sequence(F.floor(F.greatest(left, F.col("from")) / F.col("width")), F.floor(F.least(right, F.col("to")) / F.col("width")))))
        return x if p == "a" else x.drop("base", "width", "from", "to")

    x = cut(a, "a").join(cut(b, "b"), ["a_zone_id", "b_zone_id", "slab"])
    lo = F.greatest(F.least("a_x1", "a_x2"), F.least("b_x1", "b_x2"), F.col("slab") * F.col("width"))
    hi = F.least(F.greatest("a_x1", "a_x2"), F.greatest("b_x1", "b_x2"), (F.col("slab") + 1) * F.col("width"))
    return x.withColumns({"lo": lo, "hi": hi}).drop("slab", "width", "from", "to")


def overlay_area(a: DataFrame, b: DataFrame, cell: float = 1.0) -> DataFrame:
    """(a_id, b_id, area) of polygons that overlap, holes and concave shapes included.

    The area is a signed sum, over pairs of edges that share a slab, of the integral of the lower
    edge over what they share, measured from the pair's lowest point.
    """
    x = overlay_pieces(a, b, cell).where("lo < hi")

    def height(p: str, at: str) -> Column:
        return F.col(f"{p}_y1") - F.col("base") + (F.col(f"{p}_y2") - F.col(f"{p}_y1")) * (F.col(at) - F.col(f"{p}_x1")) / (F.col(f"{p}_x2") - F.col(f"{p}_x1"))

    x = x.withColumns({"a0": height("a", "lo"), "a1": height("a", "hi"), "b0": height("b", "lo"), "b1": height("b", "hi")})
    x = x.withColumns({"d0": F.col("a0") - F.col("b0"), "d1": F.col("a1") - F.col("b1"), "w": F.col("hi") - F.col("lo")})
    t = F.col("d0") / F.nullif(F.col("d0") - F.col("d1"), F.lit(0.0))
    cross = F.col("a0") + t * (F.col("a1") - F.col("a0"))
    low0, low1 = F.least("a0", "b0"), F.least("a1", "b1")
    part = F.when(F.col("d0") * F.col("d1") < 0, F.col("w") * (t * (low0 + cross) / 2 + (1 - t) * (cross + low1) / 2)).otherwise(F.col("w") * (low0 + low1) / 2)
    return x.groupBy(F.col("a_zone_id").alias("a_id"), F.col("b_zone_id").alias("b_id")).agg(F.sum(F.col("a_s") * F.col("b_s") * part).alias("area")).where("area > 1e-9")


def area_weights(overlay: DataFrame) -> DataFrame:
    """area_weight: the share of a's overlapped area that lies in b."""
    return overlay.withColumn("area_weight", F.col("area") / F.sum("area").over(W.partitionBy("a_id")))


def polygon_area(edges: DataFrame) -> DataFrame:
    return edges.groupBy("zone_id").agg(F.abs(F.sum(F.col("s") * F.abs(F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / 2)).alias("area"))


def trip_km(df: DataFrame, name: str = "distance_km") -> DataFrame:
    return df.withColumn(name, haversine_km(*(F.col(c) for c in ("start_lat", "start_lng", "end_lat", "end_lng"))))


def zone_demographics(crosswalk: DataFrame, attrs: DataFrame, sums: Sequence[str], means: Sequence[str], population: str = "population", null_safe: bool = False) -> DataFrame:
    """crosswalk(a_id, b_id, area_weight) x attrs(a_id, ...) -> per b_id weighted sums (rounded half to even) and population-weighted means.

    null_safe: a NULL value counts neither above nor below the line; else only its weight counts.
    """
    x = crosswalk.join(attrs, "a_id")
    w = F.col("area_weight")
    aggs = [F.bround(F.sum(F.col(c) * w), 0).cast("long").alias(c) for c in sums]
    for c in means:
        pw = F.col(population) * w
        below = F.sum(F.when(F.col(c).isNotNull(), pw)) if null_safe else F.sum(pw)
        aggs.append((F.sum(F.col(c) * pw) / F.nullif(below, F.lit(0.0))).alias(c))
    return x.groupBy("b_id").agg(*aggs)
