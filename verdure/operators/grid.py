"""Grid arithmetic, tiles, and joins of boxes, polygons and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.config import METRES_PER_DEGREE


def cell_area_ha(lat: Column, res: float) -> Column:
    return F.pow(F.lit(res * METRES_PER_DEGREE), 2) * F.cos(F.radians(lat)) / 10_000


def snapped(bbox: tuple[float, float, float, float], res: float) -> tuple[float, float, int, int]:
    """West, north, columns and rows of the grid with edges at multiples of res that holds the box."""
    eps = res * 1e-6
    w, s, e, n = bbox
    c0, c1 = math.floor((w + eps) / res), math.ceil((e - eps) / res)
    r0, r1 = math.floor((s + eps) / res), math.ceil((n - eps) / res)
    return c0 * res, r1 * res, c1 - c0, r1 - r0


def cell(x: Column, y: Column, res: float) -> tuple[Column, Column]:
    """Column and row numbers of the global grid; rows count downwards from the equator."""
    return F.floor(x / res).cast("int"), F.floor(-y / res).cast("int")


def snap(w: Column, s: Column, e: Column, n: Column, res: float) -> Column:
    """``snapped`` for columns: west, north, columns and rows as a struct."""
    eps = res * 1e-6
    c0, c1 = F.floor((w + eps) / res), F.ceil((e - eps) / res)
    r0, r1 = F.floor((s + eps) / res), F.ceil((n - eps) / res)
    return F.struct((c0 * res).alias("west"), (r1 * res).alias("north"), (c1 - c0).alias("cols"), (r1 - r0).alias("rows"))


def tile_of(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """West and south edge of the one half-open tile that holds a point, by arithmetic instead of a range join."""
    return (F.floor(x / size) * size).cast("double"), (F.floor(y / size) * size).cast("double")


def extent(cells: DataFrame) -> DataFrame:
    """One row: the first and last row and column of the cells, to prune a read with."""
    return cells.agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def tiles(bbox: tuple[float, float, float, float], size: float) -> list[tuple[float, float, float, float]]:
    """Tile boxes by column, the last ones clipped to the box."""
    w, s, e, n = bbox
    out, x = [], w
    while x < e - 1e-9:
        y = s
        while y < n - 1e-9:
            out.append((x, y, min(x + size, e), min(y + size, n)))
            y += size
        x += size
    return out


def boxes_overlap(a: str, b: str) -> Column:
    """Boxes (w, s, e, n columns with these prefixes) share area; touching edges do not count."""
    c = lambda n: F.col(n)
    return (c(f"{a}w") < c(f"{b}e")) & (c(f"{a}e") > c(f"{b}w")) & (c(f"{a}s") < c(f"{b}n")) & (c(f"{a}n") > c(f"{b}s"))


def join_boxes(left: DataFrame, right: DataFrame, size: float, kind: str = "inner") -> DataFrame:
    """Overlap join of boxes (l_w.. and r_w..) by the cells of a coarse grid that they cover.

    An equi-join on the cell takes the place of a nested loop; a pair counts
    in the cell that holds the lower left corner of its overlap only.
    """
    cover = lambda p: (
        F.explode(F.sequence(F.floor(F.col(f"{p}w") / size), F.floor(F.col(f"{p}e") / size))).alias("__x"),
        F.sequence(F.floor(F.col(f"{p}s") / size), F.floor(F.col(f"{p}n") / size)).alias("__ys"),
    )
    split = lambda df, p: df.select("*", *cover(p)).select("*", F.explode("__ys").alias("__y")).drop("__ys")
    both = split(left, "l_").join(split(right, "r_"), ["__x", "__y"]).where(boxes_overlap("l_", "r_"))
    home = (F.col("__x") == F.floor(F.greatest("l_w", "r_w") / size)) & (F.col("__y") == F.floor(F.greatest("l_s", "r_s") / size))
    both = both.where(home).drop("__x", "__y")
    return both.select(*left.columns).distinct() if kind == "semi" else both


def edges(ring: list[tuple[float, float]]) -> Column:
    """A ring's edges as one constant array, so expressions stay small whatever its length."""
    pairs = zip(ring, ring[1:] + ring[:1], strict=True)
    return F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*p, *q), strict=True))) for p, q in pairs))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges to the right."""
    hits = F.filter(edges(ring), lambda d: ((d.y1 > y) != (d.y2 > y)) & (x < (d.x2 - d.x1) * F.try_divide(y - d.y1, d.y2 - d.y1) + d.x1))
    return F.size(hits) % 2 == 1


def cell_touches(w: Column, s: Column, e: Column, n: Column, ring: list[tuple[float, float]]) -> Column:
    """Any part of a cell lies in the polygon: its centre does, or an edge enters the cell.  A mere touch does not count."""
    dx, dy = (e - w) * 1e-6, (n - s) * 1e-6
    w, s, e, n = w + dx, s + dy, e - dx, n - dy
    return in_polygon((w + e) / 2, (s + n) / 2, ring) | F.exists(edges(ring), lambda d: _enters(d, w, s, e, n))


def _enters(d: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """An edge passes through the inside of a box."""
    side = lambda x, y: (d.x2 - d.x1) * (y - d.y1) - (d.y2 - d.y1) * (x - d.x1)
    corners = (side(w, s), side(e, s), side(e, n), side(w, n))
    boxes = (w < F.greatest(d.x1, d.x2)) & (e > F.least(d.x1, d.x2)) & (s < F.greatest(d.y1, d.y2)) & (n > F.least(d.y1, d.y2))
    return boxes & (F.greatest(*corners) > 0) & (F.least(*corners) < 0)


def cell_inside(w: Column, s: Column, e: Column, n: Column, ring: list[tuple[float, float]]) -> Column:
    """All of a cell lies in the polygon: its centre does, and no edge enters the cell."""
    dx, dy = (e - w) * 1e-6, (n - s) * 1e-6
    return in_polygon((w + e) / 2, (s + n) / 2, ring) & ~F.exists(edges(ring), lambda d: _enters(d, w + dx, s + dy, e - dx, n - dy))


def clip(cells: DataFrame, rings: list[list[tuple[float, float]]], res: float, holes: list[list[tuple[float, float]]] = ()) -> DataFrame:
    """Cells (row, col) of which any part lies in one of the polygons and that no hole holds whole."""
    w, n = F.col("col") * res, -F.col("row") * res
    test = F.lit(False)
    for ring in rings:
        test = test | cell_touches(w, n - res, w + res, n, ring)
    for hole in holes:
        test = test & ~cell_inside(w, n - res, w + res, n, hole)
    return cells.where(test)


def nearest(left: DataFrame, right: DataFrame, x: str, y: str, value: str, res: float) -> DataFrame:
    """The right value at the nearest grid node within half a step: both sides snap to whole numbers and meet by equality."""
    node = lambda c: F.floor(F.col(c) / res + 0.5).cast("long")
    own = right.select(node(x).alias("__x"), node(y).alias("__y"), value).groupBy("__x", "__y").agg(F.max(value).alias(value))
    return left.withColumns({"__x": node(x), "__y": node(y)}).join(own, ["__x", "__y"], "left").drop("__x", "__y")


def coarser(cells: DataFrame, factor: int, value: str, kind: str = "average") -> DataFrame:
    """Blocks of factor x factor cells: average, most frequent (lowest on ties), or the centre cell."""
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    if kind == "nearest":
        mid = factor // 2
        return cells.where((F.col("row") % factor == mid) & (F.col("col") % factor == mid)).select(*block, value)
    agg = F.avg(value) if kind == "average" else F.mode(value, True)
    return cells.groupBy(*block).agg(agg.alias(value))


Ring = list[tuple[float, float]]


def rings_of(area) -> list[Ring]:
    """Rings of an area given as a box (w, s, e, n), one ring of points, or a list of rings."""
    if len(area) == 4 and all(isinstance(v, (int, float)) for v in area):
        w, s, e, n = area
        return [[(w, s), (e, s), (e, n), (w, n)]]
    if all(len(p) == 2 and isinstance(p[0], (int, float)) for p in area):
        return [[tuple(p) for p in area]]
    return [ring for part in area for ring in rings_of(part)]


def box_of(area) -> tuple[float, float, float, float]:
    """The box around all rings of an area."""
    points = [p for ring in rings_of(area) for p in ring]
    return min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)


def tiles_within(area, size: float, spark) -> DataFrame:
    """Tiles (w, s, e, n) of the area's box of which a part lies in one of its rings."""
    df = spark.createDataFrame(tiles(box_of(area), size), "w double, s double, e double, n double")
    test = F.lit(False)
    for ring in rings_of(area):
        test = test | cell_touches(F.col("w"), F.col("s"), F.col("e"), F.col("n"), ring)
    return df.where(test)
