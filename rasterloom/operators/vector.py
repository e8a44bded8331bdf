"""Polygons to raster and back. A polygon is rings of (x, y); features are numbered in order, later ones win."""

from __future__ import annotations

import math
import re
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import GridSpec, PolygonizeSpec, Raster, RasterMeta, grid, invert_affine, one_band
from ..plans.lineage import cut
from .regions import region_roots
from .rings import corner, lines_of_edges, rings_of_sides
from .zonal import stat_names, zonal_aggregate

Ring = list[tuple[float, float]]
SEGMENTS = "feature long, feature_value double, ax double, ay double, bx double, by double"


def parse_wkt(text: str | None) -> list[Ring]:
    """Rings of a POLYGON or MULTIPOLYGON; none of an empty one."""
    if not text or "EMPTY" in text.upper():
        return []
    if not re.match(r"\s*(MULTI)?POLYGON", text, re.I):
        raise ValueError("POLYGON or MULTIPOLYGON is needed")
    return [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", text)]


def segments(spark: SparkSession, geometries: list, values: list[float] | None = None) -> DataFrame:
    """Edges of polygons given as WKT or as lists of rings; empty and missing ones have none."""
    rows = []
    for k, g in enumerate(geometries, 1):
        rings = parse_wkt(g) if isinstance(g, str) or g is None else g
        value = float(values[k - 1]) if values is not None else float(k)
        for ring in rings:
            closed = list(ring) + ([ring[0]] if ring[0] != ring[-1] else [])
            rows += [(k, value, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(closed, closed[1:])]
    return spark.createDataFrame(rows, SEGMENTS)


def burn(edges: DataFrame, spec: GridSpec) -> DataFrame:
    """feature, feature_value, row, col of the cells whose centre is inside (even-odd over all rings).

    Scan lines: an edge meets the rows between its ends; the sorted crossings of a feature's row bound its spans. The
    work is edges times rows and the cells that are filled, never the bounding boxes.
    """
    a, b, c, d, e, f = spec.affine
    if b == 0 and d == 0 and a > 0:  # rows have one y: cross in world coordinates
        ya, yb, xa, xb = "ay", "by", "ax", "bx"
        to_row, py, to_col = (lambda y: (y - f) / e), (lambda r: e * (r + 0.5) + f), (lambda x: (x - c) / a)
    else:  # turned grids: cross in cell coordinates
        p, q, r0, s, t, u = invert_affine(spec.affine)
        edges = edges.select("feature", "feature_value", *((F.col(f"{k}x") * p + F.col(f"{k}y") * q + r0).alias(f"{k}c") for k in "ab"), *((F.col(f"{k}x") * s + F.col(f"{k}y") * t + u).alias(f"{k}r") for k in "ab"))
        ya, yb, xa, xb = "ar", "br", "ac", "bc"
        to_row, py, to_col = (lambda y: y), (lambda r: r + 0.5), (lambda x: x)
    ra, rb = to_row(F.col(ya)), to_row(F.col(yb))
    lo = F.greatest(F.floor(F.least(ra, rb) - 0.5).cast("int"), F.lit(0))
    hi = F.least(F.ceil(F.greatest(ra, rb)).cast("int"), F.lit(spec.height - 1))
    crossing = edges.where((F.col(ya) != F.col(yb)) & (lo <= hi)).withColumn("row", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    y = py(F.col("row"))
    crossing = crossing.where((F.col(ya) > y) != (F.col(yb) > y)).select(
        "feature", "feature_value", "row", ((F.col(xb) - F.col(xa)) * (y - F.col(ya)) / (F.col(yb) - F.col(ya)) + F.col(xa)).alias("x")
    )
    w = Window.partitionBy("feature", "row").orderBy("x")
    spans = crossing.withColumns({"n": F.row_number().over(w), "x2": F.lead("x").over(w)}).where("n % 2 = 1 and x2 is not null")
    # a centre is inside if x < centre <= x2
    first = F.greatest((F.floor(to_col(F.col("x")) - 0.5) + 1).cast("int"), F.lit(0))
    last = F.least(F.floor(to_col(F.col("x2")) - 0.5).cast("int"), F.lit(spec.width - 1))
    return spans.select("feature", "feature_value", "row", first.alias("a"), last.alias("b")).where("a <= b").select("feature", "feature_value", "row", F.explode(F.sequence("a", "b")).alias("col"))


def rasterize(spark: SparkSession, geometries: list | DataFrame, values: list[float] | None, spec: GridSpec) -> Raster:
    """Cells of polygons; later features win, the rest gets the fill value, which is also the nodata tag."""
    edges = geometries if isinstance(geometries, DataFrame) else segments(spark, geometries, values)
    top = burn(edges, spec).groupBy("row", "col").agg(F.max_by("feature_value", "feature").alias("v"))
    cells = grid(spark, spec.height, spec.width)
    df = cells.join(top, ["row", "col"], "left").select("band", "row", "col", F.when(F.col("v") != spec.fill_value, F.col("v")).alias("value"))
    return Raster(df, RasterMeta(spec.height, spec.width, 1, spec.dtype, spec.fill_value, spec.affine))


def zonal_stats_polygons(spark: SparkSession, geometries: list | DataFrame, values: Raster, stats=None, spec: GridSpec | None = None) -> DataFrame:
    """Statistics by polygon number (from 0), ``feature_index``; of overlapping polygons the last has the cell."""
    spec = spec or GridSpec.from_raster(values)
    edges = geometries if isinstance(geometries, DataFrame) else segments(spark, geometries)
    zones = burn(edges, spec).groupBy("row", "col").agg(F.max("feature").alias("zone"))
    both = zones.join(values.df.where("value is not null"), ["row", "col"])
    return zonal_aggregate(both, stat_names(stats), values.meta.band_count).withColumn("feature_index", F.col("zone") - 1)


def simplify(ring: Ring, tolerance: float) -> Ring:
    """Douglas-Peucker over a closed ring; it keeps at least a triangle."""
    pts = np.array(ring, dtype=float)
    keep = np.zeros(len(pts), dtype=bool)
    far = int(np.argmax(((pts - pts[0]) ** 2).sum(axis=1)))
    keep[[0, far, -1]] = True
    todo = [(0, far), (far, len(pts) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        line, some = pts[j] - pts[i], pts[i + 1 : j] - pts[i]
        size = math.hypot(*line)
        away = np.abs(line[0] * some[:, 1] - line[1] * some[:, 0]) / size if size else np.hypot(some[:, 0], some[:, 1])
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    out = [tuple(p) for p in pts[keep]]
    return out if len(out) >= 4 else ring


def _area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


#: Corners from which and to which a cell's top, right, bottom and left sides run, the cell to the right on the screen.
SIDES = (((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0)))


def trace(edges: list[tuple[int, int, int]], diagonal: bool) -> list[Ring]:
    """Rings of cell sides (row, col, number in SIDES), in (col, row) corners; the outer one first."""
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c, k in edges:
        (x1, y1), (x2, y2) = SIDES[k]
        step.setdefault((c + x1, r + y1), []).append((c + x2, r + y2))
    rings = []
    for start in sorted(step):
        while step.get(start):
            ring, at, way = [start], start, (0, 0)
            while True:
                ways = step[at]
                if len(ways) > 1:  # two cells meet in this corner: turn away, or through it if diagonal cells join
                    turn = lambda to: way[0] * (to[1] - at[1]) - way[1] * (to[0] - at[0])
                    ways.sort(key=turn, reverse=not diagonal)
                to = ways.pop(0)
                new = (to[0] - at[0], to[1] - at[1])
                if new == way:
                    ring[-1] = to
                else:
                    ring.append(to)
                at, way = to, new
                if at == start:
                    break
            rings.append(ring)
    rings.sort(key=lambda g: -abs(_area(g)))
    return rings


def border_sides(cells: DataFrame) -> DataFrame:
    """band, root, value, row, col, side of each side that parts a cell of ``region_roots`` from another region."""
    line = {1: ("row", "col", 1), 3: ("row", "col", -1), 2: ("col", "row", 1), 0: ("col", "row", -1)}
    other = {}
    for side, (same, along, way) in line.items():
        w = Window.partitionBy("band", same).orderBy(along)
        near = F.lead if way > 0 else F.lag
        touches = (near(along).over(w) == F.col(along) + way) & (near("root").over(w) == F.col("root"))
        other[f"s{side}"] = ~F.coalesce(touches, F.lit(False))
    # two sorts: by row, then by column
    marked = cells.withColumns({k: other[k] for k in ("s1", "s3")}).withColumns({k: other[k] for k in ("s0", "s2")})
    sides = F.filter(F.array(*(F.when(F.col(f"s{k}"), F.lit(k)) for k in range(4))), lambda x: x.isNotNull())
    return marked.select("band", "root", "value", "row", "col", F.explode(sides).alias("side"))


def wkt(rings: list[Ring]) -> str:
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")" for ring in rings) + ")"


def by_group(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` maps the columns (arrays by name) of all rows of one group to a row. Groups come sorted in few calls of
    Python, so that many small ones cost little; a task holds one group and one batch at a time."""
    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            key = batch[keys].to_numpy()
            if len(batch) and (key[0] == key[-1]).all() and (held[0][keys].iloc[0].to_numpy() == key[-1]).all():
                continue  # still the group that began before
            part = pd.concat(held, ignore_index=True)
            last = (part[keys].to_numpy() != key[-1]).any(axis=1) if len(batch) else np.ones(len(part), dtype=bool)
            yield rows(part[last])
            held = [part[~last]]
        if held:
            yield rows(pd.concat(held, ignore_index=True))

    def rows(part: pd.DataFrame) -> pd.DataFrame:
        key, columns = part[keys].to_numpy(), {c: part[c].to_numpy() for c in part}
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(part) else np.zeros(0, int)
        return pd.DataFrame([fn({c: v[a:b] for c, v in columns.items()}) for a, b in zip(new, np.append(new[1:], len(part)))], columns=names)

    names = [x.split()[0] for x in schema.split(",")]
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def polygonize(r: Raster, spec: PolygonizeSpec | None = None, band: int | None = None) -> DataFrame:
    """One polygon per region of equal values: region, value, n_cells, area, n_rings, wkt. The first ``max_polygons`` by
    region are kept, with a warning if there are more; None keeps all.

    Regions are labelled in tiles and joined. A region's rings are chained in one task from its border's sides alone, so
    the group grows with the polygon that it makes, not with the region's area.
    """
    spec = spec or PolygonizeSpec()
    r = r.band(band) if band is not None else one_band(r, "polygonize")
    a, b, c, d, e, f = r.meta.affine
    cells = cut(region_roots(r, spec.connectivity, by_value=True))
    sides = border_sides(cells).withColumn("value", F.col("value").cast("float").cast("double"))

    def rings(g: dict[str, np.ndarray]) -> tuple:
        found = trace(list(zip(g["row"].tolist(), g["col"].tolist(), g["side"].tolist())), spec.connectivity == 8)
        cell_area = abs(_area(found[0])) - sum(abs(_area(x)) for x in found[1:])
        world = [[(float(a * x + b * y + c), float(d * x + e * y + f)) for x, y in ring] for ring in found]
        if spec.simplify_tolerance:
            world = [simplify(ring, spec.simplify_tolerance) for ring in world]
        area = abs(_area(world[0])) - sum(abs(_area(x)) for x in world[1:])
        return int(g["root"][0]), float(g["value"][0]), round(cell_area), area, len(world), wkt(world)

    out = by_group(sides, ["band", "root"], rings, f"region long, {spec.value_field} double, n_cells long, area double, n_rings long, wkt string")
    return limit_polygons(cut(out), spec.max_polygons)


def polygonize_table(r: Raster, spec: PolygonizeSpec | None = None, band: int | None = None) -> DataFrame:
    """``polygonize`` with the raster's reference system beside each polygon."""
    return polygonize(r, spec, band).withColumn("crs", F.lit(r.meta.crs))


def limit_polygons(polygons: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` by region, with a warning if some are left out; None is no limit."""
    if most is not None and polygons.count() > most:
        warnings.warn(f"Polygon explosion: more than {most}, the rest is left out", UserWarning, stacklevel=3)
        return polygons.orderBy("region").limit(most)
    return polygons


def polygon_rings(r: Raster, spec: PolygonizeSpec | None = None, tile: int = 256, few: int = 1_000_000) -> DataFrame:
    """The corners of all regions' rings in order: band, region, value, ring, rank, x, y. No task holds a ring."""
    spec = spec or PolygonizeSpec()
    a, b, c, d, e, f = r.meta.affine
    sides = rings_of_sides(border_sides(cut(region_roots(r, spec.connectivity, by_value=True))), r.meta.height, r.meta.width, spec.connectivity == 8, tile, few)
    x, y = corner(F.col("side"), F.col("row"), F.col("col"))
    return sides.where("turns").select("band", F.col("root").alias("region"), "value", "ring", "rank", (x * a + y * b + c).alias("x"), (x * d + y * e + f).alias("y"))


def polygon_measures(r: Raster, spec: PolygonizeSpec | None = None, tile: int = 256, few: int = 1_000_000) -> DataFrame:
    """band, region, value, n_cells, n_rings, perimeter (sides of cells) and area of each region: sums over its rings' sides."""
    spec = spec or PolygonizeSpec()
    a, b, _, d, e, _ = r.meta.affine
    sides = rings_of_sides(border_sides(cut(region_roots(r, spec.connectivity, by_value=True))), r.meta.height, r.meta.width, spec.connectivity == 8, tile, few)
    x, y = corner(F.col("side"), F.col("row").cast("long"), F.col("col").cast("long"))
    turned = F.when(F.col("side") == 1, x).when(F.col("side") == 3, -x).when(F.col("side") == 0, -y).otherwise(y)  # twice the area towards the origin
    got = sides.groupBy("band", F.col("root").alias("region"), "value").agg(F.sum(turned).alias("twice"), F.sum((F.col("rank") == 0).cast("long")).alias("n_rings"), F.count(F.lit(1)).alias("perimeter"))
    cells = F.expr("twice div 2")
    return got.select("band", "region", "value", cells.alias("n_cells"), "n_rings", "perimeter", (cells * abs(a * e - b * d)).alias("area"))


def _contour_pieces(r: Raster, level: float) -> DataFrame:
    """id, r, c, x1, y1, x2, y2 of marching squares around the cells equal to ``level``: ends in half cells, whole numbers."""
    hot = F.when(F.col("value") == level, 1).otherwise(0)
    on = r.df.where(F.col("value") == level).select("row", "col", hot.alias("on"))
    squares_of = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(bit).alias("bit")) for i, j, bit in ((0, 0, 8), (0, -1, 4), (-1, -1, 2), (-1, 0, 1)))))
    # each cell is the top-left, top-right, bottom-right and bottom-left corner of four squares
    squares = on.select("row", "col", squares_of.alias("k")).select((F.col("row") + F.col("k.i")).alias("r"), (F.col("col") + F.col("k.j")).alias("c"), "k.bit").groupBy("r", "c").agg(F.sum("bit").alias("case"))
    top, right, bottom, left = (1, 0), (2, 1), (1, 2), (0, 1)
    table = {8: [(left, top)], 4: [(top, right)], 2: [(right, bottom)], 1: [(bottom, left)], 12: [(left, right)], 6: [(top, bottom)], 3: [(right, left)], 9: [(bottom, top)], 10: [(left, top), (right, bottom)], 5: [(top, right), (bottom, left)], 14: [(left, bottom)], 13: [(bottom, right)], 11: [(right, top)], 7: [(top, left)]}
    lines = F.lit(None)
    for k, ends in table.items():
        made = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(v).alias(name) for name, v in zip(("u1", "v1", "u2", "v2"), (*p, *q)))) for n, (p, q) in enumerate(ends)))
        lines = F.when(F.col("case") == k, made).otherwise(lines)
    row, col = F.col("r").cast("long"), F.col("c").cast("long")
    return squares.where(F.col("case") != 15).select("r", "c", F.explode(lines).alias("s")).select(
        (((row + 1) * (r.meta.width + 2) + col + 1) * 2 + F.col("s.n")).alias("id"), "r", "c",
        (2 * col + F.col("s.u1")).alias("x1"), (2 * row + F.col("s.v1")).alias("y1"), (2 * col + F.col("s.u2")).alias("x2"), (2 * row + F.col("s.v2")).alias("y2"),
    )


def _world(r: Raster, x: str, y: str) -> tuple[Column, Column]:
    """Coordinates of a point in half cells between cell centres."""
    a, b, c, d, e, f = r.meta.affine
    u, v = (F.col(x) + 1) / 2, (F.col(y) + 1) / 2
    return u * a + v * b + c, u * d + v * e + f


def contour_edges(r: Raster, level: float) -> DataFrame:
    """Marching squares around the cells equal to ``level``: x1, y1, x2, y2 between midpoints of cell sides."""
    ends = [c.alias(n) for k in "12" for c, n in zip(_world(r, f"x{k}", f"y{k}"), (f"x{k}", f"y{k}"))]
    return _contour_pieces(r, level).select(*ends)


def contour_lines(r: Raster, level: float, tile: int = 256, few: int = 1_000_000) -> DataFrame:
    """The edges of ``contour_edges`` in order: ring, rank, x1, y1, x2, y2. No task holds a line."""
    lines = lines_of_edges(_contour_pieces(r, level), tile, few)
    ends = [c.alias(n) for k in "12" for c, n in zip(_world(r, f"x{k}", f"y{k}"), (f"x{k}", f"y{k}"))]
    return lines.select("ring", "rank", *ends, F.struct("x1", "y1").alias("begin"), F.struct("x2", "y2").alias("end"))


def contour_rings(r: Raster, level: float, tile: int = 256, few: int = 1_000_000) -> DataFrame:
    """A row a line of ``contour_lines``: x, y (its first point), n_points, closed, length, wkt. Lines that end at the raster's
    border are not closed. The line's text is one value, which is all that a task holds of it."""
    lines = contour_lines(r, level, tile, few)
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    point = lambda x, y: F.concat_ws(" ", x, y)
    got = lines.groupBy("ring").agg(
        F.min_by(F.struct("x1", "y1", "begin"), "rank").alias("first"), F.max_by(F.struct("x2", "y2", "end"), "rank").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("length"),
        F.sort_array(F.collect_list(F.struct("rank", point("x2", "y2").alias("said")))).alias("points"),
    )
    closed = (F.col("first.begin.x1") == F.col("last.end.x2")) & (F.col("first.begin.y1") == F.col("last.end.y2"))
    text = F.concat(F.when(closed, "POLYGON ((").otherwise("LINESTRING ("), point("first.x1", "first.y1"), F.lit(", "), F.array_join(F.transform("points", lambda p: p["said"]), ", "), F.when(closed, "))").otherwise(")"))
    return got.select(F.col("first.x1").alias("x"), F.col("first.y1").alias("y"), (F.col("n") + 1).alias("n_points"), closed.alias("closed"), "length", text.alias("wkt"))
