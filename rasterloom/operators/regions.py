"""Labels, sieve, morphology, distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Raster
from ..plans.lineage import cut
from .components import components, joined
from .focal import weighted
from .sinks import raster_fill_sinks  # noqa: F401

TILE = 256
_NEAR = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def _tiles(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"trow": F.floor(F.col("row") / tile).cast("int"), "tcol": F.floor(F.col("col") / tile).cast("int")})


def region_roots(r: Raster, connectivity: int = 4, by_value: bool = False, tile: int = TILE) -> DataFrame:
    """band, row, col, value, root: the least row * width + col of the cell's region. Regions are cells that are nonzero
    and valid, or with ``by_value`` valid and equal. Tiles are labelled on their own, then joined where they touch."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    near, width = _NEAR[connectivity], r.meta.width

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col, value = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["value"].to_numpy()
        order = np.lexsort((col, row))
        row, col, value = row[order], col[order], value[order]
        r0, c0 = row.min(), col.min()
        at = np.full((row.max() - r0 + 3, col.max() - c0 + 3), -1, dtype=np.int64)
        at[row - r0 + 1, col - c0 + 1] = np.arange(len(row))
        pairs = []
        for dr, dc in near:
            a, b = at[1:-1, 1:-1], at[1 + dr : at.shape[0] - 1 + dr, 1 + dc : at.shape[1] - 1 + dc]
            ok = (a >= 0) & (b >= 0)
            a, b = a[ok], b[ok]
            if by_value:
                a, b = a[value[a] == value[b]], b[value[a] == value[b]]
            pairs.append((a, b))
        root = joined(len(row), pairs)
        return pd.DataFrame({"band": pdf["band"].iloc[0], "row": row, "col": col, "value": value, "local": row[root].astype(np.int64) * width + col[root]})

    inside = r.df.where("value is not null") if by_value else r.df.where("value is not null and value <> 0")
    cells = cut(_tiles(inside, tile).groupBy("band", "trow", "tcol").applyInPandas(local, "band int, row int, col int, value double, local long"))
    seam = (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)
    rim = cells.where(seam)
    other = rim.select("band", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("value").alias("v2"), F.col("local").alias("l2"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near))).alias("s")
    links = (
        rim.select("*", steps).select("band", (F.col("row") + F.col("s.a")).alias("r2"), (F.col("col") + F.col("s.b")).alias("c2"), "value", "local")
        .join(other, ["band", "r2", "c2"]).where("local <> l2" + (" and value = v2" if by_value else ""))
    )
    size = F.lit(r.meta.height * width).cast("long")  # a node is a cell's number, counted on over the bands
    node = lambda c: F.col("band") * size + F.col(c)
    roots = components(links.select(node("local").alias("u"), node("l2").alias("v")), few=1_000_000)
    roots = roots.select(F.floor(F.col("node") / size).cast("int").alias("band"), (F.col("node") % size).alias("local"), (F.col("root") % size).alias("joined"))
    return cells.join(roots, ["band", "local"], "left").select("band", "row", "col", "value", F.coalesce("joined", "local").alias("root"))


def label_connected_components(r: Raster, connectivity: int = 4) -> Raster:
    """Labels 1, 2, ... in the order of each region's first cell; background and nodata 0."""
    cells = cut(region_roots(r, connectivity))
    # numbered in blocks of cells: a block's labels follow those of the blocks before it
    first = cells.select("band", "root").distinct().withColumn("block", F.floor(F.col("root") / 65536))
    sizes = first.groupBy("band", "block").count()
    before = F.sum("count").over(Window.partitionBy("band").orderBy("block")) - F.col("count")
    within = F.row_number().over(Window.partitionBy("band", "block").orderBy("root"))
    label = first.withColumn("n", within).join(sizes.withColumn("before", before), ["band", "block"]).select("band", "root", (F.col("n") + F.col("before")).cast("double").alias("label"))
    got = cells.join(label, ["band", "root"]).select("band", "row", "col", "label")
    return r.derive(r.df.join(got, ["band", "row", "col"], "left").withColumn("value", F.coalesce("label", F.lit(0.0))), dtype="int32", nodata=0.0)


def sieve_filter(labeled: Raster, min_size: int, connectivity: int = 4, replace_value: float = 0) -> Raster:
    """Cells of labels that have fewer than ``min_size`` cells get ``replace_value``; nodata stays."""
    counts = labeled.df.where("value is not null").groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_size)
    df = labeled.df.join(counts, ["band", "value"], "left")
    exempt = F.col("value") == F.lit(labeled.meta.nodata) if labeled.meta.nodata is not None else F.lit(False)
    return labeled.derive(df.withColumn("value", F.when(F.col("n").isNotNull() & ~exempt, F.lit(float(replace_value))).otherwise(F.col("value"))))


def make_structuring_element(shape: str, size: int | tuple[int, int]) -> np.ndarray:
    """rect or cross of odd sizes, or a disk by its radius."""
    if shape == "disk":
        if not isinstance(size, int) or size < 1:
            raise ValueError("a disk has a radius of 1 or more")
        y, x = np.ogrid[-size : size + 1, -size : size + 1]
        return (x * x + y * y <= size * size).astype(np.uint8)
    h, w = (size, size) if isinstance(size, int) else size
    if h < 1 or w < 1 or h % 2 == 0 or w % 2 == 0:
        raise ValueError("sizes are odd and positive")
    if shape == "rect":
        return np.ones((h, w), dtype=np.uint8)
    if shape == "cross":
        out = np.zeros((h, w), dtype=np.uint8)
        out[h // 2], out[:, w // 2] = 1, 1
        return out
    raise ValueError(f"unknown shape {shape!r}")


def _element(structuring_element, connectivity: int) -> np.ndarray:
    if structuring_element is None:
        if connectivity not in (4, 8):
            raise ValueError("connectivity is 4 or 8")
        return make_structuring_element("cross" if connectivity == 4 else "rect", 3)
    if isinstance(structuring_element, str):
        raise TypeError("the structuring element is an array")
    se = np.asarray(structuring_element)
    if se.ndim != 2 or se.shape[0] % 2 == 0 or se.shape[1] % 2 == 0:
        raise ValueError("the structuring element has two odd dimensions")
    return (se != 0).astype(np.uint8)


def _foreground() -> Column:
    return F.when(F.col("value").isNotNull() & (F.col("value") != 0), F.lit(1.0)).otherwise(F.lit(0.0))


def _runs(line: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of ones."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], line, [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def covered(df: DataFrame, se: np.ndarray) -> DataFrame:
    """band, row, col, num: cells of value 1 under the element. It is cut into runs along rows; a run's sum is a difference
    of two running sums, so a line of the element costs the same however long its runs are, and equal lines share it."""
    ry, rx = se.shape[0] // 2, se.shape[1] // 2
    along = Window.partitionBy("band", "row").orderBy("col")
    df = df.withColumn("_sum", F.sum("value").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_all", F.last("_sum").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def up_to(shift: int) -> Column:
        """The running sum ``shift`` cells on; before the row 0, after it all."""
        if shift >= 0:
            return F.coalesce(F.lead("_sum", shift).over(along), F.col("_all")) if shift else F.col("_sum")
        return F.coalesce(F.lag("_sum", -shift).over(along), F.lit(0.0))

    lines = [tuple(_runs(line)) for line in se]
    kinds = {runs: f"_line{k}" for k, runs in enumerate(dict.fromkeys(x for x in lines if x))}
    df = df.withColumns({name: sum((up_to(b - rx) - up_to(a - rx - 1) for a, b in runs), F.lit(0.0)) for runs, name in kinds.items()})
    down = Window.partitionBy("band", "col").orderBy("row")

    def at(name: str, shift: int) -> Column:
        return F.coalesce(F.lead(name, shift).over(down) if shift > 0 else F.lag(name, -shift).over(down) if shift else F.col(name), F.lit(0.0))

    total = sum((at(kinds[runs], i - ry) for i, runs in enumerate(lines) if runs), F.lit(0.0))
    return df.withColumn("num", total)


def raster_morphology(r: Raster, op: str, connectivity: int = 4, iterations: int = 1, structuring_element=None) -> Raster:
    """erode, dilate, open or close; outside of the raster is background."""
    se = _element(structuring_element, connectivity)
    steps = {"erode": ["e"], "dilate": ["d"], "open": ["e", "d"], "close": ["d", "e"]}.get(op)
    if steps is None:
        raise ValueError(f"unknown operation {op!r}")
    df = r.df.select("band", "row", "col", _foreground().alias("value"))
    n = int(se.sum())
    for k, step in enumerate(s for s in steps for _ in range(iterations)):
        kernel = se[::-1, ::-1] if step == "d" else se  # dilation reflects its element
        hit = covered(df, kernel) if n > 25 else weighted(df, kernel.astype(float), F.col("value"), F.lit(0.0))
        df = hit.select("band", "row", "col", F.when(F.col("num") > (0.5 if step == "d" else n - 0.5), F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"))
        if k % 8 == 7:
            df = cut(df)
    return r.derive(df)


def _differs(a: Raster, b: Raster) -> Raster:
    """a and not b."""
    df = a.df.select("band", "row", "col", _foreground().alias("x")).join(b.df.select("band", "row", "col", _foreground().alias("y")), ["band", "row", "col"])
    return a.derive(df.withColumn("value", F.col("x") * (1 - F.col("y"))), dtype="uint8")


def raster_morphology_tophat(r: Raster, **how) -> Raster:
    return _differs(r, raster_morphology(r, "open", **how))


def raster_morphology_blackhat(r: Raster, **how) -> Raster:
    return _differs(raster_morphology(r, "close", **how), r)


def _line_minima(g2: np.ndarray, sweep: int = 64) -> np.ndarray:
    """min over c of (x - c)^2 + g2[:, c] for each x of each row (inf: no term). Offsets are swept for all rows at once
    until none can be less; rows that aren't through after ``sweep`` offsets get the lower envelope of their parabolas."""
    w = g2.shape[1]
    out = g2.copy()
    for k in range(1, w):
        if k > sweep or k * k >= out.max(initial=0):
            break
        np.minimum(out[:, k:], g2[:, :-k] + k * k, out=out[:, k:])
        np.minimum(out[:, :-k], g2[:, k:] + k * k, out=out[:, :-k])
    for i in np.flatnonzero((out > sweep * sweep).any(axis=1)):
        held = np.flatnonzero(np.isfinite(g2[i]))
        if not len(held):
            continue
        top, start = [], []
        for c in held.tolist():
            at = -np.inf
            while top:
                v = top[-1]
                at = (g2[i, c] + c * c - g2[i, v] - v * v) / (2 * (c - v))
                if at > start[-1]:
                    break
                top.pop()
                start.pop()
            start.append(at if top else -np.inf)
            top.append(c)
        x = np.arange(w)
        nearest = np.array(top)[np.searchsorted(start, x, side="right") - 1]
        out[i] = (x - nearest) ** 2 + g2[i, nearest]
    return out


def raster_distance_transform(r: Raster) -> Raster:
    """Exact distance in pixels to the nearest foreground cell; without any, 0. Columns by windows, then rows in numpy, as
    many at a time as make 65,536 cells."""
    fg = F.when(F.col("value").isNotNull() & (F.col("value") != 0), F.col("row"))
    up, down = Window.partitionBy("band", "col").orderBy("row"), Window.partitionBy("band", "col").orderBy(F.col("row").desc())
    gap = F.least(F.col("row") - F.last(fg, True).over(up), F.last(fg, True).over(down) - F.col("row")).cast("double")
    w = r.meta.width
    some = max(1, 65536 // w)

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        number, at = np.unique(row, return_inverse=True)
        g2 = np.full((len(number), w), np.inf)
        g2[at, col] = np.where(np.isnan(g := pdf["g"].to_numpy(np.float64)), np.inf, g * g)
        out = _line_minima(g2)[at, col]
        return pdf[["band", "row", "col"]].assign(value=np.where(pdf["hole"], np.nan, np.sqrt(np.where(np.isinf(out), 0.0, out))))

    part = r.df.withColumn("g", gap).select("band", "row", "col", "g", F.col("value").isNull().alias("hole"), F.floor(F.col("row") / some).alias("part"))
    done = part.groupBy("band", "part").applyInPandas(lines, "band int, row int, col int, value double")
    return r.derive(done.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))), dtype="float64", nodata=float("nan") if r.meta.nodata is not None else None)
