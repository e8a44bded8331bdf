"""Neighbourhood operators by window functions: along rows, then along columns. Two shuffles, no replicated pixels. Large kernels
and windows of different values go by tiles with their surroundings (``blocks``)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..model import Raster, clean
from ..plans import tiling
from .blocks import convolved, sliding_distinct


def along_row() -> WindowSpec:
    return Window.partitionBy("band", "row").orderBy("col")


def along_col() -> WindowSpec:
    return Window.partitionBy("band", "col").orderBy("row")


_3X3 = [("nw", "n", "ne"), ("w", "c", "e"), ("sw", "s", "se")]


def parse_radius(radius: int | tuple[int, int]) -> tuple[int, int]:
    if isinstance(radius, int):
        return radius, radius
    if len(radius) != 2:
        raise ValueError("the radius is a number or (rows, cols)")
    return int(radius[0]), int(radius[1])


def stencil(r: Raster, replicate: bool) -> DataFrame:
    """The eight neighbours as columns. Outside of the grid: NULL, or the nearest cell's value if ``replicate``."""
    h, w, v = r.meta.height, r.meta.width, F.col("value")
    edge = (lambda inside, x, own: F.when(inside, x).otherwise(own)) if replicate else (lambda inside, x, own: x)
    rows = r.df.select(
        "band", "row", "col", v.alias("c"), edge(F.col("col") > 0, F.lag("value").over(along_row()), v).alias("w"),
        edge(F.col("col") < w - 1, F.lead("value").over(along_row()), v).alias("e"),
    )
    cols = [F.col(x) for x in ("w", "c", "e")]
    up = [edge(F.col("row") > 0, F.lag(x).over(along_col()), c).alias(n) for x, c, n in zip("wce", cols, _3X3[0])]
    down = [edge(F.col("row") < h - 1, F.lead(x).over(along_col()), c).alias(n) for x, c, n in zip("wce", cols, _3X3[2])]
    return rows.select("band", "row", "col", *cols, *up, *down)


def all_valid() -> Column:
    out = F.lit(True)
    for name in (n for line in _3X3 for n in line):
        out &= F.col(name).isNotNull()
    return out


def weighted(df: DataFrame, kernel: np.ndarray, value: Column, weight_of: Column) -> DataFrame:
    """sum(value * kernel) and sum(weight_of * kernel) around each cell (correlation), as ``num`` and ``den``."""
    kh, kw = kernel.shape
    ry, rx = kh // 2, kw // 2
    df = df.withColumns({"_v": value, "_w": weight_of})

    def at(name: str, shift: int, w) -> Column:
        return F.coalesce(F.lead(name, shift).over(w) if shift > 0 else F.lag(name, -shift).over(w) if shift else F.col(name), F.lit(0.0))

    def total(terms: list[Column]) -> Column:
        out = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            out = out + t
        return out

    across = {}
    for i in range(kh):
        for name in ("_v", "_w"):
            across[f"{name}{i}"] = total([at(name, j - rx, along_row()) * float(kernel[i, j]) for j in range(kw) if kernel[i, j] != 0])
    df = df.withColumns(across)
    return df.withColumns({
        out: total([at(f"{name}{i}", i - ry, along_col()) for i in range(kh)]) for out, name in (("num", "_v"), ("den", "_w"))
    })


def _by_tiles(r: Raster, fn: Callable[[np.ndarray], np.ndarray], halo: int) -> Raster:
    """``fn`` of tiles with ``halo`` cells around, four times as wide as that or 256 cells."""
    side = max(256, 4 * halo)
    return tiling.dispatch_tiled(r, lambda a, _: fn(a), tiling.RasterPlan(tiling.TilingStrategy.TILED, (side, side), halo=halo))


def raster_convolve(r: Raster, kernel: np.ndarray, direct: int = 225) -> Raster:
    """Normalised correlation: sum(v * w) / sum(w) over valid cells inside; sum(w) <= 0 gives nodata (0 without sentinel).
    Kernels of over ``direct`` cells are transformed, tile by tile; they agree with sums to rounding of a tile's largest value."""
    kernel = np.asarray(kernel, dtype=float)
    if kernel.ndim != 2:
        raise ValueError("the kernel has two dimensions")
    if kernel.size > direct:
        empty = np.nan if r.meta.nodata is not None else 0.0

        def run(a: np.ndarray) -> np.ndarray:
            num, den = convolved(a, kernel)
            return np.where(np.isnan(a), np.nan, np.divide(num, den, out=np.full(a.shape, empty), where=den > 0))

        return r.derive(_by_tiles(r, run, max(kernel.shape) // 2 + 1).df, dtype="float64")
    v = F.col("value")
    df = weighted(r.df, kernel, F.coalesce(v, F.lit(0.0)), v.isNotNull().cast("double"))
    otherwise = F.lit(None) if r.meta.nodata is not None else F.lit(0.0)
    out = F.when(v.isNotNull(), F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(otherwise))
    return r.derive(df.withColumn("value", clean(out)), dtype="float64")


def raster_gaussian_filter(r: Raster, sigma: float, kernel_size: int | None = None) -> Raster:
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    size = kernel_size or 2 * math.ceil(3 * sigma) + 1
    size += 1 - size % 2
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    line /= line.sum()
    v = F.col("value")
    # the kernel is a product, so each of the two sums is taken along rows and then along columns
    df = weighted(r.df, line[None, :], F.coalesce(v, F.lit(0.0)), v.isNotNull().cast("double"))
    df = df.select("band", "row", "col", "value", F.col("num").alias("n1"), F.col("den").alias("d1"))
    df = weighted(df, line[:, None], F.col("n1"), F.col("d1"))
    return r.derive(df.withColumn("value", F.when(v.isNotNull(), F.try_divide(F.col("num"), F.col("den")))), dtype="float64")


def _focal(r: Raster, radius, first: dict[str, Column], second: dict[str, Column], value: Column) -> Raster:
    """``first`` aggregates along rows, ``second`` over those along columns; nodata centres stay."""
    ry, rx = parse_radius(radius)
    across, down = along_row().rangeBetween(-rx, rx), along_col().rangeBetween(-ry, ry)
    df = r.df.withColumns({k: c.over(across) for k, c in first.items()}).withColumns({k: c.over(down) for k, c in second.items()})
    return r.derive(df.withColumn("value", F.when(F.col("value").isNotNull(), value)), dtype="float64")


def raster_focal_min(r: Raster, radius=1) -> Raster:
    return _focal(r, radius, {"m": F.min("value")}, {"m2": F.min("m")}, F.col("m2"))


def raster_focal_max(r: Raster, radius=1) -> Raster:
    return _focal(r, radius, {"m": F.max("value")}, {"m2": F.max("m")}, F.col("m2"))


def raster_focal_mean(r: Raster, radius=1) -> Raster:
    return _focal(r, radius, {"s": F.sum("value"), "n": F.count("value")}, {"s2": F.sum("s"), "n2": F.sum("n")}, F.col("s2") / F.col("n2"))


def raster_focal_std(r: Raster, radius=1) -> Raster:
    """Population deviation; values are shifted by their band's mean, so the squares don't cancel."""
    mean = r.df.groupBy("band").agg(F.avg("value").alias("mid"))  # one row a band
    shifted = r.derive(r.df.join(F.broadcast(mean), "band").withColumn("value", F.col("value") - F.col("mid")))
    v = F.col("value")
    n, s, q = F.col("n2"), F.col("s2"), F.col("q2")
    var = q / n - (s / n) * (s / n)
    return _focal(shifted, radius, {"s": F.sum("value"), "q": F.sum(v * v), "n": F.count("value")}, {"s2": F.sum("s"), "q2": F.sum("q"), "n2": F.sum("n")}, F.sqrt(F.greatest(var, F.lit(0.0))))


def raster_focal_range(r: Raster, radius=1) -> Raster:
    return _focal(r, radius, {"lo": F.min("value"), "hi": F.max("value")}, {"lo2": F.min("lo"), "hi2": F.max("hi")}, F.col("hi2") - F.col("lo2"))


def raster_focal_variety(r: Raster, radius=1, direct: int = 49) -> Raster:
    """Number of different values. Windows of over ``direct`` cells slide over tiles, at a cost that doesn't follow them."""
    ry, rx = parse_radius(radius)
    if (2 * ry + 1) * (2 * rx + 1) > direct:
        got = _by_tiles(r, lambda a: np.where(np.isnan(a), np.nan, sliding_distinct(a, ry, rx)), max(ry, rx))
        return r.derive(got.df, dtype="float64")
    sets = {"s": F.collect_set("value")}, {"s2": F.collect_list("s")}
    return _focal(r, radius, *sets, F.size(F.array_distinct(F.flatten("s2"))).cast("double"))


def _cell(r: Raster) -> tuple[float, float]:
    return abs(r.meta.affine[0]) or 1.0, abs(r.meta.affine[4]) or 1.0


def _gradient(r: Raster) -> tuple[DataFrame, Column, Column]:
    """Horn's dz/dx and dz/dy with replicated borders."""
    cx, cy = _cell(r)
    n = {k: F.col(k) for line in _3X3 for k in line}
    dx = ((n["ne"] + 2 * n["e"] + n["se"]) - (n["nw"] + 2 * n["w"] + n["sw"])) / (8 * cx)
    dy = ((n["sw"] + 2 * n["s"] + n["se"]) - (n["nw"] + 2 * n["n"] + n["ne"])) / (8 * cy)
    return stencil(r, replicate=True), dx, dy


def _float(r: Raster) -> str:
    return "float32" if r.meta.dtype == "float32" else "float64"


def raster_slope(dem: Raster) -> Raster:
    """Degrees; any nodata in the 3 x 3 window gives nodata."""
    df, dx, dy = _gradient(dem)
    return dem.derive(df.withColumn("value", F.when(all_valid(), F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))), dtype=_float(dem))


def raster_aspect(dem: Raster) -> Raster:
    """Compass degrees; flat cells give 90."""
    df, dx, dy = _gradient(dem)
    return dem.derive(df.withColumn("value", F.when(all_valid(), F.pmod(F.lit(90.0) - F.degrees(F.atan2(-dy, dx)), F.lit(360.0)))), dtype=_float(dem))


def raster_hillshade(dem: Raster, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> Raster:
    """0 to 255, by the mathematical angle of the gradient."""
    df, dx, dy = _gradient(dem)
    dx, dy = dx * z_factor, dy * z_factor
    zenith, az = math.radians(90 - altitude), math.radians(azimuth)
    slope, aspect = F.atan(F.sqrt(dx * dx + dy * dy)), F.atan2(-dy, dx)
    shade = math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    value = F.floor(F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("double")
    return dem.derive(df.withColumn("value", F.when(all_valid(), value)), dtype="uint8", nodata=0.0 if dem.meta.nodata is not None else None)


def _terrain(dem: Raster, value: Column) -> Raster:
    """Borders and cells with nodata around them are nodata."""
    nodata = dem.meta.nodata if dem.meta.nodata is not None else -9999.0
    return dem.derive(stencil(dem, replicate=False).withColumn("value", F.when(all_valid(), value)), dtype="float64", nodata=nodata)


def _others() -> list[Column]:
    return [F.col(k) for line in _3X3 for k in line if k != "c"]


def raster_tri(dem: Raster) -> Raster:
    """Mean absolute difference from the eight neighbours."""
    total = sum((F.abs(x - F.col("c")) for x in _others()[1:]), F.abs(_others()[0] - F.col("c")))
    return _terrain(dem, total / 8)


def raster_tpi(dem: Raster) -> Raster:
    """Difference from the neighbours' mean."""
    total = sum(_others()[1:], _others()[0])
    return _terrain(dem, F.col("c") - total / 8)


def raster_curvature(dem: Raster) -> Raster:
    cx, cy = _cell(dem)
    d = ((F.col("w") + F.col("e")) / 2 - F.col("c")) / (cx * cx)
    e = ((F.col("n") + F.col("s")) / 2 - F.col("c")) / (cy * cy)
    return _terrain(dem, -2 * (d + e) * 100)
