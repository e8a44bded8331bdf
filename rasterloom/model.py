"""The data model: a raster is a DataFrame of pixels (band, row, col, value; NULL is nodata) and its metadata.

``band`` counts from 1. Every cell of the grid has a row: an absent row means outside of the raster.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]
DEFAULT_AFFINE: Affine = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
PIXELS = "band int, row int, col int, value double"


def invert_affine(m: Affine) -> Affine:
    a, b, c, d, e, f = m
    det = a * e - b * d
    if abs(det) < 1e-15:
        raise ValueError("the affine transform is singular")
    return (e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)


def compose_affine(outer: Affine, inner: Affine) -> Affine:
    """outer after inner."""
    a, b, c, d, e, f = outer
    p, q, r, s, t, u = inner
    return (a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f)


def shift_affine(m: Affine, row: float, col: float) -> Affine:
    """The transform of a window that begins at (row, col)."""
    a, b, c, d, e, f = m
    return (a, b, c + col * a + row * b, d, e, f + col * d + row * e)


@dataclass(frozen=True)
class RasterMeta:
    height: int
    width: int
    band_count: int = 1
    dtype: str = "float64"
    nodata: float | None = None
    affine: Affine = DEFAULT_AFFINE
    crs: str | None = None
    driver: str | None = None

    @property
    def pixel_count(self) -> int:
        return self.height * self.width

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """minx, miny, maxx, maxy of the four corners."""
        a, b, c, d, e, f = self.affine
        at = [(a * x + b * y + c, d * x + e * y + f) for x in (0, self.width) for y in (0, self.height)]
        xs, ys = zip(*at)
        return min(xs), min(ys), max(xs), max(ys)


@dataclass(frozen=True)
class RasterWindow:
    col_off: int
    row_off: int
    width: int
    height: int


@dataclass(frozen=True)
class TileSpec:
    tile_height: int
    tile_width: int
    overlap: int = 0

    def tile_count(self, height: int, width: int) -> tuple[int, int]:
        h, w = self.tile_height - 2 * self.overlap, self.tile_width - 2 * self.overlap
        if h <= 0 or w <= 0:
            raise ValueError("the overlap leaves no tile")
        return math.ceil(height / h), math.ceil(width / w)


@dataclass(frozen=True)
class GridSpec:
    affine: Affine
    width: int
    height: int
    dtype: str = "float64"
    fill_value: float = 0.0

    @classmethod
    def from_bounds(cls, minx: float, miny: float, maxx: float, maxy: float, resolution: float, dtype: str = "float64", fill_value: float = 0.0) -> GridSpec:
        w, h = (max(1, round((hi - lo) / resolution)) for lo, hi in ((minx, maxx), (miny, maxy)))
        return cls((resolution, 0.0, minx, 0.0, -resolution, maxy), w, h, dtype, fill_value)

    @classmethod
    def from_raster(cls, raster: Raster) -> GridSpec:
        m = raster.meta
        return cls(m.affine, m.width, m.height, m.dtype)


class ZonalStatistic(str, Enum):
    COUNT, SUM, MEAN, MIN, MAX, STD, MEDIAN = "count", "sum", "mean", "min", "max", "std", "median"


@dataclass(frozen=True)
class ZonalSpec:
    stats: tuple = (ZonalStatistic.COUNT, ZonalStatistic.SUM, ZonalStatistic.MEAN, ZonalStatistic.MIN, ZonalStatistic.MAX)

    def normalized(self) -> list[str]:
        return [ZonalStatistic(s).value for s in self.stats]


@dataclass(frozen=True)
class PolygonizeSpec:
    connectivity: int = 4
    value_field: str = "value"
    simplify_tolerance: float | None = None
    max_polygons: int | None = 1_000_000  # None: all


@dataclass
class Raster:
    """Pixels and metadata. ``events`` lists what was done, for ``report``.

    A raster whose values are a projection of another frame's carries that frame, ``root``, and the projection,
    ``step``, so that rasters of one root can be computed side by side in one pass instead of being joined (``together``).
    ``step`` maps a frame of band, row, col, the root's value and columns to keep to the same with this raster's value.
    """

    df: DataFrame
    meta: RasterMeta
    events: list[str] = field(default_factory=list)
    root: DataFrame | None = None
    step: Callable[[DataFrame, list[str]], DataFrame] | None = None

    @property
    def source(self) -> DataFrame:
        return self.df if self.root is None else self.root

    def with_value(self, value: Column, **meta) -> Raster:
        """The same grid with another value; inf and NaN become nodata."""
        out = clean(value).alias("value")

        def step(frame: DataFrame, kept: list[str]) -> DataFrame:
            own = frame if self.step is None else self.step(frame, kept)
            return own.select("band", "row", "col", *kept, out)

        return Raster(self.df.select("band", "row", "col", out), replace(self.meta, **meta), [*self.events], self.source, step)

    def derive(self, df: DataFrame, **meta) -> Raster:
        return Raster(df.select("band", "row", "col", "value"), replace(self.meta, **meta), [*self.events])

    def band(self, n: int) -> Raster:
        if not 1 <= n <= self.meta.band_count:
            raise IndexError(f"band {n} of {self.meta.band_count}")
        return self.derive(self.df.where(F.col("band") == n).withColumn("band", F.lit(1)), band_count=1)

    def window(self, w: RasterWindow) -> Raster:
        """Pixels of a window, counted from its corner; the ranges reach the scan as filters."""
        rows, cols = F.col("row").between(w.row_off, w.row_off + w.height - 1), F.col("col").between(w.col_off, w.col_off + w.width - 1)
        df = self.df.where(rows & cols).withColumns({"row": F.col("row") - w.row_off, "col": F.col("col") - w.col_off})
        h, n = min(w.height, self.meta.height - w.row_off), min(w.width, self.meta.width - w.col_off)
        return self.derive(df, height=h, width=n, affine=shift_affine(self.meta.affine, w.row_off, w.col_off))

    def wide(self) -> DataFrame:
        """row, col, b1 ... bN: one row a cell, so band arithmetic is a projection."""
        m = self.meta
        if m.band_count == 1:
            return self.df.select("row", "col", F.col("value").alias("b1"))
        return self.df.groupBy("row", "col").agg(*(F.max(F.when(F.col("band") == k, F.col("value"))).alias(f"b{k}") for k in range(1, m.band_count + 1)))

    def nodata_mask(self) -> DataFrame:
        return self.df.select("band", "row", "col", F.col("value").isNull().alias("value"))

    def valid_mask(self) -> DataFrame:
        return self.df.select("band", "row", "col", F.col("value").isNotNull().alias("value"))

    def to_numpy(self) -> np.ndarray:
        """The grid on the driver (small rasters); nodata gets the sentinel, or NaN if there is none."""
        m = self.meta
        kind = np.dtype(m.dtype)
        empty = m.nodata if m.nodata is not None else np.nan if kind.kind == "f" else 0
        out = np.full((m.band_count, m.height, m.width), empty, dtype=kind)
        rows = self.df.where(F.col("value").isNotNull()).toPandas()
        self.events.append(f"materialised {m.band_count} x {m.height} x {m.width} on the driver")
        out[rows["band"] - 1, rows["row"], rows["col"]] = rows["value"].to_numpy().astype(kind)
        return out[0] if m.band_count == 1 else out

    def report(self) -> list[str]:
        return [*self.events, self.df._jdf.queryExecution().simpleString()]

    def persist(self) -> Raster:
        self.df.persist()
        self.events.append("persisted")
        return self


_names = count()


def one_source(rasters: list[Raster]) -> bool:
    """Whether all values are projections of one frame, be it one object or two that mean the same."""
    first = rasters[0].source
    return all(r.source is first or r.source.sameSemantics(first) for r in rasters[1:])


def beside(frame: DataFrame, kept: list[str], rasters: list[Raster], names: list[str]) -> DataFrame:
    """``frame`` of band, row, col, a source's value and ``kept``; instead of the value each raster's, under its name."""
    source, done = f"source_{next(_names)}", []
    frame = frame.select("band", "row", "col", *kept, F.col("value").alias(source))
    for r, name in zip(rasters, names):
        keep = [*kept, *done, source]
        own = frame.select("band", "row", "col", *keep, F.col(source).alias("value"))
        frame = (own if r.step is None else r.step(own, keep)).select("band", "row", "col", *keep, F.col("value").alias(name))
        done.append(name)
    return frame.drop(source)


def combined(rasters: list[Raster], value: Callable[..., Column], meta: RasterMeta) -> Raster:
    """Of rasters of one source: the raster of ``value`` of their values, without a join, and itself of that source."""
    out = lambda names: clean(value(*(F.col(n) for n in names))).alias("value")

    def step(frame: DataFrame, kept: list[str]) -> DataFrame:
        names = [f"value_{next(_names)}" for _ in rasters]
        return beside(frame, kept, rasters, names).select("band", "row", "col", *kept, out(names))

    return Raster(step(rasters[0].source, []), meta, [], rasters[0].source, step)


def result_dtype(*metas: RasterMeta) -> str:
    """NumPy's result type; of integers the widest, since values are computed exactly and never wrap."""
    t = np.result_type(*(np.dtype(m.dtype) for m in metas))
    return str(t) if t.kind == "f" else "int64"


def clean(value: Column) -> Column:
    """NaN and infinities as NULL."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def check_nodata(dtype: str, nodata: float | None) -> None:
    if nodata is not None and math.isnan(nodata) and np.dtype(dtype).kind != "f":
        raise ValueError("NaN can't be the nodata value of an integer raster")


def from_numpy(spark: SparkSession, data: np.ndarray, nodata: float | None = None, affine: Affine = DEFAULT_AFFINE, crs: str | None = None) -> Raster:
    """A raster from a (rows, cols) or (bands, rows, cols) array."""
    data = np.asarray(data)
    if data.ndim not in (2, 3):
        raise ValueError("two or three dimensions are needed")
    check_nodata(str(data.dtype), nodata)
    cube = data[None] if data.ndim == 2 else data
    b, h, w = cube.shape
    values = cube.astype(np.float64).ravel()
    hole = np.isnan(values) if nodata is None or math.isnan(nodata) else (values == nodata) | np.isnan(values)
    grid = np.indices(cube.shape).reshape(3, -1)
    pdf = pd.DataFrame({"band": grid[0] + 1, "row": grid[1], "col": grid[2], "value": pd.Series(values).where(~hole).astype("Float64")})
    df = spark.createDataFrame(pdf.astype({"value": object}).where(pdf.notna(), None), PIXELS) if len(pdf) else spark.createDataFrame([], PIXELS)
    return Raster(df, RasterMeta(h, w, b, str(data.dtype), nodata, tuple(affine), crs), ["created"])


def from_dataframe(df: DataFrame, meta: RasterMeta) -> Raster:
    """A raster from pixels; a sentinel in ``value`` becomes NULL."""
    check_nodata(meta.dtype, meta.nodata)
    v = clean(F.col("value"))
    if meta.nodata is not None and not math.isnan(meta.nodata):
        v = F.nullif(v, F.lit(float(meta.nodata)))
    band = F.col("band") if "band" in df.columns else F.lit(1)
    return Raster(df.select(band.cast("int").alias("band"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), v.alias("value")), meta, ["created"])


def grid(spark: SparkSession, height: int, width: int, bands: int = 1) -> DataFrame:
    """band, row, col of every cell, made in parallel."""
    i = F.col("id")
    return spark.range(bands * height * width).select(
        (F.floor(i / (height * width)) + 1).cast("int").alias("band"), F.floor((i % (height * width)) / width).cast("int").alias("row"), (i % width).cast("int").alias("col")
    )


def stack_bands(bands: list[Raster], source: Raster | None = None) -> Raster:
    """Single-band rasters as the bands of one; grid metadata come from ``source`` or the first."""
    if not bands:
        raise ValueError("no bands")
    first = bands[0].meta
    for r in bands[1:]:
        same_nodata = r.meta.nodata == first.nodata or (first.nodata is not None and r.meta.nodata is not None and math.isnan(first.nodata) and math.isnan(r.meta.nodata))
        if (r.meta.height, r.meta.width) != (first.height, first.width) or r.meta.dtype != first.dtype or not same_nodata:
            raise ValueError("bands differ in shape, dtype or nodata")
    df = bands[0].df.withColumn("band", F.lit(1))
    for k, r in enumerate(bands[1:], 2):
        df = df.unionByName(r.df.withColumn("band", F.lit(k)))
    base = (source or bands[0]).meta
    return Raster(df, replace(first, band_count=len(bands), affine=base.affine, crs=base.crs, nodata=base.nodata))


def one_band(r: Raster, what: str) -> Raster:
    """Band 1, with a warning if there are more."""
    if r.meta.band_count == 1:
        return r
    warnings.warn(f"{what} uses band 1 of {r.meta.band_count}", UserWarning, stacklevel=3)
    return r.band(1)
