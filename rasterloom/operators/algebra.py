"""Local algebra: projections over one grid, an equi-join of two, or of two values of one source a projection again. The four
operations take pixels or tile rows (``tiles``)."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expression import Parser
from ..model import Raster, beside, clean, combined, one_source, result_dtype
from .tiles import TileRaster, check_shapes, tile_apply, tile_binary

Grid = Raster | TileRaster


def pair(a: Raster, b: Raster) -> DataFrame:
    """band, row, col, x, y; a single band meets every band of the other."""
    check_shapes(a.meta, b.meta)
    x, y = a.df.withColumnRenamed("value", "x"), b.df.withColumnRenamed("value", "y")
    if a.meta.band_count == b.meta.band_count:
        return x.join(y, ["band", "row", "col"])
    return x.join(y.drop("band"), ["row", "col"]) if b.meta.band_count == 1 else x.drop("band").join(y, ["row", "col"])


def _binary(a: Grid, b: Grid, f: Callable[[Column, Column], Column], g: np.ufunc, dtype: str | None = None) -> Grid:
    """``f`` of columns, or ``g`` of tiles."""
    nodata = a.meta.nodata if a.meta.nodata is not None else b.meta.nodata
    meta = replace(a.meta, nodata=nodata, band_count=max(a.meta.band_count, b.meta.band_count), dtype=dtype or result_dtype(a.meta, b.meta))
    if isinstance(a, TileRaster) or isinstance(b, TileRaster):
        if not (isinstance(a, TileRaster) and isinstance(b, TileRaster)):
            raise ValueError("one raster is in pixels, the other in tiles")
        return tile_binary(a, b, g, meta)
    check_shapes(a.meta, b.meta)
    if a.meta.band_count == b.meta.band_count and one_source([a, b]):
        return combined([a, b], f, meta)
    return Raster(pair(a, b).select("band", "row", "col", clean(f(F.col("x"), F.col("y"))).alias("value")), meta)


def raster_add(a: Grid, b: Grid) -> Grid:
    return _binary(a, b, lambda x, y: x + y, np.add)


def raster_subtract(a: Grid, b: Grid) -> Grid:
    return _binary(a, b, lambda x, y: x - y, np.subtract)


def raster_multiply(a: Grid, b: Grid) -> Grid:
    return _binary(a, b, lambda x, y: x * y, np.multiply)


def raster_divide(a: Grid, b: Grid) -> Grid:
    """True division; by zero gives nodata. Float32 operands give float32, integers float64."""
    dtype = result_dtype(a.meta, b.meta)
    return _binary(a, b, F.try_divide, np.divide, dtype if np.dtype(dtype).kind == "f" else "float64")


def raster_apply(r: Grid, func: Callable, nodata: float | None = None, vectorised: bool = False, dtype: str = "float64") -> Grid:
    """``func`` maps a Column to a Column; with ``vectorised``, or of tiles, it maps a numpy array, in Arrow batches. Nodata
    stays. The result is tagged with ``dtype``, since nothing is known of what ``func`` returns."""
    if isinstance(r, TileRaster):
        return tile_apply(r, func, replace(r.meta, nodata=r.meta.nodata if nodata is None else nodata, dtype=dtype))
    v = F.col("value")
    if vectorised:
        def run(values: pd.Series) -> pd.Series:
            return pd.Series(func(values.to_numpy()))

        out = F.pandas_udf(run, "double")(F.coalesce(v, F.lit(0.0)))
    else:
        out = func(v)
    return r.with_value(F.when(v.isNotNull(), out), nodata=r.meta.nodata if nodata is None else nodata, dtype=dtype)


def raster_where(condition: Raster, true_value: Raster | float, false_value: Raster | float) -> Raster:
    """Nonzero is true. Nodata of the condition or of the chosen operand is nodata if the condition has a sentinel; if
    not, the operand's sentinel passes as data."""
    operands = {name: v for name, v in (("t", true_value), ("f", false_value)) if isinstance(v, Raster)}
    for v in operands.values():
        if (v.meta.height, v.meta.width) != (condition.meta.height, condition.meta.width):
            raise ValueError("the rasters differ in shape")

    def value(c: Column, *columns: Column) -> Column:
        found, chosen = dict(zip(operands, columns)), []
        for name, v in (("t", true_value), ("f", false_value)):
            as_data = name in found and condition.meta.nodata is None and v.meta.nodata is not None
            chosen.append(F.lit(float(v)) if name not in found else F.coalesce(found[name], F.lit(float(v.meta.nodata))) if as_data else found[name])
        return F.when(c.isNull(), F.lit(None)).when(c != 0, chosen[0]).otherwise(chosen[1]).cast("double")

    rasters = [condition, *operands.values()]
    if all(v.meta.band_count == condition.meta.band_count for v in rasters) and one_source(rasters):
        return combined(rasters, value, replace(condition.meta, dtype="float64"))
    df = condition.df.withColumnRenamed("value", "c")
    for name, v in operands.items():
        on = ["band", "row", "col"] if v.meta.band_count == condition.meta.band_count else ["row", "col"]
        df = df.join(v.df.select(*on, F.col("value").alias(name)), on)
    return condition.derive(df.select("band", "row", "col", value(F.col("c"), *map(F.col, operands)).alias("value")), dtype="float64")


def raster_classify(r: Raster, bins: list[float], labels: list[float]) -> Raster:
    """The label of the number of bins that are <= the value."""
    if len(labels) != len(bins) + 1:
        raise ValueError("there must be one label more than bins")
    v = F.col("value")
    value = F.lit(float(labels[0]))
    for b, label in zip(bins, labels[1:]):  # bins ascend: the last that is reached holds
        value = F.when(v >= float(b), F.lit(float(label))).otherwise(value)
    return r.with_value(F.when(v.isNotNull(), value), dtype="float64")


def raster_expression(expression: str, **rasters: Raster) -> Raster:
    """Arithmetic over variables a to h; ``a[3]`` is a's fourth band. One projection over the joined grids."""
    if not rasters:
        raise ValueError("no rasters")
    used: dict[tuple[str, int], str] = {}

    def variable(name: str, index: int | None) -> Column:
        if name not in rasters:
            raise ValueError(f"undefined variable {name!r}")
        m = rasters[name].meta
        if index is None and m.band_count > 1:
            warnings.warn(f"{name} has {m.band_count} bands, the first is used", UserWarning, stacklevel=2)
        if (index or 0) >= m.band_count:
            raise IndexError(f"{name} has {m.band_count} bands")
        column = used.setdefault((name, index or 0), f"{name}_{index or 0}")
        return F.col(column)

    value = Parser(expression, variable).parse()
    metas = [r.meta for r in rasters.values()]
    if len({(m.height, m.width) for m in metas}) > 1:
        raise ValueError("the rasters differ in shape")
    names = list(dict.fromkeys(n for n, _ in used)) or [next(iter(rasters))]
    base = rasters[sorted(rasters)[0]] if all(i == 0 for _, i in used) else rasters[next(iter(rasters))]
    df = None
    while names:  # variables of one source share its scan, and if it has bands, one grouping
        first = rasters[names[0]]
        group = [n for n in names if rasters[n].meta.band_count == first.meta.band_count and one_source([first, rasters[n]])]
        names = [n for n in names if n not in group]
        part = beside(first.source, [], [rasters[n] for n in group], [f"of_{n}" for n in group])
        mine = {c: (f"of_{n}", i) for (n, i), c in used.items() if n in group}
        if first.meta.band_count == 1:
            part = part.select("row", "col", *(F.col(v).alias(c) for c, (v, _) in mine.items()))
        else:
            part = part.groupBy("row", "col").agg(*(F.max(F.when(F.col("band") == i + 1, F.col(v))).alias(c) for c, (v, i) in mine.items() or {"any": (f"of_{group[0]}", 0)}.items()))
        df = part if df is None else df.join(part, ["row", "col"])
    for c in used.values():
        value = F.when(F.col(c).isNotNull(), value)
    nodata = next((m.nodata for m in metas if m.nodata is not None), None)
    # float32 if no operand needs more; the values are computed in double either way
    t = np.result_type(*(np.dtype(m.dtype) for m in metas))
    dtype = "float64" if t.itemsize > 4 or t.kind in "iu" and t.itemsize == 4 else "float32"
    return Raster(df.select(F.lit(1).alias("band"), "row", "col", clean(value).alias("value")), replace(base.meta, band_count=1, nodata=nodata, dtype=dtype))


def _bands(r: Raster, *bands: int) -> None:
    for b in bands:
        if b < 1:
            raise ValueError("bands count from 1")
        if b > r.meta.band_count:
            raise IndexError(f"band {b} of {r.meta.band_count}")


def raster_ndvi(r: Raster, nir_band: int = 4, red_band: int = 3) -> Raster:
    _bands(r, nir_band, red_band)
    n, d = nir_band - 1, red_band - 1
    return raster_expression(f"(a[{n}]-a[{d}])/(a[{n}]+a[{d}])", a=r)


def raster_band_ratio(r: Raster, band_a: int, band_b: int) -> Raster:
    _bands(r, band_a, band_b)
    return raster_expression(f"a[{band_a - 1}]/a[{band_b - 1}]", a=r)


def raster_band_math(r: Raster, expression: str) -> Raster:
    """An expression over ``b``, the raster: ``b[0] + b[1]``."""
    if not expression.strip():
        raise ValueError("empty expression")
    return raster_expression(expression, b=r)
