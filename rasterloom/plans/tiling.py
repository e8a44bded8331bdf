"""Tiles: the planner, and Python functions over whole tiles with or without their surroundings."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from enum import Enum
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PIXELS, Raster, RasterMeta, shift_affine


class TilingStrategy(str, Enum):
    WHOLE, TILED = "whole", "tiled"


@dataclass(frozen=True)
class RasterPlan:
    strategy: TilingStrategy
    tile_shape: tuple[int, int] | None = None
    halo: int = 0
    n_tiles: int = 0
    bytes_per_tile: int = 0


def executor_memory_bytes(spark: SparkSession) -> int:
    """Memory of one executor's core, less 15 %."""
    conf = spark.sparkContext.getConf()
    text = conf.get("spark.executor.memory", conf.get("spark.driver.memory", "1g")).lower()
    unit = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}.get(text.rstrip("b")[-1:], 1)
    number = int("".join(x for x in text if x.isdigit()))
    return int(number * unit * 0.85 / int(conf.get("spark.executor.cores", "1")))


def max_bands_for_budget(meta: RasterMeta, budget: int, buffers: int = 2, scratch: int = 0) -> int:
    """Bands whose ``buffers`` fit beside the scratch bytes, one at least."""
    size = meta.pixel_count * np.dtype(meta.dtype).itemsize * buffers
    return max(1, int(max(0, budget - scratch) // size)) if size > 0 else 1


def analyze_raster_plan(height: int, width: int, bands: int, itemsize: int, budget: int, halo: int = 0, buffers: int = 2, scratch: int = 0) -> RasterPlan:
    """WHOLE (of 0 tiles) if everything fits in 0.7 of the budget or there is no budget; else tiles from 4096 on, multiples
    of 256, halved down to 256."""
    need, most = height * width * bands * itemsize * buffers + scratch, int(0.7 * budget)
    if budget <= 0 or need <= most:
        return RasterPlan(TilingStrategy.WHOLE, None, halo, 0, need if budget > 0 else 0)
    down = lambda n: max(256, n // 256 * 256)
    th, tw = down(min(4096, height)), down(min(4096, width))
    size = lambda: (th + 2 * halo) * (tw + 2 * halo) * bands * itemsize * buffers + scratch
    while size() > most and (th > 256 or tw > 256):
        if th >= tw:
            th = down(th // 2)
        else:
            tw = down(tw // 2)
    return RasterPlan(TilingStrategy.TILED, (th, tw), halo, math.ceil(height / th) * math.ceil(width / tw), size())


def plan_from_metadata(meta: RasterMeta, budget: int, halo: int = 0) -> RasterPlan:
    return analyze_raster_plan(meta.height, meta.width, meta.band_count, np.dtype(meta.dtype).itemsize, budget, halo)


def _shape(plan: RasterPlan, meta: RasterMeta) -> tuple[int, int]:
    if plan.strategy == TilingStrategy.WHOLE:
        return meta.height, meta.width
    if not plan.tile_shape:
        raise ValueError("a tiled plan has a tile shape")
    return plan.tile_shape


def tile_bounds(meta: RasterMeta, shape: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(row, col, height, width) of each tile, row by row."""
    return [(r, c, min(shape[0], meta.height - r), min(shape[1], meta.width - c)) for r in range(0, meta.height, shape[0]) for c in range(0, meta.width, shape[1])]


def with_tiles(df: DataFrame, shape: tuple[int, int], halo: int = 0) -> DataFrame:
    """trow, tcol; with a halo a cell also goes to the tiles that it surrounds (at most three each way)."""
    th, tw = shape
    if not halo:
        return df.withColumns({"trow": F.floor(F.col("row") / th).cast("int"), "tcol": F.floor(F.col("col") / tw).cast("int")})
    span = lambda x, n: F.sequence(F.floor((F.col(x) - halo) / n).cast("int"), F.floor((F.col(x) + halo) / n).cast("int"))
    return df.withColumn("trow", F.explode(span("row", th))).withColumn("tcol", F.explode(span("col", tw)))


def _array(pdf: pd.DataFrame, column: str, r0: int, c0: int, h: int, w: int) -> np.ndarray:
    out = np.full((h, w), np.nan)
    out[pdf["row"] - r0, pdf["col"] - c0] = pdf[column].to_numpy(float)
    return out


def dispatch_tiled(r: Raster, fn: Callable[[np.ndarray, RasterMeta], np.ndarray], plan: RasterPlan) -> Raster:
    """``fn`` maps a tile's array (NaN is nodata) and metadata to an array of the same shape; the plan's halo is given
    around the tile and cut off after. The result doesn't depend on the tiles if the halo is wide enough."""
    m, halo = r.meta, plan.halo
    th, tw = _shape(plan, m)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, tr, tc = (int(k) for k in key)
        r0, c0 = max(0, tr * th - halo), max(0, tc * tw - halo)
        h, w = min(m.height, (tr + 1) * th + halo) - r0, min(m.width, (tc + 1) * tw + halo) - c0
        out = np.asarray(fn(_array(pdf, "value", r0, c0, h, w), replace(m, height=h, width=w, band_count=1, affine=shift_affine(m.affine, r0, c0))), dtype=float)
        if out.shape != (h, w):
            raise ValueError("a tile's shape must stay")
        rows, cols = np.mgrid[tr * th : min(m.height, (tr + 1) * th), tc * tw : min(m.width, (tc + 1) * tw)]
        return pd.DataFrame({"band": band, "row": rows.ravel(), "col": cols.ravel(), "value": out[rows - r0, cols - c0].ravel()})

    df = with_tiles(r.df, (th, tw), halo).where((F.col("trow") >= 0) & (F.col("tcol") >= 0) & (F.col("trow") * th < m.height) & (F.col("tcol") * tw < m.width))
    df = df.groupBy("band", "trow", "tcol").applyInPandas(run, PIXELS)
    return r.derive(df.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))))


def dispatch_tiled_halo(r: Raster, fn, plan: RasterPlan, halo: int) -> Raster:
    return dispatch_tiled(r, fn, replace(plan, halo=halo))


def dispatch_tiled_binary(a: Raster, b: Raster, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], plan: RasterPlan) -> Raster:
    """``fn`` over the tiles of two rasters of one shape."""
    if (a.meta.height, a.meta.width, a.meta.band_count) != (b.meta.height, b.meta.width, b.meta.band_count):
        raise ValueError("the rasters differ in shape")
    th, tw = _shape(plan, a.meta)
    m = a.meta

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, tr, tc = (int(k) for k in key)
        h, w = min(m.height, (tr + 1) * th) - tr * th, min(m.width, (tc + 1) * tw) - tc * tw
        out = np.asarray(fn(*(_array(pdf, x, tr * th, tc * tw, h, w) for x in ("x", "y"))), dtype=float)
        rows, cols = np.mgrid[tr * th : tr * th + h, tc * tw : tc * tw + w]
        return pd.DataFrame({"band": band, "row": rows.ravel(), "col": cols.ravel(), "value": out.ravel()})

    both = a.df.withColumnRenamed("value", "x").join(b.df.withColumnRenamed("value", "y"), ["band", "row", "col"])
    df = with_tiles(both, (th, tw)).groupBy("band", "trow", "tcol").applyInPandas(run, PIXELS)
    return a.derive(df.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))))


def dispatch_tiled_accumulator(r: Raster, tile_fn: Callable[[np.ndarray], np.ndarray], merge_fn: Callable[[np.ndarray, np.ndarray], np.ndarray], plan: RasterPlan) -> np.ndarray:
    """A fixed-size vector per tile, merged (associatively) first in each task's partition, then on the driver."""
    th, tw = _shape(plan, r.meta)
    m = r.meta

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, tr, tc = (int(k) for k in key)
        h, w = min(m.height, (tr + 1) * th) - tr * th, min(m.width, (tc + 1) * tw) - tc * tw
        return pd.DataFrame({"part": [np.atleast_1d(np.asarray(tile_fn(_array(pdf, "value", tr * th, tc * tw, h, w)), dtype=float)).tolist()]})

    def merge(batches):
        parts = [np.array(p) for batch in batches for p in batch["part"]]
        if parts:
            yield pd.DataFrame({"part": [reduce(merge_fn, parts).tolist()]})

    parts = with_tiles(r.df, (th, tw)).groupBy("band", "trow", "tcol").applyInPandas(run, "part array<double>").mapInPandas(merge, "part array<double>")
    return reduce(merge_fn, [np.array(x.part) for x in parts.collect()])


def dispatch_tiled_multipass(r: Raster, local_fn, merge_fn: Callable[[Raster, list[tuple[int, int, int, int]]], Raster], plan: RasterPlan) -> Raster:
    """Tiles on their own, then ``merge_fn`` over the whole raster with the tiles' bounds, as DataFrame operations."""
    return merge_fn(dispatch_tiled(r, local_fn, plan), tile_bounds(r.meta, _shape(plan, r.meta)))


def dispatch_per_band(r: Raster, op: Callable[[Raster], Raster]) -> Raster:
    """Operators partition by band already, so one call does all bands; the source's nodata tag stays."""
    out = op(r)
    return out.derive(out.df, nodata=r.meta.nodata)
