"""Resampling to another grid. Nearest cells by one equi-join with the source's pixels; for taps, tiles of the target ask for the
tiles of the source that they need, and are computed from these in numpy."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PIXELS, Affine, GridSpec, Raster, compose_affine, grid, invert_affine
from .tiles import to_tiles

_SOURCE = 256


def _cubic(t: np.ndarray, k: int) -> np.ndarray:
    """Catmull-Rom weight (a = -0.5) of the tap at offset k from the cell below."""
    x = np.abs(t - k)
    near = 1.5 * x * x * x - 2.5 * x * x + 1
    far = -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


_TAPS = {"bilinear": ([0, 1], lambda t, k: t if k else 1 - t), "bicubic": ([-1, 0, 1, 2], _cubic)}


def target_side(to_source: Affine) -> int:
    """Cells along a target tile: as many as four source tiles reach, one at least."""
    a, b, _, d, e, _ = to_source
    return int(min(256, max(1, 4 * _SOURCE // max(1e-9, abs(a) + abs(b), abs(d) + abs(e)))))


def asked(r: Raster, target: GridSpec, to_source: Affine, side: int, low: int, high: int) -> DataFrame:
    """band, tile (of the target, row by row), trow, tcol (of the source; null if the tile needs none): what a tile's corners span,
    with the taps' offsets from ``low`` to ``high``."""
    a, b, c, d, e, f = to_source
    down, across = -(-target.height // side), -(-target.width // side)
    tiles = r.df.sparkSession.range(r.meta.band_count * down * across).select((F.floor(F.col("id") / (down * across)) + 1).cast("int").alias("band"), (F.col("id") % (down * across)).alias("tile"))
    y0, x0 = F.floor(F.col("tile") / across) * side, F.col("tile") % across * side
    y1, x1 = F.least(y0 + side, F.lit(target.height)), F.least(x0 + side, F.lit(target.width))
    sx, sy = ([x * p + y * q + o for x in (x0 + 0.5, x1 - 0.5) for y in (y0 + 0.5, y1 - 0.5)] for p, q, o in ((a, b, c - 0.5), (d, e, f - 0.5)))

    def span(at: list, n: int):
        first, last = F.floor(F.least(*at)) + low, F.floor(F.greatest(*at)) + high
        inside = (last >= 0) & (first <= n - 1)
        of = lambda v: F.floor(F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)) / _SOURCE).cast("int")
        return F.when(inside, F.sequence(of(first), of(last)))

    rows = tiles.withColumns({"rows": span(sy, r.meta.height), "cols": span(sx, r.meta.width)})
    return rows.select("band", "tile", F.explode_outer("rows").alias("trow"), "cols").select("band", "tile", "trow", F.explode_outer("cols").alias("tcol"))


def _gathered(r: Raster, target: GridSpec, method: str) -> DataFrame:
    """band, row, col, value: null where a tap is missing."""
    m, (taps, weight) = r.meta, _TAPS[method]
    to_source = compose_affine(invert_affine(m.affine), target.affine)
    side = target_side(to_source)
    a, b, c, d, e, f = to_source
    across = -(-target.width // side)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, tile = (int(k) for k in key)
        tr, tc = divmod(tile, across)
        row, col = np.mgrid[tr * side : min((tr + 1) * side, target.height), tc * side : min((tc + 1) * side, target.width)]
        x, y = col + 0.5, row + 0.5
        sx, sy = x * a + y * b + c - 0.5, x * d + y * e + f - 0.5
        x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
        held = pdf[pdf["data"].notna()]
        value = np.full(row.shape, np.nan)
        if len(held):
            top, left = int(held["trow"].min()) * _SOURCE, int(held["tcol"].min()) * _SOURCE
            source = np.full(((int(held["trow"].max()) + 1) * _SOURCE - top, (int(held["tcol"].max()) + 1) * _SOURCE - left), np.nan)
            for sr, sc, data in zip(held["trow"], held["tcol"], held["data"]):
                h, w = min(_SOURCE, m.height - sr * _SOURCE), min(_SOURCE, m.width - sc * _SOURCE)
                source[sr * _SOURCE - top : sr * _SOURCE - top + h, sc * _SOURCE - left : sc * _SOURCE - left + w] = np.frombuffer(data, "<f8").reshape(h, w)
            value = np.zeros(row.shape)
            for i in taps:
                for j in taps:
                    at = y0 + i - top, x0 + j - left
                    inside = (at[0] >= 0) & (at[0] < source.shape[0]) & (at[1] >= 0) & (at[1] < source.shape[1])
                    tap = np.where(inside, source[np.where(inside, at[0], 0), np.where(inside, at[1], 0)], np.nan)
                    value += tap * (weight(sy - y0, i) * weight(sx - x0, j))
        return pd.DataFrame({"band": band, "row": row.ravel(), "col": col.ravel(), "value": value.ravel()})

    tiles = to_tiles(r, (_SOURCE, _SOURCE)).df
    rows = asked(r, target, to_source, side, min(taps), max(taps)).join(tiles, ["band", "trow", "tcol"], "left")
    got = rows.groupBy("band", "tile").applyInPandas(run, PIXELS)
    return got.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def _nearest(r: Raster, target: GridSpec) -> DataFrame:
    m = r.meta
    a, b, c, d, e, f = compose_affine(invert_affine(m.affine), target.affine)
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    cells = grid(r.df.sparkSession, target.height, target.width, m.band_count)
    at = cells.withColumns({"sr": F.floor(x * d + y * e + f).cast("int"), "sc": F.floor(x * a + y * b + c).cast("int")})
    return at.join(r.df.select("band", F.col("row").alias("sr"), F.col("col").alias("sc"), "value"), ["band", "sr", "sc"], "left").select("band", "row", "col", "value")


def raster_resample(r: Raster, target: GridSpec, method: str = "bilinear") -> Raster:
    """nearest, bilinear or bicubic; cells that lack a tap (outside or nodata) get nodata, or 0 without a sentinel."""
    if method != "nearest" and method not in _TAPS:
        raise ValueError(f"unknown method {method!r}")
    m = r.meta
    got = _nearest(r, target) if method == "nearest" else _gathered(r, target, method)
    if m.dtype.startswith(("int", "uint")):
        bits, low = int(m.dtype.split("int")[1]), m.dtype.startswith("int")
        lo, hi = (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if low else (0, 2**bits - 1)
        within = F.least(F.greatest(F.rint("value"), F.lit(float(lo))), F.lit(float(hi)))
        got = got.withColumn("value", F.when(F.col("value").isNotNull(), within))
    if m.nodata is None:
        got = got.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return Raster(got, replace(m, height=target.height, width=target.width, affine=target.affine))
