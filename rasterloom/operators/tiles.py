"""Tile rows: the second layout of a raster, one row a tile.

A row holds band, trow, tcol and data: the tile's cells row by row as little-endian doubles, NaN is nodata; tiles at the
grid's end are smaller. Algebra works on whole Arrow batches of tiles: one numpy operation over the batch's bytes. Tables of
tiles are bucketed by tile (``sources.tile_tables``), so that two rasters of one tiling meet without an exchange. A
tile that has no row is outside of the raster, as an absent pixel is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PIXELS, Raster, RasterMeta
from ..plans.tiling import with_tiles

TILES = "band int, trow int, tcol int, data binary"


@dataclass
class TileRaster:
    """A function of the cells of one or several frames of tile rows (``parts``, each with its number of bands), and
    metadata. Algebra joins functions, not frames: a chain of operations over some tables joins each of them once, where
    they lie, and passes their tiles through Python once."""

    parts: list[tuple[DataFrame, int]]
    meta: RasterMeta
    tile: tuple[int, int] = (256, 256)
    cells: Callable[[list[np.ndarray]], np.ndarray] | None = None  # none: the only part's own
    events: list[str] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        """band, trow, tcol, data."""
        most, names = max(n for _, n in self.parts), [f"data_{k}" for k in range(len(self.parts))]
        if self.cells is None:
            return self.parts[0][0].select("band", "trow", "tcol", "data")
        joined = None
        for name, (df, bands) in sorted(zip(names, self.parts), key=lambda x: -x[1][1]):  # a single band meets every band
            keys = ["band", "trow", "tcol"] if bands == most else ["trow", "tcol"]
            part = df.select(*keys, F.col("data").alias(name))
            joined = part if joined is None else joined.join(part, keys)
        f = self.cells

        def run(*columns: pa.Array) -> pa.Array:
            at = _cells(columns[0])[0]
            with np.errstate(all="ignore"):
                return _as_tiles(at, f([_cells(c)[1] for c in columns]))

        return joined.select("band", "trow", "tcol", F.arrow_udf(run, "binary")(*names).alias("data"))

    @property
    def value(self) -> Callable[[list[np.ndarray]], np.ndarray]:
        return self.cells or (lambda cells: cells[0])


def check_shapes(a: RasterMeta, b: RasterMeta) -> None:
    if (a.height, a.width) != (b.height, b.width):
        raise ValueError("the rasters differ in shape")
    if a.band_count != b.band_count and 1 not in (a.band_count, b.band_count):
        raise ValueError("the rasters differ in their number of bands")


def to_tiles(r: Raster, tile: tuple[int, int] = (256, 256)) -> TileRaster:
    """Pixels as tile rows: one shuffle."""
    m, (th, tw) = r.meta, tile

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, tr, tc = (int(k) for k in key)
        cells = np.full((min(th, m.height - tr * th), min(tw, m.width - tc * tw)), np.nan)
        cells[pdf["row"] - tr * th, pdf["col"] - tc * tw] = pdf["value"].to_numpy(float)
        return pd.DataFrame({"band": [band], "trow": [tr], "tcol": [tc], "data": [cells.astype("<f8").tobytes()]})

    rows = with_tiles(r.df, tile).groupBy("band", "trow", "tcol").applyInPandas(run, TILES)
    return TileRaster([(rows, m.band_count)], m, tile, events=[*r.events])


def to_pixels(t: TileRaster) -> Raster:
    """Tile rows as pixels: no shuffle."""
    m, (th, tw) = t.meta, t.tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, tr, tc, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                values = np.frombuffer(data, "<f8")
                w = min(tw, m.width - tc * tw)
                row, col = np.divmod(np.arange(len(values)), w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), band, np.int32)), pa.array((row + tr * th).astype(np.int32)), pa.array((col + tc * tw).astype(np.int32)), pa.array(values, mask=np.isnan(values))],
                    ["band", "row", "col", "value"],
                )

    return Raster(t.df.select("band", "trow", "tcol", "data").mapInArrow(run, PIXELS), m, [*t.events])


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a batch's tiles, and all their cells one after the other."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return at - at[0], np.frombuffer(data, "<f8", (at[-1] - at[0]) // 8, at[0]) if len(column) and at[-1] > at[0] else np.empty(0)


def _as_tiles(at: np.ndarray, cells: np.ndarray) -> pa.Array:
    cells = np.where(np.isfinite(cells), cells, np.nan).astype("<f8")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(cells)])


def tile_binary(a: TileRaster, b: TileRaster, f: Callable[[np.ndarray, np.ndarray], np.ndarray], meta: RasterMeta) -> TileRaster:
    """``f`` of two rasters of one tiling; a single band meets every band of the other. A frame that both use is used once."""
    check_shapes(a.meta, b.meta)
    if a.tile != b.tile:
        raise ValueError("the rasters differ in their tiles")
    parts, places = [*a.parts], []
    for df, bands in b.parts:
        known = next((k for k, (other, _) in enumerate(parts) if df is other or df.sameSemantics(other)), len(parts))
        parts += [(df, bands)] if known == len(parts) else []
        places.append(known)
    n, left, right = len(a.parts), a.value, b.value

    def cells(of: list[np.ndarray]) -> np.ndarray:
        out = f(left(of[:n]), right([of[k] for k in places]))
        return np.where(np.isfinite(out), out, np.nan)

    return TileRaster(parts, meta, a.tile, cells)


def tile_apply(t: TileRaster, f: Callable[[np.ndarray], np.ndarray], meta: RasterMeta) -> TileRaster:
    """``f`` of the cells of many tiles at once; nodata stays."""
    value = t.value

    def cells(of: list[np.ndarray]) -> np.ndarray:
        x = value(of)
        y = f(x)
        return np.where(np.isfinite(x) & np.isfinite(y), y, np.nan)

    return TileRaster(t.parts, meta, t.tile, cells, [*t.events])


def summary(t: TileRaster) -> DataFrame:
    """band, n, total, least, most: partial results a tile, combined by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(b, c[~np.isnan(c)]) for b, c in zip(batch.column(0).to_pylist(), (np.frombuffer(d, "<f8") for d in batch.column(1).to_pylist()))]
            parts = [(b, c) for b, c in parts if len(c)]
            yield pa.RecordBatch.from_pydict({"band": pa.array([b for b, _ in parts], pa.int32()), "n": pa.array([len(c) for _, c in parts], pa.int64()), "total": pa.array([c.sum() for _, c in parts], pa.float64()), "least": pa.array([c.min() for _, c in parts], pa.float64()), "most": pa.array([c.max() for _, c in parts], pa.float64())})

    each = t.df.select("band", "data").mapInArrow(run, "band int, n long, total double, least double, most double")
    return each.groupBy("band").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
