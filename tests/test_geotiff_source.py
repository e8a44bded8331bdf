"""GeoTIFF as a data source: ranges that are read, planned partitions, pushed filters, writes by several tasks."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from rasterloom.model import Raster, RasterMeta, RasterWindow, from_numpy, stack_bands
from rasterloom.sources import geotiff, io

from test_files import tiff


def big_file(path, side=20_480, tile=256, value=7.5):
    """A BigTIFF of 3.4 GB, all but one of its tiles a hole of the disk; the tables of places stand at its end."""
    n, size = (side // tile) ** 2, tile * tile * 8
    first, tables = 4096, 4096 + n * size
    tags = [(256, 4, side), (257, 4, side), (258, 3, 64), (259, 3, 1), (277, 3, 1), (322, 4, tile), (323, 4, tile), (324, 16, tables), (325, 16, tables + 8 * n), (339, 3, 3)]
    ifd = struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, k, n if t in (324, 325) else 1, v) for t, k, v in tags) + bytes(8)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + ifd)
        f.seek(first + (n - 2) * size)
        f.write(np.full((tile, tile), value).tobytes())
        f.seek(tables)
        f.write(struct.pack(f"<{n}Q", *(first + k * size for k in range(n))) + struct.pack(f"<{n}Q", *(size,) * n))
    return side, tile


def test_large_file_is_read_by_ranges(spark, tmp_path):
    path = str(tmp_path / "big.tif")
    side, tile = big_file(path)
    assert os.path.getsize(path) > 3 << 30
    f = geotiff.opened(path)
    meta, layout, tags = geotiff.header(f, None)
    assert (meta.height, meta.width, meta.dtype) == (side, side, "float64") and f.fetched < 1 << 20
    # a window across two tiles of the last row reads these
    w = RasterWindow(side - 2 * tile + 250, side - 3, 10, 2)
    parts = geotiff.planned(layout, w, None, 1 << 22)
    f = geotiff.opened(path)
    got = [b for p in parts for b in geotiff.blocks_of(f, tags, layout, p)]
    assert [b[:3] for b in got] == [(0, 79, 78), (0, 79, 79)] and f.fetched < 2 * tile * tile * 8 + (1 << 20)
    assert io.read_raster(spark, path, window=w).to_numpy().tolist() == [[7.5] * 6 + [0.0] * 4] * 2


def test_filters_are_pushed(spark, tmp_path):
    cube = np.random.default_rng(3).integers(0, 200, (3, 70, 90)).astype(np.int16)
    path = str(tmp_path / "a.tif")
    open(path, "wb").write(tiff([cube], tile=(16, 16), planar=2))
    reader = geotiff.TiffReader({"path": path, "cells": "256"})
    assert len(reader.partitions()) == 3 * 5 * 6
    kept = list(reader.pushFilters([GreaterThan(("row",), 31), LessThanOrEqual(("row",), 33), EqualTo(("col",), 20), In(("band",), (1, 3))]))
    assert len(kept) == 4 and reader.partitions() == [geotiff.Part(p, 2, 3, 1, 2) for p in (0, 2)]
    r = io.read_raster(spark, path)
    df = r.df.where("row between 32 and 33 and col = 20 and band = 3")
    assert sorted((x.band, x.row, x.col, x.value) for x in df.collect()) == [(3, 32, 20, cube[2, 32, 20]), (3, 33, 20, cube[2, 33, 20])]
    assert r.df.where("row > 500").count() == 0 and r.df.where("band = 9").count() == 0
    # a window of the raster is a filter, and reaches the planning
    assert (r.window(RasterWindow(5, 6, 30, 20)).to_numpy() == cube[:, 6:26, 5:35]).all()
    assert r.df.where("row < 16").rdd.getNumPartitions() <= r.df.rdd.getNumPartitions()


def test_partitions_cover_everything():
    for rows, cols, cells in ((16, 16, 1), (16, 16, 600), (16, 16, 3000), (7, 90, 10_000), (16, 16, 10**9)):
        m = geotiff.Layout("<", "uint8", 70, 90, 2, 2, rows, cols, 1, 1)
        down, across = m.grid
        seen = [(p.plane, r, c) for p in geotiff.planned(m, None, None, cells) for r in range(p.r0, p.r1) for c in range(p.c0, p.c1)]
        assert sorted(seen) == [(p, r, c) for p in range(2) for r in range(down) for c in range(across)] and len(set(seen)) == len(seen)


def test_many_images_small_samples_and_holes(spark, tmp_path):
    one = np.arange(12, dtype=np.uint8).reshape(1, 3, 4)
    raw = tiff([one] * 70)
    assert len(geotiff.directories(raw)[1]) == 70 and len(geotiff.images(raw)[1]) == 70
    loop = bytearray(tiff([one]))
    first = struct.unpack_from("<I", loop, 4)[0]
    count = struct.unpack_from("<H", loop, first)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * count, first)
    with pytest.raises(ValueError, match="loop"):
        geotiff.directories(bytes(loop))
    bits = np.random.default_rng(0).integers(0, 2, (5, 13)).astype(np.uint8)
    for n in (1, 2, 4):
        values = bits * (2**n - 1)
        packed = np.packbits(np.unpackbits(values[..., None], axis=2)[:, :, 8 - n :].reshape(5, -1), axis=1).tobytes()
        m = geotiff.layout_of("<", {256: (13,), 257: (5,), 258: (n,)})
        assert (geotiff.decode_block(packed, m)[..., 0] == values).all() and m.dtype == "uint8"
    with pytest.raises(ValueError, match="bits"):
        geotiff.layout_of("<", {256: (13,), 257: (5,), 258: (12,)})
    # a tile of which no cell has a row isn't in the file, and reads as nodata
    x = np.arange(400.0 * 300).reshape(400, 300)
    r = from_numpy(spark, x, nodata=-1.0)
    half = Raster(r.df.where("row >= 256"), r.meta)
    path = str(tmp_path / "half.tif")
    io.write_raster(path, half)
    back = io.read_raster(spark, path).to_numpy()
    assert (back[256:] == x[256:]).all() and (back[:256] == -1).all() and os.path.getsize(path) < x.nbytes


@pytest.mark.parametrize("shape", [(1, 40, 50), (2, 700, 530)])
def test_several_tasks_write_one_file(spark, tmp_path, shape):
    x = np.random.default_rng(1).integers(0, 60_000, shape).astype(np.uint16)
    r = stack_bands([from_numpy(spark, p) for p in x])
    path = str(tmp_path / "a.tif")
    tiles = geotiff.encoded(r, True, 256).collect()
    runs = {}
    for t in sorted(tiles, key=lambda t: (t.run, t.within)):
        assert t.within == runs.get(t.run, 0) and t.size == len(t.data)
        runs[t.run] = t.within + t.size
    assert len(tiles) == shape[0] * -(-shape[1] // 256) * -(-shape[2] // 256)
    for _ in range(2):  # the second replaces the first
        io.write_raster(path, r)
        assert (io.read_raster(spark, path).to_numpy() == x.squeeze()).all()
    assert os.listdir(tmp_path) == ["a.tif"]


def test_failed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    good = from_numpy(spark, np.ones((300, 300)))
    bad = Raster(good.df.withColumn("value", F.when((F.col("row") == 280) & (F.col("col") == 280), F.raise_error(F.lit("no"))).otherwise(F.col("value"))), RasterMeta(300, 300))
    with pytest.raises(Exception):
        io.write_raster(str(tmp_path / "bad.tif"), bad)
    assert os.listdir(tmp_path) == []
    # a task of the last step fails
    geotiff.register(spark)
    rows = spark.range(4).select(F.col("id").alias("k"), F.lit(100).cast("long").alias("at"), F.when(F.col("id") == 3, F.raise_error(F.lit("no")).cast("binary")).otherwise(F.lit(b"x")).alias("data"))
    temp = str(tmp_path / "x.part")
    open(temp, "wb").close()
    with pytest.raises(Exception):
        rows.write.format("geotiff").mode("append").options(temp=temp, places=8, sizes=50, code="I").save(str(tmp_path / "x.tif"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError, match="store"):
        io.write_raster("s3://bucket/a.tif", good)
