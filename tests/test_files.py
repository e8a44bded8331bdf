"""GeoTIFF variants against a writer of this test's own, windows, overviews, file-to-file processing, dtypes, planner."""

import struct
import warnings
import zlib

import numpy as np
import pytest

from rasterloom.model import PolygonizeSpec, RasterWindow, from_numpy, stack_bands
from rasterloom.operators import algebra as A
from rasterloom.operators import focal as N
from rasterloom.operators import vector as V
from rasterloom.plans import tiling as T
from rasterloom.sources import geotiff, io


def pack_lzw(data):
    out, table, code, width, held, bits = bytearray(), {}, b"", 9, 0, 0

    def put(n):
        nonlocal held, bits
        bits, held = (bits << width) | n, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    def reset():
        nonlocal table, width
        table, width = {bytes([k]): k for k in range(256)}, 9

    reset()
    put(256)
    for byte in data:
        if code + bytes([byte]) in table:
            code += bytes([byte])
            continue
        put(table[code])
        table[code + bytes([byte])] = len(table) + 2
        width = 9 if len(table) + 2 < 512 else 10 if len(table) + 2 < 1024 else 11 if len(table) + 2 < 2048 else 12
        if len(table) + 2 >= 4094:
            put(256)
            reset()
        code = bytes([byte])
    put(table[code])
    put(257)
    out.append(bits << (8 - held) & 255)
    return bytes(out)


def tiff(images, codec=1, predictor=1, planar=1, tile=None, big=False, order="<"):
    """Bytes of a TIFF of (bands, rows, cols) cubes: the first is the full image, the others its overviews."""
    number, inline, head = ("Q", 8, "HHQ") if big else ("I", 4, "HHI")
    body = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for k, cube in enumerate(images):
        b, h, w = cube.shape
        th, tw = tile or (7, w)
        at, size = [], []
        for plane in cube[:, None] if planar == 2 else [cube]:
            for r in range(0, h, th):
                for c in range(0, w, tw):
                    part = plane[:, r : r + th, c : c + tw]
                    block = np.zeros((th if tile else part.shape[1], tw, len(part)), cube.dtype)
                    block[: part.shape[1], : part.shape[2]] = part.transpose(1, 2, 0)
                    if predictor == 2:
                        block[:, 1:] -= block[:, :-1].copy()
                    raw = block.astype(cube.dtype.newbyteorder(order)).tobytes()
                    if predictor == 3:
                        rows = block.astype(cube.dtype.newbyteorder(">")).view(np.uint8).reshape(len(block), tw * len(part), cube.itemsize).transpose(0, 2, 1).reshape(len(block), -1, len(part))
                        rows[:, 1:] -= rows[:, :-1].copy()
                        raw = rows.tobytes()
                    raw = {1: bytes, 5: pack_lzw, 8: zlib.compress}[codec](raw)
                    at.append(len(body))
                    size.append(len(raw))
                    body += raw
        n, place = len(at), 16 if big else 4
        tags = [(254, 4, (int(k > 0),)), (256, 4, (w,)), (257, 4, (h,)), (258, 3, (cube.itemsize * 8,) * b), (259, 3, (codec,)), (277, 3, (b,)), (284, 3, (planar,)), (317, 3, (predictor,)), (339, 3, ({"u": 1, "i": 2, "f": 3}[cube.dtype.kind],) * b)]
        tags += [(322, 4, (tw,)), (323, 4, (th,)), (324, place, at), (325, place, size)] if tile else [(273, place, at), (278, 4, (th,)), (279, place, size)]
        if k == 0:
            tags += [(33550, 12, (2.0, 2.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 100.0, 200.0, 0.0))]
        body += b"\0" * (len(body) % 2)
        body[link : link + inline] = struct.pack(order + number, len(body))
        extra = len(body) + (8 if big else 2) + (20 if big else 12) * len(tags) + inline
        ifd, more = struct.pack(order + ("Q" if big else "H"), len(tags)), b""
        for tag, kind, values in sorted(tags):
            data = struct.pack(order + {3: "H", 4: "I", 12: "d", 16: "Q"}[kind] * len(values), *values)
            ifd += struct.pack(order + head, tag, kind, len(values)) + (data.ljust(inline, b"\0") if len(data) <= inline else struct.pack(order + number, extra + len(more)))
            more += data if len(data) > inline else b""
        link = len(body) + len(ifd)
        body += ifd + b"\0" * inline + more
    return bytes(body)


CUBE = np.random.default_rng(3).integers(0, 200, (2, 30, 41))
VARIANTS = [
    dict(dtype="uint8"), dict(dtype="int16", codec=8, predictor=2, tile=(16, 16)), dict(dtype="float32", codec=5, predictor=3, tile=(16, 16), planar=2),
    dict(dtype="float64", codec=8, predictor=3), dict(dtype="uint16", codec=5, predictor=2, order=">"), dict(dtype="int32", big=True, tile=(16, 32), codec=8), dict(dtype="float32", codec=5, big=True, planar=2),
]


@pytest.mark.parametrize("how", VARIANTS, ids=str)
def test_tiff_blocks(how):
    how = dict(how)
    cube = (CUBE * (1.25 if how["dtype"].startswith("f") else 1)).astype(how.pop("dtype"))
    raw = tiff([cube], **how)
    order, found = geotiff.images(raw)
    m = geotiff.layout_of(order, found[0])
    out = np.zeros((2, 64, 64), cube.dtype)
    for plane, r, c, data in geotiff.blocks(raw, found[0], m, None, None):
        block = geotiff.decode_block(data, m)
        at = slice(plane, plane + 1) if m.planes > 1 else slice(None)
        part = block.transpose(2, 0, 1)[:, : 64 - r * m.rows, : 64 - c * m.cols]
        out[at, r * m.rows : r * m.rows + part.shape[1], c * m.cols : c * m.cols + part.shape[2]] = part
    assert (out[:, :30, :41] == cube).all() and geotiff.tiff_metadata(raw).affine == (2.0, 0.0, 100.0, 0.0, -2.0, 200.0)


def test_tiff_reads(spark, tmp_path):
    cube = CUBE.astype(np.float32)
    (tmp_path / "a.tif").write_bytes(tiff([cube, cube[:, ::2, ::2][:, :15, :20]], codec=5, predictor=3, tile=(16, 16), planar=2))
    path = str(tmp_path / "a.tif")
    assert (io.read_raster(spark, path).to_numpy() == cube).all() and io.read_raster_metadata(spark, path).band_count == 2
    w = io.read_raster(spark, path, bands=[2], window=RasterWindow(10, 12, 9, 8))
    assert (w.to_numpy() == cube[1, 12:20, 10:19]).all() and w.meta.affine == (2.0, 0.0, 120.0, 0.0, -2.0, 176.0)
    small = io.read_raster(spark, path, overview=0)
    assert (small.to_numpy() == cube[:, ::2, ::2][:, :15, :20]).all() and small.meta.affine[0] == 2.0 * 41 / 20
    with pytest.raises(Exception, match="overviews"):
        io.read_raster(spark, path, overview=1)
    raw = tiff([cube], tile=(16, 16))
    order, found = geotiff.images(raw)
    m = geotiff.layout_of(order, found[0])
    assert len(list(geotiff.blocks(raw, found[0], m, RasterWindow(0, 0, 4, 4), None))) == 1  # of six


def test_write_and_process(spark, tmp_path):
    x = np.random.default_rng(1).random((2, 300, 270)).astype(np.float32)
    x[0, 5, 7] = -9999
    r = stack_bands([from_numpy(spark, p, nodata=-9999.0, affine=(10, 0, 5, 0, -10, 9), crs="EPSG:32610") for p in x])
    io.write_raster(str(tmp_path / "a.tif"), r)
    back = io.read_raster(spark, str(tmp_path / "a.tif"))
    assert (back.to_numpy() == x).all() and back.meta.affine == r.meta.affine and back.meta.crs == "EPSG:32610" and back.meta.dtype == "float32"
    assert any("read" in e for e in back.report()) and any("materialised" in e for e in back.report())
    tiled, whole = T.RasterPlan(T.TilingStrategy.TILED, (64, 100)), T.RasterPlan(T.TilingStrategy.WHOLE)
    box = lambda a, m: np.nanmax([np.roll(np.pad(a, 1, constant_values=np.nan), (i, j), (0, 1))[1:-1, 1:-1] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    got = []
    for name, plan in (("b.tif", tiled), ("c.tif", whole), ("table", tiled)):
        meta = io.process_raster(spark, str(tmp_path / "a.tif"), str(tmp_path / name), box, plan, halo=1)
        got.append(io.read_raster(spark, str(tmp_path / name)).to_numpy())
        assert meta.dtype == "float32" and meta.nodata == -9999.0
    assert (got[0] == got[1]).all() and (got[0] == got[2]).all() and got[0][0, 5, 7] == x[0, 4:7, 6:9].max()
    io.process_raster(spark, str(tmp_path / "a.tif"), str(tmp_path / "d.tif"), N.raster_focal_max)
    assert (io.read_raster(spark, str(tmp_path / "d.tif")).to_numpy()[1] == got[0][1]).all()
    with pytest.raises(ValueError):
        io.process_raster(spark, str(tmp_path / "a.tif"), str(tmp_path / "e.tif"), box, T.RasterPlan(T.TilingStrategy.TILED))


def test_window_of_other_blocks(spark, tmp_path):
    x = np.arange(2000.0).reshape(50, 40)
    io.write_raster(str(tmp_path / "t"), from_numpy(spark, x), block=16)
    got = io.read_raster(spark, str(tmp_path / "t"), window=RasterWindow(3, 20, 4, 20))
    assert (got.to_numpy() == x[20:40, 3:7]).all()


def test_result_dtypes(spark):
    i16, f, u8 = from_numpy(spark, np.array([[1, 2]], np.int16)), from_numpy(spark, np.array([[0.5, 0.5]])), from_numpy(spark, np.array([[200, 100]], np.uint8))
    assert A.raster_add(i16, f).to_numpy().tolist() == [[1.5, 2.5]] and A.raster_add(i16, f).meta.dtype == "float64"
    assert A.raster_add(u8, u8).to_numpy().tolist() == [[400, 200]] and A.raster_subtract(i16, u8).to_numpy().tolist() == [[-199, -98]]
    assert np.allclose(A.raster_apply(i16, lambda v: v / 4).to_numpy(), [[0.25, 0.5]])
    f32 = from_numpy(spark, np.array([[3.0, 2.0]], np.float32))
    assert A.raster_divide(f32, f32).meta.dtype == "float32" and A.raster_divide(i16, i16).meta.dtype == "float64"
    assert [A.raster_expression("a + 1", a=r).meta.dtype for r in (f32, i16, f)] == ["float32", "float32", "float64"]


def test_polygon_limit_and_rings(spark):
    x = np.arange(9.0).reshape(3, 3)
    with pytest.warns(UserWarning, match="Polygon explosion"):
        assert V.polygonize(from_numpy(spark, x), PolygonizeSpec(max_polygons=2)).count() == 2
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = V.polygonize_table(from_numpy(spark, x, crs="EPSG:4326"))
        assert got.count() == 9 and got.first().crs == "EPSG:4326"
    big = np.zeros((40, 300))
    big[10:20, 20:280] = 1
    big[12:14, 200:210] = 0
    rows = sorted((r.value, r.n_cells, r.n_rings, r.area) for r in V.polygonize(from_numpy(spark, big)).collect())
    assert rows == [(0.0, 20, 1, 20.0), (0.0, 40 * 300 - 2600, 2, 9400.0), (1.0, 2580, 2, 2580.0)]
    one = np.zeros((7, 9))
    one[2:5, 2:5] = one[2:4, 6:8] = 1
    rings = sorted((r.n_points, r.closed, round(r.length, 6)) for r in V.contour_rings(from_numpy(spark, one), 1.0).collect())
    # corners are cut: a block of h x w cells has 2 (h - 1) + 2 (w - 1) straight edges and four of half a diagonal
    assert rings == [(9, True, round(4 + 4 * 0.5**0.5, 6)), (13, True, round(8 + 4 * 0.5**0.5, 6))]


def test_planner():
    plan = T.analyze_raster_plan(1000, 700, 1, 4, 2_000_000)
    assert plan.strategy == T.TilingStrategy.TILED and plan.tile_shape == (256, 512) or plan.tile_shape == (256, 256)
    assert T.analyze_raster_plan(100, 100, 1, 4, 10**9).n_tiles == 0 and T.analyze_raster_plan(100, 100, 1, 4, 0).bytes_per_tile == 0
    assert T.analyze_raster_plan(5000, 5000, 1, 8, 2**28, scratch=2**27).bytes_per_tile > 2**27
    assert T.analyze_raster_plan(4500, 4500, 1, 8, 2**28).tile_shape[0] % 256 == 0
