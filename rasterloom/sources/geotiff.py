"""GeoTIFF files as a Spark data source: headers, blocks and their codecs (none, deflate, LZW; predictors 2 and 3; samples of
1, 2, 4 and whole bytes; classic and BigTIFF).

Reading: the header's values are read by their places, without the tables of block places, however large the file is. The
blocks that window, bands and pushed filters need are planned as partitions, rectangles of neighbouring blocks; a task
reads its slices of those tables, then its blocks, by seeking. Files are opened through pyarrow's file systems; a store that
only Spark reaches is read whole, file by task (up to 2 GB).

Writing: tasks encode tiles and number their bytes; a sum over tasks gives each its place; tasks then write tiles and their
entries of the tables at their places in one file, which the commit renames to its name. No pixel, tile or table passes
through the driver. The target is a file system where several machines may write one file (a local disk, a shared mount).
"""

from __future__ import annotations

import ast
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..model import PIXELS, Affine, Raster, RasterMeta, RasterWindow, from_dataframe
from ..plans.lineage import cut
from ..plans.tiling import with_tiles

# TIFF tags, field sizes and sample formats.
_FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_KIND = {1: "u", 2: "i", 3: "f"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def geokeys_to_affine(pixel_scale=None, tiepoint=None, transformation=None) -> Affine | None:
    """A 4 x 4 transformation wins; else scale and tiepoint; else nothing."""
    if transformation is not None and len(transformation) >= 8:
        t = transformation
        return (t[0], t[1], t[3], t[4], t[5], t[7])
    if pixel_scale is not None and tiepoint is not None and len(pixel_scale) >= 2 and len(tiepoint) >= 6:
        (sx, sy), (i, j, _, x, y) = pixel_scale[:2], tiepoint[:5]
        return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    return None


def geokeys_to_crs(keys: dict[int, int]) -> str | None:
    """EPSG code as text, the projected one before the geodetic one."""
    code = keys.get(3072) or keys.get(2048)
    return f"EPSG:{code}" if code and code != 32767 else None


class Ranges:
    """A file read by places. A short read fetches some bytes more, which the next ones are served from."""

    AHEAD = 1 << 16

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.at, self.held, self.fetched = file, 0, b"", 0

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, self.AHEAD), at)
            self.fetched += len(self.held)
        found = self.held[at - self.at : at - self.at + n]
        if len(found) < n:
            raise ValueError("the file ends early")
        return found


def local_path(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def opened(path: str) -> Ranges:
    path = local_path(path)
    files, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), os.path.abspath(path))
    return Ranges(files.open_input_file(at))


def _ranges(raw: bytes | Ranges) -> Ranges:
    return raw if isinstance(raw, Ranges) else Ranges(pa.BufferReader(raw))


@dataclass(frozen=True)
class Far:
    """Values of a tag that stay in the file until a slice of them is asked for."""

    order: str
    code: str
    count: int
    at: int

    def read(self, f: Ranges, first: int, last: int) -> tuple:
        size = struct.calcsize("=" + self.code)
        return struct.unpack(self.order + self.code * (last - first), f.read(self.at + first * size, (last - first) * size))


_BLOCK_TABLES = (STRIPS, STRIP_SIZES, TILES, TILE_SIZES)


def directories(raw: bytes | Ranges) -> tuple[str, list[dict[int, tuple | Far]]]:
    """Byte order, and the tags of each image of the file; the tables of block places are ``Far``."""
    f = _ranges(raw)
    start = f.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    number, inline, head = ("Q", 8, "HHQ") if big else ("I", 4, "HHI")
    at = struct.unpack(order + number, f.read(8, 8) if big else start[4:8])[0]
    found, seen = [], set()
    while at:
        if at in seen:
            raise ValueError("the file's images form a loop")
        seen.add(at)
        count = struct.unpack(order + ("Q" if big else "H"), f.read(at, 8 if big else 2))[0]
        at += 8 if big else 2
        size = struct.calcsize("=" + head) + inline
        table = f.read(at, size * count + inline)
        tags: dict[int, tuple | Far] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + head, table, size * k)
            if kind not in _FIELD:
                continue
            code = _FIELD[kind]
            length, value = struct.calcsize("=" + code) * n, size * (k + 1) - inline
            place = at + value if length <= inline else struct.unpack_from(order + number, table, value)[0]
            if tag in _BLOCK_TABLES:
                tags[tag] = Far(order, code, n, place)
                continue
            data = f.read(place, length)
            tags[tag] = (data.split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack(order + code * n, data)
        found.append(tags)
        at = struct.unpack_from(order + number, table, size * count)[0]
    return order, found


@dataclass(frozen=True)
class Layout:
    """How an image's samples are stored."""

    order: str
    dtype: str
    height: int
    width: int
    bands: int
    planes: int
    rows: int
    cols: int
    codec: int
    predictor: int
    bits: int = 0  # of samples that are smaller than a byte

    @property
    def samples(self) -> int:
        return 1 if self.planes > 1 else self.bands

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.height // self.rows), -(-self.width // self.cols)


def layout_of(order: str, t: dict[int, tuple]) -> Layout:
    bits = t.get(BITS, (1,))[0]
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(t.get(BITS, (1,)))) > 1:
        raise ValueError(f"samples of {t.get(BITS, (1,))} bits aren't read")
    dtype = str(np.dtype(f"{_KIND[t.get(FORMAT, (1,))[0]] if bits >= 8 else 'u'}{max(bits, 8) // 8}"))
    h, w, bands = t[HEIGHT][0], t[WIDTH][0], t.get(SAMPLES, (1,))[0]
    rows, cols = (t[TILE_HEIGHT][0], t[TILE_WIDTH][0]) if TILES in t else (min(h, t.get(ROWS_PER_STRIP, (h,))[0]), w)
    codec = t.get(COMPRESSION, (NONE,))[0]
    if codec not in (NONE, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {codec} isn't read")
    return Layout(order, dtype, h, w, bands, bands if t.get(PLANAR, (1,))[0] == 2 else 1, rows, cols, codec, t.get(PREDICTOR, (1,))[0], bits if bits < 8 else 0)


def images(raw: bytes | Ranges) -> tuple[str, list[dict[int, tuple | Far]]]:
    """Byte order, and tags of the full image and its overviews in order; masks are left out."""
    order, found = directories(raw)
    return order, found[:1] + [t for t in found[1:] if t.get(SUBFILE, (0,))[0] & 1 and not t[SUBFILE][0] & 4]


def tiff_metadata(raw: bytes | Ranges, overview: int | None = None) -> RasterMeta:
    """Metadata of the full image, or of an overview (from 0): its pixels are larger by the ratio of sizes."""
    order, found = images(raw)
    if overview is not None and not 0 <= overview < len(found) - 1:
        raise IndexError(f"the file has {len(found) - 1} overviews")
    t, own = found[0], found[0 if overview is None else overview + 1]
    m = layout_of(order, own)
    geo = t.get(GEO_KEYS, ())
    keys = {geo[k]: geo[k + 3] for k in range(4, len(geo) - 3, 4) if geo[k + 1] == 0}
    nodata = float(t[NODATA][0]) if NODATA in t and t[NODATA][0].strip() else None
    a, b, c, d, e, f = geokeys_to_affine(t.get(PIXEL_SCALE), t.get(TIEPOINT), t.get(TRANSFORM)) or (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    x, y = t[WIDTH][0] / m.width, t[HEIGHT][0] / m.height
    return RasterMeta(m.height, m.width, m.bands, m.dtype, nodata, (a * x, b * y, c, d * x, e * y, f), geokeys_to_crs(keys), "GTiff")


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the most significant bit first; widths grow one code early."""
    out, table, width, last = bytearray(), [], 9, None
    bits = held = 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decode_block(data: bytes, m: Layout) -> np.ndarray:
    """(rows, cols, samples) of one strip or tile."""
    raw = data if m.codec == NONE else unpack_lzw(data) if m.codec == LZW else zlib.decompress(data)
    kind = np.dtype(m.dtype).newbyteorder(m.order)
    if m.bits:  # rows begin at whole bytes
        line = -(-m.cols * m.samples * m.bits // 8)
        each = np.unpackbits(np.frombuffer(raw, np.uint8, len(raw) // line * line).reshape(-1, line), axis=1)[:, : m.cols * m.samples * m.bits]
        return (each.reshape(len(each), m.cols, m.samples, m.bits) @ (1 << np.arange(m.bits)[::-1])).astype(np.uint8)
    line = m.cols * m.samples * kind.itemsize
    rows = len(raw) // line
    if m.predictor == 3:  # bytes of a row by significance, as differences
        planes = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, m.cols * kind.itemsize, m.samples).cumsum(axis=1, dtype=np.uint8)
        big = planes.reshape(rows, kind.itemsize, m.cols * m.samples).transpose(0, 2, 1)
        return np.ascontiguousarray(big).view(np.dtype(m.dtype).newbyteorder(">")).reshape(rows, m.cols, m.samples).astype(m.dtype)
    block = np.frombuffer(raw, kind, rows * m.cols * m.samples).reshape(rows, m.cols, m.samples)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if m.predictor == 2 else block.astype(m.dtype)


@dataclass(frozen=True)
class Part(InputPartition):
    """Block rows ``r0`` to ``r1`` and block columns ``c0`` to ``c1`` (exclusive) of a plane."""

    plane: int
    r0: int
    r1: int
    c0: int
    c1: int


def _planes(m: Layout, bands: list[int] | None) -> list[int]:
    return [p for p in range(m.planes) if m.planes == 1 or not bands or p + 1 in bands]


def planned(m: Layout, window: RasterWindow | None, bands: list[int] | None, cells: int) -> list[Part]:
    """The blocks that window and bands need, in rectangles of about ``cells`` cells: runs of whole block rows or parts of one."""
    w = window or RasterWindow(0, 0, m.width, m.height)
    (r0, c0), (down, across) = (max(0, w.row_off) // m.rows, max(0, w.col_off) // m.cols), m.grid
    r1, c1 = min(down, -(-(w.row_off + w.height) // m.rows)), min(across, -(-(w.col_off + w.width) // m.cols))
    wide = max(1, min(c1 - c0, cells // (m.rows * m.cols * m.samples)))
    high = max(1, cells // (m.rows * m.cols * m.samples * max(1, c1 - c0)))
    return [Part(p, r, min(r + high, r1), c, min(c + wide, c1)) for p in _planes(m, bands) for r in range(r0, r1, high) for c in range(c0, c1, wide)]


def blocks_of(f: Ranges, t: dict[int, tuple | Far], m: Layout, part: Part) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(plane, block row, block column, bytes) of a part; None for a block that the file leaves out."""
    places, sizes = (t[TILES], t[TILE_SIZES]) if TILES in t else (t[STRIPS], t[STRIP_SIZES])
    down, across = m.grid
    for r in range(part.r0, part.r1):
        first = (part.plane * down + r) * across
        span = (first + part.c0, first + part.c1)
        for c, at, size in zip(range(part.c0, part.c1), places.read(f, *span), sizes.read(f, *span)):
            yield part.plane, r, c, f.read(at, size) if size else None


def blocks(raw: bytes, t: dict[int, tuple | Far], m: Layout, window: RasterWindow | None, bands: list[int] | None) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(plane, block row, block column, bytes) of what the window and bands need."""
    f = _ranges(raw)
    for part in planned(m, window, bands, m.height * m.width * m.bands):
        yield from blocks_of(f, t, m, part)


def pixels(block: tuple[int, int, int, bytes | None], m: Layout, window: RasterWindow | None, left_out: float | None, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows of a block's cells that lie in the window, some lines at a time. ``left_out``: the value of blocks without bytes."""
    plane, r, c, data = block
    w = window or RasterWindow(0, 0, m.width, m.height)
    top, left = r * m.rows, c * m.cols
    rows = range(max(w.row_off, top), min(w.row_off + w.height, top + m.rows, m.height))
    cols = range(max(w.col_off, left), min(w.col_off + w.width, left + m.cols, m.width))
    if not len(rows) or not len(cols):
        return
    cube = decode_block(data, m) if data is not None else None
    step = max(1, most // len(cols))
    for at in range(rows[0], rows[-1] + 1, step):
        lines = np.arange(at, min(at + step, rows[-1] + 1), dtype=np.int32)
        for k in range(m.samples):
            n = len(lines) * len(cols)
            if cube is None:
                value = pa.array(np.full(n, np.nan if left_out is None else left_out))
            else:
                value = pa.array(cube[lines[0] - top : lines[-1] + 1 - top, cols[0] - left : cols[-1] + 1 - left, k].ravel().astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, (plane if m.planes > 1 else k) + 1, np.int32)), pa.array(np.repeat(lines, len(cols))), pa.array(np.tile(np.arange(cols[0], cols[-1] + 1, dtype=np.int32), len(lines))), value],
                ["band", "row", "col", "value"],
            )


def header(f: Ranges, overview: int | None) -> tuple[RasterMeta, Layout, dict[int, tuple | Far]]:
    order, found = images(f)
    meta = tiff_metadata(f, overview)
    tags = found[0 if overview is None else overview + 1]
    return meta, layout_of(order, tags), tags


class TiffReader(DataSourceReader):
    """Options: path; bands (``1,3``); window (``col,row,width,height``); overview; cells a partition."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.bands = [int(k) for k in options["bands"].split(",")] if options.get("bands") else None
        self.window = RasterWindow(*(int(k) for k in options["window"].split(","))) if options.get("window") else None
        self.cells = int(options.get("cells", 1 << 22))
        self.meta, self.layout, self.tags = header(opened(self.path), int(options["overview"]) if options.get("overview") else None)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of row, col and band with numbers narrow the window and the bands. Spark applies all of them again."""
        m = self.layout
        w = self.window or RasterWindow(0, 0, m.width, m.height)
        least, most = {"row": w.row_off, "col": w.col_off, "band": 1}, {"row": w.row_off + w.height - 1, "col": w.col_off + w.width - 1, "band": m.bands}
        among = set(self.bands or range(1, m.bands + 1))
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else ""
            if name in least:
                if isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    least[name] = max(least[name], x.value + isinstance(x, GreaterThan))
                if isinstance(x, (EqualTo, LessThan, LessThanOrEqual)):
                    most[name] = min(most[name], x.value - isinstance(x, LessThan))
                if isinstance(x, In) and name == "band":
                    among &= set(x.value)
            yield x
        self.window = RasterWindow(least["col"], least["row"], max(0, most["col"] - least["col"] + 1), max(0, most["row"] - least["row"] + 1))
        self.bands = sorted(b for b in among if least["band"] <= b <= most["band"]) or [0]

    def partitions(self) -> list[Part]:
        m = self.layout
        return planned(m, self.window, self.bands, max(self.cells, m.height * m.width * m.bands // 50_000))

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        left_out = 0.0 if self.meta.nodata is None else None
        f = opened(self.path)
        for block in blocks_of(f, self.tags, self.layout, partition):
            yield from pixels(block, self.layout, self.window, left_out)


class TiffWriter(DataSourceArrowWriter):
    """Rows (k, at, data) to the file ``temp``: a tile's bytes at their place, its place and size at its place in the tables."""

    def __init__(self, options: dict[str, str]) -> None:
        self.temp, self.target = options["temp"], options["path"]
        self.places, self.sizes, self.code = int(options["places"]), int(options["sizes"]), options["code"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        width = struct.calcsize("=" + self.code)
        out = os.open(self.temp, os.O_WRONLY)
        try:
            for batch in iterator:
                for k, at, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "at", "data"))):
                    for place, what in ((at, data), (self.places + k * width, struct.pack("<" + self.code, at)), (self.sizes + k * width, struct.pack("<" + self.code, len(data)))):
                        done = 0
                        while done < len(what):
                            done += os.pwrite(out, what[done:], place + done)
            os.fsync(out)
        finally:
            os.close(out)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        os.replace(self.temp, self.target)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.temp):
            os.remove(self.temp)


class GeoTiff(DataSource):
    """``spark.read.format("geotiff").load(path)``: band, row, col, value as stored, in the file's own counting."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _reached(path: str) -> bool:
    """Whether pyarrow has a file system for the path; if not, Spark has to read it."""
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def read_metadata(spark: SparkSession, path: str, overview: int | None = None) -> tuple[RasterMeta, Layout]:
    """From the header, by its places; of a file that only Spark reaches, a row of the header's values."""
    if _reached(path):
        return header(opened(path), overview)[:2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                m, layout, _ = header(_ranges(raw), overview)
                yield pd.DataFrame({"meta": [repr(vars(m))], "layout": [repr(vars(layout))]})

    row = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "meta string, layout string").first()
    meta = ast.literal_eval(row.meta.replace(": nan", ": 'nan'"))
    if meta["nodata"] == "nan":
        meta["nodata"] = float("nan")
    return RasterMeta(**meta), Layout(**ast.literal_eval(row.layout))


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None, window: RasterWindow | None = None, overview: int | None = None) -> Raster:
    """The pixels that the window and bands need, in the file's own counting."""
    meta, m = read_metadata(spark, path, overview)
    if _reached(path):
        register(spark)
        options = {"bands": ",".join(map(str, bands or ())), "window": ",".join(map(str, (window.col_off, window.row_off, window.width, window.height))) if window else "", "overview": "" if overview is None else str(overview)}
        df = spark.read.format("geotiff").options(**options).load(path)
    else:
        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for raw in batch["content"]:
                    for block in blocks(raw, header(_ranges(raw), overview)[2], m, window, bands):
                        yield pd.DataFrame([block], columns=["plane", "r", "c", "data"])

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    yield from pixels(block, m, window, 0.0 if meta.nodata is None else None)

        down, across = m.grid
        parts = max(1, min(m.planes * down * across, 4 * spark.sparkContext.defaultParallelism, meta.pixel_count * meta.band_count // 65536 + 1))
        packed = spark.read.format("binaryFile").load(path).select("content").mapInPandas(split, "plane int, r int, c int, data binary")
        df = packed.repartition(parts).mapInArrow(decode, PIXELS)
    got = from_dataframe(df, meta)
    got.events.append(f"read {path.rsplit('/', 1)[-1]} by GeoTIFF blocks")
    return got


def with_sentinel(r: Raster) -> DataFrame:
    """Pixels as stored outside: nodata is the sentinel."""
    return r.df.withColumn("value", F.coalesce("value", F.lit(r.meta.nodata).cast("double")))


def encode_block(data: np.ndarray, compress: bool) -> bytes:
    return zlib.compress(data.tobytes(), 6) if compress else data.tobytes()


def encoded(r: Raster, compress: bool, tile: int) -> DataFrame:
    """run, within, k, data: encoded tiles with their number in the file, the task that made them and their place in its bytes."""
    m = r.meta
    kind = np.dtype(m.dtype).newbyteorder("<")
    empty = m.nodata if m.nodata is not None else np.nan if kind.kind == "f" else 0
    down, across = -(-m.height // tile), -(-m.width // tile)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, tr, tc = (int(k) for k in key)
        block = np.full((tile, tile), empty, dtype=kind)
        held = pdf["value"].notna().to_numpy()
        block[(pdf["row"] - tr * tile)[held], (pdf["col"] - tc * tile)[held]] = pdf["value"].to_numpy(float)[held].astype(kind)
        return pd.DataFrame({"k": [((band - 1) * down + tr) * across + tc], "data": [encode_block(block, compress)]})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = at + np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            sizes = np.diff(ends, prepend=at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), task)), pa.array(ends - sizes), pa.array(sizes), *batch.columns], ["run", "within", "size", "k", "data"])
            at = int(ends[-1]) if len(ends) else at

    tiles = with_tiles(with_sentinel(r), (tile, tile)).groupBy("band", "trow", "tcol").applyInPandas(run, "k long, data binary")
    return tiles.mapInArrow(placed, "run long, within long, size long, k long, data binary")


def write_geotiff(path: str, r: Raster, compress: bool = True, tile: int = 256) -> None:
    """``tile`` x ``tile`` blocks band by band, little-endian, BigTIFF from 4 GB on. The file has its name once it is whole;
    a failed write leaves nothing. Tiles of which no cell has a row are left out of the file."""
    m, spark = r.meta, r.df.sparkSession
    kind, path = np.dtype(m.dtype).newbyteorder("<"), local_path(path)
    if "://" in path:
        raise ValueError("a GeoTIFF is written by several tasks at once, so to a file system; use a raster table in a store")
    tiles = cut(encoded(r, compress, tile))
    n = m.band_count * -(-m.height // tile) * -(-m.width // tile)
    big = n * tile * tile * kind.itemsize > 2**32 - 2**24
    start, places, sizes = _header(m, kind, compress, tile, n, big)
    runs = tiles.groupBy("run").agg(F.sum("size").alias("size")).orderBy("run").toPandas()  # one row a task
    base = runs["size"].cumsum() - runs["size"] + len(start)
    bases = spark.createDataFrame(list(zip(runs["run"].tolist(), base.tolist())), "run long, base long")
    temp = f"{os.path.abspath(path)}.{uuid.uuid4().hex}.part"
    try:
        with open(temp, "wb") as out:
            out.write(start)
        register(spark)
        rows = tiles.join(F.broadcast(bases), "run").select("k", (F.col("base") + F.col("within")).alias("at"), "data")
        rows.write.format("geotiff").mode("append").options(temp=temp, places=places, sizes=sizes, code="Q" if big else "I").save(os.path.abspath(path))
    finally:
        if os.path.exists(temp):
            os.remove(temp)
    r.events.append(f"written {path.rsplit('/', 1)[-1]}")


def _header(m: RasterMeta, kind: np.dtype, compress: bool, tile: int, n: int, big: bool) -> tuple[bytes, int, int]:
    """Everything before the tiles, with empty tables for ``n`` of them; where the tables of places and of sizes begin."""
    entries = _entries(m, kind, compress, tile, n, big)
    number, inline, head = ("Q", 8, "<HHQ") if big else ("I", 4, "<HHI")
    start = 16 if big else 8
    extra = start + (8 if big else 2) + (20 if big else 12) * len(entries) + inline
    ifd, more, at = struct.pack("<Q" if big else "<H", len(entries)), b"", {}
    for tag, field, values in entries:
        data = values if field == 2 else struct.pack("<" + _FIELD[field] * len(values), *values)
        ifd += struct.pack(head, tag, field, len(values))
        at[tag] = start + len(ifd) if len(data) <= inline else extra + len(more)
        ifd += data.ljust(inline, b"\0") if len(data) <= inline else struct.pack("<" + number, extra + len(more))
        more += data if len(data) > inline else b""
    first = struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start)
    whole = first + ifd + b"\0" * inline + more
    return whole + b"\0" * (-len(whole) % 16), at[TILES], at[TILE_SIZES]


def _entries(m: RasterMeta, kind: np.dtype, compress: bool, tile: int, blocks: int, big: bool) -> list[tuple[int, int, tuple | bytes]]:
    n, place, table = m.band_count, 16 if big else 4, (0,) * blocks
    a, b, c, d, e, f = m.affine
    entries = [
        (WIDTH, 4, (m.width,)), (HEIGHT, 4, (m.height,)), (BITS, 3, (kind.itemsize * 8,) * n), (COMPRESSION, 3, (DEFLATE if compress else NONE,)), (262, 3, (1,)), (SAMPLES, 3, (n,)),
        (PLANAR, 3, (2,)), (TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILES, place, table), (TILE_SIZES, place, table), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * n),
        (TRANSFORM, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
    ]
    if m.crs and m.crs.startswith("EPSG:"):
        entries.append((GEO_KEYS, 3, (1, 1, 0, 1, 3072, 0, 1, int(m.crs[5:]))))
    if m.nodata is not None:
        entries.append((NODATA, 2, f"{m.nodata!r}\0".encode()))
    return entries
