"""Tables of tile rows: Parquet files bucketed by tile, metadata beside them.

The files say which bucket they hold, so a later session finds the table as it was written. Rasters of one grid, tile and
number of buckets are joined without an exchange.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..model import RasterMeta
from ..operators.tiles import TILES, TileRaster

KEYS = ("band", "trow", "tcol")
_META = "height int, width int, band_count int, dtype string, nodata double, affine array<double>, crs string, driver string, tile_height int, tile_width int, buckets int"


def buckets_for(meta: RasterMeta, bucket_bytes: int = 128 << 20) -> int:
    """A power of two: buckets of about ``bucket_bytes``. It follows the grid and not the values, so rasters of a grid agree."""
    return 1 << max(0, (meta.height * meta.width * meta.band_count * 8 // bucket_bytes).bit_length())


def _name(path: str) -> str:
    return "tiles_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_tiles(path: str, t: TileRaster, buckets: int | None = None) -> None:
    """One file a bucket: rows are dealt by the buckets' own hash before they are written."""
    spark, n = t.df.sparkSession, buckets or buckets_for(t.meta)
    meta = [list(v) if isinstance(v, tuple) else v for v in asdict(t.meta).values()]
    spark.createDataFrame([(*meta, *t.tile, n)], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    rows = t.df.select(*KEYS, "data").repartition(n, *KEYS)
    rows.write.bucketBy(n, *KEYS).sortBy(*KEYS).mode("overwrite").option("path", f"{path}/tiles").format("parquet").saveAsTable(_name(path))
    t.events.append(f"written {path.rsplit('/', 1)[-1]} in {n} buckets")


def read_tiles(spark: SparkSession, path: str) -> TileRaster:
    """The table at ``path``, whichever session wrote it."""
    m = spark.read.parquet(f"{path}/meta").first()
    if not spark.catalog.tableExists(_name(path)):
        at = f"{path}/tiles".replace("'", "''")
        spark.sql(f"CREATE TABLE {_name(path)} ({TILES.replace(' int', ' INT').replace(' binary', ' BINARY')}) USING parquet CLUSTERED BY ({', '.join(KEYS)}) SORTED BY ({', '.join(KEYS)}) INTO {m.buckets} BUCKETS LOCATION '{at}'")
    meta = RasterMeta(m.height, m.width, m.band_count, m.dtype, m.nodata, tuple(m.affine), m.crs, m.driver)
    return TileRaster([(spark.table(_name(path)), meta.band_count)], meta, (m.tile_height, m.tile_width), events=[f"read {path.rsplit('/', 1)[-1]} by buckets"])
