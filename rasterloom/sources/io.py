"""Raster tables in Parquet, GeoTIFF files (``geotiff``), and file-to-file processing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Raster, RasterMeta, RasterWindow
from ..plans import tiling
from .geotiff import geokeys_to_affine, geokeys_to_crs, read_geotiff, read_metadata, with_sentinel, write_geotiff  # noqa: F401

BLOCK = 256
_META = "height int, width int, band_count int, dtype string, nodata double, affine array<double>, crs string, driver string, block int"


def _is_tiff(path: str) -> bool:
    return path.lower().endswith((".tif", ".tiff"))


def write_raster(path: str, r: Raster, block: int = BLOCK) -> None:
    """Pixels partitioned by band and block row, so windows and bands prune files; metadata, the block's size among them,
    beside them. A path that ends in .tif gets a GeoTIFF on the driver's disk."""
    if _is_tiff(path):
        write_geotiff(path, r)
        return
    spark = r.df.sparkSession
    m = [list(v) if isinstance(v, tuple) else v for v in asdict(r.meta).values()]
    spark.createDataFrame([(*m, block)], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    blocks = r.df.withColumn("block_row", F.floor(F.col("row") / block).cast("int"))
    blocks.repartition("band", "block_row").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("band", "block_row").parquet(f"{path}/pixels")
    r.events.append(f"written {path.rsplit('/', 1)[-1]}")


def _table_metadata(spark: SparkSession, path: str) -> tuple[RasterMeta, int]:
    row = spark.read.parquet(f"{path}/meta").first()
    return RasterMeta(row.height, row.width, row.band_count, row.dtype, row.nodata, tuple(row.affine), row.crs, row.driver), row.block


def read_raster_metadata(spark: SparkSession, path: str) -> RasterMeta:
    return read_metadata(spark, path)[0] if _is_tiff(path) else _table_metadata(spark, path)[0]


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, window: RasterWindow | None = None, overview: int | None = None) -> Raster:
    """Bands (from 1) and a window: partition and row filters of a Parquet scan, or the blocks that are read of a GeoTIFF.
    ``overview``: one of a GeoTIFF's smaller images, from 0."""
    if _is_tiff(path):
        r = read_geotiff(spark, path, bands, window, overview)
    else:
        if overview is not None:
            raise ValueError("a raster table has no overviews")
        meta, block = _table_metadata(spark, path)
        df = spark.read.parquet(f"{path}/pixels")
        if window:
            df = df.where(F.col("block_row").between(window.row_off // block, (window.row_off + window.height - 1) // block))
        r = Raster(df.select(F.col("band").cast("int"), "row", "col", "value"), meta, [f"read {path.rsplit('/', 1)[-1]} by Parquet blocks"])
    if bands:
        if min(bands) < 1 or max(bands) > r.meta.band_count:
            raise IndexError(f"the raster has {r.meta.band_count} bands")
        number = F.element_at(F.create_map(*(F.lit(x) for k, b in enumerate(bands, 1) for x in (b, k))), F.col("band"))
        r = Raster(r.df.where(F.col("band").isin(bands)).withColumn("band", number), replace(r.meta, band_count=len(bands)), r.events)
    return r.window(window) if window else r


def process_raster(spark: SparkSession, source: str, target: str, op: Callable, plan: tiling.RasterPlan | None = None, halo: int = 0) -> RasterMeta:
    """Read, transform, write; the metadata of what was written.

    Without a plan ``op`` maps a Raster to a Raster by DataFrame operations, and Spark's partitions bound the memory.
    With one it maps a tile's array and metadata to an array, with ``halo`` cells around, as in ``dispatch_tiled``. The
    source's dtype and nodata tag stay.
    """
    if plan is not None and plan.strategy == tiling.TilingStrategy.TILED and not plan.tile_shape:
        raise ValueError("a tiled plan has a tile shape")
    r = read_raster(spark, source)
    out = op(r) if plan is None else tiling.dispatch_tiled_halo(r, op, plan, halo)
    done = Raster(out.df, replace(out.meta, dtype=r.meta.dtype, nodata=r.meta.nodata, driver="GTiff" if _is_tiff(target) else None), [*r.events])
    write_raster(target, done)
    return done.meta

