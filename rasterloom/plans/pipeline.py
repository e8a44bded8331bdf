"""Plans as text, capabilities, and memory as Spark reports it."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import SparkSession

from ..model import PolygonizeSpec, Raster

#: What polygonize does, in order, with the Spark operation behind each step.
POLYGONIZE_STEPS = (
    ("read", "scan of pixels"), ("nodata mask", "filter: value is not null"), ("sieve", "optional: aggregate by label, join"), ("components", "grouped map by tile, seam join, star rounds"),
    ("contour", "cell borders of a region"), ("rings", "grouped map by region: chains of borders"), ("polygons", "projection to WKT"),
)


def plan_polygonize_pipeline(r: Raster, spec: PolygonizeSpec | None = None) -> list[tuple[str, str]]:
    """The steps for this raster; nothing runs."""
    spec = spec or PolygonizeSpec()
    if spec.connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    size = f"{r.meta.height} x {r.meta.width}, {spec.connectivity}-connected"
    return [(name, f"{what} ({size})" if name == "components" else what) for name, what in POLYGONIZE_STEPS]


def has_geotiff_support() -> bool:
    """GeoTIFF is read and written here (uncompressed and deflate)."""
    return find_spec("zlib") is not None


def has_codec_support(module: str) -> bool:
    """Whether an optional decoder can be imported."""
    return find_spec(module) is not None


def memory_stats(spark: SparkSession) -> dict[str, tuple[int, int]]:
    """Storage memory of each executor: (most, free) bytes."""
    held = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    out, it = {}, held.iterator()
    while it.hasNext():
        entry = it.next()
        out[entry._1()] = (entry._2()._1(), entry._2()._2())
    return out


def free_memory(spark: SparkSession) -> None:
    """Drop everything that is cached."""
    spark.catalog.clearCache()
