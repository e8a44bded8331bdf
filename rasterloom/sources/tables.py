"""The driver's tables seen as rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Raster, RasterMeta


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hole() -> Column:
    """Cells that the nodata variants leave out."""
    return (F.col("row") * 7 + F.col("col")) % 13 == 0


def _holes(df: DataFrame, nodata: bool) -> DataFrame:
    return df.withColumn("value", F.when(~hole(), F.col("value"))) if nodata else df


def emb(spark: SparkSession, sf_dir: str, nodata: bool = False) -> Raster:
    """embeddings: a row a vector, 64 columns."""
    t = _read(spark, sf_dir, "embeddings")
    df = t.select(F.lit(1).alias("band"), F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).select("band", "row", "col", F.col("v").cast("double").alias("value"))
    height = t.agg(F.max("vec_id")).first()[0] + 1
    return Raster(_holes(df, nodata), RasterMeta(height, 64, nodata=-9999.0 if nodata else None))


def emb_zones(spark: SparkSession, sf_dir: str) -> Raster:
    t = _read(spark, sf_dir, "embeddings")
    height = t.agg(F.max("vec_id")).first()[0] + 1
    df = t.select(F.lit(1).alias("band"), F.col("vec_id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("col"), F.col("label").cast("double").alias("value"))
    return Raster(df, RasterMeta(height, 64, dtype="int32"))


def _keyed(spark: SparkSession, sf_dir: str, table: str, key: str, width: int, columns: list[str], nodata: bool) -> Raster:
    t = _read(spark, sf_dir, table).select(key, *columns)
    height = t.agg(F.max(key)).first()[0] // width + 1
    cell = [F.floor(F.col(key) / width).cast("int").alias("row"), (F.col(key) % width).cast("int").alias("col")]
    if len(columns) == 1:
        df = t.select(F.lit(1).alias("band"), *cell, F.col(columns[0]).cast("double").alias("value"))
    else:
        df = t.select(*cell, F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("k", "value")).select((F.col("k") + 1).alias("band"), "row", "col", "value")
    return Raster(_holes(df, nodata), RasterMeta(height, width, len(columns), nodata=-9999.0 if nodata else None))


def dem(spark: SparkSession, sf_dir: str, nodata: bool = False) -> Raster:
    return _keyed(spark, sf_dir, "orders", "o_orderkey", 50, ["o_totalprice"], nodata)


def events(spark: SparkSession, sf_dir: str, nodata: bool = False) -> Raster:
    return _keyed(spark, sf_dir, "events", "event_id", 100, ["value"], nodata)


def parts(spark: SparkSession, sf_dir: str, nodata: bool = False) -> Raster:
    """Two bands: size and price."""
    return _keyed(spark, sf_dir, "part", "p_partkey", 50, ["p_size", "p_retailprice"], nodata)
