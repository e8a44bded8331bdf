"""Cut lineage: write to the shared folder, read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task's Parquet writer holds before it writes them (Parquet's own default, 128 MB, is much for one core).
_BLOCK = 16 << 20
_made: list[tuple[SparkSession, str]] = []
#: Paths given out since the ``finished`` began that this thread is in.
_inside: ContextVar[list[str] | None] = ContextVar("inside", default=None)
#: Spark deletes a query's shuffle files at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; on a cluster,
    where each machine would write its own disk, it is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str = "cut") -> str:
    """A path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    if (own := _inside.get()) is not None:
        own.append(path)
    return path


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` from a table in the shared folder, and the table's path, to be dropped when nothing reads it any more."""
    path = new_path(df.sparkSession)
    df.write.option("parquet.block.size", _BLOCK).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: lineage ends, lost executors cost nothing."""
    return written(df)[0]


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` gives, from a table; the tables written meanwhile go, and the shuffle files of each step with it."""
    own: list[str] = []
    before, token = spark.conf.get(_CLEANUP, None), _inside.set(own)
    spark.conf.set(_CLEANUP, "true")
    try:
        try:
            df = make()
        finally:
            _inside.reset(token)
        return cut(df)
    finally:
        for path in own:
            drop(spark, path)
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def drop(spark: SparkSession, path: str) -> None:
    """Delete what ``new_path`` gave out, before the end."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = [(s, p) for s, p in _made if p != path]


def _clean() -> None:
    for spark, path in list(_made):
        try:
            drop(spark, path)
        except Exception:  # the session may have ended; the files then stay in the shared folder
            return
