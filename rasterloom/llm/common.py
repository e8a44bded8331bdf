"""What the operators of this subpackage share: bounded samples, small Arrow batches, byte word splitting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows at most: texts may be long, and a batch is held on both sides of the pipe."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def small_broadcasts(spark: SparkSession) -> None:
    """Spark broadcasts tables of 1 MB at most by itself. It goes by a file's size, and columns of ids take many times that
    in the driver's memory, once for each of the joins that run at a time."""
    size = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower())
    if size and int(size[1]) << 10 * " kmgtp".find(size[2] or " ") > 1 << 20:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")


def labelled_sample(docs: DataFrame, labels: DataFrame, wanted: list[str], most: int) -> DataFrame:
    """At most ``most`` labelled documents: those whose doc_id hashes lowest. Columns: doc_id, text, ``wanted``.

    The bound is on rows that a model is fitted on, nothing else. Only ids and labels are ordered; since there
    are at most ``most`` of them, they are broadcast to the scan of the documents. Of the documents with one doc_id the
    text of least hash counts, so a repeated id can't exceed the bound; a task sends one text of an id at most.
    """
    picked = (
        labels.select("doc_id", *wanted).where(F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(*(F.max(c).alias(c) for c in wanted))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    one = found.groupBy("doc_id", *wanted).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    return one.select("doc_id", "one.text", *wanted)


#: Lower-cases A-Z and turns ASCII punctuation and controls into spaces; other bytes stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 39 else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Words as bytes: ASCII letters lower-cased, split at ASCII punctuation and white space."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()
