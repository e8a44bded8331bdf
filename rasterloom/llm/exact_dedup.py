"""Exact dedup by skew-safe combining.

Rows get the digest of their normalised text (SHA-256). Only digests that occur more than once need their contents
compared: a scan keeps the rows of repeated digests (which are broadcast, as 64-bit hashes, if they take at most
``broadcast_bytes``, counted; beyond that the rows meet them in a salted join, and texts are shuffled once more). Those
rows are deduplicated locally (a task's partial aggregation sends a text once, however often it holds it), merged in
salted digest groups (a task has one salt), and the salts' winners are combined globally. Each of the three stages
groups by digest and whole content, so a digest shared by different texts never merges them. Digests of which contents
differ (none with SHA-256 so far; ``digest`` can be replaced) are resolved by joining on the content as well. No text of
an unrepeated digest is shuffled or grouped while the repeated ones can be broadcast.

Defined results: null text is empty; a null doc_id stays only if all ids of its group are null; of repeated rows with
one doc_id and text one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Runs of ASCII white space that aren't one space already.
TO_FIX = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_ENTRY = 32  # bytes that a 64-bit hash takes in a broadcast table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), TO_FIX, " ")


def combined(full: DataFrame, first: DataFrame, repeated: int, salts: int, broadcast_bytes: int) -> DataFrame:
    """d, t, keep_id, group_size of each text of repeated digests: the local, salted and global stages."""
    key, salt = F.xxhash64("d").alias("key"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    if repeated * _ENTRY <= broadcast_bytes:
        rows = full.select("*", key, salt).join(F.broadcast(first.select(key).distinct()), "key", "left_semi")
    else:  # by salted digest, so that a hot digest's rows aren't one task
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
        salted = first.select(key, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).distinct()
        rows = full.select("*", key, salt).join(salted.hint("merge"), ["key", "salt"], "left_semi")
    return (
        rows.groupBy("key", "salt", "d", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .groupBy("d", "t").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def exact_dedup(docs: DataFrame, salts: int = 64, digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256), broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    full = docs.select("doc_id", normalised(F.col("text")).alias("t")).withColumn("d", digest(F.col("t")))
    meta = cut(full.select("doc_id", "d", F.sha2("t", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("uid")))
    # partial aggregation: a task sends a digest once, however often it occurs
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid")
    first = cut(meta.groupBy("d").agg(F.min(row).alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", F.col("w.uid").alias("first_uid")))
    winners = combined(full, first, first.count(), salts, broadcast_bytes)
    sizes = cut(winners.groupBy("d").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    # rows go straight from their exchange into one join, so Spark can split the partition of a hot digest
    groups = cut(sizes.join(first, "d"))
    one = meta.join(groups.hint("merge"), "d", "left").where("coalesce(texts, 1) = 1").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("uid") == F.col("first_uid"))).alias("kept"),
        "text_sha256",
    )
    if sizes.where("texts > 1").isEmpty():
        return one
    shared = full.join(sizes.where("texts > 1").select("d"), "d", "left_semi")
    order = Window.partitionBy("d", "t", "doc_id").orderBy("doc_id")
    rest = (
        shared.withColumn("nth", F.row_number().over(order)).join(winners, ["d", "t"])
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.sha2("t", 256).alias("text_sha256"))
    )
    return one.unionByName(rest)
