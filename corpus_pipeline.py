"""A corpus pipeline of five stages: language, exact copies, near copies, benchmark leaks, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontaminate, exact_dedup, lang_id, simhash
from rasterloom.plans.lineage import cut, drop, new_path

RANKS = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; lang becomes the predicted language."""
    model = lang_id.train(docs.select("doc_id", "text", "lang"))
    got = lang_id.score(docs, model, "text", "source", "n_chars").where("accepted")
    return got.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with row_id, which tells rows apart whose doc_id is null or repeated: a file's hash and the place in it. What
    isn't read from files is written first, with a number."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select(*COLUMNS, place.alias("row_id"))
    except AnalysisException:  # no files behind it
        return cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_id")))


def _as_ids(docs: DataFrame) -> DataFrame:
    """Rows of ``_numbered`` for an operator: their identity as doc_id, in the order of doc_id, null ones last."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_id").alias("doc_id"), "text")


def _only(docs: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``_numbered`` whose row_id is in ``rows`` (``left_anti``: isn't): null and repeated doc_ids included."""
    return docs.join(rows.select("row_id"), "row_id", how).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: the one with the smallest doc_id."""
    docs = _numbered(docs)
    return _only(docs, exact_dedup.exact_dedup(_as_ids(docs)).where("kept").select("doc_id.row_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of at least 0.8, one row: the one with the smallest doc_id."""
    docs = _numbered(docs)
    return _only(docs, simhash.similar_groups(_as_ids(docs)).where("keep").select("doc_id.row_id"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    docs = _numbered(docs)
    found = decontaminate.contaminated(docs.select(F.col("row_id").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, found.select(F.col("doc_id").alias("row_id")).distinct(), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return bpe.digest_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]

#: Language models and components of near copies can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet in the shared folder and read again; what a stage
    was given goes when it is through."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
