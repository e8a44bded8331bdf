"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame operations alone.

A test item leaks into a document if at least ``containment`` of its distinct five-word shingles occur there (words:
runs of letters and digits, lower-cased). An item of one to four words has one shingle, its whole sequence, and is
looked for among the documents' runs of as many words.

Items are partitioned by size (powers of two of their shingle count n); each item is sketched by k = n - ceil(containment
* n) + 1 of its shingle hashes: the least (a bottom-k MinHash), but those that over ``common`` items share come last, so
a phrase of many items doesn't multiply the documents that have it. A document that contains the item lacks at most
k - 1 of its shingles, so it holds at least one of any k of them: no leak is missed. A sketch of the *document* would
lose a 30-word item in a 20,000-word text (their Jaccard similarity is near 0), so the document's side isn't sketched:
all its shingle hashes probe the items' sketches, and a partition is probed only by documents that have enough shingles
for its least item. Candidates are verified by exact shingle containment: strings are compared, not hashes.

Items with the same shingles are searched once and share the result. Sketches and items are broadcast only if they take
at most ``broadcast_bytes`` (counted: 40 bytes an entry, and the strings), else Spark joins by shuffle and splits hot keys.

Defined results: null texts and texts without words have no shingles, such items match nothing; the rows of a repeated
doc_id are verified one by one, the pair is returned once with the greatest containment; a null doc_id or item_id takes
no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

SHINGLE = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(words: Column, size: Column | int) -> Column:
    """1, 2, ... one for each run of ``size`` words; empty if there are too few words."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _once(words: Column, of: Callable[[Column], Column]) -> Column:
    """``of(words)`` with the words worked out once, not again for each shingle: they are bound as a lambda's variable."""
    return F.transform(F.array(words), of)[0]


def _runs(w: Column, sizes: list[int], of: Callable[[Column], Column]) -> Column:
    def each(size: int) -> Column:
        return F.transform(_starts(w, size), lambda i: of(F.slice(w, i, size)))

    return each(sizes[0]) if len(sizes) == 1 else F.flatten(F.array(*map(each, sizes)))


def shingle_hashes(words: Column, sizes: list[int]) -> Column:
    return _once(words, lambda w: _runs(w, sizes, lambda x: F.xxhash64(x)))


def shingle_strings(words: Column, sizes: list[int]) -> Column:
    return _once(words, lambda w: F.array_distinct(_runs(w, sizes, lambda x: F.array_join(x, " "))))


def item_strings(words: Column) -> Column:
    """Distinct shingles of an item: of SHINGLE words, or all its words if they are fewer."""
    return F.when(F.size(words) >= SHINGLE, shingle_strings(words, [SHINGLE])).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def _bounded(df: DataFrame, taken: int, most: int) -> DataFrame:
    return F.broadcast(df) if taken <= most else df


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, broadcast_bytes: int = 64 << 20, common: int = 16) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, n_shingles, n_found, containment."""
    items = (
        benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("w"))
        .select("item_id", F.least(F.size("w"), F.lit(SHINGLE)).alias("words"), F.array_sort(item_strings(F.col("w"))).alias("s")).where("size(s) > 0")
    )
    classes = cut(
        items.groupBy("s", "words").agg(F.min("item_id").alias("rep"), F.sort_array(F.collect_set("item_id")).alias("members"))
        .withColumn("n", F.size("s")).withColumn("need", F.ceil(F.col("n") * F.lit(containment) - 1e-9).cast("int"))
        .withColumn("part", F.floor(F.log2("n")).cast("int"))
    )
    least = classes.groupBy("part").agg(F.min("need").alias("part_need"))
    hashed = classes.select("rep", "part", "n", "need", F.explode("s").alias("x")).withColumn("h", F.xxhash64(F.split("x", " ")))
    often = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > common)
    ranked = hashed.join(often, "h", "left").groupBy("rep", "part", "n", "need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "h"))).alias("a"))
    sketch = cut(
        ranked.join(F.broadcast(least), "part")  # at most 31 partitions
        .select("rep", "part_need", F.explode(F.slice("a", F.lit(1), F.col("n") - F.col("need") + 1)).alias("x")).select("rep", "part_need", "x.h")
    )
    strings = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    taken = classes.agg(F.sum(strings + 40 * F.col("n") + 8 * F.size("members")), F.collect_set("words")).first()
    class_bytes, sketch_bytes = taken[0] or 0, 40 * sketch.count()
    sizes = sorted({SHINGLE, *taken[1]}, reverse=True)  # at most SHINGLE of them
    probes = (
        docs.where(F.col("doc_id").isNotNull()).select("doc_id", words_of(F.col("text")).alias("w"))
        .select("doc_id", shingle_hashes(F.col("w"), sizes).alias("hs")).select("doc_id", F.size("hs").alias("size"), F.explode("hs").alias("h"))
    )
    found = cut(
        probes.join(_bounded(sketch, sketch_bytes, broadcast_bytes), "h").where("size >= part_need")
        .groupBy("doc_id").agg(F.collect_set("rep").alias("reps"))
    )
    own = (
        docs.select("doc_id", "text").join(found, "doc_id").select("doc_id", "reps", words_of(F.col("text")).alias("w"))
        .select("doc_id", shingle_strings(F.col("w"), sizes).alias("ds"), F.explode("reps").alias("rep"))
    )
    return (
        own.join(_bounded(classes, class_bytes, broadcast_bytes), "rep")
        .select("doc_id", "members", "n", F.size(F.array_intersect("ds", "s")).alias("n_found"), "need").where("n_found >= need")
        .groupBy("doc_id", "members", "n").agg(F.max("n_found").alias("n_found"))
        .select("doc_id", F.explode("members").alias("item_id"), F.col("n").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"), (F.col("n_found") / F.col("n")).alias("containment"))
    )
