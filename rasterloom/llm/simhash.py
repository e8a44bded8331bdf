"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded with zeros). Two fingerprints that
differ in at most 2 bits agree wholly in one segment while the segment that follows it (cyclically) differs in at
most one bit. The Golay code is perfect: each 23-bit word is within 3 bits of one codeword, whose 12-bit index is its
nearest key; the codewords within 4 bits give one key or six. Words one bit apart share the nearest key of either and
a key of the other. So a bucket is a whole segment and a key of the next; candidates are a fingerprint by its nearest
key and another by any of its keys, verified by counting differing bits.

A bucket of more than ``most`` candidates isn't paired: its members get the 65 words within one bit as keys. Two
fingerprints are within 2 bits exactly if they share such a word, so its (at most 65) holders are linked as a star,
which has the same components. Copies are counted once: everything works on distinct fingerprints.

Word similarity (``similar_groups``). 64 bits of a plain SimHash can't state a Jaccard similarity of 0.8: such texts differ
in 10 bits on average, and copies with one changed word in 240 in 4. So this mode takes weighted SimHashes: a
fingerprint has ``segments`` segments of 23 bits, each with its own weights of the shingles (u**-8, with u uniform by
the shingle's hash), so that a segment is ruled by a few shingles and two texts agree in a share of their segments that
is about their similarity. Each segment is decoded to its Golay codeword's index; errors fall into some segments only
(pigeonhole), so each of ``keys`` keys joins the indices of ``together`` segments. Candidates of a bucket are verified by
the Jaccard similarity of their whole shingle sets, so nothing below the limit is linked. At 0.8 a pair shares no key with a
probability of about 0.002, at 0.9 of under 0.0001. Texts of one shingle set are one class. In a bucket each class is compared
with the bucket's least only.

What the keys leave out is found exactly (``_left_out``). Sets of n shingles that are similar enough share one of the first
n - ceil(similarity * n) + 1 of them, in any order that all sets have in common: by hash, and shingles of many texts last,
the more frequent the later. So copies of one text with changes begin with what their changes made. Of the holders of a
shingle each is first compared with the one that has the fewest shingles before it, by its size: the copy with the fewest
changes. Two copies similar to each other are similar to this one unless their changes have shingles in common, so large
groups are linked by one comparison a copy. Then all pairs between components are compared, without a bound, by the places
of the shingle they share, which tell those with too many changes; few are left, except for crowds of texts that share most
of their shingles just below the limit and of which no text is the common one.
Before whole sets, parities are compared: a bit tells whether an odd number of a set's shingles fall on it. Each differing
bit takes a shingle that only one of the two sets has, so pairs with more such bits than they may have such shingles go.

Defined results: null and empty texts have fingerprint zero; a null doc_id is linked like others, a component of only
null ids has a null component_id; repeated rows are all returned; an empty table gives an empty result; other columns
are ignored. ``similar_groups``: texts without words are one class, similar to no other; ids must be unique and not null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..plans.lineage import cut, finished
from .common import small_batches, small_broadcasts

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; ASCII letters lower-cased."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    h, joined = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) <= shingle:
        return h(joined(tokens), SEED)
    parts = [tokens[i:] for i in range(shingle)]
    hashes = np.array([h(joined(s), SEED) for s in zip(*parts)], dtype=np.uint64)
    # per byte of the hash a count of its 256 values; bits follow from those
    as_bytes, half = hashes.view(np.uint8).reshape(-1, 8), len(hashes) / 2
    if len(hashes) < 256:
        counts = _BITS[as_bytes].sum(axis=0, dtype=np.int64)
    else:
        held = np.bincount((as_bytes + (np.arange(8, dtype=np.int64) << 8)).ravel(), minlength=2048).reshape(8, 256)
        counts = held @ _BITS.astype(np.int64)
    return int(np.packbits(counts.ravel() > half, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


class Golay:
    """The [23, 12, 7] code by its generator polynomial; tables follow from the rule."""

    GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

    def __init__(self) -> None:
        remainder = np.array([self._mod(1 << i) for i in range(23)], dtype=np.int32)
        self.table = np.zeros((3, 256), dtype=np.int32)  # syndrome by byte of the word
        for byte in range(3):
            for bit in range(min(8, 23 - 8 * byte)):
                has = (np.arange(256) >> bit) & 1
                self.table[byte] ^= has.astype(np.int32) * remainder[8 * byte + bit]
        self.leader = np.zeros(2048, dtype=np.int32)
        self.further = np.full((2048, 5), -1, dtype=np.int32)
        filled = np.zeros(2048, dtype=np.int32)
        for weight in (1, 2, 3, 4):
            for places in combinations(range(23), weight):
                error, s = sum(1 << p for p in places), int(np.bitwise_xor.reduce(remainder[list(places)]))
                if weight < 4:
                    self.leader[s] = error
                else:
                    self.further[s, filled[s]] = error
                    filled[s] += 1

    @classmethod
    def _mod(cls, word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= cls.GENERATOR << (bit - 11)
        return word

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        return self.table[0, words & 255] ^ self.table[1, words >> 8 & 255] ^ self.table[2, words >> 16]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (upper 12 bits) of the codeword within 3 bits."""
        return (words ^ self.leader[self.syndromes(words)]) >> 11

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index) of each codeword within 4 bits."""
        s = self.syndromes(words)
        at, k = np.nonzero(self.further[s] >= 0)
        return np.concatenate([np.arange(len(words)), at]), np.concatenate([(words ^ self.leader[s]) >> 11, (words[at] ^ self.further[s[at], k]) >> 11])


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18))]


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    code = Golay()
    for batch in batches:
        fp = batch["fp"].to_numpy(np.int64)
        parts = _segments(fp)
        for i in range(3):
            whole, fuzzy = parts[i], parts[(i + 1) % 3]
            at, key = code.near(fuzzy)
            bucket = (np.int64(i) << 35) | (whole[at] << 12) | key
            first = np.arange(len(at)) < len(fp)  # the nearest key of each
            yield pd.DataFrame({"bucket": bucket, "fp": fp[at], "nearest": first})


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        fp = batch["fp"].to_numpy(np.int64)
        yield pd.DataFrame({"key": (fp.view(np.uint64)[:, None] ^ flips).view(np.int64).ravel(), "fp": np.repeat(fp, 65)})


def links(fps: DataFrame, most: int = 256) -> DataFrame:
    """fps: distinct fp (long). Links u, v that have the components of all pairs within 2 bits."""
    rows = cut(fps.mapInPandas(_buckets, "bucket long, fp long, nearest boolean"))
    sizes = rows.groupBy("bucket").agg(F.count_if("nearest").alias("a"), F.count(F.lit(1)).alias("b")).where("a > 0 and b > 1")
    shared = cut(sizes)
    large = shared.where(F.col("a") * F.col("b") > most)
    few = rows.join(shared.where(F.col("a") * F.col("b") <= most).select("bucket"), "bucket", "left_semi")
    few = cut(few)
    a, b = few.where("nearest").select("bucket", F.col("fp").alias("u")), few.select("bucket", F.col("fp").alias("v"))
    found = a.join(b, "bucket").where("u <> v and bit_count(u ^ v) <= 2").select("u", "v")
    if large.isEmpty():
        return found
    hot = rows.join(large.select("bucket"), "bucket", "left_semi").select("fp").distinct()
    stars = hot.mapInPandas(_stars, "key long, fp long").groupBy("key").agg(F.collect_set("fp").alias("s")).where("size(s) > 1")
    return found.unionByName(stars.select(F.array_min("s").alias("u"), F.explode("s").alias("v")))


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, most: int = 256) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, keep (one row of each component has it)."""
    small_batches(docs.sparkSession)
    base = cut(docs.select("doc_id", fingerprints(F.coalesce("text", F.lit(""))).alias("fp"), F.monotonically_increasing_id().alias("uid")))
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid")
    classes = cut(base.groupBy("fp").agg(F.min(row).alias("w")))
    roots = components(links(classes.select("fp"), most))
    member = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "w", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("w").alias("least"))
    known = member.join(least, "root").select("fp", "least")
    return base.join(known, "fp").select(
        "doc_id", hex64(F.col("fp")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"), (F.col("uid") == F.col("least.uid")).alias("keep")
    )


_HEAVY, _POWER = 4, 8
#: One in so many texts is counted to order shingles by how frequent they are; so many of the most frequent are put last.
_SHARE, _LATE = 8, 1 << 20
#: So many links (16 bytes each) are joined in one task.
_FEW = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, worked out once; it starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str | None, shingle: int, known: _Words) -> np.ndarray:
    """Distinct shingle hashes in order (a text of fewer words is one shingle)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = max(1, len(words) - shingle + 1)
    out = np.full(n, np.uint64(min(shingle, len(words))))
    for k in range(min(shingle, len(words))):  # each place has a multiplier of its own
        out += words[k : k + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64))
    return np.unique(_mixed(out))


def _heaviest(s: np.ndarray, segments: int) -> np.ndarray:
    """segments x ``_HEAVY``: the least u of the shingles (the heaviest), filled with the greatest number."""
    a, b = _multipliers(segments)
    out = np.full((segments, _HEAVY), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 1 << 14):
        u = a * s[at : at + (1 << 14)] + b
        if u.shape[1] > _HEAVY:
            u = np.partition(u, _HEAVY - 1, axis=1)[:, :_HEAVY]
        out = np.sort(np.concatenate([out, u], axis=1), axis=1)[:, :_HEAVY] if at else np.concatenate([u, out[:, u.shape[1] :]], axis=1)
    return out


def weighted_segments(sets: list[np.ndarray], segments: int) -> np.ndarray:
    """texts x segments: 23 bits each, the weighted SimHash of a text's shingles, by its ``_HEAVY`` heaviest ones."""
    if not sets:
        return np.zeros((0, segments), np.int64)
    u = np.stack([_heaviest(s, segments) for s in sets])
    weight = ((u.min(axis=2, keepdims=True).astype(np.float32) + 1) / (u.astype(np.float32) + 1)) ** _POWER
    bits = np.unpackbits(_mixed(u).view(np.uint8).reshape(*u.shape, 8)[..., :3], axis=-1, bitorder="little")[..., :23]
    on = np.einsum("tsh,tshb->tsb", weight, bits.astype(np.float32)) > weight.sum(axis=2, keepdims=True) / 2
    return (on << np.arange(23)).sum(axis=2)


@cache
def _multipliers(segments: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 63, (segments, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1), draw.integers(0, 1 << 63, (segments, 1), dtype=np.uint64)


def subsets(segments: int, size: int, count: int) -> list[list[int]]:
    """``count`` sets of segments, each segment as often as any other, drawn with a fixed seed."""
    draw, deck, out = np.random.default_rng([SEED, size]), [], []
    for _ in range(count):
        while len(set(deck)) < size:
            deck += draw.permutation(segments).tolist()
        out.append(sorted(list(dict.fromkeys(deck))[:size]))
        for x in out[-1]:
            deck.remove(x)
    return out


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *parts]))


def prefix_size(n: int, similarity: float) -> int:
    """Of a set of n, how many elements can't all be missing in a similar one."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def parities(s: np.ndarray) -> np.ndarray:
    """64-bit words of as many bits as ``s`` has elements or up to twice as many (a power of two, 256 at least): 1 where an odd
    number of elements fall. Half the bits follow by XOR of the two halves."""
    bits = max(256, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """Bits that differ between ``parities`` of sets of which one has at most twice the elements of the other."""
    half = lambda x: F.transform(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), lambda y, k: y.bitwiseXOR(F.get(x, k + (F.size(x) / 2).cast("int"))))
    as_small = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    return F.aggregate(F.zip_with(as_small(a, b), as_small(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)


def _signatures(shingle: int, segments: int):
    def run(texts: pa.Array) -> pa.Array:
        code, known = Golay(), _Words()
        sizes, classes, words, held = [], [], [], []
        for t in texts:  # one text at a time as a Python string
            s = shingle_set(t.as_py(), shingle, known)
            sizes.append(len(s))
            classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if len(s):
                held.append(s)
            if len(held) == 64:
                words.append(weighted_segments(held, segments))
                held = []
        index = iter(code.nearest(np.concatenate([*words, weighted_segments(held, segments)]).astype(np.int64)).astype(np.int64))
        codes = [next(index) if n else np.zeros(0, np.int64) for n in sizes]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(classes, pa.binary()), _lists(codes)], ["n", "class", "code"])

    return F.arrow_udf(run, "n int, class binary, code array<bigint>")


def _sets(shingle: int):
    def run(texts: pa.Array) -> pa.Array:
        known = _Words()
        return _lists([shingle_set(t.as_py(), shingle, known).view(np.int64) for t in texts])

    return F.arrow_udf(run, "array<bigint>")


def _firsts(shingle: int, similarity: float, late: Broadcast):
    """first: the first shingles of a text in the order that puts ``late`` ones (sorted; with their places) after all others;
    parity: its set's ``parities``."""
    def run(texts: pa.Array) -> pa.Array:
        known, firsts, parity = _Words(), [], []
        keys, place = late.value
        for t in texts:
            s = shingle_set(t.as_py(), shingle, known)
            parity.append(parities(s))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                is_late = keys[at] == s
                s = np.concatenate([s[~is_late], s[is_late][np.argsort(place[at[is_late]])]])
            firsts.append(s[: prefix_size(len(s), similarity)].view(np.int64))
        return pa.StructArray.from_arrays([_lists(firsts), _lists(parity)], ["first", "parity"])

    return F.arrow_udf(run, "first array<bigint>, parity array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return cut(both.where(F.col("common") >= F.lit(similarity) * (F.col("total") - F.col("common")) - 1e-9).select("u", "v"))


def _keys(of: DataFrame, chosen: list[list[int]]) -> DataFrame:
    """key, node, n: one row for each set of segments."""
    key = lambda k, some: F.xxhash64(F.lit(k), *(F.col("code")[i] for i in some))
    return of.select("node", "n", F.explode(F.array(*(key(k, some) for k, some in enumerate(chosen)))).alias("key"))


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, segments: int = 32, together: int = 5, keys: int = 40, most: int = 64) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id), keep (one row of each component has it)."""
    spark = docs.sparkSession
    small_batches(spark)
    small_broadcasts(spark)

    def grouped() -> DataFrame:
        base = cut(docs.select("doc_id", _signatures(shingle, segments)(F.coalesce("text", F.lit(""))).alias("g")).select("doc_id", "g.*"))
        classes = cut(
            base.groupBy("class").agg(F.min(F.struct("doc_id", "n", "code")).alias("w"))
            .select("class", "w.*", F.monotonically_increasing_id().alias("node"))
        )
        roots = finished(spark, lambda: _by_keys(docs, classes, similarity, shingle, segments, together, keys))
        roots = finished(spark, lambda: _left_out(docs, classes, roots, similarity, shingle, most))
        member = classes.select("class", "doc_id", "node").join(roots, "node", "left").select("class", "doc_id", F.coalesce("root", "node").alias("root"))
        least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        known = member.join(least, "root").select("class", "component_id")
        return base.select("doc_id", "class").join(known, "class").select("doc_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("keep"))

    return finished(spark, grouped)


def _by_keys(docs: DataFrame, classes: DataFrame, similarity: float, shingle: int, segments: int, together: int, keys: int) -> DataFrame:
    """node, root of the classes that are linked to the least class of a bucket."""
    alike = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9
    rows = _keys(classes.where("n > 0"), subsets(segments, together, keys))
    # partial aggregation: a task sends a key once, however often it occurs
    shared = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1")
    buckets = cut(rows.join(shared, "key").select("key", "node", "n", "lead"))
    stars = buckets.where((F.col("node") != F.col("lead.node")) & alike(F.col("n"), F.col("lead.n"))).select(F.col("lead.node").alias("u"), F.col("node").alias("v"), "key")
    sets = cut(_texts(docs, classes, stars.select(F.explode(F.array("u", "v")).alias("node")).distinct()).select("node", _sets(shingle)("text").alias("s")))
    # an eighth of the keys joins most of a large group; then only pairs that are apart are compared
    some = F.pmod(F.xxhash64("key"), F.lit(8)) == 0
    roots = _joined(None, _verified(stars.where(some).select("u", "v").distinct(), sets, similarity))
    return _joined(roots, _verified(_apart(stars.where(~some), roots), sets, similarity))


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the classes in ``nodes``."""
    picked = classes.join(nodes, "node", "left_semi").select("doc_id", "node")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").select("node", "text")


def _shared(places: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """key, node, n, at, root, lead of the shingles of ``places`` (key, node, n, at) that nodes of several components hold;
    lead: the node with the fewest shingles before this one, by its size."""
    placed = places.join(roots, "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    least = F.struct((F.col("at") - F.lit((1 - similarity) / (1 + similarity)) * F.col("n")).alias("w"), "node", "n", "at", "root")
    # partial aggregation: what one component holds alone goes here
    several = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min(least).alias("lead")).where("a <> b")
    return cut(placed.join(several.select("key", "lead"), "key"))


def _left_out(docs: DataFrame, classes: DataFrame, roots: DataFrame, similarity: float, shingle: int, most: int) -> DataFrame:
    """node, root when all pairs of nodes of different components that are similar enough are linked too."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    # which shingles come late is only a matter of speed, any choice is right if it's one for all sets: those of many texts
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SHARE)) == 0).select(F.explode(_sets(shingle)(text)).alias("key"))
    often = some.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > max(1, most // _SHARE))
    late = often.orderBy(F.desc("df"), "key").limit(_LATE).select("key").toArrow()["key"].to_numpy().view(np.uint64)[::-1]
    order = np.argsort(late)
    late = spark.sparkContext.broadcast((late[order], order))  # keys, and their places from the least frequent on
    firsts = docs.select("doc_id", _firsts(shingle, similarity, late)(text).alias("f")).select("doc_id", "f.*")
    firsts = cut(classes.where("n > 0").select("doc_id", "node", "n").join(firsts, "doc_id").select("node", "n", "first", "parity"))

    # the first shingle that two sets share is followed by enough in both
    def near(n: Column, at: Column, n2: Column, at2: Column) -> Column:
        return F.least(n - at, n2 - at2) >= F.lit(similarity / (1 + similarity)) * (n + n2) - 1e-6

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (firsts.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity")) for c in "uv")
        apart = F.lit((1 - similarity) / (1 + similarity)) * (F.col("u_n") + F.col("v_n")) + 1e-6
        pairs = cut(pairs.join(a, "u").join(b, "v").where(differing(F.col("u_parity"), F.col("v_parity")) <= apart).select("u", "v"))
        if pairs.isEmpty():
            return pairs
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        return _verified(pairs, cut(_texts(docs, classes, nodes).select("node", _sets(shingle)("text").alias("s"))), similarity)

    n, at = F.col("n"), F.col("at")
    # of a text's copies with changes, the one with the fewest is similar to most; what is similar to it needs no pairs
    places = _shared(firsts.select("node", "n", F.posexplode("first").alias("at", "key")), roots, similarity)
    stars = places.where((F.col("root") != F.col("lead.root")) & near(n, at, F.col("lead.n"), F.col("lead.at")))
    roots = _joined(roots, linked(cut(stars.select(F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v")).distinct())))
    places = _shared(places.select("key", "node", "n", "at"), roots, similarity)
    other = places.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "at", "root")))
    # of two components one isn't the lead's, which holds most of a large group: its own pairs aren't even formed
    apart = places.where("root <> lead.root").join(other, "key").where("root <> root2 and (root2 = lead.root or node < node2)")
    pairs = apart.where(near(n, at, F.col("n2"), F.col("at2"))).select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v"))
    return _joined(roots, linked(cut(pairs.distinct())))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs u, v whose components differ."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    both = pairs.select("u", "v").distinct().join(root("u"), "u", "left").join(root("v"), "v", "left")
    return both.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root of the components of ``links`` and those found before.

    Links are first moved to the roots known, and a node that is only ever the greater of its links to the least of its
    neighbours: of a large group, whose members mostly have links to a few leading ones, the rounds see only these.
    Few links (counted) are joined in one task.
    """
    if roots is not None:
        if links.isEmpty():
            return roots
        own = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        links = links.join(own("u"), "u", "left").join(own("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    pairs = cut(links.where("u <> v").select(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).distinct())
    if pairs.count() <= _FEW:
        new = components(pairs.select(F.col("low").alias("u"), F.col("high").alias("v")), _FEW)
    else:
        leaves = cut(pairs.groupBy("high").agg(F.min("low").alias("least")).join(pairs.select(F.col("low").alias("high")).distinct(), "high", "left_anti"))
        core = pairs.join(leaves, "high", "left").select("low", F.coalesce("least", "high").alias("other")).where("low <> other").select(F.col("low").alias("u"), F.col("other").alias("v"))
        found = cut(components(core))
        to = found.select(F.col("node").alias("least"), F.col("root").alias("to"))
        hung = leaves.join(to, "least", "left").select(F.col("high").alias("node"), F.coalesce("to", "least").alias("root"))
        tops = leaves.select(F.col("least").alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
        new = cut(found.unionByName(hung).unionByName(tops))
    if roots is None:
        return new
    moved = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(known.unionByName(new.join(roots.select("node"), "node", "left_anti")))
