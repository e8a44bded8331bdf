"""Suffix-array dedup: remove bytes covered by a 100-byte string that also starts earlier.

Equal 100-byte windows must meet in one task without sending every suffix anywhere:

1. *Anchors.* In each window the 40-byte gram of least hash (leftmost on ties) is its anchor, so equal windows have
   equal anchors at equal places. Consecutive windows share an anchor; a run of them is one anchor entry.
2. *Which anchors repeat.* Tasks send packed hashes by bucket, each hash once per task with a mark if the task itself
   holds it twice and how often; answers say which entries repeat. A hot anchor costs a task one entry. Anchors that
   occur more than ``spread`` times are marked as hot for everyone who holds them.
3. *Segments.* Documents with repeated anchors are joined with their text; the bytes of each repeated run are cut out.
   Equal segments are combined in the task (the earliest stays, the others' windows are known to be repeats), and the
   rest goes to the bucket of its anchor. A hot anchor may have very many different segments (one passage, each time
   in other surroundings), so its segments are cut into pairs of windows, which go to the bucket of the ``depth - 1``
   bytes that both windows hold. Segments that meet there differ in their outermost bytes only: 66,048 at most.
4. *Transforms.* A bucket combines equal segments again. Anchors left with several different segments get shard
   Burrows-Wheeler transforms, merged by interleave refinement (``bwt``); intervals of 100 common bytes give each
   repeated window its first start. Suffixes are sorted within shards only; the merge distributes by counting.
5. *Removal.* Repeat runs are joined with the documents that have some; their covered bytes go.

Order of starts: doc_id (null last), then place. Rows that repeat both doc_id and text count as one document, each row
gets its result; rows of one doc_id and different texts are ordered by their text's hash. Null text is empty; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated
from ..plans.lineage import cut

GRAM = 40
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SHIFT, _LOW = np.uint64(29), np.uint64((1 << 23) - 1)
_AT_ONCE = 1 << 20


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes (a multiple of 8) at each place; raw is contiguous and long enough."""
    n = len(raw) - GRAM + 1
    word = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = word[:n] * _MIX[0]
    for k in range(1, GRAM // 8):
        h ^= h >> _SHIFT
        h += word[8 * k : 8 * k + n]
        h *= _MIX[k % 4]
    h ^= h >> _SHIFT
    return h


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(document, anchor place, first window, last window, hash) of each run; places are in the joined ``raw``."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(raw) < depth:
        return none
    h = gram_hashes(raw)
    width, reach = depth - GRAM + 1, 1
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # joined texts are under 2^23 bytes, else one alone
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & _LOW).astype(np.int64)
    valid = np.zeros(len(at) + 1, dtype=np.int8)
    long = ends - starts >= depth
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - depth + 1, -1)
    window = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(window):
        return none
    place = at[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    place = place[first]
    return np.searchsorted(ends, place, side="right"), place, window[first], window[last], h[place]


def _joined(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to about _AT_ONCE bytes: (number of the first, bytes, starts, ends)."""
    i = 0
    while i < len(texts):
        k, size = i, 0
        while k < len(texts) and (k == i or size + len(texts[k]) <= _AT_ONCE):
            size += len(texts[k])
            k += 1
        ends = np.cumsum([len(t) for t in texts[i:k]])
        yield i, np.frombuffer(b"".join(texts[i:k]), dtype=np.uint8), ends - np.diff(ends, prepend=0), ends
        i = k


def _text_anchors(texts: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
    """Anchor runs of each text, places in the text; texts over 4 MB are taken in overlapping pieces."""
    out = []
    for i, raw, starts, ends in _joined(texts):
        if len(raw) <= 1 << 22:
            d, place, first, last, h = anchors(raw, starts, ends, depth)
            out.append((d + i, place - starts[d], first - starts[d], last - starts[d], h))
            continue
        step = (1 << 22) - depth + 1  # windows of one piece; a run may be cut in two, which does no harm
        for at in range(0, len(raw) - depth + 1, step):
            part = np.ascontiguousarray(raw[at : at + step + depth - 1])
            d, place, first, last, h = anchors(part, np.zeros(1, np.int64), np.array([len(part)]), depth)
            out.append((d + i, place + at, first + at, last + at, h))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else anchors(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), depth)


def _encoded(batch: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch["text"]]


_ANSWER = "origin long, kind int, a binary, b binary, c binary, d binary"
_ASK = f"bucket int, {_ANSWER}"


def _asks(depth: int, buckets: int):
    """Kind 0: a = hashes, b = 1 if the task holds it twice or more, c = number of the first such anchor, d = how often
    it holds those of b. Kind 1: a = documents, b = 1 if the task holds the anchor twice or more, c = anchors of each
    document, d = number of the first equal anchor for those of b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seq = TaskContext.get().partitionId(), 0
        held: list = []

        def flush() -> pd.DataFrame:
            nonlocal seq
            origin = task * 1_000_000 + seq
            seq += 1
            ids, xs, counts, hashes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(hashes, kind="stable")
            h = hashes[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(h)))
            many = times > 1
            rows = []
            known = np.ones(len(h), dtype=bool)
            known[order[first[~many]]] = False
            u, ref = h[first], order[first].astype(np.uint32)
            leader = np.empty(len(h), dtype=np.uint32)
            leader[order] = np.repeat(ref, times)
            rows.append((int(origin % buckets), origin, 1, ids.tobytes() + xs.tobytes(), np.packbits(known).tobytes(), counts.astype(np.int64).tobytes(), leader[known].tobytes()))
            to = (u % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                at = by[cuts[k] : cuts[k + 1]]
                rows.append((int(k), origin, 0, u[at].tobytes(), np.packbits(many[at]).tobytes(), ref[at].tobytes(), times[at][many[at]].astype(np.uint32).tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "origin", "kind", "a", "b", "c", "d"])

        size = 0
        for batch in batches:
            d, _, _, _, h = _text_anchors(_encoded(batch), depth)
            held.append((batch["doc"].to_numpy(np.int64), batch["x"].to_numpy(np.int64), np.bincount(d, minlength=len(batch)), h))
            size += len(h)
            if size > 2_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _answers(spread: int):
    """a: the references whose hash occurs elsewhere, b: those (or a task's first) of hashes that occur over ``spread``
    times; document lists pass through."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks, passed = group[group["kind"] == 0], group[group["kind"] == 1]
        rows = list(passed[["origin", "kind", "a", "b", "c", "d"]].itertuples(index=False, name=None))
        if len(asks):
            h = [np.frombuffer(a, dtype=np.uint64) for a in asks["a"]]
            ends = np.cumsum([len(x) for x in h])
            many = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=len(x)).astype(bool) for b, x in zip(asks["b"], h)])
            h = np.concatenate(h)
            ref = np.concatenate([np.frombuffer(c, dtype=np.uint32) for c in asks["c"]])
            times = np.ones(len(h), dtype=np.int64)
            times[many] = np.concatenate([np.frombuffer(d, dtype=np.uint32) for d in asks["d"]])
            order = np.argsort(h, kind="stable")
            s = h[order]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            total, size = np.add.reduceat(times[order], first), np.diff(np.append(first, len(s)))
            shared, hot = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
            shared[order] = np.repeat(total > 1, size)
            hot[order] = np.repeat(total > spread, size)
            shared &= ~many
            for origin, lo, hi in zip(asks["origin"], np.append(0, ends[:-1]), ends):
                part = ref[lo:hi]
                hit, over = part[shared[lo:hi]], part[hot[lo:hi]]
                if len(hit) or len(over):
                    rows.append((int(origin), 0, hit.tobytes(), over.tobytes(), b"", b""))
        return pd.DataFrame(rows, columns=["origin", "kind", "a", "b", "c", "d"])

    return run


def _by_document(group: pd.DataFrame) -> pd.DataFrame:
    """Of one task's documents: which of their anchors repeat, and which are hot (null: none)."""
    lists = group[group["kind"] == 1].iloc[0]
    ids = np.frombuffer(lists["a"], dtype=np.int64)
    counts = np.frombuffer(lists["c"], dtype=np.int64)
    ids, xs = ids[: len(counts)], ids[len(counts) :]
    hit = np.unpackbits(np.frombuffer(lists["b"], dtype=np.uint8), count=int(counts.sum())).astype(bool)
    known, hot = np.flatnonzero(hit), np.zeros(len(hit), dtype=bool)
    answers = group[group["kind"] == 0]
    for a, b in zip(answers["a"], answers["b"]):
        hit[np.frombuffer(a, dtype=np.uint32)] = True
        hot[np.frombuffer(b, dtype=np.uint32)] = True
    hot[known] = hot[np.frombuffer(lists["d"], dtype=np.uint32)]
    ends = np.cumsum(counts)
    sums, hots = (np.concatenate([[0], np.cumsum(x)]) for x in (hit, hot))
    got = np.flatnonzero(sums[ends] > sums[ends - counts])
    stretches = [(ends[k] - counts[k], ends[k]) for k in got]
    return pd.DataFrame({
        "doc": ids[got], "x": xs[got], "hits": [np.packbits(hit[i:k]).tobytes() for i, k in stretches],
        "hot": [np.packbits(hot[i:k]).tobytes() if hots[k] > hots[i] else None for i, k in stretches],
    })


#: With b packed segments (compressed); without b the runs of repeated windows of one document, which pass through.
_SEG = "bucket int, doc long, x long, a binary, b binary"
_RUNS = "doc long, x long, a binary"
NULL_DOC = np.iinfo(np.int64).max


def _run_rows(runs: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple]:
    return [(doc, x, _covered([np.array(r, dtype=np.int64).tobytes()]).tobytes()) for (doc, x), r in runs.items()]


def _pairs(content: bytes, anchor: int, depth: int) -> Iterator[tuple[int, bytes, int]]:
    """(start, bytes, hash of the bytes that both hold) of each pair of windows of a segment; one alone at an end.

    Windows are paired by their distance to the anchor, so equal windows of different segments are paired alike.
    """
    n = len(content) - depth + 1
    for at in range(-(anchor % 2 == 0), n, 2):
        low = max(at, 0)
        yield low, content[low : min(at + 1, n - 1) + depth], xxhash.xxh64_intdigest(content[at + 1 : at + depth])


def _segments(depth: int, buckets: int):
    """b of a segment row: per segment hash, document, x, start, length; a: their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[bytes, tuple[int, int, int, int]] = {}
        hot: dict[bytes, int] = {}  # segments of hot anchors, and where their anchor is
        runs: dict = defaultdict(list)

        def sent(segments: dict[bytes, tuple[int, int, int, int]]) -> pd.DataFrame:
            rows = _packed(segments, buckets) + [(x % buckets, doc, x, a, None) for doc, x, a in _run_rows(runs)]
            segments.clear()
            runs.clear()
            return pd.DataFrame(rows, columns=["bucket", "doc", "x", "a", "b"])

        def flush() -> Iterator[pd.DataFrame]:
            pairs: dict[bytes, tuple[int, int, int, int]] = {}
            for content, anchor in hot.items():
                doc, x, start, _ = best.pop(content)
                for at, pair, h in _pairs(content, anchor, depth):
                    _offer(pairs, runs, pair, (doc, x, start + at, h), depth)
                if len(pairs) > 200_000:
                    yield sent(pairs)
            hot.clear()
            if pairs:
                yield sent(pairs)
            yield sent(best)

        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                texts = _encoded(part)
                d, place, first, last, h = _text_anchors(texts, depth)
                counts = np.bincount(d, minlength=len(part))
                bits = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=int(n)) for x, n in zip(part["hits"], counts)]
                hit = np.concatenate(bits).astype(bool)
                over = [np.zeros(n, dtype=np.uint8) if x is None else np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=int(n)) for x, n in zip(part["hot"], counts)]
                offset = np.where(np.concatenate(over), place - first, -1)
                ids, xs = part["doc"].tolist(), part["x"].tolist()
                for k, f, e, g, anchor in zip(d[hit].tolist(), first[hit].tolist(), last[hit].tolist(), h[hit].tolist(), offset[hit].tolist()):
                    content = texts[k][f : e + depth]
                    _offer(best, runs, content, (ids[k], xs[k], f, g), depth)
                    if anchor >= 0:
                        hot[content] = anchor
                if len(best) > 100_000:
                    yield from flush()
        yield from flush()

    return run


def _offer(best: dict, runs: dict, content: bytes, new: tuple[int, int, int, int], depth: int) -> None:
    """Keep the earliest of equal segments; the windows of the others are repeats."""
    old = best.get(content)
    if old is None:
        best[content] = new
        return
    if new[:3] == old[:3]:
        return
    if new[:3] < old[:3]:
        best[content], new = new, old
    runs[new[:2]].append((new[2], new[2] + len(content)))


def _packed(best: dict[bytes, tuple[int, int, int, int]], buckets: int) -> list[tuple]:
    to: dict[int, list] = defaultdict(list)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for content, v in best.items():
        to[v[3] % buckets].append((content, v))
    rows = []
    for k, items in to.items():
        info = np.array([(v[0], v[1], v[2], len(c)) for c, v in items], dtype=np.int64)
        hashes = np.array([v[3] for _, v in items], dtype=np.uint64)
        rows.append((k, 0, 0, squeeze(b"".join(c for c, _ in items)), squeeze(info.T.tobytes() + hashes.tobytes())))
    return rows


def _bucket(depth: int, block: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        best: dict = {}
        runs: dict = defaultdict(list)
        whole = zstandard.ZstdDecompressor().decompress
        packed = group["b"].notna()
        passed = list(group.loc[~packed, ["doc", "x", "a"]].itertuples(index=False, name=None))
        for a, b in zip(group.loc[packed, "a"], group.loc[packed, "b"]):
            a, b = whole(a), whole(b)
            n = len(b) // 40
            info = np.frombuffer(b, dtype=np.int64, count=4 * n).reshape(4, n).T.tolist()
            at = 0
            for (doc, x, start, length), h in zip(info, np.frombuffer(b, dtype=np.uint64, offset=32 * n).tolist()):
                _offer(best, runs, a[at : at + length], (doc, x, start, h), depth)
                at += length
        by: dict[int, list[bytes]] = defaultdict(list)
        for content, v in best.items():
            by[v[3]].append(content)
        part: list[bytes] = []
        size = 0
        for contents in by.values():
            if len(contents) > 1:  # segments of different anchors never hold equal windows: transforms by whole anchors
                part += contents
                size += sum(map(len, contents))
            if size > block:
                _repeats(part, best, runs, depth)
                part, size = [], 0
        if part:
            _repeats(part, best, runs, depth)
        return pd.DataFrame(passed + _run_rows(runs), columns=["doc", "x", "a"])

    return run


def _repeats(contents: list[bytes], best: dict, runs: dict, depth: int) -> None:
    """Windows that also start earlier, by merged transforms of the segments."""
    contents.sort(key=lambda c: best[c][:3])  # string numbers are then in document order
    interval, string, offset = repeated(contents, depth)
    if not len(interval):
        return
    order = np.lexsort((offset, string, interval))
    interval, string, offset = interval[order], string[order], offset[order]
    start = np.array([best[c][2] for c in contents], dtype=np.int64)[string] + offset
    later = interval[1:] == interval[:-1]
    same = np.zeros(len(interval), dtype=bool)
    same[1:] = later
    at = np.flatnonzero(same)
    by = np.lexsort((start[at], string[at]))
    s, w = string[at][by], start[at][by]
    cuts = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1)))
    ends = np.append(cuts[1:], len(s)) - 1
    for k, a, b in zip(s[cuts].tolist(), w[cuts].tolist(), w[ends].tolist()):
        runs[best[contents[k]][:2]].append((a, b + depth))


def _covered(runs: list[bytes]) -> np.ndarray:
    """Maximal covered stretches: rows of start, end."""
    all_ = np.concatenate([np.frombuffer(r, dtype=np.int64).reshape(-1, 2) for r in runs])
    all_ = all_[np.argsort(all_[:, 0], kind="stable")]
    reach = np.maximum.accumulate(all_[:, 1])
    new = np.flatnonzero(np.append(True, all_[1:, 0] > reach[:-1]))
    return np.stack([all_[new, 0], reach[np.append(new[1:], len(all_)) - 1]], axis=1)


def _removed(outputs: bool):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_runs in batches:
            rows: list[tuple] = []
            for text, runs in zip(texts, all_runs):
                if text is None:
                    rows.append((0, 0, None) + (None, None) * outputs)
                    continue
                raw, spans = text.encode("utf-8", "surrogatepass"), _covered(list(runs))
                kept, at = [], 0
                for a, b in spans.tolist():
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                row = (len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept, spans.ravel().tolist()) if outputs else row)
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 5 if outputs else 3])

    return run


def suffix_dedup(docs: DataFrame, depth: int = 100, outputs: bool = True, block: int = 1 << 16, spread: int = 4096, bucket_bytes: int = 1 << 22) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``outputs`` also kept (binary, null
    if nothing was removed) and spans (start, end, start, end, ...). ``depth`` is a multiple of 4, 64 to 128. Anchors that occur
    more than ``spread`` times are split by their surroundings; groups are as many as the text has ``bucket_bytes``, so
    their size stays the same as the input grows; the result is the same for every value."""
    if depth % 4 or not 64 <= depth <= 128:
        raise ValueError("depth must be a multiple of 4, from 64 to 128")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // bucket_bytes)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_DOC)).alias("doc"), F.xxhash64(text).alias("x"), text.alias("text"))
    keyed = rows.select("doc", "x", "text")
    asked = keyed.where(F.octet_length("text") >= depth).mapInPandas(_asks(depth, buckets), _ASK)
    answers = asked.groupBy("bucket").applyInPandas(_answers(spread), _ANSWER)
    hits = answers.groupBy("origin").applyInPandas(_by_document, "doc long, x long, hits binary, hot binary")
    hits = cut(hits.dropDuplicates(["doc", "x"]))
    found = keyed.join(hits.hint("merge"), ["doc", "x"])
    segments = found.mapInPandas(_segments(depth, buckets), _SEG)
    runs = segments.groupBy("bucket").applyInPandas(_bucket(depth, block), _RUNS).groupBy("doc", "x").agg(F.collect_list("a").alias("runs"))
    kind = "n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<long>" * outputs
    removed = F.pandas_udf(_removed(outputs), kind)
    got = rows.join(runs.hint("merge"), ["doc", "x"], "left").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("runs").isNull(), F.sha2("text", 256)).alias("whole"),
        removed(F.when(F.col("runs").isNotNull(), F.col("text")), "runs").alias("got"),
    )
    more = [F.col(f"got.{c}") for c in ("kept", "spans") if outputs]
    return got.select("doc_id", "n_bytes", "got.n_removed", "got.n_spans", F.coalesce("got.kept_sha256", "whole").alias("kept_sha256"), *more)
