"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are split by a pattern; the distinct pieces of a batch are encoded together. Pieces are bucketed by length into
padded matrices, one piece a row, ids of single bytes at first. Each round, every row merges its leftmost pair of
minimum rank: a pair's rank and result come from a hash table of id pairs (open addressing in numpy arrays), and a
merge is a compaction: what follows moves one place left. Rows without a pair to merge leave the matrix. Pieces of over
``2 * LONG`` bytes would move too much that way; all of a batch are rows of one ragged matrix, a line of ids linked to their
neighbours, with the places of each rank kept in lists. A round takes the least rank of all rows and merges its
occurrences, left to right, except in rows where a new pair would rank below it (there only the leftmost, the others
after it), which gives every row the same ids as one merge a round; only pairs beside a merge are looked up. The cost
follows the bytes, whatever they are.

Ranks come from a file of base64 tokens and ranks, one a line; its path is a parameter. It is read by the driver and
broadcast (its size is the vocabulary's, under 1 MB for 50,000 tokens).

Defined results: null text counts as empty and has no ids; lone surrogates can't occur in Spark strings; any bytes are
encodable if the 256 single bytes have ranks, which is checked; an empty table gives an empty result; other columns
are ignored, repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LONG = 64
_AT_ONCE = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Hash table from a pair of ids to the id (which is the rank) that they merge to; -1 where they don't."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        self.probes = 1
        todo, step = np.arange(len(keys)), 0
        while len(todo):  # insert all at once: of those that want one free slot, one gets it, the rest go on
            slot = (self._slot(keys[todo]) + step) & ((1 << self.bits) - 1)
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, won = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = won[free[won]]
            self.keys[slot[won]], self.values[slot[won]] = keys[todo[won]], np.array(merged, dtype=np.int32)[todo[won]]
            todo = np.delete(todo, won)
            step += 1
            self.probes = max(self.probes, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


NONE = np.int32(2**31 - 1)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
        self.ranks, self.pattern, self.table = ranks, regex.compile(pattern), PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ranks(self, m: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair of a matrix padded with -1; NONE where there is no pair to merge."""
        left, right = m[:, :-1], m[:, 1:]
        real = right >= 0
        out = np.full(left.shape, NONE, dtype=np.int32)
        got = self.table.find(left[real], right[real])
        out[real] = np.where(got < 0, NONE, got)
        return out

    def _short(self, m: np.ndarray) -> np.ndarray:
        """Every row merges its leftmost minimum-rank pair each round, until none has one."""
        done = m.copy()
        rows, ranks = np.arange(len(m)), self._ranks(m)
        places = np.arange(m.shape[1])
        while len(rows):
            at = ranks.argmin(axis=1)
            n = np.arange(len(rows))
            least = ranks[n, at]
            live = least != NONE
            done[rows[~live]] = -1
            done[rows[~live], : m.shape[1]] = m[~live]
            rows, m, ranks, at, least = rows[live], m[live], ranks[live], at[live], least[live]
            if not len(rows):
                break
            n = np.arange(len(rows))
            source = places + (places > at[:, None])  # compaction: the right half of the pair goes
            padded = np.concatenate([m, np.full((len(m), 1), -1, dtype=np.int32)], axis=1)
            m = np.take_along_axis(padded, source, axis=1)
            m[n, at] = least
            padded = np.concatenate([ranks, np.full((len(m), 1), NONE, dtype=np.int32)], axis=1)
            ranks = np.take_along_axis(padded, source[:, :-1], axis=1)
            for side in (-1, 0):  # only the pairs on both sides of the merge are new
                k = at + side
                ok = (k >= 0) & (k < ranks.shape[1])
                a, b = m[n[ok], k[ok]], m[n[ok], np.minimum(k[ok] + 1, m.shape[1] - 1)]
                got = self.table.find(a, np.maximum(b, 0))
                ranks[n[ok], k[ok]] = np.where((b < 0) | (got < 0), NONE, got)
        return done

    def _long(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of long rows of single-byte ids."""
        lengths = np.array([len(r) for r in rows])
        ids, row = np.concatenate(rows).astype(np.int32), np.repeat(np.arange(len(rows)), lengths)
        n = len(ids)
        after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        after[ends - 1], before[ends - lengths] = -1, -1
        alive = np.ones(n, dtype=bool)
        got = np.full(n, -1, dtype=np.int32)  # rank of the pair that begins here
        pairs = np.flatnonzero(after >= 0)
        got[pairs] = self.table.find(ids[pairs], ids[after[pairs]])
        held: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[got[places] >= 0]
            if not len(places):
                return
            ranks = got[places]
            by = np.argsort(ranks, kind="stable")
            places, ranks = places[by], ranks[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(places, cuts), ranks[np.append(0, cuts)].tolist()):
                if rank not in held:
                    held[rank] = []
                    heapq.heappush(order, rank)
                held[rank].append(part)

        put(pairs)
        while order:
            rank = heapq.heappop(order)
            at = np.unique(np.concatenate(held.pop(rank)))
            at = at[got[at] == rank]
            if not len(at):
                continue
            # of overlapping occurrences (a pair of equal ids) every second of each stretch
            new = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            nth = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
            every, at = at, at[nth % 2 == 0]
            while True:
                right = after[at]
                left, beyond = before[at], after[right]
                # a neighbour that is merged in this round too has the new id
                merged_left = (left >= 0) & np.isin(left, right)
                left = np.where(merged_left, before[left], left)
                merged_beyond = (beyond >= 0) & np.isin(beyond, at)
                a, b = np.where(merged_left, rank, ids[left]), np.where(merged_beyond, rank, ids[beyond])
                first = np.full(len(at), rank, dtype=np.int32)
                new_left = np.where(left >= 0, self.table.find(a, first), np.int32(-1))
                new_right = np.where(beyond >= 0, self.table.find(first, b), np.int32(-1))
                # one after the other a merge meets its neighbour on the right as it is before that one's merge
                meets = np.where(merged_beyond, self.table.find(first, np.maximum(ids[beyond], 0)), np.int32(-1))
                below = ((new_left >= 0) & (new_left < rank)) | ((new_right >= 0) & (new_right < rank)) | ((meets >= 0) & (meets < rank))
                one = np.unique(row[at], return_index=True)[1]
                alone = np.zeros(len(at), dtype=bool)
                alone[one] = True
                wait = ~alone & np.isin(row[at], row[at[below]])
                if not wait.any():
                    break
                held.setdefault(rank, []).append(every[np.isin(row[every], row[at[wait]])])  # what is merged now is told by its rank
                at = at[~wait]
            if rank in held:
                heapq.heappush(order, rank)
            alive[right], got[right] = False, -1
            ids[at], after[at] = rank, beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            got[at] = new_right
            got[left[left >= 0]] = new_left[left >= 0]
            put(np.unique(np.concatenate([at, left[left >= 0]])))
        kept = np.add.reduceat(alive, ends - lengths)
        return np.split(ids[alive], np.cumsum(kept)[:-1])

    def _add(self, pieces: list[str]) -> None:
        """Encode pieces not met before."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.array([len(r) for r in raw])
        parts: list = [None] * len(raw)
        counts = np.zeros(len(raw), dtype=np.int64)
        whole = np.array([self.ranks.get(r, -1) for r in raw], dtype=np.int32)
        rest = np.flatnonzero(whole < 0)
        for k in np.flatnonzero(whole >= 0):
            parts[k] = whole[k : k + 1]
            counts[k] = 1
        low = 1
        while low <= LONG:  # buckets of 2, 3-4, 5-8, ... bytes
            members = rest[(lengths[rest] > low) & (lengths[rest] <= 2 * low)]
            for at in range(0, len(members), 1 << 16):
                some = members[at : at + (1 << 16)]
                m = np.full((len(some), 2 * low), -1, dtype=np.int32)
                size = lengths[some]
                m[np.arange(2 * low) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join([raw[k] for k in some]), dtype=np.uint8)]
                m = self._short(m)
                for k, n, row in zip(some, (m >= 0).sum(axis=1), m):
                    parts[k], counts[k] = row[:n], n
            low *= 2
        long = rest[lengths[rest] > low]
        if len(long):
            for k, ids in zip(long, self._long([self.byte_ids[np.frombuffer(raw[k], dtype=np.uint8)] for k in long])):
                parts[k], counts[k] = ids, len(ids)
        base = len(self.known)
        self.known.update(zip(pieces, range(base, base + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.lengths = np.concatenate([self.lengths, counts])
        self.ids = np.concatenate([self.ids, *parts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.known) > 200_000:  # the memory of pieces is only for speed
            self._forget()
        find, known = self.pattern.findall, self.known
        split = [find(t) for t in texts]
        flat = [p for s in split for p in s]
        new = list(set(flat) - known.keys())
        if new:
            self._add(new)
        numbers = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))
        lengths = self.lengths[numbers]
        ids = ragged(self.ids, self.starts[numbers], lengths)
        per_text = np.array([len(s) for s in split], dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(per_text)
        return ids, sums[ends] - sums[ends - per_text]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids."""
        return ragged(self.token_bytes, self.token_starts[ids], self.token_lengths[ids])


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``values`` one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)]


def groups(texts: list[str]) -> Iterator[slice]:
    """Slices of about 260,000 characters, so that a batch of long texts needs no more memory than one of short."""
    i = 0
    while i < len(texts):
        k, size = i, 0
        while k < len(texts) and (k == i or size + len(texts[k]) <= _AT_ONCE):
            size += len(texts[k])
            k += 1
        yield slice(i, k)
        i = k


def _run(docs: DataFrame, ranks_path: str, pattern: str, digests: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(held.value, pattern)
        for batch in batches:
            texts, rows = batch.tolist(), []
            for s in groups(texts):
                ids, counts = codec.encode(texts[s])
                raw = codec.decode(ids)
                ends = np.cumsum(counts)
                sums = np.concatenate([[0], np.cumsum(codec.token_lengths[ids])])
                for a, b, n in zip(ends - counts, ends, counts):
                    own, decoded = ids[a:b], raw[sums[a] : sums[b]]
                    if digests:
                        rows.append((n, hashlib.sha256(own.astype("<u4")).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                    else:
                        rows.append((n, own, decoded.tobytes().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=fields)

    udf = F.pandas_udf(run, kind)
    return docs.select("doc_id", udf(F.coalesce("text", F.lit(""))).alias("got")).select("doc_id", "got.*")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded (the text got back from the ids)."""
    return _run(docs, ranks_path, pattern, False)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As ``encode_documents`` with SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded bytes."""
    return _run(docs, ranks_path, pattern, True)
