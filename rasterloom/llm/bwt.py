"""Burrows-Wheeler transforms of shards and their merge by interleave refinement, in numpy.

A collection of byte strings is cut into shards. Each string counts as circular with two end marks that sort before
all bytes. A shard's rotations are sorted (to a depth of 128 bytes) by prefix doubling; its transform holds, for each
rotation in order, the four bytes before it. ``merge`` never sorts the union: it keeps an interleave (which shard each
place of the merged order takes its next rotation from) and refines it: a pass distributes the places stably by the
four bytes before them, which turns an order by t bytes into one by t + 4 bytes. Where a pass separates neighbours,
their common prefix is shorter than t + 4; what is left together after ``depth / 4`` passes is a repeated interval.
"""

from __future__ import annotations

import numpy as np

STEP = 4


def stable_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys below 2**bits: the place is put below the key, and the packed numbers are sorted."""
    n = len(keys)
    low = max(1, int(n - 1).bit_length())
    if bits + low > 63:
        return np.argsort(keys, kind="stable")
    packed = (keys.astype(np.int64) << low) | np.arange(n, dtype=np.int64)
    packed.sort()
    return packed & ((1 << low) - 1)


def distributed(keys: np.ndarray) -> np.ndarray:
    """Stable order of unsigned keys by counting: one distribution for each 16 bits, the least significant first (numpy's
    stable order of 16-bit numbers is a radix sort)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, 8 * keys.itemsize, 16):
        order = order[np.argsort((keys >> keys.dtype.type(shift)).astype(np.uint16)[order], kind="stable")]
    return order


class Shard:
    """Sorted rotations of some strings: where each starts, and the four bytes before it."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) + 2 for s in strings], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        text = np.frombuffer(b"\xff\xff".join(strings) + b"\xff\xff", dtype=np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: marks become 0
        n = len(text)
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[ends - 1] = starts
        jump2 = nxt[nxt]
        jump = jump2[jump2]
        rank = text.astype(np.int64)
        rank = (rank << 8) | rank[nxt]
        word = ((rank << 16) | rank[jump2]).astype(np.uint32)  # four bytes from each place
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[starts] = ends - 1
        before = before[before]
        before = before[before]
        rank, bits, depth = word.astype(np.int64), 32, STEP
        while True:
            order = stable_order(rank, bits)
            key = rank[order]
            first = np.empty(n, dtype=np.int64)
            first[0], first[1:] = 0, key[1:] != key[:-1]
            number = np.cumsum(first)
            if depth >= 128 or number[-1] == n - 1:
                break
            rank = np.empty(n, dtype=np.int64)
            rank[order] = number
            half = max(1, int(number[-1]).bit_length())
            # rank by `depth` bytes here and `depth` bytes on give the rank by twice as many
            rank, bits = (rank << half) | rank[jump], 2 * half
            jump, depth = jump[jump], depth * 2
        self.before = word[before][order]
        self.string = np.repeat(np.arange(len(strings)), lengths)[order]
        self.offset = order - starts[self.string]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, interval): each merged place's shard, and the number of its interval of ``depth`` common bytes."""
    take = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.before) for s in shards])
    before = np.concatenate([s.before for s in shards])
    interval = np.zeros(len(take), dtype=np.int32)
    symbol = before.copy()
    split = np.zeros(len(take), dtype=bool)
    for _ in range(depth // STEP):
        if len(shards) > 1:  # the places of a shard, in order, take its rotations in order
            symbol[distributed(take)] = before
        place = distributed(symbol)
        take, was, ordered = take[place], interval[place], symbol[place]
        np.not_equal(ordered[1:], ordered[:-1], out=split[1:])
        split[1:] |= was[1:] != was[:-1]
        interval = np.cumsum(split, dtype=np.int32)
    return take, interval


def repeated(strings: list[bytes], depth: int, shard_bytes: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, string, offset) of every ``depth``-byte window that occurs more than once, by interval."""
    shards, part, size, bases = [], [], 0, []
    for i, s in enumerate(strings):
        if not part:
            bases.append(i)
        part.append(s)
        size += len(s) + 2
        if size >= shard_bytes or i == len(strings) - 1:
            shards.append(Shard(part))
            part, size = [], 0
    take, interval = merge(shards, depth)
    string, offset = np.empty(len(take), dtype=np.int64), np.empty(len(take), dtype=np.int64)
    for k, (s, base) in enumerate(zip(shards, bases)):
        own = take == k
        string[own], offset[own] = s.string + base, s.offset
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    keep = (np.bincount(interval)[interval] > 1) & (offset + depth <= lengths[string])
    return interval[keep], string[keep], offset[keep]
