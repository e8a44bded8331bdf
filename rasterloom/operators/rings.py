"""Rings put in order by list ranking: no task holds a ring.

Pieces of a line (sides of cells, edges of contours) each have a successor. Within a tile they are walked to segments; a segment
ends where the line may leave the tile. Segments are linked to the ones that follow by a join, and ranked by pointer doubling:
a round doubles how far every segment looks ahead, so a ring of n segments takes about log2(n) rounds. A first doubling finds
the least piece ahead, so that each ring is cut before the segment that holds it; a second one sums lengths up to the
end. Once the segments are ``few`` (counted), one task walks them instead. A piece's rank is its segment's start plus
its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.tiling import with_tiles

#: Corners (column, row) from which and to which a cell's top, right, bottom and left sides run, the cell to the right.
CORNERS = np.array([[[0, 0], [1, 0]], [[1, 0], [1, 1]], [[1, 1], [0, 1]], [[0, 1], [0, 0]]])


def walked(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces and the places of their successors (-1: none here): first piece of each one's segment (of a closed one
    the least), place in it, and whether it is closed."""
    n = len(ids)
    head, place, closed = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    starts = np.ones(n, bool)
    starts[after[after >= 0]] = False
    to = after.tolist()
    seen = [False] * n
    for begin, ring in ((np.flatnonzero(starts).tolist(), False), (np.argsort(ids, kind="stable").tolist(), True)):
        for k in begin:
            if seen[k]:
                continue
            way, at = [], k
            while at >= 0 and not seen[at]:
                seen[at] = True
                way.append(at)
                at = to[at]
            head[way], place[way], closed[way] = k, np.arange(len(way)), ring
    return head, place, closed


SEGMENT = "n long, least long, to_x long, to_y long, last_way int"


def _with_segments(out: pd.DataFrame, ids: np.ndarray, after: np.ndarray, way: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """``out`` with seg, pos, closed; on a segment's first piece also what is known of all of it."""
    head, place, closed = walked(ids, after)
    order = np.lexsort((place, head))
    first = np.flatnonzero(np.append(True, head[order][1:] != head[order][:-1])) if len(order) else np.zeros(0, int)
    last = order[np.append(first[1:], len(order)) - 1] if len(order) else first
    begin = order[first]
    out = out.assign(seg=ids[head], pos=place, closed=closed)
    for name, kind in (x.split() for x in SEGMENT.split(", ")):
        out[name] = pd.array(np.zeros(len(out), np.int64), "Int64" if kind == "long" else "Int32")
        out.loc[:, name] = pd.NA
    size = np.diff(np.append(first, len(order)))
    least = np.minimum.reduceat(ids[order], first) if len(order) else first
    for name, values in (("n", size), ("least", least), ("to_x", ends[last, 0]), ("to_y", ends[last, 1]), ("last_way", way[last])):
        out.iloc[begin, out.columns.get_loc(name)] = values
    return out


def ranked(segments: DataFrame, few: int = 1_000_000) -> DataFrame:
    """segments: seg, next (null: the line ends), n, least. Returns seg, ring (the least of the ring's least), offset, total."""
    if segments.count() <= few:
        return _walked_whole(segments)
    # the least piece ahead; what ends says so by a number below all pieces, so whoever gets to see it is open
    look = segments.select("seg", "next", "least", F.when(F.col("next").isNull(), -1 - F.col("seg")).otherwise(F.col("least")).alias("low"))
    while True:
        ahead = look.select(F.col("seg").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        lower = F.coalesce(F.col("low2") < F.col("low"), F.lit(False))
        new = cut(look.join(ahead, "next", "left").select("seg", F.col("next2").alias("next"), "least", F.least("low", "low2").alias("low"), lower.alias("moved")))
        look = new.drop("moved")
        if new.where("moved").isEmpty():  # then every window's least is the next window's, so it is the ring's
            break
    heads = look.where((F.col("low") >= 0) & (F.col("least") == F.col("low"))).select(F.col("seg").alias("next"), F.lit(True).alias("head"))
    line = segments.join(heads, "next", "left").select("seg", F.when(F.col("head").isNull(), F.col("next")).alias("next"), F.col("n").alias("dist"), F.col("seg").alias("end"))
    line = cut(line)
    while not line.where("next is not null").isEmpty():
        ahead = line.select(F.col("seg").alias("next"), F.col("next").alias("next2"), F.col("dist").alias("dist2"), F.col("end").alias("end2"))
        line = cut(line.join(ahead, "next", "left").select("seg", F.col("next2").alias("next"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.coalesce("end2", "end").alias("end")))
    whole = line.join(segments.select("seg", "least"), "seg").groupBy("end").agg(F.max("dist").alias("total"), F.min("least").alias("ring"))
    return line.join(whole, "end").select("seg", "ring", (F.col("total") - F.col("dist")).alias("offset"), "total")


def _walked_whole(segments: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = {s: (None if pd.isna(x) else int(x), int(n), int(low)) for b in batches for s, x, n, low in zip(b["seg"], b["next"], b["n"], b["least"])}
        reached = {x for x, _, _ in of.values() if x is not None}
        done, rows = set(), []
        for start in [s for s in of if s not in reached] + sorted(of, key=lambda s: of[s][2]):
            way, at = [], start
            while at is not None and at not in done:
                done.add(at)
                way.append(at)
                at = of[at][0]
            total, offset, low = sum(of[s][1] for s in way), 0, min((of[s][2] for s in way), default=0)
            for s in way:
                rows.append((s, low, offset, total))
                offset += of[s][1]
        yield pd.DataFrame(rows, columns=["seg", "ring", "offset", "total"], dtype=np.int64)

    return segments.select("seg", "next", "n", "least").coalesce(1).mapInPandas(run, "seg long, ring long, offset long, total long")


def _placed(pieces: DataFrame, links: DataFrame, columns: list[str], few: int) -> DataFrame:
    """``columns`` of pieces with ring, rank, total and closed. links: seg, next, before (way before the segment) of open segments."""
    segments = pieces.where("pos = 0 and not closed").select("seg", "n", "least").join(links.select("seg", "next"), "seg", "left")
    known = cut(ranked(cut(segments), few))
    before = links.where(F.col("next").isNotNull()).select(F.col("next").alias("seg"), F.col("before"))
    of_open = pieces.where("not closed").join(known.join(before, "seg", "left"), "seg")
    turn = lambda before: F.when(F.col("pos") > 0, F.col("turns")).otherwise(F.coalesce(F.col("way") != before, F.lit(True)))
    from_open = of_open.select(*columns, "ring", (F.col("offset") + F.col("pos")).alias("rank"), turn(F.col("before")).alias("turns"))
    alone = pieces.where("closed").select(*columns, F.col("seg").alias("ring"), F.col("pos").alias("rank"), "turns")
    return from_open.unionByName(alone)


def rings_of_sides(sides: DataFrame, height: int, width: int, diagonal: bool, tile: int = 256, few: int = 1_000_000) -> DataFrame:
    """Of ``border_sides``: band, root, value, row, col, side with ring (the least side's number), rank (0 at the ring's
    start, the next side along it 1) and turns (the side goes another way than the one before)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band, root, row, col, side = (pdf[c].to_numpy(np.int64) for c in ("band", "root", "row", "col", "side"))
        ids = ((band * height + row) * width + col) * 4 + side
        begin, end = (CORNERS[side, k] + np.stack([col, row], axis=1) for k in (0, 1))
        inside = (end[:, 0] % tile != 0) & (end[:, 1] % tile != 0)
        regions, region = np.unique(root, return_inverse=True)
        key = lambda at, way: (region * (height + 2) + at[:, 1]) * (width + 2) * 4 + at[:, 0] * 4 + way
        starts = key(begin, side)
        order = np.argsort(starts)
        after = np.full(len(ids), -1, np.int64)
        turn = 3 if diagonal else 1  # where two cells of a region meet in a corner: through it, or round the own cell
        for way in ((side + turn) % 4, side, (side + 4 - turn) % 4):
            wanted = key(end, way)
            at = np.minimum(np.searchsorted(starts[order], wanted), len(order) - 1)
            hit = inside & (after < 0) & (starts[order][at] == wanted)
            after[hit] = order[at][hit]
        turns = np.ones(len(ids), bool)
        some = after >= 0
        turns[after[some]] = side[after[some]] != side[some]
        return _with_segments(pdf[["band", "root", "value", "row", "col", "side"]].assign(id=ids, x=begin[:, 0], y=begin[:, 1], way=side.astype(np.int32), turns=turns), ids, after, side.astype(np.int32), end)

    kind = f"band int, root long, value double, row int, col int, side int, id long, x long, y long, way int, turns boolean, seg long, pos long, closed boolean, {SEGMENT}"
    pieces = cut(with_tiles(sides, (tile, tile)).groupBy("band", "trow", "tcol").applyInPandas(run, kind))
    firsts = pieces.where("pos = 0 and not closed")
    ends = firsts.select("band", "root", F.col("to_x").alias("x"), F.col("to_y").alias("y"), "seg", "last_way")
    starts = firsts.select("band", "root", "x", "y", F.col("seg").alias("next"), "way")
    turn = 3 if diagonal else 1
    first_choice = F.when(F.col("way") == (F.col("last_way") + turn) % 4, 0).when(F.col("way") == F.col("last_way"), 1).otherwise(2)
    links = ends.join(starts, ["band", "root", "x", "y"]).groupBy("seg").agg(F.min_by(F.struct("next", F.col("last_way").alias("before")), first_choice).alias("to"))
    return _placed(pieces, cut(links.select("seg", "to.next", "to.before")), ["band", "root", "value", "row", "col", "side"], few)


def lines_of_edges(edges: DataFrame, tile: int = 256, few: int = 1_000_000) -> DataFrame:
    """edges: id, r, c (the square they lie in), x1, y1, x2, y2 (whole numbers; a point is left by one edge at most and
    reached by one). Returns id, x1, y1, x2, y2, ring (the line's least id), rank."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x1, y1, x2, y2, ids = (pdf[c].to_numpy(np.int64) for c in ("x1", "y1", "x2", "y2", "id"))
        low, high = min(x1.min(), x2.min()), max(x1.max(), x2.max())
        key = lambda x, y: y * (high - low + 1) + x - low
        order = np.argsort(key(x1, y1))
        starts, wanted = key(x1, y1)[order], key(x2, y2)
        at = np.minimum(np.searchsorted(starts, wanted), len(order) - 1)
        after = np.where(starts[at] == wanted, order[at], -1)
        zero = np.zeros(len(ids), np.int32)
        return _with_segments(pdf[["id", "x1", "y1", "x2", "y2"]].assign(way=zero, turns=False), ids, after, zero, np.stack([x2, y2], axis=1))

    kind = f"id long, x1 long, y1 long, x2 long, y2 long, way int, turns boolean, seg long, pos long, closed boolean, {SEGMENT}"
    tiles = edges.withColumns({"trow": F.floor(F.col("r") / tile), "tcol": F.floor(F.col("c") / tile)})
    pieces = cut(tiles.groupBy("trow", "tcol").applyInPandas(run, kind))
    firsts = pieces.where("pos = 0 and not closed")
    starts = firsts.select(F.col("x1").alias("to_x"), F.col("y1").alias("to_y"), F.col("seg").alias("next"))
    links = cut(firsts.select("seg", "to_x", "to_y").join(starts, ["to_x", "to_y"]).select("seg", "next", F.lit(0).alias("before")))
    return _placed(pieces, links, ["id", "x1", "y1", "x2", "y2"], few).drop("turns")


def corner(side: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """Column and row of the corner from which a cell's side starts."""
    return col + F.when(side.isin(1, 2), 1).otherwise(0), row + F.when(side.isin(2, 3), 1).otherwise(0)
