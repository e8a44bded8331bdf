"""Sinks by a spill graph.

Every tile is flooded from its rim on its own: a cell gets the rim cell that its water reaches first, and the least level
over which it gets there. Rim cells are the nodes of a graph; two of them are linked at the least level over which
water passes between their parts of the tile (of those links only a spanning forest of least levels is kept), neighbours in
two tiles at the higher of their values, cells of the raster's border to the outside at their own. A node's level is the
least over all ways to the outside of the way's highest link, and a cell's that or its own, whichever is higher.

Node levels come from Boruvka rounds. In a round every component takes its lowest link that leads out; no way out of it
is lower, and the links taken along the tree that they make are no higher, so a node's level is the maximum of the links
that its components took until one of them led outside. Components at least halve in a round. Once the links left are
``few`` (counted), one task finishes them. The raster is written once, flooded by tiles, and read once more at the end, however
long the ways are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PIXELS, Raster
from ..plans.lineage import cut
from ..plans.tiling import with_tiles

OUTSIDE = -1
_HOLE, _ABSENT, _WALLED = -1, -2, -3  # in place of a cell's rim cell
_TILE = "band int, trow int, tcol int, height int, width int, level binary, rim binary, nodes array<long>, z array<double>, u array<long>, v array<long>, w array<double>"


def _forest(links: dict[tuple[int, int], float]) -> list[tuple[int, int, float]]:
    """Of weighted links a spanning forest of least weights."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    kept = []
    for (a, b), w in sorted(links.items(), key=lambda e: (e[1], e[0])):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            kept.append((a, b, w))
    return kept


def flooded(z: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Of a tile (NaN is nodata): each cell's level over which it spills to the rim, the number of the rim cell that it spills
    to, and the links between rim cells. Lowest cells first; a cell is entered once."""
    h, w = z.shape
    wide = w + 2
    values = np.full((h + 2, wide), np.nan)
    values[1:-1, 1:-1] = z
    valid = ~np.isnan(values)
    rim = np.zeros_like(valid)
    rim[[1, h], 1:-1] = rim[1:-1, [1, w]] = True
    height, open_ = values.ravel().tolist(), valid.ravel().tolist()
    level, label = [float("inf")] * len(height), [_WALLED] * len(height)
    heap = []
    for k in np.flatnonzero(rim & valid).tolist():
        level[k], label[k] = height[k], k
        heap.append((height[k], k))
    heapq.heapify(heap)
    near = (-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1)
    links: dict[tuple[int, int], float] = {}
    while heap:
        top, k = heapq.heappop(heap)
        own = label[k]
        for step in near:
            n = k + step
            if not open_[n]:
                continue
            other = label[n]
            if other == _WALLED:
                level[n] = up = height[n] if height[n] > top else top
                label[n] = own
                heapq.heappush(heap, (up, n))
            elif other != own:
                pair, at = (own, other) if own < other else (other, own), level[n] if level[n] > top else top
                if at < links.get(pair, float("inf")):
                    links[pair] = at
    inner = lambda x: np.array(x).reshape(h + 2, wide)[1:-1, 1:-1]
    # numbers of the tile's own cells instead of the padded grid's
    own_number = lambda k: (k // wide - 1) * w + k % wide - 1
    labels = inner(label)
    labels = np.where(labels >= 0, own_number(labels), labels)
    labels = np.where(absent, _ABSENT, np.where(np.isnan(z), _HOLE, labels)).astype(np.int32)
    return inner(level), labels, [(own_number(a), own_number(b), x) for (a, b, x) in _forest(links)]


def _tiles(dem: Raster, tile: int) -> DataFrame:
    h, w = dem.meta.height, dem.meta.width

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, tr, tc = (int(k) for k in key)
        shape = min(tile, h - tr * tile), min(tile, w - tc * tile)
        z, absent = np.full(shape, np.nan), np.ones(shape, dtype=bool)
        at = (pdf["row"] - tr * tile).to_numpy(), (pdf["col"] - tc * tile).to_numpy()
        z[at], absent[at] = pdf["value"].to_numpy(float), False
        level, label, links = flooded(z, absent)
        number = lambda k: (tr * tile + k // shape[1]) * w + tc * tile + k % shape[1]
        rim = np.zeros(shape, dtype=bool)
        rim[[0, -1]] = rim[:, [0, -1]] = True
        nodes = np.flatnonzero(rim & ~np.isnan(z))
        u, v, weight = (np.array([x[k] for x in links]) for k in range(3))
        return pd.DataFrame({
            "band": [band], "trow": [tr], "tcol": [tc], "height": [shape[0]], "width": [shape[1]], "level": [level.astype("<f8").tobytes()], "rim": [label.astype("<i4").tobytes()],
            "nodes": [number(nodes)], "z": [z.ravel()[nodes]], "u": [number(u.astype(np.int64))], "v": [number(v.astype(np.int64))], "w": [weight.astype(float)],
        })

    return with_tiles(dem.df, (tile, tile)).groupBy("band", "trow", "tcol").applyInPandas(run, _TILE)


def spill_graph(tiles: DataFrame, height: int, width: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Links u, v, w between rim cells, and outlets u, w. A node is the cell's number, counted on over the bands."""
    node = lambda number, band=F.col("band"): band * F.lit(height * width) + number
    rim = tiles.select("band", F.explode(F.arrays_zip("nodes", "z")).alias("x")).select(
        "band", F.floor(F.col("x.nodes") / width).alias("row"), (F.col("x.nodes") % width).alias("col"), F.col("x.z").alias("z")
    )
    within = tiles.select("band", F.explode(F.arrays_zip("u", "v", "w")).alias("x")).select(node(F.col("x.u")).alias("u"), node(F.col("x.v")).alias("v"), F.col("x.w").alias("w"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)))))
    part = lambda c: F.floor(F.col(c) / tile)
    towards = rim.select("*", steps.alias("s")).withColumns({"r2": F.col("row") + F.col("s.a"), "c2": F.col("col") + F.col("s.b")})
    towards = towards.where((part("row") != part("r2")) | (part("col") != part("c2")))
    other = rim.select("band", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("z").alias("z2"))
    across = towards.join(other, ["band", "r2", "c2"]).select(
        node(F.col("row") * width + F.col("col")).alias("u"), node(F.col("r2") * width + F.col("c2")).alias("v"), F.greatest("z", "z2").alias("w")
    )
    border = rim.where((F.col("row") == 0) | (F.col("row") == height - 1) | (F.col("col") == 0) | (F.col("col") == width - 1))
    return within.unionByName(across), border.select(node(F.col("row") * width + F.col("col")).alias("u"), F.col("z").alias("w"))


def _finished(links: DataFrame, outlets: DataFrame) -> DataFrame:
    """u, level of all nodes that reach the outside, in one task: the lowest first, from the outlets on."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[int, list[tuple[float, int]]] = {}
        heap = []
        for batch in batches:
            for u, v, w in zip(batch["u"].tolist(), batch["v"].tolist(), batch["w"].tolist()):
                if v == OUTSIDE:
                    heap.append((w, u))
                else:
                    near.setdefault(u, []).append((w, v))
                    near.setdefault(v, []).append((w, u))
        heapq.heapify(heap)
        done: dict[int, float] = {}
        while heap:
            level, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = level
            for w, v in near.get(u, ()):
                if v not in done:
                    heapq.heappush(heap, (max(w, level), v))
        yield pd.DataFrame({"u": np.fromiter(done, np.int64, len(done)), "level": np.fromiter(done.values(), float, len(done))})

    every = links.select("u", "v", "w").unionByName(outlets.select("u", F.lit(OUTSIDE).cast("long").alias("v"), "w"))
    return every.coalesce(1).mapInPandas(run, "u long, level double")


def _roots(best: DataFrame) -> DataFrame:
    """u, root, w of best (u, v, w: the link that u takes): where the links taken lead to, OUTSIDE or the lesser of the two nodes
    that take the same one."""
    back = best.select(F.col("u").alias("v"), F.col("v").alias("back"))
    mutual = (F.col("back") == F.col("u")) & (F.col("u") < F.col("v"))
    up = cut(best.join(back, "v", "left").select("u", F.when(mutual, F.col("u")).otherwise(F.col("v")).alias("root"), "w"))
    while True:
        above = up.select(F.col("u").alias("root"), F.col("root").alias("above"))
        moved = F.coalesce("above", "root")  # the outside has no row
        new = cut(up.join(above, "root", "left").select("u", moved.alias("root"), "w", (moved != F.col("root")).alias("moved")))
        up = new.select("u", "root", "w")
        if new.where("moved").isEmpty():
            return up


def node_levels(links: DataFrame, outlets: DataFrame, few: int) -> DataFrame:
    """u, level; nodes that don't reach the outside have no row."""
    taken: list[DataFrame] = []
    links, outlets = cut(links.groupBy("u", "v").agg(F.min("w").alias("w"))), cut(outlets.groupBy("u").agg(F.min("w").alias("w")))
    while (n := links.count()) + outlets.count() > few and n:
        ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).unionByName(outlets.select("u", F.lit(OUTSIDE).cast("long").alias("v"), "w"))
        # links of one weight in one order, the same from both sides, so that links taken make no circle
        lowest = F.min(F.struct("w", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).alias("x")
        best = ways.groupBy("u").agg(lowest).select("u", F.when(F.col("x.a") == F.col("u"), F.col("x.b")).otherwise(F.col("x.a")).alias("v"), "x.w")
        roots = _roots(cut(best))
        taken.append(roots)
        to = roots.select("u", "root")
        moved = links.join(to, "u").select("v", F.col("root").alias("u"), "w").join(to.withColumnRenamed("u", "v"), "v").select("u", F.col("root").alias("v"), "w").where("u <> v")
        moved = cut(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w")))
        ends = outlets.join(to, "u").where(F.col("root") != OUTSIDE).select(F.col("root").alias("u"), "w")
        ends = ends.unionByName(moved.where(F.col("u") == OUTSIDE).select(F.col("v").alias("u"), "w"))
        links, outlets = moved.where(F.col("u") != OUTSIDE), cut(ends.groupBy("u").agg(F.min("w").alias("w")))
    levels = cut(_finished(links, outlets))
    for roots in reversed(taken):
        above = levels.select(F.col("u").alias("root"), "level")
        outside = roots.where(F.col("root") == OUTSIDE).select("u", F.col("w").alias("level"))
        levels = cut(roots.where(F.col("root") != OUTSIDE).join(above, "root").select("u", F.greatest("w", "level").alias("level")).unionByName(outside))
    return levels


def raster_fill_sinks(dem: Raster, tile: int = 256, few: int = 1_000_000) -> Raster:
    """Each inner cell gets the least level over which it spills to the border (8 neighbours); nodata is a barrier, and cells
    that it walls off are infinite. ``few``: links that one task finishes."""
    m = dem.meta
    tiles = cut(_tiles(dem, tile))
    links, outlets = spill_graph(tiles, m.height, m.width, tile)
    levels = node_levels(links, outlets, few)
    size, w = m.height * m.width, m.width
    number = F.col("u") % size
    of_tile = levels.select(
        F.floor(F.col("u") / size).cast("int").alias("band"), F.floor(F.floor(number / w) / tile).cast("int").alias("trow"), F.floor(number % w / tile).cast("int").alias("tcol"),
        number.alias("node"), "level",
    ).groupBy("band", "trow", "tcol").agg(F.collect_list(F.struct("node", "level")).alias("found"))  # at most a rim

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                own, rim = np.frombuffer(t.level, "<f8"), np.frombuffer(t.rim, "<i4")
                row, col = np.divmod(np.arange(len(own)), t.width)
                row, col = row + t.trow * tile, col + t.tcol * tile
                spill = np.full(len(own), np.inf)
                for x in t.found if t.found is not None else ():
                    spill[(x["node"] // w - t.trow * tile) * t.width + x["node"] % w - t.tcol * tile] = x["level"]
                value = np.where(rim >= 0, np.maximum(own, spill[rim]), np.where(rim == _WALLED, np.inf, np.nan))
                some = rim != _ABSENT
                yield pd.DataFrame({"band": t.band, "row": row[some], "col": col[some], "value": value[some]})

    done = tiles.select("band", "trow", "tcol", "width", "level", "rim").join(of_tile, ["band", "trow", "tcol"], "left").mapInPandas(run, PIXELS)
    return dem.derive(done.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))))
