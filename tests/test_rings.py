"""Rings by list ranking against rings traced in one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.model import PolygonizeSpec, from_numpy, stack_bands
from rasterloom.operators import rings
from rasterloom.operators import vector as V
from rasterloom.operators.regions import region_roots

from test_sinks import spiral

rng = np.random.default_rng(4)
ringed = np.zeros((20, 30))
ringed[3:17, 3:27] = 1
ringed[6:14, 8:22] = 0
ringed[9, 9] = ringed[10, 10] = 1  # cells that meet in a corner, inside a hole
GRIDS = {"noise": rng.integers(0, 2, (19, 23)).astype(float), "holes": ringed, "spiral": (spiral(25) == 1).astype(float), "one": np.ones((9, 9)), "checks": np.indices((12, 13)).sum(axis=0) % 2.0}


def points(ring):
    """A closed ring's corners from its least one on."""
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


@pytest.mark.parametrize("name", GRIDS)
@pytest.mark.parametrize("connectivity", [4, 8])
def test_rings(spark, name, connectivity):
    r = from_numpy(spark, GRIDS[name], affine=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
    spec = PolygonizeSpec(connectivity=connectivity)
    few = 0 if name in ("noise", "spiral") else 10**6
    got = {}
    for x in V.polygon_rings(r, spec, tile=8, few=few).collect():
        got.setdefault((x.region, x.ring), []).append((x.rank, (int(x.x), int(x.y))))
    mine = sorted((k[0], points([p for _, p in sorted(v)])) for k, v in got.items())
    sides = {}
    for x in V.border_sides(region_roots(r, connectivity, by_value=True)).collect():
        sides.setdefault(x.root, []).append((x.row, x.col, x.side))
    want = []
    for root, edges in sides.items():
        for ring in V.trace(edges, connectivity == 8):
            body = ring[:-1]
            straight = lambda k: (body[k][0] - body[k - 1][0]) * (body[(k + 1) % len(body)][1] - body[k][1]) == (body[k][1] - body[k - 1][1]) * (body[(k + 1) % len(body)][0] - body[k][0])
            want.append((root, points([p for k, p in enumerate(body) if not straight(k)])))
    assert mine == sorted(want)
    measures = {x.region: x for x in V.polygon_measures(r, spec, tile=8, few=few).collect()}
    for root, edges in sides.items():
        m = measures[root]
        assert m.perimeter == len(edges) and m.n_rings == sum(1 for x in want if x[0] == root) and m.area == m.n_cells
    assert sum(m.n_cells for m in measures.values()) == GRIDS[name].size


def test_ranks_are_whole(spark):
    """Over several tiles and bands every ring counts from 0 without a gap, each side follows the one before it."""
    r = stack_bands([from_numpy(spark, g) for g in (GRIDS["noise"], GRIDS["noise"][::-1].copy())])
    sides = V.border_sides(region_roots(r, 4, by_value=True))
    out = {}
    for x in rings.rings_of_sides(sides, 19, 23, False, tile=6, few=10).collect():
        out.setdefault((x.band, x.root, x.ring), []).append((x.rank, x.row, x.col, x.side))
    for v in out.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v)))
        at = lambda x, k: tuple(rings.CORNERS[x[3], k] + (x[2], x[1]))
        assert all(at(a, 1) == at(b, 0) for a, b in zip(v, v[1:] + v[:1]))
    assert sum(map(len, out.values())) == sides.count()


@pytest.mark.parametrize("few", [0, 10**6])
def test_lines_that_end(spark, few):
    """Rings and open lines, whatever their lengths, through rounds and in one task."""
    lines = [[5, 9, 2, 14], [1], [30, 21, 28, 25, 27, 22, 29, 40, 41], [50, 51], [60, 3, 61, 7, 62, 63, 64, 65]]
    rows, closed = [], (0, 3, 4)
    for k, line in enumerate(lines):
        after = line[1:] + ([line[0]] if k in closed else [None])
        rows += [(s, x, s % 3 + 1, 10 * s) for s, x in zip(line, after)]
    rows.append((70, 70, 4, 700))  # its own successor
    df = spark.createDataFrame(rows, "seg long, next long, n long, least long").repartition(3)
    got = {r.seg: r for r in rings.ranked(df, few).collect()}
    for k, line in enumerate([*lines, [70]]):
        start = line.index(min(line)) if k in closed else 0
        order, at = line[start:] + line[:start], 0
        total = sum(s % 3 + 1 for s in line) if line != [70] else 4
        for s in order:
            assert (got[s].ring, got[s].offset, got[s].total) == (10 * min(line), at, total), (line, s)
            at += s % 3 + 1


def test_contours(spark):
    """Over tiles and with cells that are smaller than nine digits show."""
    x = np.zeros((40, 50))
    x[3:30, 4:44] = 1
    x[10:20, 10:30] = 0
    x[0:5, 20:24] = 1  # the outline passes through the border
    for affine in ((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), (1e-11, 0.0, 5.0, 0.0, -1e-11, 7.0)):
        for few in (0, 10**6):
            got = V.contour_rings(from_numpy(spark, x, affine=affine), 1.0, tile=16, few=few).collect()
            edges = V.contour_edges(from_numpy(spark, x, affine=affine), 1.0)
            assert sum(r.n_points - 1 for r in got) == edges.count() and sorted(r.closed for r in got) == [True, True]
            assert all(r.wkt.startswith("POLYGON ((") and r.wkt.count(",") == r.n_points - 1 for r in got)
            assert np.isclose(sum(r.length for r in got), edges.agg(F.sum(F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2))).first()[0])
    assert V.contour_rings(from_numpy(spark, np.zeros((4, 4))), 1.0).count() == 0
