"""Sinks against plain relaxation, with small tiles and in one piece, and the rounds against one task."""

import numpy as np
import pytest

from rasterloom.model import Raster, from_numpy, stack_bands
from rasterloom.operators import sinks


def relaxed(z):
    """Levels by repeated passes over all cells; NaN is a barrier."""
    h, w = z.shape
    level = np.full((h, w), np.inf)
    edge = np.zeros((h, w), bool)
    edge[[0, -1]] = edge[:, [0, -1]] = True
    level[edge] = z[edge]
    hole = np.isnan(z)
    level[hole] = np.inf
    while True:
        p = np.pad(level, 1, constant_values=np.inf)
        low = np.min([p[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        new = np.where(edge | hole, level, np.minimum(level, np.maximum(z, low)))
        if (new == level).all():
            return np.where(hole, np.nan, level)
        level = new


def spiral(n):
    """One way of low cells from the middle to the border, walls between."""
    z = np.full((n, n), 100.0)
    r = c = 0
    way, seen = (0, 1), 0
    z[0, 0] = 1
    while seen < 4:
        a, b = r + 2 * way[0], c + 2 * way[1]
        if 0 <= a < n and 0 <= b < n and z[a, b] == 100:
            z[r + way[0], c + way[1]] = z[a, b] = 1
            r, c, seen = a, b, 0
        else:
            way, seen = (way[1], -way[0]), seen + 1
    z[r, c] = -5
    return z


rng = np.random.default_rng(6)
holes = rng.random((33, 47))
holes[rng.random(holes.shape) < 0.25] = np.nan
ring = np.zeros((20, 20))
ring[5:15, 5:15] = np.nan
ring[7:13, 7:13] = 3
CASES = {
    "noise": rng.random((40, 50)), "ties": rng.integers(0, 4, (37, 29)).astype(float), "holes": holes, "walled": ring, "spiral": spiral(35),
    "bowl": np.hypot(*np.mgrid[-20:21, -20:21]) * -1 + 7, "row": rng.random((1, 9)), "cell": np.ones((1, 1)), "no data": np.full((6, 6), np.nan),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("few", [0, 10**6])
def test_levels(spark, name, few):
    if few == 0 and name not in ("ties", "holes", "spiral", "no data"):
        pytest.skip("rounds are run on four of the cases")
    got = sinks.raster_fill_sinks(from_numpy(spark, CASES[name]), tile=8, few=few)
    rows = got.df.collect()
    out = np.full(CASES[name].shape, np.nan)
    for r in rows:
        out[r.row, r.col] = np.nan if r.value is None else r.value
    assert len(rows) == out.size and np.array_equal(out, relaxed(CASES[name]), equal_nan=True)


def test_bands_and_absent_cells(spark):
    x = np.stack([CASES["noise"], CASES["noise"][::-1]])
    r = stack_bands([from_numpy(spark, p) for p in x])
    got = sinks.raster_fill_sinks(r, tile=16, few=40)
    assert np.array_equal(got.to_numpy(), np.stack([relaxed(p) for p in x])) and got.meta.band_count == 2
    part = sinks.raster_fill_sinks(Raster(from_numpy(spark, x[0]).df.where("row <> 20"), from_numpy(spark, x[0]).meta), tile=16)
    wall = x[0].copy()
    wall[20] = np.nan
    assert part.df.where("row = 20").count() == 0 and np.array_equal(part.to_numpy(), relaxed(wall), equal_nan=True)
    assert sinks.raster_fill_sinks(Raster(r.df.limit(0), r.meta)).df.count() == 0


def test_one_tile():
    """Links of a tile are a forest, and levels through it are those of all links."""
    z = CASES["noise"][:12, :15]
    level, label, links = sinks.flooded(z, np.zeros(z.shape, bool))
    edge = np.zeros(z.shape, bool)
    edge[[0, -1]] = edge[:, [0, -1]] = True
    assert len(links) == edge.sum() - 1 and (level[edge] == z[edge]).all() and set(np.unique(label)) == set(np.flatnonzero(edge))
    assert np.array_equal(level, relaxed(z))
