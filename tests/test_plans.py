"""Planner, plans as text, sinks against a priority flood on the whole grid."""

import heapq

import numpy as np
import pytest

from rasterloom.model import PolygonizeSpec, from_numpy
from rasterloom.operators import regions as L
from rasterloom.plans import pipeline as P
from rasterloom.plans import tiling as T


def test_plans(spark):
    r = from_numpy(spark, np.zeros((3, 3)))
    assert len(P.plan_polygonize_pipeline(r)) == 7 and P.has_geotiff_support() and not P.has_codec_support("no_such_module")
    with pytest.raises(ValueError):
        P.plan_polygonize_pipeline(r, PolygonizeSpec(connectivity=6))
    assert all(most >= free >= 0 for most, free in P.memory_stats(spark).values())
    P.free_memory(spark)
    assert T.plan_from_metadata(r.meta, 0).strategy == T.TilingStrategy.WHOLE and T.max_bands_for_budget(r.meta, 1) == 1
    assert T.executor_memory_bytes(spark) > 0


def flood(z):
    h, w = z.shape
    level = np.full(z.shape, np.inf)
    heap = []
    for i in range(h):
        for j in range(w):
            if (i in (0, h - 1) or j in (0, w - 1)) and not np.isnan(z[i, j]):
                level[i, j] = z[i, j]
                heapq.heappush(heap, (z[i, j], i, j))
    while heap:
        v, i, j = heapq.heappop(heap)
        if v > level[i, j]:
            continue
        for a in range(max(0, i - 1), min(h, i + 2)):
            for b in range(max(0, j - 1), min(w, j + 2)):
                if not np.isnan(z[a, b]) and max(v, z[a, b]) < level[a, b]:
                    level[a, b] = max(v, z[a, b])
                    heapq.heappush(heap, (level[a, b], a, b))
    return np.where(np.isnan(z), np.nan, level)


@pytest.mark.parametrize("tile", [4, 256])
def test_sinks_do_not_depend_on_tiles(spark, tile):
    z = np.random.default_rng(8).random((11, 13)).round(2)
    z[4, 5] = z[7, 2] = np.nan
    got = L.raster_fill_sinks(from_numpy(spark, z), tile=tile).to_numpy()
    assert np.array_equal(got, flood(z), equal_nan=True)
