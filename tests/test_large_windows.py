"""Operators whose cost doesn't follow window, kernel or zone, each against a plain version."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.model import GridSpec, compose_affine, from_numpy, invert_affine, stack_bands
from rasterloom.operators import focal as N
from rasterloom.operators import regions as L
from rasterloom.operators import resample as R
from rasterloom.operators import zonal as Z
from rasterloom.operators.blocks import convolved, sliding_distinct

rng = np.random.default_rng(12)


def holed(shape, values, share=0.1):
    x = values(shape).astype(float)
    x[rng.random(shape) < share] = np.nan
    return x


def plain_distinct(x, ry, rx):
    h, w = x.shape
    out = np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            part = x[max(0, r - ry) : r + ry + 1, max(0, c - rx) : c + rx + 1]
            out[r, c] = len(np.unique(part[~np.isnan(part)]))
    return out


@pytest.mark.parametrize("ry,rx", [(0, 0), (1, 4), (5, 2), (30, 40), (3, 0)])
def test_sliding_distinct(ry, rx):
    for k in (2, 30, 10**6):
        x = holed((23, 31), lambda s, k=k: rng.integers(0, k, s))
        assert (sliding_distinct(x, ry, rx) == plain_distinct(x, ry, rx)).all()
    assert (sliding_distinct(np.full((3, 4), np.nan), ry, rx) == 0).all()


def test_distinct_doesnt_follow_the_window():
    x = rng.integers(0, 50, (200, 200)).astype(float)
    took = []
    for radius in (3, 3, 40):
        start = time.perf_counter()
        sliding_distinct(x, radius, radius)
        took.append(time.perf_counter() - start)
    assert took[2] < 4 * took[1]


def test_variety_by_tiles(spark):
    x = holed((60, 70), lambda s: rng.integers(0, 9, s))
    r = from_numpy(spark, x)
    want = np.where(np.isnan(x), np.nan, plain_distinct(x, 6, 4))
    assert np.array_equal(N.raster_focal_variety(r, (6, 4)).to_numpy(), want, equal_nan=True)
    small = N.raster_focal_variety(r, (2, 3), direct=1), N.raster_focal_variety(r, (2, 3), direct=10**6)
    assert np.array_equal(small[0].to_numpy(), small[1].to_numpy(), equal_nan=True)


def sums(x, kernel):
    h, w = x.shape
    kh, kw = kernel.shape
    ry, rx = kh // 2, kw // 2
    num, den = np.zeros((h, w)), np.zeros((h, w))
    for i in range(kh):
        for j in range(kw):
            a, b = i - ry, j - rx
            part = np.full((h, w), np.nan)
            part[max(0, -a) : h - max(0, a), max(0, -b) : w - max(0, b)] = x[max(0, a) : h + min(0, a), max(0, b) : w + min(0, b)]
            num += np.where(np.isnan(part), 0, part * kernel[i, j])
            den += np.where(np.isnan(part), 0, kernel[i, j])
    return num, den


@pytest.mark.parametrize("shape", [(61, 61), (3, 5), (4, 6), (1, 31)])
def test_convolved(shape):
    kernel = rng.random(shape)
    x = holed((90, 80), lambda s: rng.normal(size=s) + 1000, 0.3)
    x[:30, :40] = np.nan  # where no cell is near, the weights' sum is zero
    (num, den), (want, weight) = convolved(x, kernel), sums(x, kernel)
    assert np.allclose(num, want, rtol=1e-9, atol=1e-9) and np.allclose(den, weight, rtol=1e-9, atol=1e-9) and ((den > 0) == (weight > 0)).all()
    signed = kernel - kernel.mean()
    assert np.allclose(convolved(x, signed)[0], sums(x, signed)[0], atol=1e-7)


def test_large_kernels(spark):
    x = holed((100, 90), lambda s: rng.normal(size=s), 0.2)
    kernel = rng.random((17, 21))
    num, den = sums(x, kernel)
    got = N.raster_convolve(from_numpy(spark, x), kernel).to_numpy()
    assert np.allclose(got, np.where(np.isnan(x) | (den <= 0), np.nan, num / np.where(den > 0, den, 1)), rtol=1e-9, equal_nan=True)
    one = rng.random((3, 3))
    r = from_numpy(spark, x)
    assert np.allclose(N.raster_convolve(r, one, direct=0).to_numpy(), N.raster_convolve(r, one).to_numpy(), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("se", [L.make_structuring_element("disk", 20), L.make_structuring_element("rect", (7, 5)), (rng.random((9, 7)) < 0.5).astype(np.uint8)], ids=["disk", "rect", "random"])
def test_large_elements(spark, se):
    x = (rng.random((70, 60)) < (0.02 if se.sum() > 100 else 0.1)).astype(float)
    ry, rx = se.shape[0] // 2, se.shape[1] // 2
    grown, kept = np.zeros(x.shape), np.zeros(x.shape)
    y = 1 - x
    wide, wide_y = np.pad(x, ((ry, ry), (rx, rx))), np.pad(y, ((ry, ry), (rx, rx)))
    for r in range(70):
        for c in range(60):
            grown[r, c] = (wide[r : r + se.shape[0], c : c + se.shape[1]] * se[::-1, ::-1]).any()
            kept[r, c] = (wide_y[r : r + se.shape[0], c : c + se.shape[1]][se == 1] == 1).all()
    dilated = L.raster_morphology(from_numpy(spark, x), "dilate", structuring_element=se)
    assert (dilated.to_numpy() == grown).all()
    assert (L.raster_morphology(from_numpy(spark, y), "erode", structuring_element=se).to_numpy() == kept).all()
    if se.sum() > 1000:  # windows follow the element's lines: 41 of them, of 21 kinds, not its 1,257 cells
        text = dilated.df._jdf.queryExecution().analyzed().toString()
        assert text.count("windowspecdefinition") < 140


def taps_of(x, to_source, shape, method):
    """Resampling a cell at a time."""
    a, b, c, d, e, f = to_source
    out = np.full(shape, np.nan)
    for i in range(shape[0]):
        for j in range(shape[1]):
            sx, sy = (j + 0.5) * a + (i + 0.5) * b + c - 0.5, (j + 0.5) * d + (i + 0.5) * e + f - 0.5
            x0, y0 = int(np.floor(sx)), int(np.floor(sy))
            total = 0.0
            for p in R._TAPS[method][0]:
                for q in R._TAPS[method][0]:
                    ok = 0 <= y0 + p < x.shape[0] and 0 <= x0 + q < x.shape[1]
                    weight = R._TAPS[method][1]
                    total += (x[y0 + p, x0 + q] if ok else np.nan) * float(weight(np.float64(sy - y0), p) * weight(np.float64(sx - x0), q))
            out[i, j] = total
    return out


@pytest.mark.parametrize("method", ["bilinear", "bicubic"])
@pytest.mark.parametrize("affine", [(0.7, 0.0, -3.0, 0.0, -0.9, 2.0), (0.5, 0.4, 10.0, 0.3, -0.6, -5.0), (40.0, 0.0, 3.0, 0.0, -33.0, 0.0), (1.0, 0.0, 900.0, 0.0, -1.0, 0.0)], ids=["finer", "turned", "coarser", "outside"])
def test_tile_gather(spark, monkeypatch, method, affine):
    monkeypatch.setattr(R, "_SOURCE", 16)
    x = holed((70, 90), lambda s: rng.normal(size=s), 0.05)
    r = stack_bands([from_numpy(spark, p, nodata=-9999.0) for p in (x, -x)])
    target = GridSpec(affine, 40, 35)
    got = R.raster_resample(r, target, method)
    to_source = compose_affine(invert_affine(r.meta.affine), affine)
    want = taps_of(x, to_source, (35, 40), method)
    cube = got.df.toPandas()
    assert len(cube) == 2 * 35 * 40
    out = np.full((2, 35, 40), np.nan)
    out[cube["band"] - 1, cube["row"], cube["col"]] = cube["value"].astype(float)
    assert np.allclose(out[0], want, equal_nan=True) and np.allclose(out[1], -want, equal_nan=True)


def test_gather_asks_for_what_it_needs(spark):
    """Every source tile that a tap lies in is asked for, and at a grid of the same size few more than twice."""
    r = from_numpy(spark, np.zeros((2000, 1500)))
    to_source = (1.1, 0.0, 7.0, 0.0, 1.0, -3.0)
    side = R.target_side(to_source)
    got = R.asked(r, GridSpec((1, 0, 0, 0, 1, 0), 1300, 2000), to_source, side, -1, 2).where("trow is not null")
    tiles = -(-2000 // 256) * -(-1500 // 256)
    # a target tile of 256 cells touches two source tiles each way at most, plus one for the stretch
    assert got.count() <= 6 * tiles and got.select("trow", "tcol").distinct().count() == tiles


@pytest.mark.parametrize("few", [3, 50])
def test_median_by_selection(spark, few):
    zones = {
        1: rng.normal(size=3001), 2: rng.integers(0, 3, 2000).astype(float), 3: np.exp(rng.normal(size=1500) * 200), 4: np.full(400, 2.5), 5: np.array([7.0]), 6: np.array([1.0, 2.0]),
        7: np.concatenate([np.zeros(500), rng.normal(size=500)]), 8: np.arange(1000.0) // 500 * 1e300, 9: -np.exp(rng.normal(size=1200) * 50),
    }
    rows = [(z, b, float(v if b == 1 else -v)) for z, x in zones.items() for v in x for b in (1, 2)]
    both = spark.createDataFrame(rows, "zone long, band int, value double").repartition(5)
    got = {(r.zone, r.band): r.median for r in Z.medians(both, few=few).collect()}
    assert got == {(z, b): float(np.median(x if b == 1 else -x)) for z, x in zones.items() for b in (1, 2)}


def test_zonal_medians_of_large_zones(spark, monkeypatch):
    x, zones = holed((40, 50), lambda s: rng.normal(size=s)), rng.integers(0, 3, (40, 50)).astype(float)
    one, two = from_numpy(spark, x), stack_bands([from_numpy(spark, p) for p in (x, x * 2 + 1)])
    z = from_numpy(spark, zones)
    calls = lambda: [sorted(map(tuple, Z.zonal_stats(z, r, names).collect())) for r in (one, two) for names in (["mean", "median", "count"], ["median"])]
    plain = calls()
    monkeypatch.setattr(Z, "DIRECT", 100)
    by_selection = calls()
    for a, b in zip(plain, by_selection):
        assert np.allclose(np.array(a, float), np.array(b, float))
    assert Z.zonal_stats(z, one, ["mean", "median", "count"]).columns == ["zone", "mean", "median", "count"]
    empty = Z.zonal_stats(z, one.with_value(F.lit(None).cast("double")), ["median"])
    assert empty.count() == 0


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_integers_keep_their_nodata(spark, method):
    """Rounded and held in range; cells without a value stay so, with a sentinel or without."""
    x = rng.integers(0, 255, (12, 14)).astype(np.uint8)
    x[3, 4] = 7
    for nodata, empty in ((7, 7), (None, 0)):
        r = from_numpy(spark, x, nodata=nodata)
        got = R.raster_resample(r, GridSpec((0.5, 0.0, -1.0, 0.0, -0.5, 1.0), 34, 30), method)
        out = got.to_numpy()
        assert out.dtype == np.uint8 and (out[:2] == empty).all() and (out[:, :2] == empty).all()
        assert got.df.where("value < 0 or value > 255 or value <> floor(value)").count() == 0
