"""Tile rows and their tables, and values of one source: results and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.model import Raster, from_numpy, stack_bands
from rasterloom.operators import algebra as A
from rasterloom.operators import tiles as TL
from rasterloom.sources import tile_tables

RNG = np.random.default_rng(8)
X, Y = RNG.normal(size=(2, 70, 50)), np.round(RNG.normal(size=(2, 70, 50)))
X[0, 3, 4] = Y[1, 60, 49] = np.nan


def stacked(spark, cube):
    return stack_bands([from_numpy(spark, p) for p in cube]) if len(cube) > 1 else from_numpy(spark, cube[0])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(r, path, tile=(32, 16), buckets=4):
    tile_tables.write_tiles(str(path), TL.to_tiles(r, tile), buckets)
    return tile_tables.read_tiles(r.df.sparkSession, str(path))


@pytest.mark.parametrize("bands", [(2, 2), (1, 2), (2, 1), (1, 1)])
def test_algebra_of_tiles(spark, tmp_path, bands):
    x, y = (stacked(spark, c[:b]) for c, b in zip((X, Y), bands))
    a, b = table(x, tmp_path / "a"), table(y, tmp_path / "b")
    for f, g in ((A.raster_add, np.add), (A.raster_subtract, np.subtract), (A.raster_multiply, np.multiply), (A.raster_divide, np.divide)):
        with np.errstate(all="ignore"):
            want = g(X[: bands[0]], Y[: bands[1]])
        got = f(a, b)
        out = TL.to_pixels(got).to_numpy().reshape(max(bands), 70, 50)
        assert np.array_equal(out, np.where(np.isfinite(want), want, np.nan), equal_nan=True) and got.meta.band_count == max(bands)
        pixels = f(x, y).to_numpy().reshape(max(bands), 70, 50)
        assert np.array_equal(out, pixels, equal_nan=True)


def test_tables_are_joined_where_they_lie(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    a, b = (table(stacked(spark, c), tmp_path / n) for c, n in ((X, "a"), (Y, "b")))
    text = plan(A.raster_add(A.raster_apply(a, np.sqrt), b).df)
    assert "SortMergeJoin" in text and "Exchange" in plan(A.raster_add(TL.to_tiles(stacked(spark, X)), TL.to_tiles(stacked(spark, Y))).df)
    assert "Exchange" not in plan(A.raster_add(a, b).df)
    c = table(stacked(spark, X + 1), tmp_path / "c")
    chain = A.raster_apply(A.raster_multiply(A.raster_add(A.raster_add(a, b), a), A.raster_subtract(c, b)), lambda v: v / 2)
    text = plan(chain.df)
    assert "Exchange" not in text and text.count("SortMergeJoin") == 2 and text.count("ArrowEvalPython") == 1
    assert np.allclose(TL.to_pixels(chain).to_numpy(), (2 * X + Y) * (X + 1 - Y) / 2, equal_nan=True)
    # a session that hasn't written the table finds its buckets in the files
    spark.sql(f"DROP TABLE {tile_tables._name(str(tmp_path / 'a'))}")
    again = tile_tables.read_tiles(spark, str(tmp_path / "a"))
    assert "Exchange" not in plan(A.raster_add(again, b).df)
    assert np.array_equal(TL.to_pixels(again).to_numpy(), X, equal_nan=True) and again.meta == a.meta and again.tile == (32, 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_tiles_apart(spark, tmp_path):
    x, y = (stacked(spark, c) for c in (X, Y))
    with pytest.raises(ValueError, match="tiles"):
        A.raster_add(TL.to_tiles(x, (8, 8)), TL.to_tiles(y, (16, 8)))
    with pytest.raises(ValueError, match="pixels"):
        A.raster_add(TL.to_tiles(x), y)
    with pytest.raises(ValueError, match="shape"):
        A.raster_add(TL.to_tiles(x), TL.to_tiles(from_numpy(spark, np.ones((3, 3)))))
    # absent pixels are nodata of a tile that has others; tiles without rows stay absent
    part = TL.to_tiles(Raster(x.df.where("row >= 40"), x.meta), (32, 16))
    assert part.df.where("trow = 0").count() == 0 and TL.to_pixels(part).df.where("row < 40 and value is not null").count() == 0
    s = {r.band: r for r in TL.summary(TL.to_tiles(x, (32, 16))).collect()}
    assert [s[b].n for b in (1, 2)] == [3499, 3500] and np.isclose(s[2].total, X[1].sum()) and s[1].least == np.nanmin(X[0]) and s[1].most == np.nanmax(X[0])
    empty = TL.to_tiles(Raster(x.df.limit(0), x.meta))
    assert A.raster_add(empty, empty).df.count() == 0 and TL.summary(empty).count() == 0


def joins(r):
    return plan(r.df).count("Join")


def test_one_source_needs_no_join(spark):
    r = stacked(spark, X[:1])
    f, g = A.raster_apply(r, lambda v: v * 2), A.raster_apply(A.raster_classify(r, [0.0], [1, 2]), lambda v: v + 1)
    x = X[0]
    low = np.where(np.isnan(x), np.nan, np.where(x >= 0, 3.0, 2.0))
    nested = A.raster_divide(A.raster_add(f, g), A.raster_subtract(r, A.raster_apply(f, F.abs, vectorised=False)))
    for got, want in (
        (A.raster_add(f, g), 2 * x + low), (nested, (2 * x + low) / (x - abs(2 * x))), (A.raster_where(r.with_value((F.col("value") > 0).cast("double")), f, g), np.where(x > 0, 2 * x, low)),
        (A.raster_expression("a * b - c", a=f, b=g, c=r), 2 * x * low - x), (A.raster_multiply(r, r), x * x), (A.raster_apply(A.raster_add(f, g), lambda v: -v), -(2 * x + low)),
    ):
        assert joins(got) == 0 and np.allclose(got.to_numpy(), want, equal_nan=True)
    # other rows or another source still meet by a join
    other = stacked(spark, Y[:1])
    assert joins(A.raster_add(r, other)) == 1 and joins(A.raster_add(A.raster_add(f, g), other)) == 1
    both = stacked(spark, X)
    assert joins(A.raster_add(both, both)) == 0 and joins(A.raster_add(both, both.band(1))) == 1
    assert np.allclose(A.raster_add(both, both.band(1)).to_numpy(), X + X[0], equal_nan=True)
    assert joins(A.raster_expression("a[0] + b[1]", a=both, b=A.raster_apply(both, lambda v: -v))) == 0
    assert np.allclose(A.raster_expression("a[0] + b[1]", a=both, b=A.raster_apply(both, lambda v: -v)).to_numpy(), X[0] - X[1], equal_nan=True)


def test_same_files_are_one_source(spark, tmp_path):
    path = str(tmp_path / "t")
    stacked(spark, X[:1]).df.write.parquet(path)
    read = lambda: Raster(spark.read.parquet(path), stacked(spark, X[:1]).meta)
    assert joins(A.raster_add(A.raster_apply(read(), lambda v: v + 1), read())) == 0
    assert joins(A.raster_add(Raster(read().df.where("row > 3"), read().meta), read())) == 1
