"""Queries over tables that exceed a tile or a limit, against their SQL."""

from functools import partial

import numpy as np
import pytest

from rasterloom import queries as Q
from rasterloom.model import PolygonizeSpec
from rasterloom.operators import vector as V

duckdb = pytest.importorskip("duckdb")


def oracle(name, table, at):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet/*.parquet')")
    return sorted(con.sql(Q.ORACLE_SQL[name]).fetchall(), key=str)


def test_multipass_of_many_tiles(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(4100, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "vec_id long, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, Q.QUERIES["dispatch_tiled_multipass"](spark, str(tmp_path)).collect()), key=str)
    assert got == oracle("dispatch_tiled_multipass", "embeddings", tmp_path)


def test_polygons_beyond_the_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PolygonizeSpec", partial(PolygonizeSpec, max_polygons=2))  # what a call without a spec gets
    value = np.random.default_rng(3).uniform(0, 200, 400)
    spark.createDataFrame(list(enumerate(value.tolist())), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, Q.QUERIES["polygonize_area_by_value"](spark, str(tmp_path)).collect()), key=str)
    assert got == oracle("polygonize_area_by_value", "events", tmp_path)
    assert Q.QUERIES["polygonize"](spark, str(tmp_path)).count() == Q.QUERIES["polygonize_table"](spark, str(tmp_path)).count() > 100
