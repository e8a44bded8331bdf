"""Connected components of links, by alternating large-star and small-star rounds until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop, written


def joined(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least number that each of n is connected to: roots hook onto lesser ones, then all point to their roots."""
    parent = np.arange(n)
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while len(a):
        pa, pb = parent[a], parent[b]
        apart = pa != pb
        a, b, pa, pb = a[apart], b[apart], pa[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, root of links between whole numbers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(batches), ignore_index=True)
        nodes, at = np.unique(every[["u", "v"]].to_numpy(np.int64).ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pd.DataFrame({"node": nodes, "root": nodes[joined(len(nodes), [(at[:, 0], at[:, 1])])]})

    return edges.coalesce(1).mapInPandas(run, "node long, root long")


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """edges: u, v (any orderable type). Returns node, root (the least node reachable); nodes without links are absent.

    A round joins the links to each node's least neighbour; that aggregation combines before its shuffle, and Spark
    splits joins on a node with many links. Each round is written, so a lost executor repeats one round at most, and the
    table of the round before goes. ``few``: so many links or less (counted), between whole numbers, are left to one task.
    """
    spark = edges.sparkSession
    edges, held = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, now = None, _state(edges)
    while now != before and now[0]:
        if now[0] <= few:
            return cut(_in_one_task(edges))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: a node's greater neighbours get the least of its neighbourhood
        large, last = written(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its lesser neighbours get the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        drop(spark, held)
        edges, held = written(moved.where("u <> v").distinct())
        drop(spark, last)
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
