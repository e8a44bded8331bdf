"""What near copies hold on disk, and the comparison by parities before whole sets are read."""

import glob
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import simhash
from rasterloom.plans import lineage

from test_near_copies import brute_components

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    words = [f"w{k}" for k in range(800)]
    out = ["", None, "one two"]
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(30, 200))]
        for changed in (0, 1, 3, 9):
            copy = list(base)
            for at in draw.sample(range(len(copy)), changed):
                copy[at] = "other"
            out.append(" ".join(copy))
    return out


def test_only_the_result_stays_on_disk(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before, conf = {p for _, p in lineage._made}, spark.conf.get(CLEANUP)
    got = simhash.similar_groups(df)
    new = [p for _, p in lineage._made if p not in before]
    assert len(new) == 1 and os.path.isdir(new[0].removeprefix("file:"))
    folder = lineage.shared_dir(spark).removeprefix("file:")
    assert {os.path.join(folder, x) for x in os.listdir(folder) if x.startswith("cut-")} <= {p.removeprefix("file:") for p in before | {new[0]}}
    assert spark.conf.get(CLEANUP) == conf
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(brute_components(texts)))


def test_steps_leave_no_shuffle_files(spark):
    tops = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f for top in tops for f in glob.glob(f"{top}/*/shuffle_*")}
    before = held()
    made = []

    def make():
        made.append(lineage.cut(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count()))
        until = time.time() + 20
        while held() - before and time.time() < until:
            time.sleep(0.2)
        made.append(held() - before)
        return made[0].where("k < 7")

    assert lineage.finished(spark, make).count() == 7 and not made[1]


def test_tables_go_when_a_step_fails(spark):
    before = len(lineage._made)

    def make():
        lineage.cut(spark.range(3))
        raise KeyError("x")

    with pytest.raises(KeyError):
        lineage.finished(spark, make)
    assert len(lineage._made) == before and lineage._inside.get() is None


def test_parities_differ_in_no_more_bits_than_sets_in_elements(spark):
    draw, rows = np.random.default_rng(4), []
    for n, other in ((1, 1), (200, 230), (250, 260), (255, 257), (500, 520), (600, 500), (3000, 3100), (4096, 4097), (4000, 4200)):
        for common in (0, min(n, other) // 2, min(n, other) - 1, min(n, other)):
            x = draw.integers(0, 1 << 63, n + other, dtype=np.uint64) * np.uint64(3)
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:common], x[n : n + other - common]]))
            odd = np.setxor1d(a, b)
            bits = min(64 * len(simhash.parities(s)) for s in (a, b))
            want = int((np.bincount((odd & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).sum())
            rows.append((simhash.parities(a).tolist(), simhash.parities(b).tolist(), want, len(odd)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, want int, most int")
    got = df.select(simhash.differing(F.col("a"), F.col("b")).alias("d"), "want", "most").collect()
    assert all(r.d == r.want <= r.most for r in got) and {len(r[0]) != len(r[1]) for r in rows} == {True, False}


@pytest.mark.parametrize(("few", "late"), [(0, 3), (20, 1)])
def test_many_links_and_many_frequent_shingles(spark, texts, monkeypatch, few, late):
    monkeypatch.setattr(simhash, "_FEW", few)
    monkeypatch.setattr(simhash, "_LATE", late)
    monkeypatch.setattr(simhash, "_SHARE", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, keys=1, most=2).collect()}
    assert got == dict(enumerate(brute_components(texts)))
