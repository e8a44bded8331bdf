"""Whitening against exact rational arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rasterloom.llm import whitening as W

KIND = "vec_id long, embedding array<float>, label int"


def exact(rows):
    """vec_id, x of the rows that remain; sums; covariance in fractions."""
    kept = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    cov = [[sum(Fraction(n * x[i] - sums[i], n) * Fraction(n * x[j] - sums[j], n) for _, x in kept) / n for j in range(d)] for i in range(d)]
    return kept, n, sums, cov


@pytest.mark.parametrize("scale", [1.0, 1e-2, 3e13])
def test_against_fractions(spark, scale):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6)) * scale
    rows = [(k, (rng.normal(size=6) @ mix + 3 * scale).astype(np.float32).tolist()) for k in range(90)]
    rows += [(90, None), (91, [None] * 6), (92, [float("nan")] * 6), (93, [1.0] * 5 + [float("inf")]), (7, rows[7][1]), (None, rows[8][1]), (94, [])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], KIND).repartition(5)
    got = W.whiten_embeddings(df).collect()
    kept, n, sums, cov = exact(rows)
    assert len(got) == len(kept) * 6 and n == 92 and {r.n for r in got} == {92}
    deviations = {k: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for k, x in kept}
    assert all(r.deviation == (deviations[r.vec_id] if deviations[r.vec_id] < 1 << 63 else None) for r in got)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    centred = {k: np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) for k, x in kept}
    for j in range(6):
        mine = {r.vec_id: r for r in got if r.component == j + 1}
        want = {k: v @ vectors[:, j] / np.sqrt(values[j]) for k, v in centred.items()}
        sign = 1 if np.sign(mine[0].whitened) == np.sign(want[0]) else -1
        assert all(abs(sign * mine[k].whitened - want[k]) < 1e-6 for k in want)
        assert all(abs(r.explained / (values[j] / values.sum()) - 1) < 1e-9 for r in mine.values())
    assert all(r.identity_error < 1e-9 for r in got)


def test_scatter_is_exact(spark):
    """Also beyond what doubles or longs hold, in partitions with and without rows."""
    rows = [(k, [float(np.float32(3.1e15 * (k % 7 - 3))), float(k), -1e18 * (k % 2)]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    of = W.usable(df)
    xs = [[min(max(math.floor(64 * c), -(1 << 62)), 1 << 62) + 1_000_000 for c in v] + [1] for _, v in rows]
    m = W.scatter(of.rows, 3, W.primes(2 * of.n * (int(min(of.top * 64, float(1 << 62))) + 1_000_001) ** 2))
    assert m == [[sum(x[i] * x[j] for x in xs) for j in range(4)] for i in range(4)]


def test_primes_and_remainders():
    p = W.primes(10**40)
    assert all(q < 1 << 21 and all(q % k for k in range(2, math.isqrt(q) + 1)) for q in p) and len(set(p)) == len(p) and math.prod(p) > 10**40 >= math.prod(p[:-1])
    assert all(W.reconstructed([v % q for q in p], p) == v for v in (0, 1, -1, 10**39, -(10**39)))
    # a block of the largest residues is still exact
    x = np.full((5000, 2), p[0] - 1, dtype=np.int64)
    assert W.products(iter([x]), p[:1], 2)[0].tolist() == [[5000 * (p[0] - 1) ** 2 % p[0]] * 2 + [5000 * (p[0] - 1) % p[0]]] * 2 + [[5000 * (p[0] - 1) % p[0]] * 2 + [5000]]


def test_degenerate(spark):
    """No rows; one row; a constant dimension; several lengths; more dimensions than components are returned."""
    empty = W.whiten_embeddings(spark.createDataFrame([(1, None, 0)], KIND))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    one = W.whiten_embeddings(spark.createDataFrame([(1, [0.5, 2.0], 0)], KIND)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2)]
    rows = [(k, [1.0, float(k)], 0) for k in range(20)] + [(50, [1.0], 0), (51, [1.0, 2.0, 3.0], 0)]
    got = W.whiten_embeddings(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 40 and all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in got)
    wide = [(k, np.random.default_rng(k).normal(size=40).tolist(), 0) for k in range(60)]
    got = W.whiten_embeddings(spark.createDataFrame(wide, KIND)).collect()
    assert len(got) == 60 * 32 and {r.component for r in got} == set(range(1, 33)) and max(r.identity_error for r in got) < 1e-9
