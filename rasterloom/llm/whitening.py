"""Embedding whitening with an exact scatter matrix, by residue numbers.

Entries become integers x. A task multiplies its rows modulo several primes below 2^21: products of residues are below 2^42,
so a double-precision matrix product over 2,048 rows is exact, and is reduced before the next. A column of ones beside
the entries gives sums and count in the same product. Residues of the tasks' products are summed by Spark (below 2^21 each,
so 2^42 tasks fit a long), and the Chinese remainder theorem gives the exact integers: there are as many primes as
the bound 2 n max|x|^2, taken from a first pass over the table, needs. What the driver gets is one number a prime
and pair of dimensions. The covariance (n M - S S') / n^2 is formed from exact integers, which is the centred
product without rounding, then decomposed in double precision.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries are dropped, and so are vectors
of another length than the most frequent one (of equally frequent ones the longest); an entry's 64 c is held within
+-2^62; null and repeated ids are kept as rows; a deviation that no long can hold is null. A component whose
eigenvalue is within rounding of zero (constant dimensions, fewer vectors than dimensions) has null whitened and
isn't part of identity_error, which is null if no component is left; ``explained`` is null if the trace is zero. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
_ROWS = 2048  # residues are below 2^21, so a sum of so many products is below 2^53
_LARGEST = 1 << 62


def primes(bound: int) -> list[int]:
    """Primes from 2^21 downwards whose product exceeds ``bound``."""
    found, product, k = [], 1, (1 << 21) - 1
    while product <= bound:
        if all(k % d for d in range(3, isqrt(k) + 1, 2)):
            found.append(k)
            product *= k
        k -= 2
    return found


def reconstructed(residues: list[int], moduli: list[int]) -> int:
    """The integer nearest to zero that has these residues."""
    product, value = 1, 0
    for r, p in zip(residues, moduli):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if value > product // 2 else value


@dataclass(frozen=True)
class Vectors:
    """vec_id, v of the vectors that remain, as doubles; their number, their length and their largest entry but for the sign."""

    rows: DataFrame
    n: int
    d: int
    top: float


def usable(vectors: DataFrame) -> Vectors | None:
    """None if no vector remains."""
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where((F.size("v") > 0) & sound)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return Vectors(rows.where(F.size("v") == most.d), most.n, most.d, most.top) if most else None


def as_integers(column: pa.Array, d: int) -> np.ndarray:
    """(rows, d) of x."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(np.clip(values * SCALE, -_LARGEST, _LARGEST)).astype(np.int64) + OFFSET


def products(parts: Iterator[np.ndarray], moduli: list[int], d: int) -> np.ndarray:
    """(primes, d + 1, d + 1): [x 1]'[x 1] modulo each prime."""
    total = np.zeros((len(moduli), d + 1, d + 1), dtype=np.int64)
    for x in parts:
        for at in range(0, len(x), _ROWS):
            rows = x[at : at + _ROWS]
            for k, p in enumerate(moduli):
                r = np.ones((len(rows), d + 1))
                r[:, :d] = rows % p
                total[k] = (total[k] + (r.T @ r).astype(np.int64) % p) % p
    return total


def scatter(rows: DataFrame, d: int, moduli: list[int]) -> list[list[int]]:
    """[x 1]'[x 1] over all rows, exact. A task sends its upper triangle; Spark sums residues."""
    i, j = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = products((as_integers(b.column(0), d) for b in batches), moduli, d)
        if total[:, d, d].any():  # of an empty partition nothing; no number of rows is zero modulo all primes
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_pydict({"k": np.full(len(i), k, np.int32), "cell": np.arange(len(i)), "part": total[k][i, j]})

    sums = rows.select("v").mapInArrow(run, "k int, cell long, part long").groupBy("cell", "k").agg(F.sum("part").alias("part"))
    by_cell: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # as many as there are pairs of dimensions and primes
        by_cell.setdefault(r.cell, {})[r.k] = r.part
    whole = [[0] * (d + 1) for _ in range(d + 1)]
    for cell, parts in by_cell.items():
        value = reconstructed([parts[k] % p for k, p in enumerate(moduli)], moduli)
        whole[i[cell]][j[cell]] = whole[j[cell]][i[cell]] = value
    return whole


@dataclass(frozen=True)
class Whitening:
    """n, the sums S, and unit components by falling eigenvalue; ``whole``: does n x - S fit a long?"""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    whole: bool

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.whole:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components) in double precision."""
        scale = np.sqrt(np.where(self.sound, self.values, 1))
        return (self.centred(x) / self.n).astype(np.float64) @ self.components / scale

    @property
    def sound(self) -> np.ndarray:
        """Which components have an eigenvalue that isn't zero within rounding."""
        return self.values > max(self.trace, 0) * 1e-14 * len(self.sums)


def fit(of: Vectors, most: int = 32) -> Whitening:
    """``most``: how many components."""
    n, d, largest = of.n, of.d, int(min(of.top * SCALE, float(_LARGEST))) + OFFSET + 1
    m = scatter(of.rows, d, primes(2 * n * largest * largest))
    sums = m[d][:d]
    # Python's division of integers is correctly rounded
    cov = np.array([[(n * m[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:most]
    return Whitening(n, sums, values[order], vectors[:, order], float(np.trace(cov)), 2 * n * largest < 1 << 62)


def identity_error(rows: DataFrame, w: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity. Whitened rows are about S / n already; what their
    mean has of rounding is taken off the products' sum."""
    d, sound = len(w.sums), w.sound
    c = int(sound.sum())
    if not c:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + 1, c + 1))
        for b in batches:
            z = np.ones((len(b), c + 1))
            z[:, :c] = w.whitened(as_integers(b.column(0), d))[:, sound]
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"cell": np.arange((c + 1) ** 2), "part": total.ravel()})

    sums = rows.select("v").mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).orderBy("cell")
    total = sums.toPandas()["part"].to_numpy().reshape(c + 1, c + 1) / w.n
    return float(np.abs(total[:c, :c] - np.outer(total[c, :c], total[c, :c]) - np.eye(c)).max())


OUT = "n long, deviation long, whitened array<double>"


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, n, deviation, whitened (one entry a component) of ``usable`` vectors' rows."""
    d, sound = len(w.sums), w.sound
    kind = dict(rows.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = as_integers(b.column(1), d)
            if not len(x):
                continue
            z = w.whitened(x)
            holes = np.broadcast_to(~sound, z.shape).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel(), mask=holes))
            away = w.centred(x)
            small = w.whole and d * int(np.abs(away).max()) ** 2 < 1 << 63
            sizes = (away * away).sum(axis=1).tolist() if small else [sum(int(v) ** 2 for v in row) for row in away]
            deviation = pa.array([v if v < 1 << 63 else None for v in sizes], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), w.n)), deviation, lists], ["vec_id", "n", "deviation", "whitened"])

    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, {OUT}")


def whiten_embeddings(vectors: DataFrame, most: int = 32) -> DataFrame:
    """One row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    of = usable(vectors)
    if of is None:
        none = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, {none}")
    w = fit(of, most)
    error = identity_error(of.rows, w)
    share = [float(v / w.trace) if w.trace > 0 else None for v in w.values]
    explained = F.element_at(F.array(*(F.lit(v).cast("double") for v in share)), F.col("component"))
    each = whiten(of.rows, w).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.withColumn("component", F.col("place") + 1).select(
        "vec_id", "component", "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
