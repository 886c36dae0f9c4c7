"""Centroid clustering in whole numbers, pruned by Ptolemaic pivots.

For points x, c and pivots p, q Ptolemy's inequality says
d(x, c) d(p, q) >= |d(x, p) d(c, q) - d(x, q) d(c, p)|. Distances of all vectors
to the pivots are computed once and kept beside them; those of the centroids
once a round. The bounds are rounded down, a centroid is left out only if its
bound lies beyond a distance already known, and all others are checked in
integers, so every assignment is exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.llm.common import slices
from horizonkit.session import written

#: Units of a component; components beyond this size in units would take squared distances out of 64 bits.
UNITS, LARGEST = 256, 1 << 26
#: Pivots and pairs of them whose bounds are taken.
PIVOTS, PAIRS = 8, 10
#: Vectors a task handles at a time.
AT_ONCE = 2048
_EPS = np.finfo(np.float64).eps


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, pair by pair."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` to the few rows of ``c``."""
    return np.stack([squared(x, row) for row in c], axis=1) if len(c) else np.empty((len(x), 0), np.int64)


def choose_pivots(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Different points far apart: the first, then each time the farthest from those chosen."""
    far, chosen = squared(points, points[0]), [0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(points, points[chosen[-1]]))
    return points[chosen]


def pivot_pairs(pivots: np.ndarray, n: int = PAIRS) -> list[tuple[int, int]]:
    """The pairs farthest apart."""
    gaps = all_squared(pivots, pivots)
    pairs = [(i, j) for i in range(len(pivots)) for j in range(i + 1, len(pivots))]
    return sorted(pairs, key=lambda p: (-gaps[p], p))[:n]


def lower_bounds(near: np.ndarray, own: np.ndarray, gaps: dict[tuple[int, int], float]) -> np.ndarray:
    """Lower bounds of the distances vector - centroid, never above them.

    ``near`` and ``own``: distances of the vectors and of the centroids to the
    pivots. A rounded distance is off by less than one part in 2**52, so the
    difference of two products is off by less than eight such parts of their sum.
    """
    best = np.zeros((len(near), len(own)))
    for (p, q), gap in gaps.items():
        a, b = np.outer(near[:, p], own[:, q]), np.outer(near[:, q], own[:, p])
        np.maximum(best, (np.abs(a - b) - 8 * _EPS * (a + b)) * ((1 - 8 * _EPS) / gap), out=best)
    return best


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, own: np.ndarray,
            gaps: dict[tuple[int, int], float]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many were checked."""
    low = lower_bounds(near, own, gaps)
    first = low.argmin(1)
    best = squared(x, centroids[first])
    rows = np.arange(len(x))
    open_ = low * low * (1 - 4 * _EPS) <= best[:, None]
    open_[rows, first] = False
    i, c = np.nonzero(open_)
    found = np.full(low.shape, np.iinfo(np.int64).max)
    found[rows, first] = best
    for at in range(0, len(i), 1 << 15):
        k, m = i[at:at + (1 << 15)], c[at:at + (1 << 15)]
        found[k, m] = squared(x[k], centroids[m])
    to = found.argmin(1)  # the first of equal ones
    return to, found[rows, to], len(x) + len(i)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``(vec_id, x)`` of the vectors of ``dim`` finite components: whole units, rounded down, as an array."""
    fits = (F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
            .where(F.col("x").isNotNull() & fits)
            .select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(UNITS)))).alias("x")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim)


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2:", id_col: str = "vec_id",
            vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Assign the vectors of ``dim`` finite components to ``k`` centroids: ``(vec_id, cluster, distance)`` and the centroids.

    Components become whole units of 1/256, rounded down. Centroids start as
    the vectors whose id, behind ``seed``, has the smallest sha256; a round
    assigns every vector to the nearest (ties: the smaller number) and moves a
    centroid to the mean of its vectors, rounded down; one without vectors
    stays. After ``rounds`` vectors are assigned once more.

    Null vectors, other lengths, null and non-finite components take no part.
    A null id is hashed as an empty one. Of repeated ids the smaller vector
    comes first as a centroid, and each of its rows is assigned; equal vectors
    make equal centroids, of which the larger numbers get no vectors. Fewer
    than ``k`` vectors make fewer centroids; none give an empty result. A
    component of 2**18 or more raises a ValueError: its distances would not fit 64 bits.
    """
    spark = rows.sparkSession
    kept = whole_vectors(rows, id_col, vec_col, dim)
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.empty((0, dim), np.int64)
    centroids = np.array([r["x"] for r in sorted(first, key=lambda r: (r["h"], r["x"]))], np.int64)
    pivots = choose_pivots(centroids)
    pairs = pivot_pairs(pivots)
    gaps = {(p, q): float(np.sqrt(squared(pivots[[p]], pivots[q])[0])) for p, q in pairs}

    def measured(batches):
        for b in slices(batches, AT_ONCE):
            x = _matrix(b.column(1), dim)
            if x.max(initial=0) > LARGEST or x.min(initial=0) < -LARGEST:
                raise ValueError(f"a component is beyond {LARGEST // UNITS}")
            near = all_squared(x, pivots)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary()),
                 pa.array([v.tobytes() for v in near.astype("<i8")], pa.binary())], ["vec_id", "x", "near"])

    table = written(kept.mapInArrow(measured, "vec_id long, x binary, near binary"), "vectors")
    for _ in range(rounds):
        centroids = _moved(table, centroids, pivots, gaps)
    own = np.sqrt(all_squared(centroids, pivots).astype(np.float64))

    def assigned(batches):
        for b in slices(batches, AT_ONCE):
            x, near = _read(b, dim, len(pivots))
            to, distance, _ = nearest(x, near, centroids, own, gaps)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(assigned, "vec_id long, cluster int, distance long"), centroids


def _read(b: pa.RecordBatch, dim: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, dim)
    return x, np.sqrt(np.frombuffer(b"".join(b.column(2).to_pylist()), "<i8").reshape(-1, pivots).astype(np.float64))


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, gaps: dict) -> np.ndarray:
    """Centroids after one round: a task adds up its vectors by cluster, Spark the tasks' sums, at most k rows come back."""
    own = np.sqrt(all_squared(centroids, pivots).astype(np.float64))
    k, dim = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in slices(batches, AT_ONCE):
            x, near = _read(b, dim, len(pivots))
            to, _, _ = nearest(x, near, centroids, own, gaps)
            order = np.argsort(to, kind="stable")
            starts = np.flatnonzero(np.diff(to[order], prepend=-1))
            if len(to):
                total[to[order][starts]] += np.add.reduceat(x[order].astype(np.int64), starts)
            count += np.bincount(to, minlength=k)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(met, pa.int32()), "n": pa.array(count[met], pa.int64()),
                                          "s": pa.array(list(total[met]), pa.list_(pa.int64()))})

    wide = [F.sum(F.col("s")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dim)]
    out = centroids.copy()
    for r in table.select("vec_id", "x", "near").mapInArrow(sums, "cluster int, n long, s array<long>").groupBy("cluster").agg(
            F.sum("n").alias("n"), *wide).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster``'s rows with their cluster's and the whole inertia, and their centroid's sha256."""
    assigned = written(assigned, "assigned")
    of = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # at most k rows
    table = [(c, s, sum(of.values()), centroid_digest(centroids[c])) for c, s in of.items()]
    small = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
