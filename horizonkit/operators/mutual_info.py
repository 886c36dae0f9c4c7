"""Mutual information between each feature and a discrete target.

``mi_knn`` is the k-nearest-neighbour estimator for a continuous feature and
a discrete label (Ross 2014, PLoS ONE 9(2)), exact in 1-D:

* r_i  = distance to the k-th neighbour inside i's class (k = min(K, n_c - 1));
* m_i  = points of any class with |x_j - x_i| < r_i (itself included; when
  r_i = 0 the points equal to x_i);
* MI   = max(0, psi(N) + <psi(k)> - <psi(n_c)> - <psi(m)>); classes with a
  single row are left out entirely.

No step orders a whole feature in one task: ranks come from bucketed row
numbers, neighbours from ``lag`` / ``lead`` inside blocks of equal row count
(each block also gets the K rows beyond its edges), and m_i from a bucketed
running count over the values merged with the two range probes of every
point. Ties are not broken by random noise (the library adds some), so tied
data can differ slightly.

``mi_by_column`` gives the same numbers for the columns of a table of at most
``COLUMN_ROWS`` rows: such a column fits a task, which sorts it once for all
folds; its values travel packed, a few rows for each column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonkit.functions.digamma import digamma_int, digamma_of
from horizonkit.operators.prefix import bucketed_row_number, bucketed_running_sum, with_quantile_bucket
from horizonkit.session import cut_lineage


#: Rows of a block within which neighbours are looked up.
BLOCK_ROWS = 200_000
#: Rows of a column that a task takes at once (some 100 MB with all that is derived from them).
COLUMN_ROWS = 1 << 20


def mi_knn(long: DataFrame, id_col: str = "id", k: int = 3, block_rows: int = BLOCK_ROWS,
           rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``long``: (id, feature, x, y) -> (feature, mi).

    Works on distinct values with multiplicities: equal points have the same
    radius and count, so a value held by a third of all rows is one row here.
    """
    pts = long.select("feature", F.col("x").cast("double").alias("x"), "y").where(
        F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull())
    vals = pts.groupBy("feature", "y", "x").agg(F.count("*").alias("c"))
    st = vals.groupBy("feature", "y").agg(F.sum("c").alias("nc"))
    vals = (vals.join(st.where(F.col("nc") > 1), ["feature", "y"])           # drop singleton classes
                .withColumn("k", F.least(F.lit(k), F.col("nc") - 1)))
    vals = with_quantile_bucket(vals, ["feature", "y"], "x", rows_per_bucket=rows_per_bucket)
    vals = bucketed_row_number(vals, ["feature", "y"], [F.col("x")], "__vb", "rn").drop("__vb")

    # the K nearest distinct values on each side (each holds >= 1 point): a row goes to its
    # block, and to the next one too if it is within K rows of the edge between them
    at = (F.col("rn") - 1) % F.lit(block_rows)
    own = F.floor((F.col("rn") - 1) / F.lit(block_rows))
    blocks = F.array(own, F.when(at < k, own - 1), F.when(at >= block_rows - k, own + 1))
    spread = vals.select("*", own.alias("__own"), F.explode(F.array_compact(blocks)).alias("__block"))
    w = Window.partitionBy("feature", "y", "__block").orderBy("rn")
    near = {}
    for a in range(1, k + 1):
        for sign, step in ((-1, F.lag), (1, F.lead)):
            near[f"d{sign * a + k}"] = F.abs(step("x", a).over(w) - F.col("x"))
            near[f"c{sign * a + k}"] = step("c", a).over(w)
    v = spread.withColumns(near).where(F.col("__own") == F.col("__block"))

    def side_dist(sign: int, p: int):
        """Distance of the p-th nearest point on one side (NULL if fewer)."""
        if p == 0:
            return F.lit(0.0)
        expr = None
        cum = None
        for i in range(1, k + 1):
            ci = F.coalesce(F.col(f"c{sign * i + k}"), F.lit(0))
            cum = ci if cum is None else cum + ci
            di = F.col(f"d{sign * i + k}")
            expr = F.when(F.lit(p) <= cum, di) if expr is None else expr.when(F.lit(p) <= cum, di)
        return expr

    def radius(j: int):
        cands = []
        for a in range(0, j + 1):
            left, right = side_dist(-1, a), side_dist(1, j - a)
            cands.append(F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right)))
        return F.least(*cands) if len(cands) > 1 else cands[0]

    j = F.col("k") - (F.col("c") - 1)              # neighbours still needed beyond the ties
    r = F.lit(0.0)
    for jj in range(k, 0, -1):
        r = F.when(j == jj, radius(jj)).otherwise(r)
    v = cut_lineage(v.withColumn("r", F.when(j <= 0, F.lit(0.0)).otherwise(r))
                     .select("feature", "y", "x", "c", "k", "nc", "r"))

    # m: each row as one data value and two range probes; a running count over all of a
    # feature's rows, then the two probes of a row meet again.
    # order inside a value: 'lt' probe (0) < data (1) < 'le' probe (2)
    some = F.col("r") > 0
    rows = F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("t"), F.col("c").alias("w"), F.lit(0).alias("s")),
                   F.struct((F.col("x") + F.col("r")).alias("v"), F.when(some, 0).otherwise(2).alias("t"),
                            F.lit(0).cast("long").alias("w"), F.lit(1).alias("s")),
                   F.struct((F.col("x") - F.col("r")).alias("v"), F.when(some, 2).otherwise(0).alias("t"),
                            F.lit(0).cast("long").alias("w"), F.lit(-1).alias("s")))
    events = with_quantile_bucket(v.select("*", F.explode(rows).alias("e")).select("feature", "y", "x", "c", "k", "nc", "e.*"),
                                  ["feature"], "v", rows_per_bucket=rows_per_bucket)
    cum = bucketed_running_sum(events, ["feature"], [F.col("v"), F.col("t")], "__vb", {"cum": "w"})
    q = (cum.where(F.col("s") != 0).groupBy("feature", "y", "x", "c", "k", "nc")
            .agg(F.sum(F.col("s") * F.col("cum")).alias("m")))
    wsum = lambda e: F.sum(F.col("c") * e)  # noqa: E731 — multiplicity-weighted sums
    mi = q.groupBy("feature").agg(
        F.sum("c").alias("N"), wsum(digamma_int(F.col("k"))).alias("sk"),
        wsum(digamma_int(F.col("nc"))).alias("snc"), wsum(digamma_int(F.col("m"))).alias("sm"))
    val = (digamma_int(F.col("N")) + (F.col("sk") - F.col("snc") - F.col("sm")) / F.col("N"))
    return mi.select("feature", F.greatest(val, F.lit(0.0)).alias("mi"))


def mi_by_column(rows: DataFrame, width: int, folds: int | None = None, k: int = 3) -> DataFrame:
    """``rows``: (x array<double> of ``width`` values, y double, fold int) -> (feature int, out int, mi).

    ``feature`` is a place in ``x``; ``out`` a fold whose rows are left out, each of ``folds`` in turn (None: no
    row is, and ``out`` is 0). Values and labels are left out as in ``mi_knn``, and a column without any has no row.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            y, fold = (np.ascontiguousarray(b.column(i).to_numpy(zero_copy_only=False), t).tobytes() for i, t in ((1, "<f8"), (2, "<i4")))
            yield pa.RecordBatch.from_pydict({"feature": pa.array(range(width), pa.int32()), "x": pa.array([v.astype("<f8").tobytes() for v in x.T], pa.binary()),
                                              "y": pa.array([y] * width, pa.binary()), "fold": pa.array([fold] * width, pa.binary())})

    def score(key, t):
        x, y, fold = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("x", "<f8"), ("y", "<f8"), ("fold", "<i4")))
        order = np.argsort(x, kind="stable")
        order = order[:np.count_nonzero(~np.isnan(x))]  # NaN stands last
        x, fold, classes = x[order], fold[order], np.unique(y[order], return_inverse=True)[1]
        found = {}
        for out in range(folds or 1):
            own = slice(None) if folds is None else fold != out
            if (mi := _mi_of_sorted(x[own], classes[own], k)) is not None:
                found[out] = mi
        return pa.table({"feature": pa.array([key[0].as_py()] * len(found), pa.int32()), "out": pa.array(list(found), pa.int32()),
                         "mi": pa.array(list(found.values()), pa.float64())})

    given = F.lit(0) if folds is None else F.col("fold").cast("int")
    some = rows.select("x", F.col("y").cast("double").alias("y"), given.alias("fold")).where("y is not null and fold is not null")
    return (some.mapInArrow(pack, "feature int, x binary, y binary, fold binary")
            .groupBy("feature").applyInArrow(score, "feature int, out int, mi double"))


def _mi_of_sorted(x: np.ndarray, classes: np.ndarray, k: int) -> float | None:
    """``mi_knn`` of one column: its values in order and their classes, numbered."""
    counts = np.bincount(classes)
    many = counts[classes] > 1  # single rows of a class are left out
    x, classes = x[many], classes[many]
    if not len(x):
        return None
    r = np.empty(len(x))
    with np.errstate(invalid="ignore"):
        for c in np.flatnonzero(counts > 1):
            own = classes == c
            s, kc = x[own], min(k, counts[c] - 1)
            wide = np.concatenate((np.full(kc, -np.inf), s, np.full(kc, np.inf)))
            near = None
            for a in range(kc + 1):  # so many of the nearest ones below, the others above
                low, high = wide[kc - a:kc - a + len(s)], wide[2 * kc - a:2 * kc - a + len(s)]
                both = np.maximum(np.where(s == low, 0.0, s - low), np.where(s == high, 0.0, high - s))
                near = both if near is None else np.fmin(near, both)
            r[own] = near
        some = r > 0
        until = np.where(some, np.searchsorted(x, x + r, "left"), np.searchsorted(x, x, "right"))
        before = np.where(some, np.searchsorted(x, x - r, "right"), np.searchsorted(x, x, "left"))
    n, kept = len(x), counts[counts > 1]
    fixed = (kept * (digamma_of(np.minimum(k, kept - 1)) - digamma_of(kept))).sum()
    return max(0.0, float(digamma_of(np.array([n]))[0] + (fixed - digamma_of(until - before).sum()) / n))


def mi_binned(long: DataFrame, id_col: str = "id", bins: int = 10, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Plug-in MI on equal-frequency bins (``ntile`` by (x, id) per feature).

    Rows are counted by value first: only a value that lies on the edge of two
    bins needs its rows in the order of their ids, and those are numbered in
    blocks of ids, so a value held by a third of all rows is no group of one task.
    """
    pts = long.select(id_col, "feature", F.col("x").cast("double").alias("x"), "y").where(
        F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull())
    n = pts.groupBy("feature").agg(F.count("*").alias("n"))
    counts = pts.groupBy("feature", "x", "y").agg(F.count("*").alias("c"))
    values = with_quantile_bucket(counts.groupBy("feature", "x").agg(F.sum("c").alias("cx")), ["feature"], "x", rows_per_bucket=rows_per_bucket)
    values = cut_lineage(bucketed_running_sum(values, ["feature"], [F.col("x")], "__vb", {"until": "cx"}).join(n, "feature")
                         .select("feature", "x", (F.col("until") - F.col("cx")).alias("before"), "until", "n"))

    def ntile(rn: Column) -> Column:
        qn, rem = F.floor(F.col("n") / bins), F.col("n") % bins
        big = rem * (qn + 1)
        return (F.when(rn <= big, F.floor((rn - 1) / (qn + 1)) + 1)
                .otherwise(F.floor(F.try_divide(rn - 1 - big, qn)) + rem + 1).cast("int"))

    first, last = ntile(F.col("before") + 1), ntile(F.col("until"))
    whole = counts.join(values.where(first == last), ["feature", "x"]).select("feature", first.alias("bin"), "y", "c")
    edge = values.where(first != last)                                    # fewer than ``bins`` values a feature
    rows = with_quantile_bucket(pts.join(edge, ["feature", "x"]), ["feature", "x"], id_col, rows_per_bucket=rows_per_bucket)
    rows = bucketed_row_number(rows, ["feature", "x"], [F.col(id_col)], "__vb", "rn")
    parted = (rows.withColumn("bin", ntile(F.col("before") + F.col("rn"))).groupBy("feature", "bin", "y")
              .agg(F.count("*").alias("c")))
    cells = whole.unionByName(parted).groupBy("feature", "bin", "y").agg(F.sum("c").alias("c"))
    pb = cells.groupBy("feature", "bin").agg(F.sum("c").alias("cb"))
    py = cells.groupBy("feature", "y").agg(F.sum("c").alias("cy"))
    j = cells.join(pb, ["feature", "bin"]).join(py, ["feature", "y"]).join(n, "feature")
    term = (F.col("c") / F.col("n")) * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cy")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def select_k(scores: DataFrame, k: int, score: str = "mi") -> DataFrame:
    """The k best features by score (name breaks ties)."""
    from pyspark.sql import Window
    top = scores.orderBy(F.col(score).desc(), F.col("feature")).limit(k)
    w = Window.orderBy(F.col(score).desc(), F.col("feature"))     # over <= k rows
    return top.withColumn("rank", F.row_number().over(w))
