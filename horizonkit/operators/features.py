"""Feature-matrix operators: standardisation, correlation reducer, overlap.

Correlations of wide tables are sums of cross products by pairs of column
blocks; the driver sees one number a column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.operators.networks import added


def standardize_stats(long: DataFrame) -> DataFrame:
    """Mean and population std per feature (sklearn scaler statistics)."""
    return long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardize(long: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """z = (x - mean) / std fitted on ``fit`` (default: the input); std 0 -> z 0."""
    st = standardize_stats(long if fit is None else fit)
    z = F.when(F.col("std") > 0, (F.col("x") - F.col("mean")) / F.col("std")).otherwise(
        F.col("x") - F.col("mean"))
    return long.join(st, "feature").withColumn("z", z).drop("mean", "std")


#: Columns of a block, and numbers of cross products that a task holds in one pass.
BLOCK, HELD = 256, 1 << 23


def block_pairs(n_cols: int, block: int = BLOCK, held: int = HELD) -> list[list[tuple[int, int]]]:
    """All pairs of column blocks (the first not after the second), in as many passes as ``held`` numbers a pass ask for."""
    n = -(-n_cols // block)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    per = max(1, held // (block * block))
    return [pairs[k:k + per] for k in range(0, len(pairs), per)]


def strongest_earlier(wide: DataFrame, cols: list[str], block: int = BLOCK, held: int = HELD) -> dict[int, float]:
    """For each column the largest |Pearson r| with an earlier one, where there is any.

    Tasks add up the cross products of pairs of column blocks, Spark adds up the tasks' sums and
    keeps one number a column; no matrix of all columns is made anywhere. A constant column
    and one with a missing value have no r.
    """
    d = len(cols)
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    rows = wide.select(x.alias("x"))
    stats = (rows.select(F.posexplode("x").alias("at", "v")).groupBy("at")
             .agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("v"), F.count_if(F.col("v").isNull() | F.isnan("v")).alias("bad"))
             .collect())  # a row for each column
    mean, spread = np.zeros(d), np.full(d, np.nan)
    for r in stats:
        mean[r["at"]] = r["m"] if r["m"] is not None else 0.0
        if not r["bad"] and r["v"] > 0:
            spread[r["at"]] = np.sqrt(r["n"] * r["v"])
    found: dict[int, float] = {}
    for pairs in block_pairs(d, block, held):
        sums = added(rows.mapInArrow(_crossed(d, mean, pairs, block), "bi int, bj int, part int, n long, loss double, g binary"), ["bi", "bj"])
        most = sums.mapInArrow(_largest(d, spread, block), "j int, r double").groupBy("j").agg(F.max("r").alias("r"))
        for r in most.collect():  # at most a row for each column
            found[r["j"]] = max(r["r"], found.get(r["j"], 0.0))
    return found


def _crossed(d: int, mean: np.ndarray, pairs: list[tuple[int, int]], block: int):
    def run(batches):
        from pyspark import TaskContext
        total, n = {p: 0.0 for p in pairs}, 0
        for b in batches:
            x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d) - mean
            n += len(x)
            for i, j in pairs:
                total[i, j] = total[i, j] + x[:, i * block:(i + 1) * block].T @ x[:, j * block:(j + 1) * block]
        if n:
            yield pa.RecordBatch.from_pydict({
                "bi": pa.array([i for i, _ in pairs], pa.int32()), "bj": pa.array([j for _, j in pairs], pa.int32()),
                "part": pa.array([TaskContext.get().partitionId()] * len(pairs), pa.int32()), "n": pa.array([n] * len(pairs)),
                "loss": pa.array([0.0] * len(pairs)), "g": pa.array([total[p].tobytes() for p in pairs], pa.binary())})

    return run


def _largest(d: int, spread: np.ndarray, block: int):
    def run(batches):
        for b in batches:
            for i, j, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                rows, cols = (np.arange(k * block, min((k + 1) * block, d)) for k in (i, j))
                r = np.abs(np.frombuffer(g, "<f8").reshape(len(rows), len(cols)) / np.outer(spread[rows], spread[cols]))
                r[(rows[:, None] >= cols) | np.isnan(r)] = -1.0
                most = r.max(0)
                yield pa.RecordBatch.from_pydict({"j": pa.array(cols[most >= 0], pa.int32()), "r": pa.array(most[most >= 0])})

    return run


def correlation_reducer(wide: DataFrame, cols: list[str], threshold: float = 0.9) -> DataFrame:
    """Drop column j if |r(i, j)| > threshold for any earlier i.

    Earlier columns count even when they are dropped themselves (the
    reference compares against the full upper triangle); NaN (constant
    column) never triggers a drop. Returns one row per column.
    """
    most = strongest_earlier(wide, cols)
    rows = [(c, j, float(most[j]) if j in most else None, int(most.get(j, 0.0) <= threshold)) for j, c in enumerate(cols)]
    return wide.sparkSession.createDataFrame(
        rows, "feature string, idx int, max_abs_corr double, kept int")


def selection_overlap(selected: DataFrame, model: str = "model") -> DataFrame:
    """For each set of models, how many features all of them selected.

    ``selected``: (model, feature). The per-feature set is bounded by the
    number of models.
    """
    per = selected.groupBy("feature").agg(
        F.concat_ws("|", F.sort_array(F.collect_set(model))).alias("models"))
    return per.groupBy("models").agg(F.count("*").alias("n_features"),
                                     F.concat_ws(",", F.sort_array(F.collect_list("feature"))).alias("features"))


class CorrelationReducer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """L1: the reducer as a fit / transform stage on named columns."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to reduce", TypeConverters.toListString)
    threshold = Param(Params._dummy(), "threshold", "|r| above which a later column is dropped",
                      TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, threshold=0.9):
        super().__init__()
        self._setDefault(threshold=0.9)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CorrelationReducerModel":
        table = correlation_reducer(df, self.getOrDefault("inputCols"), self.getOrDefault("threshold"))
        keep = [r["feature"] for r in table.orderBy("idx").collect() if r["kept"] == 1]   # one row per column
        return CorrelationReducerModel(keep=keep, drop=[c for c in self.getOrDefault("inputCols") if c not in keep])


class CorrelationReducerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    keep = Param(Params._dummy(), "keep", "kept columns", TypeConverters.toListString)
    drop = Param(Params._dummy(), "drop", "dropped columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, keep=None, drop=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault("drop"))
