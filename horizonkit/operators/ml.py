"""Model stages: selector, scaler, evaluator, classifiers, search, out-of-fold, importance.

Trees (``trees``) and networks (``networks``) train many models at once over
one binned or packed table; here they become stages of Spark ML pipelines.
Feature columns stay named until the ML boundary, where ``VectorAssembler``
builds the vector.
"""

from __future__ import annotations

import base64
import itertools
import json
import math
import random

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from horizonkit.functions import metrics as M
from horizonkit.functions.coerce import portable_hash
from horizonkit.operators import evaluation as EV
from horizonkit.operators import mutual_info
from horizonkit.operators import networks as NN
from horizonkit.operators import trees as TR
from horizonkit.operators.mutual_info import mi_by_column, mi_knn
from horizonkit.operators.prefix import bucketed_row_number, hash_bits_for, hash_bucket
from horizonkit.session import written

# ------------------------------------------------------------------ L2
class GMeanEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Strict G-Mean of ``prediction`` vs ``label`` (one aggregate job); the columns are kept when it is saved."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "predicted class", TypeConverters.toString)

    @keyword_only
    def __init__(self, labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        counts = M.confusion_aggs(self.getOrDefault("labelCol"), self.getOrDefault("predictionCol"))
        return dataset.agg(*counts).select(M.gmean_strict().alias("g")).first()["g"]

    def isLargerBetter(self) -> bool:
        return True


# ------------------------------------------------------------------ E7 as a stage
class _SelParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "number of features kept", TypeConverters.toInt)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id column", TypeConverters.toString)


class MISelector(Estimator, _SelParams, DefaultParamsReadable, DefaultParamsWritable):
    """SelectKBest(mutual information) on named columns -> assembled vector.

    Scores are computed on the rows it is fitted on; a search over k ranks
    each fold once and passes the ranking on (``search``). Scaling does not
    change k-NN MI, so selecting before the scaler equals the reference's
    scale-then-select order.
    """

    @keyword_only
    def __init__(self, inputCols=None, labelCol="label", k=10, outputCol="features", idCol="id"):
        super().__init__()
        self._setDefault(labelCol="label", k=10, outputCol="features", idCol="id")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MISelectorModel":
        cols = self.getOrDefault("inputCols")
        if self.getOrDefault("k") >= len(cols):          # keeps everything: no scoring pass
            return MISelectorModel(selected=list(cols), outputCol=self.getOrDefault("outputCol"))
        ranked = mi_ranking(df, cols, self.getOrDefault("labelCol"), self.getOrDefault("idCol"))
        keep = [c for c in cols if c in set(ranked[: self.getOrDefault("k")])]
        return MISelectorModel(selected=keep, outputCol=self.getOrDefault("outputCol"))


def mi_ranking(df: DataFrame, cols: list[str], label: str = "label", id_col: str = "id") -> list[str]:
    """Columns by falling mutual information with the label (one row per column comes to the driver)."""
    if fits_by_column(df, label):
        scores = {cols[r["feature"]]: r["mi"] for r in mi_by_column(_columns(df, cols, label, F.lit(0)), len(cols)).collect()}
        return sorted(cols, key=lambda c: (-scores.get(c, 0.0), c))
    long = df.select(F.col(id_col).alias("id"), F.col(label).alias("y"),
                     F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("kv")).select("id", "y", "kv.*")
    scores = {r["feature"]: r["mi"] for r in mi_knn(long).collect()}
    return sorted(cols, key=lambda c: (-scores.get(c, 0.0), c))


def fits_by_column(df: DataFrame, label: str) -> bool:
    """Whether a task may take a whole column of the table (a label that is no number stays with ``mi_knn``)."""
    return isinstance(df.schema[label].dataType, NumericType) and df.limit(mutual_info.COLUMN_ROWS + 1).count() <= mutual_info.COLUMN_ROWS


def _columns(df: DataFrame, cols: list[str], label: str, fold) -> DataFrame:
    return df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), F.col(label).alias("y"), fold.alias("fold"))


def fold_rankings(df: DataFrame, cols: list[str], label: str, id_col: str, fold_col: str, n_folds: int) -> list[list[int]]:
    """For each fold the places of ``cols`` by falling mutual information on the rows outside it, all folds in one pass."""
    if fits_by_column(df, label):
        score = {f"{r['out']}:{r['feature']}": r["mi"] for r in mi_by_column(_columns(df, cols, label, F.col(fold_col)), len(cols), n_folds).collect()}
        return [sorted(range(len(cols)), key=lambda i: (-score.get(f"{f}:{i}", 0.0), cols[i])) for f in range(n_folds)]
    outside = F.explode(F.array(*[F.lit(i) for i in range(n_folds)])).alias("out")
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("y"), F.col(fold_col).alias("fold"), *cols, outside).where("fold <> out")
    long = rows.select("id", "y", F.explode(F.array(*[
        F.struct(F.concat_ws(":", F.col("out").cast("string"), F.lit(str(i))).alias("feature"), F.col(c).cast("double").alias("x"))
        for i, c in enumerate(cols)])).alias("kv")).select("id", "y", "kv.*")
    score = {r["feature"]: r["mi"] for r in mi_knn(long).collect()}  # a row for each fold and column
    return [sorted(range(len(cols)), key=lambda i: (-score.get(f"{f}:{i}", 0.0), cols[i])) for f in range(n_folds)]


class MISelectorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    selected = Param(Params._dummy(), "selected", "kept columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, selected=None, outputCol="features"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.getOrDefault("selected"),
                               outputCol=self.getOrDefault("outputCol")).transform(df)


# ------------------------------------------------------------------ D17 as a stage
class PopulationScaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population standard deviation of a vector column; constant columns become 0."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "scaled vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="scaled"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        col = vector_to_array(F.col(self.getOrDefault("inputCol")))
        rows = (df.select(F.posexplode(col).alias("at", "v")).groupBy("at")
                .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("at").collect())  # a row for each column
        return PopulationScalerModel(inputCol=self.getOrDefault("inputCol"), outputCol=self.getOrDefault("outputCol"),
                                     mean=[r["m"] for r in rows], std=[r["s"] or 1.0 for r in rows])


class PopulationScalerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "scaled vector column", TypeConverters.toString)
    mean = Param(Params._dummy(), "mean", "column means", TypeConverters.toListFloat)
    std = Param(Params._dummy(), "std", "column deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="scaled", mean=None, std=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        mean, std = (F.array(*[F.lit(v) for v in self.getOrDefault(n)]) for n in ("mean", "std"))
        scaled = F.transform(vector_to_array(F.col(self.getOrDefault("inputCol"))), lambda x, i: (x - mean[i]) / std[i])
        return df.withColumn(self.getOrDefault("outputCol"), array_to_vector(scaled))


# ------------------------------------------------------------------ L5, F7-F11
# The reference's search spaces (sklearn names).
K_GRID = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 120, 140, 180, 200, 220, 239]
GRIDS = {
    "RandomForest": {"n_estimators": [100, 200, 300], "max_features": ["sqrt", 0.6, 0.8],
                     "max_depth": [10, 20, None], "min_samples_leaf": [1, 2, 4],
                     "criterion": ["gini", "entropy"]},
    "GradientBoosting": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1],
                         "max_depth": [3, 5, 10], "subsample": [0.8, 0.9, 1.0]},
    "XGBoost": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1],
                "max_depth": [3, 5, 7], "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0]},
    "LightGBM": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1],
                 "num_leaves": [20, 31, 40], "max_depth": [-1, 10, 20], "subsample": [0.8, 0.9, 1.0],
                 "colsample_bytree": [0.8, 0.9, 1.0]},
    "MLPClassifier": {"hidden_layer_sizes": [(50,), (100,), (50, 25)], "activation": ["tanh", "relu"], "solver": ["adam"],
                      "alpha": [0.0001, 0.001, 0.05], "learning_rate": ["constant", "adaptive"]},
}
WEIGHTED = {"RandomForest", "GradientBoosting", "XGBoost", "LightGBM"}


class _FitParams(Params):
    name = Param(Params._dummy(), "name", "model of the registry", TypeConverters.toString)
    params = Param(Params._dummy(), "params", "its parameters as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight column, if any", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id column", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)


class RegistryClassifier(Estimator, _FitParams, DefaultParamsReadable, DefaultParamsWritable):
    """A tree ensemble or network of the registry on a vector column."""

    @keyword_only
    def __init__(self, name=None, params="{}", featuresCol="scaled", labelCol="label", weightCol="", idCol="id", seed=42):
        super().__init__()
        self._setDefault(params="{}", featuresCol="scaled", labelCol="label", weightCol="", idCol="id", seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ScoringModel":
        name, params, weight = self.getOrDefault("name"), json.loads(self.getOrDefault("params")), self.getOrDefault("weightCol")
        rows = df.select(F.col(self.getOrDefault("idCol")).alias("id"), vector_to_array(F.col(self.getOrDefault("featuresCol"))).alias("x"),
                         F.col(self.getOrDefault("labelCol")).cast("double").alias("y"),
                         (F.col(weight) if weight and name in WEIGHTED else F.lit(1.0)).alias("w"), F.lit(0).alias("fold"))
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to fit")
        if name == "MLPClassifier":
            table = NN.matrix(rows, first[0])
            job = NN.job(table, NN.net_of(params), range(first[0]), None, self.getOrDefault("seed"))
            job = NN.train(table, [job])[0]
            state = job.state.packed()
            return ScoringModel(kind="network", state=base64.b64encode(state).decode(), featuresCol=self.getOrDefault("featuresCol"),
                                mean=job.mean.tolist(), std=job.std.tolist())
        table = TR.binned(rows, first[0])
        model = TR.fit(table, TR.spec_of(name, params), seed=self.getOrDefault("seed"))
        return ScoringModel(kind="trees", state=base64.b64encode(model.packed(table.edges)).decode(),
                            featuresCol=self.getOrDefault("featuresCol"), mean=[], std=[])


class ScoringModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted model of the registry: adds ``probability`` and ``prediction`` (a tie at one half is class 0)."""

    kind = Param(Params._dummy(), "kind", "trees or network", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "its arrays, compressed", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    mean = Param(Params._dummy(), "mean", "shift of a network's inputs", TypeConverters.toListFloat)
    std = Param(Params._dummy(), "std", "scale of a network's inputs", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, kind="trees", state="", featuresCol="scaled", mean=None, std=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def unpacked(self):
        """Trees with the edges of their bins, or a network's state."""
        data = base64.b64decode(self.getOrDefault("state"))
        return TR.Ensemble.unpacked(data) if self.getOrDefault("kind") == "trees" else NN.State.unpacked(data)

    def _transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.unpacked())  # the model's size
        trees = self.getOrDefault("kind") == "trees"
        mean, std = np.array(self.getOrDefault("mean")), np.array(self.getOrDefault("std"))

        @F.pandas_udf("double")
        def positive(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            values = np.stack(x.to_numpy())
            if trees:
                model, edges = sent.value
                return pd.Series(model.probability(TR.bin_values(values, edges)))
            z = NN.logits((values - mean) / std, sent.value.weights, sent.value.net)
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

        p = F.col("probability")
        return (df.withColumn("probability", positive(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
                .withColumn("prediction", (p > 0.5).cast("double"))
                .withColumn("probability", array_to_vector(F.array(1 - p, p))))


def make_classifier(name: str, params: dict, seed: int = 42, weight_col: str | None = None,
                    features: str = "scaled", label: str = "label", id_col: str = "id") -> RegistryClassifier:
    """One classifier from a sampled parameter dict."""
    if name not in GRIDS:
        raise ValueError(name)
    (NN.net_of(params) if name == "MLPClassifier" else TR.spec_of(name, params))  # fails here, not in a job
    return RegistryClassifier(name=name, params=json.dumps(params), featuresCol=features, labelCol=label,
                              weightCol=weight_col or "", idCol=id_col, seed=seed)


def make_pipeline(name: str, params: dict, k: int, cols: list[str], weight_col: str | None = None,
                  label: str = "label", id_col: str = "id") -> Pipeline:
    """select(k) -> standard scaler (mean, population std) -> classifier."""
    sel = MISelector(inputCols=cols, labelCol=label, k=k, outputCol="features", idCol=id_col)
    return Pipeline(stages=[sel, PopulationScaler(), make_classifier(name, params, weight_col=weight_col, label=label, id_col=id_col)])


def sample_draws(name: str, n_draws: int, seed: int = 42, k_grid=None) -> list[dict]:
    """draws without replacement from the full grid (k is one dimension)."""
    grid = dict(GRIDS[name])
    grid["k"] = list(k_grid or K_GRID)
    keys = sorted(grid)
    total = 1
    for kk in keys:
        total *= len(grid[kk])
    rng = random.Random(seed)
    idx = rng.sample(range(total), min(n_draws, total))
    out = []
    for i in idx:
        d = {}
        for kk in keys:
            d[kk] = grid[kk][i % len(grid[kk])]
            i //= len(grid[kk])
        out.append(d)
    return out


def grid_draws(name: str, k_grid=None) -> list[dict]:
    """the full grid."""
    grid = dict(GRIDS[name])
    grid["k"] = list(k_grid or K_GRID)
    keys = sorted(grid)
    return [dict(zip(keys, v)) for v in itertools.product(*[grid[k] for k in keys])]


def search(train: DataFrame, name: str, cols: list[str], draws: list[dict], fold_col: str = "fold",
           weight_col: str | None = None, label: str = "label",
           n_folds: int = 5, id_col: str = "id") -> tuple[dict, float, list, PipelineModel]:
    """cross-validated G-Mean of each draw; returns (best draw, score, all scores, refit).

    Columns are ranked once for all folds, features binned (or packed) once, and
    all draws of all folds are trained over that one table. The best draw (the
    first one on ties) is fitted once more on all rows.
    """
    scores = search_scores(train, name, cols, draws, fold_col, weight_col, label, n_folds, id_col)
    best, score = max(scores, key=lambda t: t[1])
    params, k = split_best(best)
    refit = make_pipeline(name, params, min(k, len(cols)), cols, weight_col, label, id_col).fit(train)
    return best, score, scores, refit


def search_scores(train: DataFrame, name: str, cols: list[str], draws: list[dict], fold_col: str = "fold", weight_col: str | None = None,
                  label: str = "label", n_folds: int = 5, id_col: str = "id") -> list[tuple[dict, float]]:
    """Every draw with its mean G-Mean over the folds (a row for each draw comes back)."""
    for d in draws:
        make_classifier(name, split_best(d)[0])  # a draw that cannot be made fails before any job
    capped, ranked, rows = _search_inputs(train, name, cols, draws, fold_col, weight_col, label, n_folds, id_col)
    if name == "MLPClassifier":
        counts = NN.search_counts(NN.matrix(rows, len(cols)), capped, ranked)
    else:
        counts = TR.search_counts(TR.binned(rows, len(cols)), name, capped, ranked)
    found = {r["draw"]: r["g"] for r in counts.select("draw", M.gmean_strict().alias("g")).groupBy("draw").agg(F.avg("g").alias("g")).collect()}
    return [(d, found[i]) for i, d in enumerate(draws)]


def _search_inputs(train, name, cols, draws, fold_col, weight_col, label, n_folds, id_col):
    """Draws with k within the columns, the folds' rankings, and the rows ``id, x, y, w, fold``."""
    if all(d["k"] >= len(cols) for d in draws):
        ranked = [list(range(len(cols)))] * n_folds
    else:
        ranked = fold_rankings(train, cols, label, id_col, fold_col, n_folds)
    capped = [d | {"k": min(d["k"], len(cols))} for d in draws]
    rows = train.select(F.col(id_col).alias("id"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"),
                        F.col(label).cast("double").alias("y"),
                        (F.col(weight_col) if weight_col and name in WEIGHTED else F.lit(1.0)).alias("w"), F.col(fold_col).alias("fold"))
    return capped, ranked, rows


def oof_side_by_side(train: DataFrame, name: str, params: dict, k: int, cols: list[str], fold_col: str = "fold", weight_col: str | None = None,
                     label: str = "label", n_folds: int = 5, id_col: str = "id") -> DataFrame:
    """``id, fold, label, p`` of every training row, the folds' models trained at once over one table."""
    [draw], ranked, rows = _search_inputs(train, name, cols, [params | {"k": k}], fold_col, weight_col, label, n_folds, id_col)
    chosen = [sorted(r[:draw["k"]]) for r in ranked]
    if name == "MLPClassifier":
        return NN.held_out(NN.matrix(rows, len(cols)), NN.net_of(params), chosen)
    return TR.held_out(TR.binned(rows, len(cols)), TR.spec_of(name, params), chosen)


def split_best(best: dict) -> tuple[dict, int]:
    """model parameters and k apart."""
    return {k: v for k, v in best.items() if k != "k"}, best["k"]


def positive_prob(df: DataFrame, out: str = "p") -> DataFrame:
    """B24 input: P(class 1) out of the probability vector."""
    return df.withColumn(out, vector_to_array("probability")[1])


def fold_pipelines(train: DataFrame, pipe: Pipeline, fold_col: str = "fold", k: int = 5) -> list[Pipeline]:
    """The pipeline for each held-out fold, columns ranked for all folds in one pass."""
    sel, *rest = pipe.getStages()
    if not isinstance(sel, MISelector) or sel.getOrDefault("k") >= len(sel.getOrDefault("inputCols")):
        return [pipe] * k
    cols, n = sel.getOrDefault("inputCols"), sel.getOrDefault("k")
    ranked = fold_rankings(train, cols, sel.getOrDefault("labelCol"), sel.getOrDefault("idCol"), fold_col, k)
    return [Pipeline(stages=[MISelectorModel(selected=[cols[i] for i in sorted(r[:n])], outputCol=sel.getOrDefault("outputCol")), *rest])
            for r in ranked]


def oof_predictions(train: DataFrame, pipe: Pipeline, fold_col: str = "fold", k: int = 5) -> DataFrame:
    """fit on the other folds, predict the held-out fold, union (weights
    are those of the whole training set, as in the reference)."""
    parts = []
    for i, own in enumerate(fold_pipelines(train, pipe, fold_col, k)):
        m = own.fit(train.where(F.col(fold_col) != i))
        parts.append(positive_prob(m.transform(train.where(F.col(fold_col) == i))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_report(train: DataFrame, pipe: Pipeline, fold_col: str = "fold", k: int = 5, label: str = "label") -> DataFrame:
    """F16 + D15: per-fold metric set at the default cut, then mean / population std."""
    preds = oof_predictions(train, pipe, fold_col, k).withColumn("pred", F.col("prediction").cast("int"))
    m = EV.metrics_table(EV.confusion(preds, label, "pred", [fold_col]), keep=[fold_col]).drop("gmean_score")
    long = m.unpivot([fold_col], ["accuracy", "precision", "recall", "specificity", "f1", "gmean"], "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def multipliers(n: int, repeats: int, seed: int = 42) -> list[tuple[int, int]]:
    """For each repeat (a, b): place i of n rows -> (a i + b) mod n is a permutation, as a and n share no factor."""
    out = []
    for r in range(repeats):
        a = 1 + ((r + 1) * 2_654_435_761 + seed) % n
        while math.gcd(a, n) != 1:
            a += 1
        out.append((a, ((r + 1) * 40_503 + seed * 7_919) % n))
    return out


def permuted_copies(test: DataFrame, cols: list[str], repeats: int = 10, seed: int = 42,
                    id_col: str = "id") -> DataFrame:
    """Each row once per (``__f`` column, ``__r`` repeat), that column's value taken from another row.

    In repeat r the row of rank i (by one seeded hash) takes the value of the
    row of rank i by a seeded hash of that repeat: a shuffle of its own for each
    repeat. All repeats are ranked in one pass; the join moves ``repeats`` copies of
    the rows, and the columns are spread afterwards inside each task.
    """
    bits = hash_bits_for(test.count())

    def ranked(df: DataFrame, part: list[str]) -> DataFrame:
        h = df.withColumn("__hb", hash_bucket(F.col("__h"), bits))
        return bucketed_row_number(h, part, [F.col("__h"), F.col(id_col)], "__hb", "__rid").drop("__h", "__hb")

    shuffles = F.explode(F.array(*[F.struct(F.lit(r).alias("__r"), portable_hash(F.col(id_col), seed + r).alias("__h"))
                                   for r in range(repeats)])).alias("__s")
    other = ranked(test.select(id_col, F.struct(*[F.col(c) for c in cols]).alias("__from"), shuffles).select(id_col, "__from", "__s.*"), ["__r"])
    own = ranked(test.withColumn("__h", portable_hash(F.col(id_col), seed + 10_007)), []).select(
        "*", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("__r"))
    names = F.explode(F.array(*[F.lit(c) for c in cols])).alias("__f")
    j = own.join(other.drop(id_col), ["__rid", "__r"]).select("*", names)
    changed = [F.when(F.col("__f") == c, F.col(f"__from.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
               for c in test.columns]
    return j.select(*changed, "__f", "__r")


def permutation_importance(score, test: DataFrame, cols: list[str], repeats: int = 10, seed: int = 42,
                           id_col: str = "id", label: str = "label", top: int | None = 15) -> DataFrame:
    """mean G-Mean drop when one of ``cols`` is shuffled among the test rows.

    ``score(df)`` adds an integer column ``pred``; it runs once over the rows
    and once over all shuffled copies.
    """
    base = score(test).agg(*M.confusion_aggs(label, "pred")).select(M.gmean_strict().alias("base"))
    g = (score(permuted_copies(test, cols, repeats, seed, id_col)).groupBy("__f", "__r")
         .agg(*M.confusion_aggs(label, "pred")).select("__f", M.gmean_strict().alias("g")))
    b = base.first()["base"]
    imp = g.groupBy(F.col("__f").alias("feature")).agg((F.lit(b) - F.avg("g")).alias("importance"))
    imp = imp.orderBy(F.col("importance").desc(), "feature")
    return imp.limit(top) if top else imp


def predicted_by(model: PipelineModel):
    """The ``score`` of a fitted pipeline."""
    return lambda df: model.transform(df).withColumn("pred", F.col("prediction").cast("int"))


def training_history(model: PipelineModel, train: DataFrame, val: DataFrame, label: str = "label", id_col: str = "id") -> DataFrame:
    """train and validation log-loss after every tree of a fitted boosting model."""
    ensemble, edges = model.stages[-1].unpacked()

    def losses(df: DataFrame) -> list[float]:
        for st in model.stages[:-1]:
            df = st.transform(df)
        rows = df.select(F.col(id_col).alias("id"), vector_to_array(model.stages[-1].getOrDefault("featuresCol")).alias("x"),
                         F.col(label).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0).alias("fold"))
        return TR.stage_losses(TR.binned(rows, len(edges), edges=edges), ensemble)

    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(losses(train), losses(val), strict=True))]
    return val.sparkSession.createDataFrame(rows, "iteration int, train_loss double, val_loss double")


def learning_curve(data: DataFrame, cols: list[str], params: dict, part_col: str, label: str = "label", id_col: str = "id",
                   seed: int = 42, state: NN.State | None = None, epochs: int | None = None) -> tuple[DataFrame, NN.State]:
    """F20 for the network: both parts' log-loss after every epoch of one training run, and where it stands.

    ``part_col`` is ``train`` or ``test``; with a ``state`` of an earlier call training goes on from there.
    """
    rows = data.select(F.col(id_col).alias("id"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"),
                       F.col(label).cast("double").alias("y"), F.when(F.col(part_col) == "train", 0).otherwise(1).alias("fold"))
    table = NN.matrix(rows, len(cols))
    job = NN.job(table, NN.net_of(params), range(len(cols)), 1, seed)
    if state is not None:
        job.state = state
    done = NN.train(table, [job], epochs, watch=True)[0].state
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(done.losses)]  # a row for each epoch
    return data.sparkSession.createDataFrame(rows, "iteration int, train_loss double, val_loss double"), done
