"""Mutual information by whole columns, networks' reused arrays, histograms of boosted trees."""

import math

import numpy as np
from pyspark.sql import functions as F

from horizonkit.operators import ml as ML
from horizonkit.operators import mutual_info as MI
from horizonkit.operators import networks as NN
from horizonkit.operators import trees as TR


def odd_rows():
    """Ties, nulls, NaN, a class of one row, rows without label or fold."""
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 4)), None if i % 7 == 0 else float(i % 5) + float(rng.normal()) / 9,
             math.nan if i % 11 == 0 else 1.0, float(i % 2), i % 3) for i in range(120)]
    return [*rows, (200, 0.5, 1.0, 2.0, 3.0, 9.0, 0), (201, 0.1, 1.0, 2.0, 3.0, None, 1), (202, 0.2, 1.0, 2.0, 3.0, 1.0, None)]


def test_ranking_by_columns_is_that_of_the_long_table(spark, monkeypatch):
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(odd_rows(), "id long, a double, b double, c double, d double, label double, fold int").repartition(3).cache()
    long = df.select("id", F.col("label").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])).alias("kv")).select("id", "y", "kv.*")
    want = {r["feature"]: r["mi"] for r in MI.mi_knn(long).collect()}
    got = {cols[r["feature"]]: r["mi"] for r in MI.mi_by_column(ML._columns(df, cols, "label", F.lit(0)), 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in cols)
    with monkeypatch.context() as m:
        m.setattr(MI, "COLUMN_ROWS", 0)
        ranked, folds = ML.mi_ranking(df, cols), ML.fold_rankings(df, cols, "label", "id", "fold", 3)
    monkeypatch.setattr(ML, "mi_knn", None)  # small tables need no long table, shuffled by value
    assert ML.mi_ranking(df, cols) == ranked
    assert ML.fold_rankings(df, cols, "label", "id", "fold", 3) == folds


def test_steps_in_used_arrays_are_those_in_new_ones():
    rng, room = np.random.default_rng(1), NN.Room()
    for n in (40, 7, 44):  # more and fewer rows than before
        x, y = rng.normal(size=(n, 6)), rng.integers(0, 2, n).astype(float)
        for net in (NN.Net((5,), "tanh"), NN.Net((8, 3), "relu")):
            w = NN.first_weights(net, 6, 3)
            loss, g = NN.summed_gradient(x, y, w, net, room)
            step = 1e-6 * np.eye(len(w))
            lost = lambda v: NN.summed_loss(NN.logits(x, v, net), y)  # noqa: B023, E731
            assert loss == lost(w) and np.allclose(g, [(lost(w + s) - lost(w - s)) / 2e-6 for s in step], atol=1e-5)
            again = NN.summed_gradient(x, y, w, net)
            assert again[0] == loss and (again[1] == g).all()


def test_bins_looked_up_once_give_the_same_histogram():
    rng = np.random.default_rng(2)
    bins, candidates = rng.integers(0, 9, (50, 6)).astype(np.uint8), np.array([[0, 2, 5], [1, 2, 3]])
    rows, node, d, g = rng.integers(0, 50, 300), rng.integers(0, 2, 300), rng.random(300), rng.random(300)
    want = np.zeros((3, 2, 3, 9))
    for r, j, a, b in zip(rows, node, d, g, strict=True):
        for s, f in enumerate(candidates[j]):
            want[:, j, s, bins[r, f]] += 1, a, b
    own = bins[rows[None], candidates[node].T]
    for long in (1, 4096):
        TR.LONG, before = long, TR.LONG
        try:
            for known in (None, own):
                assert np.allclose(TR.histogram(bins, rows, node, candidates, d, g, 9, known), want)
        finally:
            TR.LONG = before


def test_a_table_is_turned_round_once_for_all_trees(monkeypatch):
    rng, turned = np.random.default_rng(4), []
    bins, y = rng.integers(0, 8, (90, 5)).astype(np.uint8), rng.integers(0, 2, 90).astype(float)
    monkeypatch.setattr(TR, "trees_at_once", lambda rows: 1)
    monkeypatch.setattr(TR.np, "asfortranarray", lambda a, turn=np.asfortranarray: turned.append(len(a)) or turn(a))
    for name in ("RandomForest", "XGBoost"):
        turned.clear()
        spec = TR.spec_of(name, {"n_estimators": 4, "max_depth": 3})
        made = TR.fit_in_task(np.arange(90), y, np.ones((1, 90)), bins, spec, [np.arange(5)], lambda t: TR.tree_seeds(1, 0, 0, t)[None])[0]
        assert sum(g.count for g in made.groups) == 4 and turned == [90]
