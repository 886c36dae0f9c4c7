"""Tree ensembles and networks: the two ways agree, and both agree with plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from horizonkit.operators import ml as ML
from horizonkit.operators import networks as NN
from horizonkit.operators import trees as TR


def rows_of(spark, n=240, width=5, seed=0, parts=3):
    rng = np.random.RandomState(seed)
    x = np.round(rng.randn(n, width), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.4 * rng.randn(n) > 0).astype(float)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), 1.0 + i % 3, i % 3) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, x array<double>, y double, w double, fold int").repartition(parts)


SPECS = [TR.spec_of("RandomForest", {"n_estimators": 5, "max_depth": 4, "max_features": 0.6, "criterion": "entropy"}),
         TR.spec_of("RandomForest", {"n_estimators": 3, "max_depth": None, "min_samples_leaf": 4}),
         TR.spec_of("GradientBoosting", {"n_estimators": 3, "max_depth": 2, "subsample": 0.8}),
         TR.spec_of("XGBoost", {"n_estimators": 2, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8}),
         TR.spec_of("LightGBM", {"n_estimators": 2, "num_leaves": 6, "colsample_bytree": 0.8, "min_child_samples": 5})]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"{s.score}-{s.leaves}-{s.depth}")
def test_both_ways_grow_the_same_trees(spark, monkeypatch, spec):
    _, _, df = rows_of(spark)
    table = TR.binned(df, 5, n_bins=8)
    assert table.small
    near = TR.fit(table, spec, n_bins=8)
    monkeypatch.setattr(TR, "SMALL_BYTES", 0)
    monkeypatch.setattr(TR, "CELLS", 8 * 5 * 7)  # open nodes in several parts
    far = TR.fit(table, spec, n_bins=8)
    assert math.isclose(near.start, far.start, rel_tol=1e-12)
    for a, b in zip(near.groups, far.groups, strict=True):
        assert np.array_equal(a.left, b.left) and np.array_equal(a.feature, b.feature)
        inner = a.feature >= 0
        assert np.array_equal(a.bin[inner], b.bin[inner]) and np.allclose(a.value, b.value)
    assert sum((g.feature >= 0).sum() for g in near.groups) > 3


@pytest.mark.parametrize("name", ["RandomForest", "XGBoost"])
def test_both_ways_search_alike(spark, monkeypatch, name):
    _, _, df = rows_of(spark)
    draws = [{"n_estimators": 3, "max_depth": 2, "k": 2}, {"n_estimators": 2, "max_depth": 3, "k": 5}]
    ranked = [[0, 1, 2, 3, 4], [1, 0, 2, 3, 4], [2, 1, 0, 4, 3]]
    table = TR.binned(df, 5, n_bins=8)
    near = sorted(map(tuple, TR.search_counts(table, name, draws, ranked, n_bins=8).collect()))
    monkeypatch.setattr(TR, "SMALL_BYTES", 0)
    far = sorted(map(tuple, TR.search_counts(table, name, draws, ranked, n_bins=8).collect()))
    assert near == far and [r[:2] for r in near] == [(d, f) for d in range(2) for f in range(3)]
    assert all(sum(r[2:]) == 80 for r in near)


def test_one_tree_by_hand(spark):
    """Without draws a tree takes the cut of largest gain everywhere."""
    x, y, df = rows_of(spark)
    table = TR.binned(df, 5, n_bins=8)
    ids, _, y, w, bins = TR.at_hand(table)
    spec = TR.Spec(boost=False, trees=1, depth=3, min_leaf=5)
    growth = TR.Growth(spec, np.arange(5)[None], np.array([1], np.uint64))
    values, leaf = TR.grow(bins, growth, w[None], (w * y)[None], None, 8)

    def gini(rows):
        a, b = w[rows & (y == 1)].sum(), w[rows & (y == 0)].sum()
        return 2 * a * b / (a + b) if a + b else 0.0

    def check(node, rows, depth):
        best, cut = 0.0, None
        for f in range(5):
            for b in range(7):
                left = rows & (bins[:, f] <= b)
                right = rows & ~left
                if min(left.sum(), right.sum()) >= 5:
                    gain = gini(rows) - gini(left) - gini(right)
                    if gain > best + 1e-7:
                        best, cut = gain, (f, b)
        if depth == 3 or cut is None:
            assert growth.left[node] < 0 and np.array_equal(leaf[0] == node, rows)
            assert math.isclose(values[node], w[rows & (y == 1)].sum() / w[rows].sum())
            return
        assert (growth.feature[node], growth.bin[node]) == cut
        left = rows & (bins[:, cut[0]] <= cut[1])
        check(growth.left[node], left, depth + 1)
        check(growth.left[node] + 1, rows & ~left, depth + 1)

    check(0, np.ones(len(y), bool), 0)


def test_best_first_takes_the_largest_gains(spark):
    _, _, df = rows_of(spark, n=400)
    ids, _, y, w, bins = TR.at_hand(TR.binned(df, 5, n_bins=16))
    p = np.full(len(y), y.mean())
    made = {}
    for leaves in (4, 9):
        spec = TR.Spec(boost=True, trees=1, leaves=leaves, min_leaf=3, score="newton", rate=0.1)
        growth = TR.Growth(spec, np.arange(5)[None], np.array([1], np.uint64))
        TR.grow(bins, growth, np.ones((1, len(y))), (y - p)[None], (p * (1 - p))[None], 16)
        made[leaves] = growth
        at = np.unique(TR.descend(growth, bins))
        assert len(at) == leaves

    def cuts(growth):
        """Cuts by their path from the root, with their gain."""
        path = {0: ""}
        for i in range(1, len(growth.parent)):
            up = int(growth.parent[i])
            path[i] = path[up] + ("L" if growth.left[up] == i else "R")
        return {path[i]: growth.gain[i] for i in np.flatnonzero(growth.feature >= 0)}

    small, large = cuts(made[4]), cuts(made[9])
    order, front = [], {""}
    while len(order) < 8:  # always the open cut of largest gain
        best = max((p for p in front if p in large), key=large.get)
        order.append(best)
        front = front - {best} | {best + "L", best + "R"}
    assert set(small) == set(order[:3]) and set(large) == set(order)


def test_models_score_null_and_odd_rows(spark):
    _, _, df = rows_of(spark)
    rows = df.union(spark.createDataFrame([(900, None, 1.0, 1.0, 0), (901, [0.0] * 5, None, 1.0, 0), (902, [0.0] * 4 + [None], 1.0, None, None)], df.schema))
    table = TR.binned(rows, 5)
    assert table.n_rows == 241
    model = TR.fit(table, TR.spec_of("XGBoost", {"n_estimators": 5}))
    packed, edges = TR.Ensemble.unpacked(model.packed(table.edges))
    _, _, y, _, bins = TR.at_hand(table)
    assert np.array_equal(packed.probability(bins), model.probability(bins)) and packed.spec == model.spec
    assert all(np.array_equal(a, b) for a, b in zip(edges, table.edges, strict=True))
    assert ((model.probability(bins) > 0.5) == y).mean() > 0.7
    one = TR.fit(TR.binned(df.where("y = 1"), 5), TR.spec_of("LightGBM", {"n_estimators": 2}))
    assert one.probability(np.zeros((1, 5), np.uint8))[0] > 0.99


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.RandomState(1)
    x, y = rng.randn(30, 4), (rng.rand(30) > 0.5).astype(float)
    for net in (NN.Net((5,), "tanh", alpha=0.3), NN.Net((4, 3), "relu", alpha=0.1)):
        w = NN.first_weights(net, 4, 3)

        def loss(w, net=net):
            return NN.summed_loss(NN.logits(x, w, net), y) + NN.penalty(w, net, 4)[0]

        g = NN.summed_gradient(x, y, w, net)[1] + NN.penalty(w, net, 4)[1]
        for i in range(len(w)):
            e = np.zeros(len(w))
            e[i] = 1e-6
            assert abs((loss(w + e) - loss(w - e)) / 2e-6 - g[i]) < 1e-4


def test_both_ways_train_the_same_network(spark, monkeypatch):
    x, _, df = rows_of(spark, n=450)
    table = NN.matrix(df, 5)
    mean, std = table.scale()
    assert np.allclose(mean, x.mean(0)) and np.allclose(std, x.std(0)) and NN.batches_of(450) == 3
    jobs = [NN.job(table, NN.Net((6,), "tanh", 0.01, epochs=3), [0, 1, 2, 3, 4], 0), NN.job(table, NN.Net((4, 2), "relu", epochs=2), [1, 2], None)]
    near = NN.train(table, jobs, watch=True)
    monkeypatch.setattr(NN, "SMALL_BYTES", 0)
    jobs = [NN.job(table, NN.Net((6,), "tanh", 0.01, epochs=3), [0, 1, 2, 3, 4], 0), NN.job(table, NN.Net((4, 2), "relu", epochs=2), [1, 2], None)]
    far = NN.train(table, jobs, watch=True)
    for a, b in zip(near, far, strict=True):
        assert np.allclose(a.state.weights, b.state.weights) and a.state.epoch == b.state.epoch == a.state.net.epochs
        assert np.allclose([v[0] for v in a.state.losses], [v[0] for v in b.state.losses])
    assert np.allclose([v[1] for v in near[0].state.losses], [v[1] for v in far[0].state.losses])


def test_training_goes_on_where_it_stopped(spark):
    _, _, df = rows_of(spark, n=300)
    data = df.select("id", *[F.col("x")[i].alias(f"c{i}") for i in range(5)], F.col("y").alias("label"),
                     F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"))
    cols = [f"c{i}" for i in range(5)]
    params = {"hidden_layer_sizes": [8], "max_iter": 6}
    whole, at = ML.learning_curve(data, cols, params, "part")
    _, first = ML.learning_curve(data, cols, params, "part", epochs=2)
    assert first.epoch == 2
    again, last = ML.learning_curve(data, cols, params, "part", state=NN.State.unpacked(first.packed()))
    assert [tuple(r) for r in whole.collect()] == [tuple(r) for r in again.collect()] and np.array_equal(at.weights, last.weights)
    assert len(at.losses) == 6 and at.losses[-1][0] < at.losses[0][0]


def test_network_learns_and_stops(spark):
    _, _, df = rows_of(spark, n=600)
    table = NN.matrix(df, 5)
    ranked = [[0, 1, 2, 3, 4]] * 3
    draws = [{"hidden_layer_sizes": (20,), "activation": "tanh", "alpha": 1e-4, "learning_rate": r, "max_iter": 300, "k": 5} for r in ("constant", "adaptive")]
    rows = [tuple(r) for r in NN.search_counts(table, draws, ranked).collect()]
    assert len(rows) == 6 and len({r[1:] for r in rows}) == 3  # equal draws, one training
    assert all((r[2] + r[5]) / sum(r[2:]) > 0.75 for r in rows)


@pytest.mark.parametrize("name,params", [("RandomForest", {"n_estimators": 10, "max_depth": 40}), ("GradientBoosting", {"n_estimators": 10}),
                                         ("XGBoost", {"n_estimators": 10}), ("LightGBM", {"n_estimators": 10}),
                                         ("MLPClassifier", {"hidden_layer_sizes": [10], "max_iter": 60})])
def test_pipelines_save_and_load(spark, tmp_path, name, params):
    from pyspark.ml import PipelineModel
    _, _, df = rows_of(spark)
    data = df.select("id", *[F.col("x")[i].alias(f"c{i}") for i in range(5)], F.col("y").alias("label"), F.col("w").alias("weight"), "fold")
    cols = [f"c{i}" for i in range(5)]
    model = ML.make_pipeline(name, params, 3, cols, "weight").fit(data)
    out = ML.positive_prob(model.transform(data))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = ML.positive_prob(PipelineModel.load(str(tmp_path / "m")).transform(data))
    a, b = ({r["id"]: r["p"] for r in t.select("id", "p").collect()} for t in (out, again))
    assert a == b and len(a) == 240 and all(0 <= p <= 1 for p in a.values())
    assert out.where((F.col("p") > 0.5) != (F.col("prediction") == 1)).count() == 0
    assert out.where(F.col("prediction") == F.col("label")).count() > 160


def test_saved_evaluator_keeps_its_columns(tmp_path):
    ML.GMeanEvaluator(labelCol="truth", predictionCol="said").save(str(tmp_path / "e"))
    got = ML.GMeanEvaluator.load(str(tmp_path / "e"))
    assert (got.getOrDefault("labelCol"), got.getOrDefault("predictionCol")) == ("truth", "said")


@pytest.mark.parametrize("name,params", [("RandomForest", {"n_estimators": 5, "max_depth": 3}), ("XGBoost", {"n_estimators": 3, "max_depth": 2}),
                                         ("MLPClassifier", {"hidden_layer_sizes": [5], "max_iter": 3})])
def test_out_of_fold_side_by_side(spark, monkeypatch, name, params):
    _, _, df = rows_of(spark)
    data = df.select("id", *[F.col("x")[i].alias(f"c{i}") for i in range(5)], F.col("y").alias("label"), F.col("w").alias("weight"), "fold")
    got = []
    for size in (TR.SMALL_BYTES, 0):
        monkeypatch.setattr(TR, "SMALL_BYTES", size)
        monkeypatch.setattr(NN, "SMALL_BYTES", size)
        rows = ML.oof_side_by_side(data, name, params, 5, [f"c{i}" for i in range(5)], weight_col="weight", n_folds=3).collect()
        got.append({r["id"]: (r["fold"], r["label"], round(r["p"], 9)) for r in rows})
    assert got[0] == got[1] and len(got[0]) == 240 and all(f == i % 3 for i, (f, _, _) in got[0].items())


def test_the_larger_sibling_is_not_counted(monkeypatch):
    rng = np.random.RandomState(2)
    bins, n = rng.randint(0, 16, (600, 6)).astype(np.uint8), 600
    y = (bins[:, 0] + bins[:, 1] > 14).astype(float) - 0.4
    counted, plain = [], TR.histogram
    monkeypatch.setattr(TR, "histogram", lambda b, rows, *more: counted.append(len(rows)) or plain(b, rows, *more))
    spec = TR.Spec(boost=True, trees=1, depth=4, score="variance")
    growth = TR.Growth(spec, np.arange(6)[None], np.array([1], np.uint64))
    values, leaf = TR.grow(bins, growth, np.ones((1, n)), y[None], np.ones((1, n)), 16)
    assert counted[0] == n and len(counted) == 4 and max(counted[1:]) <= n / 2
    assert np.allclose(values[leaf[0]], [y[leaf[0] == i].mean() for i in leaf[0]])


def test_trees_of_long_tables_are_dealt_to_tasks():
    assert len(TR._blocks(100, 8_205)) >= 12 and TR._blocks(5, 240) == [(0, 5)]
    assert TR.trees_at_once(500_000) == 1 and TR.trees_at_once(240) == TR.TREES_AT_ONCE
    assert [k for a, z in TR._blocks(100, 500_000) for k in range(a, z)] == list(range(100))


def test_sums_of_a_step(spark, monkeypatch):
    """Added where they arrive or by Spark, they are the sums over all rows; a task's BLAS keeps to one thread."""
    x, y, df = rows_of(spark)
    table = NN.matrix(df, 5)
    jobs = [NN.job(table, NN.Net((4,), "tanh"), range(5), f) for f in (0, None)]
    near = NN._step_sums(table, jobs, 0, 1, 3)
    monkeypatch.setattr(NN, "TASK_SUMS", 0)
    far = NN._step_sums(table, jobs, 0, 1, 3)
    for i, j in enumerate(jobs):
        own = np.arange(240) % 3 != (-1 if j.left_out is None else j.left_out)
        loss, g = NN.summed_gradient(j.inputs(x[own]), y[own], j.state.weights, j.state.net)
        for n, lost, got in (near[i], far[i]):
            assert n == own.sum() and math.isclose(lost, loss, rel_tol=1e-9) and np.allclose(got, g)


def test_the_cohort_is_read_once_for_all_horizons(spark):
    from horizonkit.operators.study import run_horizon_study
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return float(i % 17)

    df = (spark.range(80).select(F.explode(F.array(F.lit(3), F.lit(5))).alias("horizon"), (F.col("id") % 2).cast("int").alias("Target"), "id")
          .withColumn("a", value("id")).withColumn("b", F.col("id") * 0.5).drop("id"))
    study = run_horizon_study(df, horizons=(3, 5, 99), spaces={"RandomForest": []})
    assert seen.value == 160
    assert sorted((r.horizon, r.step) for r in study.rejects.collect()) == [(3, "search"), (5, "search"), (99, "prepare")]


def test_nodes_of_one_class_are_not_searched_for_cuts(monkeypatch):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.5).astype(float)
    bins = rng.integers(0, 8, (400, 6)).astype(np.uint8)
    bins[:, 0] = np.where(y == 1, bins[:, 0], bins[:, 0] // 2)
    w, searched, histogram = np.where(y == 1, 1.3, 0.8), [], TR.histogram

    def noted(columns, rows, node, candidates, d, g, n_bins):
        of = np.bincount(node, minlength=len(candidates))
        searched.extend(((np.bincount(node, x, len(candidates)) < of).all() for x in (g == 0, g == d)))
        return histogram(columns, rows, node, candidates, d, g, n_bins)

    monkeypatch.setattr(TR, "histogram", noted)
    for score in ("gini", "entropy"):
        spec = TR.spec_of("RandomForest", {"n_estimators": 5, "criterion": score, "max_features": 0.8})
        model = TR.fit_in_task(np.arange(400), y, w[None], bins, spec, [np.arange(6)], lambda t: TR.tree_seeds(1, 0, 0, t)[None], 8)[0]
        assert sum(len(g.left) for g in model.groups) > 50
    assert searched and all(searched)
