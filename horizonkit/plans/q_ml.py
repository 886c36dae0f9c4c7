"""Queries: model fitting, search, out-of-fold threshold, evaluation.

What a fitted model scores has no SQL; what surrounds it has (which rows are
scored in which fold, which shuffle a column gets), and is checked there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from horizonkit.functions import coerce as K
from horizonkit.operators import evaluation as EV
from horizonkit.operators import ml as ML
from horizonkit.operators import split as SP
from horizonkit.plans import roles as R
from horizonkit.plans.registry import query
from horizonkit.session import written

COLS = [f"f{i}" for i in range(R.N_EMB)]
#: Boosting at the search spaces' first values.
GBT_FIXED = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "subsample": 0.9, "colsample_bytree": 0.8}
RF_FIXED = {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1, "criterion": "gini",
            "max_features": "sqrt"}


def _data(spark, d):
    """features -> stratified 80/20 split -> folds on train -> balanced weights."""
    w = R.features_wide(spark, d).withColumnRenamed("vec_id", "id").withColumn("label", F.col("label").cast("double"))
    s = SP.stratified_split(w, "id", "label")
    train = SP.stratified_folds(s.where(F.col("split") == "train"), "id", "label")
    # fits, folds and draws read them many times: written once
    train = written(SP.balanced_weights(train, "label"), "train")
    test = written(s.where(F.col("split") == "test"), "test")
    return train, test


def _preds(model, test):
    out = ML.positive_prob(model.transform(test))
    return out.select("id", F.col("label").cast("int").alias("label"), K.r6("p").alias("p"),
                      F.col("prediction").cast("int").alias("pred"))


@query("fit_rf")
def fit_rf(spark, d):
    """weighted random forest on k = 20 MI-selected features."""
    train, test = _data(spark, d)
    return _preds(ML.make_pipeline("RandomForest", RF_FIXED, 20, COLS, "weight").fit(train), test)


@query("fit_gbt")
def fit_gbt(spark, d):
    """weighted boosting by the hessian, rows and columns drawn for each tree."""
    train, test = _data(spark, d)
    return _preds(ML.make_pipeline("XGBoost", GBT_FIXED, 20, COLS, "weight").fit(train), test)


@query("fit_lightgbm")
def fit_lightgbm(spark, d):
    """weighted boosting with best-first growth up to 31 leaves."""
    train, test = _data(spark, d)
    p = {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": -1, "colsample_bytree": 0.8}
    return _preds(ML.make_pipeline("LightGBM", p, 20, COLS, "weight").fit(train), test)


@query("fit_mlp")
def fit_mlp(spark, d):
    """MLP (no weights, as in the reference); layers = [k, 50, 2]."""
    train, test = _data(spark, d)
    return _preds(ML.make_pipeline("MLPClassifier", {"hidden_layer_sizes": (50,)}, 20, COLS).fit(train), test)


def _search(spark, d, name, draws):
    """All draws over five folds: their parameters, cross-validated G-Mean, and which is best."""
    train, _ = _data(spark, d)
    scores = ML.search_scores(train, name, COLS, draws, weight_col="weight")
    best = max(range(len(scores)), key=lambda i: scores[i][1])
    rows = [(i, str(sorted((k, str(v)) for k, v in dr.items())), int(dr["k"]), float(sc), int(i == best)) for i, (dr, sc) in enumerate(scores)]
    out = spark.createDataFrame(rows, "draw int, params string, k int, cv_gmean double, best int")
    return out.withColumn("cv_gmean", K.r6("cv_gmean"))


@query("search_rf")
def search_rf(spark, d):
    """seeded random search as declared, 200 draws x 5 folds, G-Mean scorer."""
    return _search(spark, d, "RandomForest", ML.sample_draws("RandomForest", 200, seed=42))


@query("search_lightgbm")
def search_lightgbm(spark, d):
    """200 draws x 5 folds of best-first boosted trees."""
    return _search(spark, d, "LightGBM", ML.sample_draws("LightGBM", 200, seed=42))


@query("search_mlp")
def search_mlp(spark, d):
    """200 draws x 5 folds of networks; draws that make the same network are trained once."""
    return _search(spark, d, "MLPClassifier", ML.sample_draws("MLPClassifier", 200, seed=42))


@query("search_grid")
def search_grid(spark, d):
    """a whole grid: every number of columns for one forest."""
    draws = [dr for dr in ML.grid_draws("RandomForest") if {k: v for k, v in dr.items() if k != "k"} == RF_FIXED]
    return _search(spark, d, "RandomForest", draws)


_GAINS_SQL = """
WITH x AS (SELECT vec_id AS id, label < 5 AS y, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(64)) AS feature FROM embeddings),
n AS (SELECT count(*) AS n, sum(CASE WHEN label < 5 THEN 1 ELSE 0 END) AS n1 FROM embeddings),
placed AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) AS place FROM x),
edges AS (SELECT DISTINCT feature, v AS edge FROM placed, n, range(1, 32) t(i) WHERE place = ceil(i * n / 32.0)),
binned AS (SELECT id, x.feature, CASE WHEN y THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS w, CASE WHEN y THEN n / (2.0 * n1) ELSE 0.0 END AS g,
                  (SELECT count(*) FROM edges e WHERE e.feature = x.feature AND e.edge < x.v) AS bin FROM x, n),
{root},
best AS (SELECT feature, bin FROM gains0 ORDER BY gain DESC, feature, bin LIMIT 1),
side AS (SELECT id, CASE WHEN b.bin <= best.bin THEN 1 ELSE 2 END AS node FROM binned b JOIN best ON b.feature = best.feature),
{children}
SELECT CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, round(gain, 6) + 0.0 AS gain,
       CAST(n_left AS BIGINT) AS n_left, CAST(n_all AS BIGINT) AS n_all
FROM (SELECT * FROM gains0 UNION ALL SELECT * FROM gains1)"""


def _gains_sql(name: str, rows: str, node: str) -> str:
    score = lambda g, d: f"({g} * {g} + ({d} - {g}) * ({d} - {g})) / {d}"
    return f"""cells{name} AS (SELECT {node} AS node, feature, bin, count(*) AS n, sum(w) AS d, sum(g) AS g FROM {rows} GROUP BY ALL),
sums{name} AS (SELECT node, feature, bin, sum(n) OVER o AS nl, sum(d) OVER o AS dl, sum(g) OVER o AS gl,
                      sum(n) OVER a AS nt, sum(d) OVER a AS dt, sum(g) OVER a AS gt FROM cells{name}
               WINDOW o AS (PARTITION BY node, feature ORDER BY bin), a AS (PARTITION BY node, feature)),
gains{name} AS (SELECT node, feature, bin, round(({score('gl', 'dl')} + {score('(gt - gl)', '(dt - dl)')} - {score('gt', 'dt')}) / dt, 10) AS gain,
                       nl AS n_left, nt AS n_all FROM sums{name} WHERE nl >= 2 AND nt - nl >= 2)"""


@query("tree_split_gains", sql=_GAINS_SQL.format(root=_gains_sql("0", "binned", "0"), children=_gains_sql("1", "binned JOIN side USING (id)", "node")))
def tree_split_gains(spark, d):
    """every admissible cut of a weighted tree's root and of the root's children, with its gain."""
    from horizonkit.operators import trees as TR
    w = SP.balanced_weights(R.features_wide(spark, d).withColumn("label", F.col("label").cast("double")), "label")
    table = TR.binned(w.select(F.col("vec_id").alias("id"), F.array(*[F.col(c).cast("double") for c in COLS]).alias("x"),
                               F.col("label").alias("y"), F.col("weight").alias("w"), F.lit(0).alias("fold")), len(COLS))
    spec = TR.Spec(boost=False, trees=1, depth=2, min_leaf=2)
    return TR.first_gains(table, spec, rounds=2).select("node", "feature", "bin", K.r6("gain").alias("gain"), "n_left", "n_all")


#: Weights of a network of four inputs and two hidden units: sin(1) / 2, sin(2) / 2, ...
_NET_WEIGHTS = 13
_NET_SQL = """
WITH x AS (SELECT CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END AS y, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b,
                  CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc, avg(d) AS md, stddev_pop(d) AS sd FROM x),
z AS (SELECT y, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c, (d - md) / sd AS d FROM x, m),
h AS (SELECT *, tanh(a * sin(1) / 2 + b * sin(3) / 2 + c * sin(5) / 2 + d * sin(7) / 2 + sin(9) / 2) AS p,
                tanh(a * sin(2) / 2 + b * sin(4) / 2 + c * sin(6) / 2 + d * sin(8) / 2 + sin(10) / 2) AS q FROM z),
o AS (SELECT *, p * sin(11) / 2 + q * sin(12) / 2 + sin(13) / 2 AS s FROM h),
e AS (SELECT *, 1 / (1 + exp(-s)) - y AS r, (1 / (1 + exp(-s)) - y) * sin(11) / 2 * (1 - p * p) AS u,
             (1 / (1 + exp(-s)) - y) * sin(12) / 2 * (1 - q * q) AS t FROM o)
SELECT CAST(k AS INTEGER) AS weight, round(sum(CASE k WHEN -1 THEN ln(1 + exp(s)) - y * s WHEN 0 THEN u * a WHEN 1 THEN t * a WHEN 2 THEN u * b
       WHEN 3 THEN t * b WHEN 4 THEN u * c WHEN 5 THEN t * c WHEN 6 THEN u * d WHEN 7 THEN t * d WHEN 8 THEN u WHEN 9 THEN t
       WHEN 10 THEN r * p WHEN 11 THEN r * q ELSE r END), 6) + 0.0 AS value
FROM e, range(-1, 13) w(k) GROUP BY k"""


@query("mlp_gradient", sql=_NET_SQL)
def mlp_gradient(spark, d):
    """a tanh network's loss (weight -1) and gradient, summed over all rows, at given weights."""
    import numpy as np

    from horizonkit.operators import networks as NN
    rows = R.features_wide(spark, d).select(F.col("vec_id").alias("id"), F.array(*[F.col(c).cast("double") for c in COLS[:4]]).alias("x"),
                                            F.col("label").cast("double").alias("y"), F.lit(0).alias("fold"))
    table = NN.matrix(rows, 4)
    job = NN.job(table, NN.Net((2,), "tanh"), range(4), None)
    job.state.weights = np.sin(np.arange(1, _NET_WEIGHTS + 1)) / 2
    found = NN.gradients(table, [job]).select("loss", F.posexplode(NN.unpacked_sums("g", _NET_WEIGHTS)).alias("weight", "value"))
    loss = found.where("weight = 0").select(F.lit(-1).alias("weight"), F.col("loss").alias("value"))
    return found.select("weight", "value").unionByName(loss).select("weight", K.r6("value").alias("value"))


@query("oof_predictions")
def oof_predictions(spark, d):
    """out-of-fold probabilities for the training rows."""
    train, _ = _data(spark, d)
    o = ML.oof_predictions(train, ML.make_pipeline("RandomForest", RF_FIXED, 20, COLS, "weight"))
    return o.select("id", "fold", F.col("label").cast("int").alias("label"), K.r6("p").alias("p"))


@query("evaluate_test")
def evaluate_test(spark, d):
    """Threshold from out-of-fold scores, then the test report."""
    train, test = _data(spark, d)
    pipe = ML.make_pipeline("RandomForest", RF_FIXED, 20, COLS, "weight")
    oof = ML.oof_predictions(train, pipe).select(F.col("label").cast("int").alias("label"), "p")
    t = EV.best_threshold(EV.threshold_sweep(oof)).first()["best_threshold"]
    preds = EV.predict_at(ML.positive_prob(pipe.fit(train).transform(test)), "p", t)
    rep = EV.classification_report(preds.withColumn("label", F.col("label").cast("int")), "label", "pred")
    return rep.withColumn("threshold", F.lit(round(t, 4)))


@query("cv_report")
def cv_report(spark, d):
    """Per-fold metrics at the default cut, mean and population std."""
    train, _ = _data(spark, d)
    r = ML.cv_report(train, ML.make_pipeline("RandomForest", RF_FIXED, 20, COLS, "weight"))
    return r.select("metric", K.r6("mean").alias("mean"), K.r6("std").alias("std"))


def _inner(train):
    inner = SP.stratified_split(train.drop("split"), "id", "label", test_size=0.25, out="inner")
    return inner.where(F.col("inner") == "train"), inner.where(F.col("inner") == "test")


@query("history")
def history(spark, d):
    """losses after every boosted tree on an inner 75 / 25 % split, both parts."""
    train, _ = _data(spark, d)
    own, val = _inner(train)
    p = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "subsample": 1.0}
    return ML.training_history(ML.make_pipeline("GradientBoosting", p, 20, COLS).fit(own), own, val)


@query("history_mlp")
def history_mlp(spark, d):
    """the network's log-loss on both parts after every epoch of one run, up to 2,000 of them."""
    train, _ = _data(spark, d)
    inner = SP.stratified_split(train.drop("split"), "id", "label", test_size=0.25, out="inner")
    return ML.learning_curve(inner, COLS, {"hidden_layer_sizes": (50,)}, "inner")[0]


@query("perm_importance")
def perm_importance(spark, d):
    """permutation importance of the selected columns (10 repeats, G-Mean drop), top 15."""
    train, test = _data(spark, d)
    m = ML.make_pipeline("RandomForest", RF_FIXED, 15, COLS, "weight").fit(train)
    chosen = m.stages[0].getOrDefault("selected")
    imp = ML.permutation_importance(ML.predicted_by(m), test.withColumn("label", F.col("label").cast("int")), chosen)
    return imp.select("feature", K.r6("importance").alias("importance"))


_RULE_COLS = ["f0", "f1", "f2", "f3"]
_RULE_SQL = """
WITH x AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label,
                  CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1,
                  CAST(embedding[3] AS DOUBLE) AS f2, CAST(embedding[4] AS DOUBLE) AS f3 FROM embeddings),
own AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5(id || ':10049'), 1, 8) AS BIGINT), id) AS rid FROM x),
src AS (SELECT r, f0, f1, f2, f3, row_number() OVER (PARTITION BY r ORDER BY
               CAST('0x' || substr(md5(id || ':' || (42 + r)), 1, 8) AS BIGINT), id) AS rid
        FROM x, range(10) t(r)),
c AS (SELECT label, r, f, CASE WHEN f = 'f0' THEN s.f0 ELSE o.f0 END AS f0, CASE WHEN f = 'f1' THEN s.f1 ELSE o.f1 END AS f1,
             CASE WHEN f = 'f2' THEN s.f2 ELSE o.f2 END AS f2, CASE WHEN f = 'f3' THEN s.f3 ELSE o.f3 END AS f3
      FROM own o JOIN src s USING (rid), (SELECT unnest(['f0', 'f1', 'f2', 'f3']) AS f)),
p AS (SELECT f, r, label, CASE WHEN 2 * f0 - f1 + f2 / 2 > 0 THEN 1 ELSE 0 END AS pred FROM c
      UNION ALL SELECT 'base', 0, label, CASE WHEN 2 * f0 - f1 + f2 / 2 > 0 THEN 1 ELSE 0 END FROM x),
m AS (SELECT f, r, sum(CASE WHEN label = 1 AND pred = 1 THEN 1.0 ELSE 0 END) AS tp,
             sum(CASE WHEN label = 0 AND pred = 1 THEN 1.0 ELSE 0 END) AS fp,
             sum(CASE WHEN label = 1 AND pred = 0 THEN 1.0 ELSE 0 END) AS fn,
             sum(CASE WHEN label = 0 AND pred = 0 THEN 1.0 ELSE 0 END) AS tn FROM p GROUP BY f, r),
g AS (SELECT f, r, {gmean} AS g FROM m)
SELECT f AS feature, round((SELECT g FROM g WHERE f = 'base') - avg(g), 6) + 0.0 AS importance
FROM g WHERE f <> 'base' GROUP BY f""".format(gmean="sqrt((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) * (tn / (tn + fp + 1e-8)))")


@query("perm_importance_rule", sql=_RULE_SQL)
def perm_importance_rule(spark, d):
    """F17 under a fixed rule instead of a model: every shuffle can be checked in SQL."""
    x = R.features_wide(spark, d).withColumnRenamed("vec_id", "id")
    rule = lambda df: df.withColumn("pred", (2 * F.col("f0") - F.col("f1") + F.col("f2") / 2 > 0).cast("int"))
    imp = ML.permutation_importance(rule, x.select("id", "label", *_RULE_COLS), _RULE_COLS, top=None)
    return imp.select("feature", K.r6("importance").alias("importance"))


_SPLIT_SQL = """
WITH x AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT), id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM x),
s AS (SELECT id, label, rn <= floor(0.2 * n + 0.5) AS test FROM r),
f AS (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY
                         CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT), id) - 1) % 5 AS fold FROM s WHERE NOT test)"""


@query("fit_rf_coverage", sql=_SPLIT_SQL + """
SELECT id, CAST(label AS INTEGER) AS label, TRUE AS in_range, TRUE AS pred_follows_p FROM s WHERE test""")
def fit_rf_coverage(spark, d):
    """a fitted model scores every test row once, within 0 to 1, and predicts what is likelier."""
    train, test = _data(spark, d)
    out = ML.positive_prob(ML.make_pipeline("RandomForest", RF_FIXED, 20, COLS, "weight").fit(train).transform(test))
    return out.select("id", F.col("label").cast("int").alias("label"), F.col("p").between(0, 1).alias("in_range"),
                      ((F.col("p") > 0.5) == (F.col("prediction") == 1)).alias("pred_follows_p"))


@query("oof_coverage", sql=_SPLIT_SQL + """
SELECT id, CAST(fold AS INTEGER) AS fold, CAST(label AS INTEGER) AS label, TRUE AS in_range FROM f""")
def oof_coverage(spark, d):
    """every training row gets one out-of-fold probability, in its own fold."""
    train, _ = _data(spark, d)
    o = ML.oof_predictions(train, ML.make_pipeline("RandomForest", RF_FIXED, 20, COLS, "weight"))
    return o.select("id", "fold", F.col("label").cast("int").alias("label"), F.col("p").between(0, 1).alias("in_range"))


#: The study's declared space: two draws of each model, searched whole; networks train for 60 epochs at most.
STUDY_SPACE = {
    "RandomForest": [{"n_estimators": 100, "max_depth": 10, "max_features": "sqrt", "min_samples_leaf": 4, "k": 10},
                     {"n_estimators": 100, "max_depth": 10, "max_features": 0.6, "min_samples_leaf": 4, "criterion": "entropy", "k": 10}],
    "GradientBoosting": [{"n_estimators": 100, "learning_rate": r, "max_depth": 3, "subsample": 0.8, "k": 10} for r in (0.05, 0.1)],
    "XGBoost": [{"n_estimators": 100, "learning_rate": r, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8, "k": 10} for r in (0.05, 0.1)],
    "LightGBM": [{"n_estimators": 100, "learning_rate": r, "num_leaves": 20, "max_depth": -1, "k": 10} for r in (0.05, 0.1)],
    "MLPClassifier": [{"hidden_layer_sizes": [50], "activation": a, "solver": "adam", "alpha": 0.0001, "max_iter": 60, "k": 10} for a in ("tanh", "relu")],
}


def _study(spark, d, **more):
    from horizonkit.operators import cohort as C
    from horizonkit.operators.study import run_horizon_study
    from horizonkit.plans.q_cohort import merged
    lab = C.label_horizons(merged(spark, d), event_col="Obito_MS", time_col="Tempo")
    lab = lab.withColumnRenamed("exam_ts", "Date Holter")
    return run_horizon_study(lab, drop_cols=["ID", "Name", "Obito_MS", "Time"], nominal=["o_orderpriority"], **more)


@query("horizon_study")
def horizon_study(spark, d):
    """horizons x five models on the merged cohort: each one's declared space searched whole, refit,
    out-of-fold threshold, test metrics; pipelines, summaries, reports and test splits written to the shared folder."""
    from horizonkit.session import scratch_path
    out = _study(spark, d, spaces=STUDY_SPACE, out_dir=scratch_path(spark, "study"), parallelism=10).summary
    return out.select("horizon", "model", "k", K.r6("threshold").alias("threshold"), K.r6("cv_gmean").alias("cv_gmean"), "n_train", "n_test",
                      *[K.r6(c).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1", "gmean")])


@query("study_rejects", sql="""
SELECT CAST(h AS INTEGER) AS horizon, m AS model, s AS step FROM (
  VALUES (3, 'NoSuchModel', 'search'), (5, 'NoSuchModel', 'search'), (3, 'MLPClassifier', 'search'), (5, 'MLPClassifier', 'search')) t(h, m, s)
WHERE EXISTS (SELECT 1 FROM lineitem)
UNION ALL SELECT 99, NULL, 'prepare' WHERE EXISTS (SELECT 1 FROM lineitem)""")
def study_rejects(spark, d):
    """Models that fail and a horizon without rows are left out and reported; the study survives them."""
    spaces = {"NoSuchModel": [{"k": 10}], "MLPClassifier": [{"solver": "lbfgs", "k": 10}],
              "LightGBM": [{"n_estimators": 2, "num_leaves": 4, "k": 100}]}
    study = _study(spark, d, horizons=(3, 5, 99), spaces=spaces)
    if study.summary.count() != 2:
        raise RuntimeError("the models that can be fitted were not")
    return study.rejects.select("horizon", "model", "step")


@query("pipeline_roundtrip")
def pipeline_roundtrip(spark, d):
    """A10: fitted pipeline saved to the shared folder, loaded, used to score."""
    from horizonkit.session import scratch_path
    from horizonkit.sources import sinks as SK
    train, test = _data(spark, d)
    model = ML.make_pipeline("RandomForest", RF_FIXED, 20, COLS, "weight").fit(train)
    path = scratch_path(spark, "pipeline")
    SK.save_pipeline(model, path)
    return _preds(SK.load_pipeline(path), test)
