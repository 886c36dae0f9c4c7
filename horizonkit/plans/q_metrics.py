"""Queries: metrics, thresholds, ROC/AUC, splits and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from horizonkit.functions import coerce as K
from horizonkit.operators import clean as CL
from horizonkit.operators import evaluation as EV
from horizonkit.operators import split as SP
from horizonkit.plans import oracle_cte as Q
from horizonkit.plans import roles as R
from horizonkit.plans.registry import query

_METRICS_SQL = """
  round((tp + tn) / (tp + tn + fp + fn + 1e-8), 6) AS accuracy,
  round(tp / (tp + fp + 1e-8), 6) AS precision,
  round(tp / (tp + fn + 1e-8), 6) AS recall,
  round(tn / (tn + fp + 1e-8), 6) AS specificity,
  round(2 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8))
        / ((tp / (tp + fp + 1e-8)) + (tp / (tp + fn + 1e-8)) + 1e-8), 6) AS f1,
  round(sqrt((tn / (tn + fp + 1e-8)) * (tp / (tp + fn + 1e-8))), 6) AS gmean,
  round(sqrt(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END * (tn / (tn + fp + 1e-8))), 6)
    AS gmean_score"""

_CONF_SQL = """
  CAST(count_if(label = 0 AND pred = 0) AS DOUBLE) AS tn,
  CAST(count_if(label = 0 AND pred = 1) AS DOUBLE) AS fp,
  CAST(count_if(label = 1 AND pred = 0) AS DOUBLE) AS fn,
  CAST(count_if(label = 1 AND pred = 1) AS DOUBLE) AS tp"""



def _r6_all(df, skip=()):
    return df.select(*[K.r6(c).alias(c) if c not in skip else F.col(c) for c in df.columns])


def _preds(spark, d, t=0.5):
    return EV.predict_at(R.scores(spark, d), "p", t)


@query("event_rate", sql="""
WITH s AS (SELECT CASE WHEN doc_id % 17 <> 0 THEN toxic END AS y FROM labels)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(y = 0) AS BIGINT) AS n0,
       CAST(count_if(y = 1) AS BIGINT) AS n1,
       round(count_if(y = 1) * 100.0 / count(*), 6) AS event_pct FROM s""")
def event_rate(spark, d):
    """D3: value counts and event rate (denominator counts missing labels)."""
    lab = R.table(spark, d, "labels").select(
        F.when(F.col("doc_id") % 17 != 0, F.col("toxic")).alias("y"))
    return lab.agg(F.count("*").alias("n_rows"), F.count_if(F.col("y") == 0).cast("long").alias("n0"),
                   F.count_if(F.col("y") == 1).cast("long").alias("n1"),
                   K.r6(F.try_divide(F.count_if(F.col("y") == 1) * 100.0, F.count("*"))).alias("event_pct"))


@query("confusion", sql=f"""
WITH {Q.SCORES}, pr AS (SELECT label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores)
SELECT CAST(count_if(label = 0 AND pred = 0) AS BIGINT) AS tn,
       CAST(count_if(label = 0 AND pred = 1) AS BIGINT) AS fp,
       CAST(count_if(label = 1 AND pred = 0) AS BIGINT) AS fn,
       CAST(count_if(label = 1 AND pred = 1) AS BIGINT) AS tp FROM pr""")
def confusion(spark, d):
    """Confusion counts at the default cut 0.5."""
    return EV.confusion(_preds(spark, d))


@query("metric_set", sql=f"""
WITH {Q.SCORES}, pr AS (SELECT label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores),
c AS (SELECT {_CONF_SQL} FROM pr)
SELECT {_METRICS_SQL} FROM c""")
def metric_set(spark, d):
    """Metric set with epsilon + strict G-Mean."""
    return _r6_all(EV.metrics_table(EV.confusion(_preds(spark, d))))


@query("anomaly_metrics", sql=f"""
WITH {Q.SCORES},
pr AS (SELECT label, CASE WHEN p >= 0.5 THEN -1 ELSE 1 END AS code FROM scores),
rm AS (SELECT label, CASE WHEN (SELECT count_if(code = -1) FROM pr) > 0
                          THEN CASE WHEN code = -1 THEN 1 ELSE 0 END ELSE code END AS pred FROM pr),
c AS (SELECT {_CONF_SQL} FROM rm)
SELECT {_METRICS_SQL} FROM c""")
def anomaly_metrics(spark, d):
    """-1/1 outlier codes remapped (-1 -> 1, else 0) before scoring."""
    s = R.scores(spark, d).withColumn("pred", F.when(F.col("p") >= 0.5, -1).otherwise(1))
    return _r6_all(EV.metrics_table(EV.confusion(CL.remap_anomaly(s, "pred"))))


@query("report", sql=f"""
WITH {Q.SCORES}, pr AS (SELECT label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores),
{Q.REPORT}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM f
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM f
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def report(spark, d):
    """Classification report as a table."""
    return _r6_all(EV.classification_report(_preds(spark, d)), skip=("class", "support"))


_FOLDS_SQL = f"""
WITH {Q.SCORES},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label
                               ORDER BY CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT), id) AS rn
  FROM scores)"""


@query("kfold_summary", sql=_FOLDS_SQL + f""",
pr AS (SELECT (rn - 1) % 5 AS fold, label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM ranked),
c AS (SELECT fold, {_CONF_SQL} FROM pr GROUP BY fold),
m AS (SELECT fold,
        (tp + tn) / (tp + tn + fp + fn + 1e-8) AS accuracy, tp / (tp + fp + 1e-8) AS precision,
        tp / (tp + fn + 1e-8) AS recall, tn / (tn + fp + 1e-8) AS specificity,
        2 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8))
          / ((tp / (tp + fp + 1e-8)) + (tp / (tp + fn + 1e-8)) + 1e-8) AS f1,
        sqrt((tn / (tn + fp + 1e-8)) * (tp / (tp + fn + 1e-8))) AS gmean FROM c),
l AS (UNPIVOT m ON accuracy, precision, recall, specificity, f1, gmean INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM l GROUP BY metric""")
def kfold_summary(spark, d):
    """F2 + F16 + D15: metrics per stratified fold, mean and population std."""
    f = SP.stratified_folds(_preds(spark, d), "id", "label")
    m = EV.metrics_table(EV.confusion(f, group=["fold"]), keep=["fold"]).drop("gmean_score")
    long = m.unpivot(["fold"], ["accuracy", "precision", "recall", "specificity", "f1", "gmean"],
                     "metric", "value")
    return long.groupBy("metric").agg(K.r6(F.avg("value")).alias("mean"),
                                      K.r6(F.stddev_pop("value")).alias("std"))


@query("stratified_folds", sql=_FOLDS_SQL + """
SELECT id, label, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM ranked""")
def stratified_folds(spark, d):
    return SP.stratified_folds(R.scores(spark, d), "id", "label").select("id", "label", "fold")


@query("stratified_split", sql=_FOLDS_SQL + """,
n AS (SELECT label, count(*) AS nc FROM scores GROUP BY label)
SELECT r.id, r.label, CASE WHEN r.rn <= floor(0.2 * n.nc + 0.5) THEN 'test' ELSE 'train' END AS split
FROM ranked r JOIN n ON r.label = n.label""")
def stratified_split(spark, d):
    return SP.stratified_split(R.scores(spark, d), "id", "label").select("id", "label", "split")


@query("class_weights", sql="""
WITH n AS (SELECT toxic, count(*) AS nc FROM labels GROUP BY toxic),
t AS (SELECT sum(nc) AS n, count(*) AS k FROM n)
SELECT l.doc_id, l.toxic, round(CASE WHEN t.k < 2 THEN 1.0 ELSE t.n / (t.k * n.nc) END, 6) AS weight
FROM labels l JOIN n ON l.toxic = n.toxic, t""")
def class_weights(spark, d):
    """Balanced weights ``n / (k * n_c)``."""
    lab = R.table(spark, d, "labels").select("doc_id", "toxic")
    return SP.balanced_weights(lab, "toxic").withColumn("weight", K.r6("weight"))


@query("log_loss", sql=f"""
WITH {Q.SCORES}, c AS (SELECT label, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM scores)
SELECT round(-avg(CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss FROM c""")
def log_loss(spark, d):
    """Clipped binary log-loss."""
    return EV.log_loss(R.scores(spark, d)).select(K.r6("log_loss").alias("log_loss"))


def _models(spark, d):
    s = R.table(spark, d, "documents").select("doc_id", "n_chars").join(
        R.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    arr = F.array(
        F.struct(F.lit("chars_mod").alias("Model"), ((F.col("n_chars") % 101) / 100.0).alias("p")),
        F.struct(F.lit("id_mod").alias("Model"), ((F.col("doc_id") * 37 % 100) / 99.0).alias("p")),
        F.struct(F.lit("length").alias("Model"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p")))
    return s.select(F.col("toxic").alias("label"), F.explode(arr).alias("m")).select("label", "m.*")


_MODELS_SQL = """
WITH s AS (SELECT d.doc_id, d.n_chars, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
mp AS (
  SELECT 'chars_mod' AS Model, label, (n_chars % 101) / 100.0 AS p FROM s
  UNION ALL SELECT 'id_mod', label, (doc_id * 37 % 100) / 99.0 FROM s
  UNION ALL SELECT 'length', label, least(n_chars / 20000.0, 1.0) FROM s)"""


@query("model_comparison", sql=_MODELS_SQL + """,
pr AS (SELECT Model, label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM mp),
r AS (SELECT Model, count_if(label = 1 AND pred = 1) / count_if(label = 1) AS sens,
             count_if(label = 0 AND pred = 0) / count_if(label = 0) AS spec FROM pr GROUP BY Model)
SELECT Model, 'G-Mean' AS Metric, round(sqrt(sens * spec), 6) AS Score FROM r
UNION ALL SELECT Model, 'Sensitivity', round(sens, 6) FROM r
UNION ALL SELECT Model, 'Specificity', round(spec, 6) FROM r""")
def model_comparison(spark, d):
    """Per-model sensitivity, specificity, G-Mean, melted."""
    out = EV.model_comparison(EV.predict_at(_models(spark, d), "p", 0.5))
    return out.withColumn("Score", K.r6("Score"))


@query("threshold_sweep", sql=f"""
WITH {Q.SCORES}, {Q.THRESHOLDS},
c AS (SELECT t.i, t.t,
        CAST(count_if(s.label = 1 AND s.p >= t.t) AS BIGINT) AS tp,
        CAST(count_if(s.label = 0 AND s.p >= t.t) AS BIGINT) AS fp,
        CAST(count_if(s.label = 1 AND s.p < t.t) AS BIGINT) AS fn,
        CAST(count_if(s.label = 0 AND s.p < t.t) AS BIGINT) AS tn
      FROM thresholds t, scores s GROUP BY t.i, t.t)
SELECT CAST(i AS INTEGER) AS i, round(t, 6) AS threshold, tp, fp, fn, tn,
       round(sqrt(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END * (tn / (tn + fp + 1e-8))), 6)
         AS score
FROM c""")
def threshold_sweep(spark, d):
    """all 99 thresholds from one histogram pass (oracle: 99 passes)."""
    sw = EV.threshold_sweep(R.scores(spark, d))
    return sw.withColumn("threshold", K.r6("threshold")).withColumn("score", K.r6("score"))


@query("best_threshold", sql=f"""
WITH {Q.SCORES}, {Q.THRESHOLDS},
{Q.BEST}
SELECT round(CASE WHEN score > 0 THEN t ELSE 0.5 END, 6) AS best_threshold,
       round(CASE WHEN score > 0 THEN score ELSE 0.0 END, 6) AS best_score FROM b""")
def best_threshold(spark, d):
    """smallest threshold with the best strict G-Mean (0.5 if none > 0)."""
    b = EV.best_threshold(EV.threshold_sweep(R.scores(spark, d)))
    return b.select(K.r6("best_threshold").alias("best_threshold"), K.r6("best_score").alias("best_score"))


_ROC_SQL = f"""
WITH {Q.SCORES},
per AS (SELECT p, count_if(label = 1) AS tp_s, count_if(label = 0) AS fp_s FROM scores GROUP BY p),
tot AS (SELECT sum(tp_s) AS n_pos, sum(fp_s) AS n_neg FROM per),
cum AS (SELECT p, tp_s, fp_s,
          sum(tp_s) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp_c,
          sum(fp_s) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp_c FROM per)"""


@query("roc_points", sql=_ROC_SQL + """
SELECT round(p, 6) AS threshold, round(fp_c / n_neg, 6) AS fpr, round(tp_c / n_pos, 6) AS tpr FROM cum, tot""")
def roc_points(spark, d):
    """ROC points per distinct score."""
    pts = EV.roc_points(R.scores(spark, d), rows_per_bucket=100)
    return pts.select(K.r6("threshold").alias("threshold"), K.r6("fpr").alias("fpr"), K.r6("tpr").alias("tpr"))


@query("auc", sql=_ROC_SQL + """
SELECT round(sum((fp_s / n_neg) * ((tp_c - tp_s) + tp_s / 2.0) / n_pos), 6) AS auc FROM cum, tot""")
def auc(spark, d):
    """trapezoid AUC from the ROC histogram."""
    return EV.auc_from_points(EV.roc_points(R.scores(spark, d), rows_per_bucket=100)).select(K.r6("auc").alias("auc"))


