"""Classifier evaluation on a predictions table ``(id, label, p[, pred, group])``.

Every operator first collapses rows into small histograms with partial
aggregates (per class, per distinct score, per threshold count); ordered
logic then runs on those small tables, or on bucketed windows
(``prefix.bucketed_running_sum``) where the table is not small (ROC over
continuous scores).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horizonkit.functions import metrics as M
from horizonkit.operators.prefix import bucketed_running_sum, with_quantile_bucket

N_THRESHOLDS = 99


def predict_at(df: DataFrame, p: str = "p", t: float = 0.5, out: str = "pred") -> DataFrame:
    """class = ``p >= t``."""
    return df.withColumn(out, (F.col(p) >= F.lit(t)).cast("int"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred",
              group: list[str] | None = None) -> DataFrame:
    """Tn, fp, fn, tp (per group if given)."""
    aggs = M.confusion_aggs(label, pred)
    return df.groupBy(*(group or [])).agg(*aggs)


def metrics_table(conf: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """D13 (+ strict G-Mean) from a confusion table."""
    ms = M.metric_set()
    return conf.select(*(keep or []), *[v.alias(k) for k, v in ms.items()],
                       M.gmean_strict().alias("gmean_score"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / F1 / support, accuracy, macro, weighted.

    The only data pass is ``groupBy(label, pred).count()`` (<= classes^2 rows).
    Zero division gives 0. ``accuracy`` is reported in the f1 column with the
    total support, as the text report prints it.
    """
    cm = df.groupBy(label, pred).agg(F.count("*").alias("n"))
    as_true = cm.select(F.col(label).cast("string").alias("class"), "n",
                        F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("tp"),
                        F.lit(0).cast("long").alias("npred"))
    as_pred = cm.select(F.col(pred).cast("string").alias("class"), F.lit(0).cast("long").alias("n"),
                        F.lit(0).cast("long").alias("tp"), F.col("n").alias("npred"))
    per = (as_true.unionByName(as_pred).groupBy("class")
           .agg(F.sum("n").alias("support"), F.sum("tp").alias("tp"), F.sum("npred").alias("npred")))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("class", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                  F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                  F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    cols = ["class", "precision", "recall", "f1", "support"]
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), F.try_divide("tp", "n").alias("f1"),
                     F.col("n").alias("support"))
    return per.select(*cols).unionByName(macro).unionByName(weighted).unionByName(acc)


def thresholds_passed(p: str = "p", n: int = N_THRESHOLDS):
    """How many sweep thresholds ``t_i = 0.01 + (i-1)*0.01`` satisfy ``t_i <= p``.

    Exact against the float thresholds: the three candidates around
    ``floor(100 p)`` are compared with the real t_i; all lower ones pass and
    all higher ones fail by a 0.01 margin.
    """
    j0 = F.floor(F.col(p) * 100).cast("long")
    base = F.greatest(F.least(j0 - 2, F.lit(n)), F.lit(0))
    extra = None
    for d in (-1, 0, 1):
        i = j0 + d
        ok = ((i >= 1) & (i <= n) & (M.threshold_value(i) <= F.col(p))).cast("long")
        extra = ok if extra is None else extra + ok
    return base + extra


def threshold_sweep(df: DataFrame, label: str = "label", p: str = "p",
                    n: int = N_THRESHOLDS, metric=None) -> DataFrame:
    """confusion counts and a score for all 99 thresholds, one scan.

    Rows are reduced to a histogram of "thresholds passed" (<= 2 x 100 rows);
    threshold i predicts positive exactly for rows that passed >= i.
    ``metric`` (L3) maps the confusion columns to a score Column; the default
    is the strict G-Mean.
    """
    spark = df.sparkSession
    hist = (df.select(F.col(label).alias("y"), thresholds_passed(p, n).alias("c"))
              .groupBy("c").agg(F.count_if(F.col("y") == 1).alias("n1"),
                                F.count_if(F.col("y") == 0).alias("n0")))
    grid = spark.range(0, n + 1).select(F.col("id").cast("long").alias("c"))
    w = Window.orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, 0)  # <= 100 rows
    cum = (grid.join(hist, "c", "left").na.fill(0, ["n1", "n0"])
               .select("c", F.sum("n1").over(w).alias("tp"), F.sum("n0").over(w).alias("fp"),
                       F.sum("n1").over(Window.partitionBy()).alias("n_pos"),
                       F.sum("n0").over(Window.partitionBy()).alias("n_neg")))
    out = (cum.where(F.col("c") >= 1)
              .select(F.col("c").cast("int").alias("i"), M.threshold_value(F.col("c")).alias("threshold"),
                      F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                      (F.col("n_pos") - F.col("tp")).cast("long").alias("fn"),
                      (F.col("n_neg") - F.col("fp")).cast("long").alias("tn")))
    return out.withColumn("score", (metric or M.gmean_strict)())


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """Smallest threshold with the largest score; ``default`` if none scores > 0."""
    top = sweep.orderBy(F.col("score").desc(), F.col("i").asc()).limit(1)
    return top.select(F.when(F.col("score") > 0, F.col("threshold")).otherwise(F.lit(default))
                      .alias("best_threshold"),
                      F.when(F.col("score") > 0, F.col("score")).otherwise(F.lit(0.0)).alias("best_score"))


def roc_points(df: DataFrame, label: str = "label", p: str = "p", group: list[str] | None = None,
               rows_per_bucket: int = 1_000_000) -> DataFrame:
    """one ROC point per distinct score (descending); (0, 0) is implicit.

    Rows collapse to distinct scores first (a hot score becomes one row);
    cumulative counts use quantile buckets of the scores. All points are kept
    (no dropping of collinear points); AUC is unaffected.
    """
    g = group or []
    per = (df.groupBy(*g, p).agg(F.count_if(F.col(label) == 1).alias("tp_s"),
                                 F.count_if(F.col(label) == 0).alias("fp_s")))
    tot = per.groupBy(*g).agg(F.sum("tp_s").alias("n_pos"), F.sum("fp_s").alias("n_neg"))
    per = per.where(F.col(p).isNotNull())                                # no score: no point, but one of the totals
    per = with_quantile_bucket(per.withColumn("__down", -F.col(p).cast("double")), g, "__down", "__b", rows_per_bucket).drop("__down")
    cum = bucketed_running_sum(per, g, [F.col(p).desc()], "__b", {"tp_c": "tp_s", "fp_c": "fp_s"})
    if g:
        cum = cum.join(tot, g)
    else:  # two numbers: bring them to the driver instead of joining a 1-row table
        t = tot.first()
        cum = cum.withColumns({c: F.lit(t[c] or 0).cast("long") for c in ("n_pos", "n_neg")})
    pts = cum.select(*g, F.col(p).alias("threshold"), "tp_s", "fp_s", "tp_c", "fp_c", "n_pos", "n_neg",
                     F.try_divide("fp_c", "n_neg").alias("fpr"), F.try_divide("tp_c", "n_pos").alias("tpr"))
    return pts


def auc_from_points(pts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """trapezoid area, summed per distinct score (no ordered pass)."""
    g = group or []
    area = F.try_divide(F.col("fp_s") * ((F.col("tp_c") - F.col("tp_s")) + F.col("tp_s") / 2.0),
                        F.col("n_neg").cast("double") * F.col("n_pos"))  # the product of two counts may pass any whole number type
    return pts.groupBy(*g).agg(F.sum(area).alias("auc"))


def log_loss(df: DataFrame, label: str = "label", p: str = "p", eps: float = 1e-15,
             group: list[str] | None = None) -> DataFrame:
    """Mean binary cross-entropy with clipping; rows without a label don't count."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    ll = F.when(F.col(label) == 1, F.log(q)).when(F.col(label).isNotNull(), F.log(1 - q))
    return df.groupBy(*(group or [])).agg((-F.avg(ll)).alias("log_loss"))


def model_comparison(preds: DataFrame, model: str = "Model", label: str = "label",
                     pred: str = "pred") -> DataFrame:
    """D19 + B23: sensitivity, specificity, G-Mean per model, in long form."""
    r = preds.groupBy(model).agg(
        F.try_divide(F.count_if((F.col(label) == 1) & (F.col(pred) == 1)), F.count_if(F.col(label) == 1)).alias("sens"),
        F.try_divide(F.count_if((F.col(label) == 0) & (F.col(pred) == 0)), F.count_if(F.col(label) == 0)).alias("spec"))
    wide = r.select(model, F.sqrt(F.col("sens") * F.col("spec")).alias("G-Mean"),
                    F.col("sens").alias("Sensitivity"), F.col("spec").alias("Specificity"))
    return wide.unpivot([model], ["G-Mean", "Sensitivity", "Specificity"], "Metric", "Score")
