"""Metric expressions over confusion counts (columns ``tp fp fn tn``).

Fixed values: epsilon 1e-8 in the metric set and in specificity; the strict
G-Mean (the tuning score) has no epsilon on recall and scores 0 when there
are no positives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def c(name) -> Column:
    return F.col(name).cast("double") if isinstance(name, str) else name.cast("double")


def specificity(tn="tn", fp="fp") -> Column:
    return c(tn) / (c(tn) + c(fp) + F.lit(EPS))


def recall_strict(tp="tp", fn="fn") -> Column:
    return F.when(c(tp) + c(fn) > 0, c(tp) / (c(tp) + c(fn))).otherwise(F.lit(0.0))


def gmean_strict(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    """sqrt(recall * specificity) as the search/threshold scorer."""
    return F.sqrt(recall_strict(tp, fn) * specificity(tn, fp))


def metric_set(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """The reference's six metrics, epsilon everywhere."""
    acc = (c(tp) + c(tn)) / (c(tp) + c(tn) + c(fp) + c(fn) + F.lit(EPS))
    prec = c(tp) / (c(tp) + c(fp) + F.lit(EPS))
    rec = c(tp) / (c(tp) + c(fn) + F.lit(EPS))
    spec = specificity(tn, fp)
    f1 = F.lit(2.0) * prec * rec / (prec + rec + F.lit(EPS))
    return {"accuracy": acc, "precision": prec, "recall": rec, "specificity": spec,
            "f1": f1, "gmean": F.sqrt(spec * rec)}


def confusion_aggs(label="label", pred="pred") -> list[Column]:
    """D10 as four conditional counts (one-class inputs need no fallback)."""
    y, p = F.col(label), F.col(pred)
    return [F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
            F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
            F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
            F.count_if((y == 1) & (p == 1)).cast("long").alias("tp")]


def threshold_value(i) -> Column:
    """The i-th (1-based) sweep threshold as numpy builds it: 0.01 + (i-1)*0.01."""
    idx = F.col(i) if isinstance(i, str) else i
    return F.lit(0.01) + (idx - 1).cast("double") * F.lit(0.01)
