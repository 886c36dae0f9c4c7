"""Queries: sources and sinks round trips through the shared folder.

Each call writes Spark-derived data under ``spark.checkpoint.dir`` (a fresh
sub-folder) and returns what it reads back; the oracle computes the same from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from horizonkit.functions import coerce as K
from horizonkit.operators import cohort as C
from horizonkit.operators import evaluation as EV
from horizonkit.operators import hrv as H
from horizonkit.plans import oracle_cte as Q
from horizonkit.plans import roles as R
from horizonkit.plans.q_cohort import merged
from horizonkit.plans.registry import query
from horizonkit.session import scratch_path
from horizonkit.sources import signals as SG
from horizonkit.sources import sinks as SK
from horizonkit.sources import tables as TB


@query("signal_roundtrip", sql="""
SELECT user_id AS patient_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
       CAST(value AS FLOAT) AS value
FROM events""")
def signal_roundtrip(spark, d):
    """Per-patient text files written and scanned back in order."""
    s = H.sample_index(R.signal(spark, d), "user_id", "ts", "event_id")
    path = scratch_path(spark, "signals")
    SG.write_signal_dir(s, path, "user_id", "sample_idx", "value")
    samples, _ = SG.read_signal_dir(spark, path, r"user_id=(\d+)/", on="path", recursive=True)
    return samples


@query("horizon_sink_roundtrip", sql=f"""
WITH {Q.MERGED}
SELECT m.ID, m.Name, m.Obito_MS, m.Tempo, CAST(h AS INTEGER) AS horizon,
       CASE WHEN Obito_MS = 1 AND Tempo < h THEN 1 ELSE 0 END AS Target
FROM merged m, (SELECT unnest([3, 5, 7, 10]) AS h)
WHERE (Obito_MS = 1 AND Tempo < h) OR (Obito_MS = 0 OR Tempo >= h)""")
def horizon_sink_roundtrip(spark, d):
    """Labelled rows written partitioned by horizon, each horizon's folder read back by itself."""
    lab = C.label_horizons(merged(spark, d), event_col="Obito_MS", time_col="Tempo")
    path = scratch_path(spark, "horizons")
    SK.write_horizons(lab.select("ID", "Name", "Obito_MS", "Tempo", "horizon", "Target"), path)
    back = None
    for h in (3, 5, 7, 10):
        part = spark.read.parquet(f"{path}/horizon={h}").withColumn("horizon", F.lit(h))
        back = part if back is None else back.unionByName(part)
    return back.select("ID", "Name", "Obito_MS", "Tempo", F.col("horizon").cast("int"), "Target")


_NA_LIST = ", ".join("'" + x + "'" for x in TB.NA_STRINGS)


@query("csv_roundtrip", sql=f"""
WITH src AS (
  SELECT l_orderkey, l_linenumber,
         CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'null'
              WHEN 2 THEN replace(printf('%.2f', l_tax), '.', ',') WHEN 3 THEN 'n/a'
              ELSE printf('%.2f', l_discount) END AS raw
  FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN raw IN ({_NA_LIST}) THEN NULL ELSE raw END AS raw,
       CASE WHEN raw IN ({_NA_LIST}) THEN NULL
            WHEN regexp_full_match(replace(raw, ',', '.'), '{K.NUMERIC_PATTERN}')
            THEN TRY_CAST(trim(replace(raw, ',', '.')) AS DOUBLE) END AS value
FROM src""")
def csv_roundtrip(spark, d):
    """CSV sink with header, fallback scan, pandas NA set, repair."""
    li = R.table(spark, d, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    raw = (F.when(k == 0, "NA").when(k == 1, "null")
            .when(k == 2, F.replace(F.format_string("%.2f", "l_tax"), F.lit("."), F.lit(",")))
            .when(k == 3, "n/a").otherwise(F.format_string("%.2f", "l_discount")))
    path = scratch_path(spark, "clinical") + ".csv"
    SK.write_features(li.select("l_orderkey", "l_linenumber", raw.alias("raw")), path,
                      ["l_orderkey", "l_linenumber", "raw"], fmt="csv")
    back = TB.load_first(spark, [path + ".missing", path],
                         schema="l_orderkey long, l_linenumber int, raw string")
    return back.select("l_orderkey", "l_linenumber", "raw", K.decimal_comma("raw").alias("value"))


@query("summary_roundtrip", sql=f"""
WITH {Q.SCORES}, {Q.THRESHOLDS}, {Q.BEST},
best AS (SELECT CASE WHEN score > 0 THEN t ELSE 0.5 END AS t FROM b),
pr AS (SELECT label, CASE WHEN p >= best.t THEN 1 ELSE 0 END AS pred FROM scores, best),
{Q.REPORT},
rep AS (SELECT class, f1, support FROM f
        UNION ALL SELECT 'macro avg', avg(f1), sum(support) FROM f
        UNION ALL SELECT 'weighted avg', sum(f1 * support) / sum(support), sum(support) FROM f
        UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(support) FROM f)
SELECT '5anos' AS horizon_dir, 'chars_mod' AS model_dir, 'chars_mod' AS model_name,
       printf('%.4f', best.t) AS optimal_threshold, class, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
FROM rep, best""")
def summary_roundtrip(spark, d):
    """Summary JSON per (horizon, model) written, discovered, read back."""
    sc = R.scores(spark, d)
    t = EV.best_threshold(EV.threshold_sweep(sc)).first()["best_threshold"]
    rep = EV.classification_report(EV.predict_at(sc, "p", t))
    root = scratch_path(spark, "results")
    summ = SK.summary_frame(spark, "chars_mod", 1, t, {"rule": "n_chars % 101 / 100"}, ["n_chars"], rep)
    SK.write_summary(summ, f"{root}/5anos/chars_mod/summary")
    SK.write_report(rep, f"{root}/5anos/chars_mod/report")
    back = SK.read_summaries(spark, root)
    return back.select("horizon_dir", "model_dir", "model_name", "optimal_threshold",
                       F.explode("classification_report").alias("r")).select(
        "horizon_dir", "model_dir", "model_name", "optimal_threshold", "r.class",
        K.r6("r.f1").alias("f1"), "r.support")


_RULES = {"chars_mod": "(n_chars % 101) / 100.0D", "chars_div": "least(1.0D, n_chars / 5000.0D)"}
_RULES_SQL = {"chars_mod": "(n_chars % 101) / 100.0", "chars_div": "least(1.0, n_chars / 5000.0)"}
_SAVED_SQL = "WITH t AS (" + " UNION ALL ".join(
    f"""SELECT '{h}anos' AS horizon_dir, '{m}' AS model, l.toxic AS label, CAST({e} AS DOUBLE) AS p, {t} AS cut
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % {h} = 0""" for h in (3, 5) for m, e in _RULES_SQL.items()
    for t in [0.3 if m == "chars_mod" else 0.6]) + """),
c AS (SELECT horizon_dir, model, count_if(label = 1) AS n1, count_if(label = 0) AS n0,
             count_if(label = 1 AND p >= cut) / count_if(label = 1) AS sens, count_if(label = 0 AND p < cut) / count_if(label = 0) AS spec
      FROM t GROUP BY horizon_dir, model),
a AS (SELECT x.horizon_dir, x.model, sum(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0 END) AS wins
      FROM t x JOIN t y ON x.horizon_dir = y.horizon_dir AND x.model = y.model WHERE x.label = 1 AND y.label = 0 GROUP BY x.horizon_dir, x.model)
SELECT horizon_dir, model, 'Sensitivity' AS metric, round(sens, 6) + 0.0 AS score FROM c
UNION ALL SELECT horizon_dir, model, 'Specificity', round(spec, 6) + 0.0 FROM c
UNION ALL SELECT horizon_dir, model, 'G-Mean', round(sqrt(sens * spec), 6) + 0.0 FROM c
UNION ALL SELECT horizon_dir, model, 'AUC', round(wins / (n1 * n0), 6) + 0.0 FROM a JOIN c USING (horizon_dir, model)"""


def _write_study(spark, d, root):
    """Two horizons of two rule models with all artefacts, and a folder with the summary or the pipeline alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer
    rows = (R.table(spark, d, "documents").select("doc_id", "n_chars").join(R.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
            .select(F.col("doc_id").alias("id"), "n_chars", F.col("toxic").alias("label")))
    for h in (3, 5):
        test = rows.where(F.col("id") % h == 0)
        SK.write_test_split(test, ["n_chars"], f"{root}/{h}anos")
        for name, rule in _RULES.items():
            model = Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {rule} AS p FROM __THIS__")]).fit(test)
            t = 0.3 if name == "chars_mod" else 0.6
            rep = EV.classification_report(EV.predict_at(model.transform(test), "p", t))
            summary = SK.summary_frame(spark, name, 1, t, {"rule": rule}, ["n_chars"], rep)
            for base, whole in ((f"{root}/{h}anos/{name}", True), (f"{root}/{h}anos/{name}_unfitted", False)):
                SK.write_summary(summary, f"{base}/summary")
                SK.write_report(rep, f"{base}/report")
                if whole:
                    SK.save_pipeline(model, f"{base}/pipeline")
        SK.save_pipeline(model, f"{root}/{h}anos/unreported/pipeline")


@query("study_from_artifacts", sql=_SAVED_SQL)
def study_from_artifacts(spark, d):
    """Saved models found by both artefacts, run on the saved test splits, and compared."""
    from horizonkit.operators.study import compare_saved, saved_predictions
    root = scratch_path(spark, "study")
    _write_study(spark, d, root)
    out = compare_saved(saved_predictions(spark, root))
    return out.select("horizon_dir", "model", F.col("Metric").alias("metric"), K.r6("Score").alias("score"))


@query("report_roundtrip", sql=f"""
WITH {Q.SCORES}, {Q.THRESHOLDS}, {Q.BEST},
best AS (SELECT CASE WHEN score > 0 THEN t ELSE 0.5 END AS t FROM b),
pr AS (SELECT label, CASE WHEN p >= best.t THEN 1 ELSE 0 END AS pred FROM scores, best),
{Q.REPORT},
rep AS (SELECT class, f1, support FROM f
        UNION ALL SELECT 'macro avg', avg(f1), sum(support) FROM f
        UNION ALL SELECT 'weighted avg', sum(f1 * support) / sum(support), sum(support) FROM f
        UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(support) FROM f)
SELECT '5anos' AS horizon_dir, 'chars_mod' AS model_dir, class, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep""")
def report_roundtrip(spark, d):
    """The text report written and read back, tagged by its folder."""
    sc = R.scores(spark, d)
    t = EV.best_threshold(EV.threshold_sweep(sc)).first()["best_threshold"]
    root = scratch_path(spark, "results")
    SK.write_report(EV.classification_report(EV.predict_at(sc, "p", t)), f"{root}/5anos/chars_mod/report")
    return SK.read_report(spark, root).select("horizon_dir", "model_dir", "class", K.r6("f1").alias("f1"), "support")


@query("merged_table_roundtrip", sql=f"""
WITH {Q.MERGED}
SELECT ID, Name, Data_MSC, Tempo, quantity FROM merged""")
def merged_table_roundtrip(spark, d):
    """The merged table written and scanned back."""
    path = scratch_path(spark, "merged")
    SK.write_table(merged(spark, d), path)
    return TB.read_table(spark, path, fmt="parquet").select("ID", "Name", "Data_MSC", "Tempo", "quantity")
