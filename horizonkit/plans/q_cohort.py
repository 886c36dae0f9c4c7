"""Queries: cohort merge, horizons, filters and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from horizonkit.operators import cohort as C
from horizonkit.plans import oracle_cte as Q
from horizonkit.plans import roles as R
from horizonkit.plans.registry import query


def merged(spark, d):
    return C.clinical_merge(
        R.study(spark, d), R.clinical(spark, d),
        name_col="Name", study_date_col="exam_ts", clinical_date_col="visit_ts",
        event_col="Obito_MS", death_date_col="death_ts", order_cols=["ord_key", "ord_line", "death_ts"],
        clinical_cols=["qty", "disc", "tax", "absent_col"], rename={"qty": "quantity"}, lead=3)


@query("cohort_horizons", sql=f"""
WITH {Q.MERGED},
lab AS (
  SELECT h.horizon,
         CASE WHEN Obito_MS = 1 AND Tempo < h.horizon THEN 1
              WHEN Obito_MS = 0 OR Tempo >= h.horizon THEN 0 END AS Target
  FROM merged, (VALUES (3), (5), (7), (10)) h(horizon))
SELECT horizon,
       CAST(count(Target) AS BIGINT) AS n,
       CAST(count_if(Target = 0) AS BIGINT) AS n_class0,
       CAST(count_if(Target = 1) AS BIGINT) AS n_class1,
       CAST(count_if(Target IS NULL) AS BIGINT) AS n_dropped,
       CASE WHEN count(Target) > 0
            THEN round(count_if(Target = 1) * 100.0 / count(Target), 6) END AS event_pct
FROM lab GROUP BY horizon""")
def cohort_horizons(spark, d):
    """Flagship: merge -> elapsed years -> 4 horizons -> class counts."""
    lab = C.label_horizons(merged(spark, d), event_col="Obito_MS", time_col="Tempo",
                           keep_unlabelled=True)
    return C.horizon_stats(lab)


@query("clinical_merge", sql=f"""
WITH {Q.MERGED}
SELECT ID, Name, exam_ts, Data_MSC, Tempo, quantity, disc, tax, Obito_MS, Time,
       o_totalprice, o_orderpriority FROM merged""")
def clinical_merge(spark, d):
    return merged(spark, d)


@query("horizon_dataset", sql=f"""
WITH {Q.MERGED}
SELECT m.ID, m.Name, m.Obito_MS, m.Tempo, h.horizon,
       CASE WHEN Obito_MS = 1 AND Tempo < h.horizon THEN 1 ELSE 0 END AS Target
FROM merged m, (VALUES (3), (5), (7), (10)) h(horizon)
WHERE (Obito_MS = 1 AND Tempo < h.horizon) OR (Obito_MS = 0 OR Tempo >= h.horizon)""")
def horizon_dataset(spark, d):
    """B3 rows themselves (what the per-horizon CSV sink receives)."""
    lab = C.label_horizons(merged(spark, d), event_col="Obito_MS", time_col="Tempo")
    return lab.select("ID", "Name", "Obito_MS", "Tempo", "horizon", "Target")


@query("merge_report", sql=f"""
WITH {Q.MERGED}
SELECT CAST(coalesce(sum(Obito_MS), 0) AS BIGINT) AS deaths,
       CAST(count(Data_MSC) AS BIGINT) AS dates_found,
       CAST(coalesce(sum(Obito_MS), 0) - count(Data_MSC) AS BIGINT) AS missing
FROM merged""")
def merge_report(spark, d):
    return C.merge_report(merged(spark, d), "Obito_MS")


@query("unresolved_names", sql=f"""
WITH {Q.MERGED}
SELECT DISTINCT Name FROM merged WHERE Obito_MS = 1 AND Data_MSC IS NULL""")
def unresolved_names(spark, d):
    return C.unresolved_names(merged(spark, d), "Name", "Obito_MS")


@query("death_lookup", sql=f"""
WITH {Q.STUDY}, {Q.CLINICAL}
SELECT Name, death_ts AS death FROM (
  SELECT Name, death_ts,
         row_number() OVER (PARTITION BY Name ORDER BY ord_key, ord_line, death_ts) AS rn
  FROM clinical WHERE death_ts IS NOT NULL AND Name IS NOT NULL) t WHERE rn = 1""")
def death_lookup(spark, d):
    """First non-null death date per name over the whole history."""
    return C.first_non_null_by(R.clinical(spark, d), "Name", "death_ts",
                               ["ord_key", "ord_line", "death_ts"], "death")


@query("study_filter", sql=f"""
WITH {Q.STUDY}
SELECT ID, Obito_MS, Time FROM study WHERE Obito_MS = 1 AND Time < 5
UNION ALL
SELECT ID, Obito_MS, Time FROM study WHERE Obito_MS = 0 OR Time = 5""")
def study_filter(spark, d):
    return C.study_filter(R.study(spark, d), "Obito_MS", "Time").select("ID", "Obito_MS", "Time")


@query("event_flag", sql=f"""
WITH {Q.STUDY}
SELECT ID, CASE WHEN Obito_MS = 1 AND Time < 5 THEN 1 ELSE 0 END AS event
FROM study WHERE (Obito_MS = 1 AND Time < 5) OR (Obito_MS = 0 OR Time = 5)""")
def event_flag(spark, d):
    s = C.study_filter(R.study(spark, d), "Obito_MS", "Time")
    return s.select("ID", C.event_flag("Obito_MS", "Time").alias("event"))


_PATIENTS_SQL = f"""
WITH {Q.STUDY},
patients AS (
  SELECT o.o_custkey AS PID, s.ID, s.Obito_MS, s.Time
  FROM study s JOIN orders o ON s.ID = o.o_orderkey
  WHERE (s.Obito_MS = 1 AND s.Time < 5) OR (s.Obito_MS = 0 OR s.Time = 5)),
firsts AS (
  SELECT PID, ID, Obito_MS, Time FROM (
    SELECT *, row_number() OVER (PARTITION BY PID ORDER BY ID) AS rn FROM patients) t
  WHERE rn = 1),
ids AS (SELECT DISTINCT user_id AS patient_id FROM events)"""


def _patients(spark, d):
    s = C.study_filter(R.study(spark, d), "Obito_MS", "Time")
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"),
                                           F.col("o_custkey").alias("PID"))
    return s.join(o, "ID").select("PID", "ID", "Obito_MS", "Time")


def _signal_ids(spark, d):
    return R.signal(spark, d).select(F.col("user_id").alias("patient_id")).distinct()


@query("first_match_lookup", sql=_PATIENTS_SQL + """
SELECT i.patient_id, f.ID, f.Obito_MS, f.Time,
       CASE WHEN f.Obito_MS = 1 AND f.Time < 5 THEN 1 ELSE 0 END AS event
FROM ids i JOIN firsts f ON i.patient_id = f.PID""")
def first_match_lookup(spark, d):
    """C3 + B2: first patient row per signal id, with its event flag."""
    matched, _ = C.lookup_first_match(_signal_ids(spark, d), _patients(spark, d),
                                      "patient_id", "PID", ["ID"])
    return matched.select("patient_id", "ID", "Obito_MS", "Time",
                          C.event_flag("Obito_MS", "Time").alias("event"))


@query("lookup_rejects", sql=_PATIENTS_SQL + """
SELECT i.patient_id FROM ids i WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.PID = i.patient_id)""")
def lookup_rejects(spark, d):
    """Signal ids with no patient row (the reference raises per file)."""
    _, rejects = C.lookup_first_match(_signal_ids(spark, d), _patients(spark, d),
                                      "patient_id", "PID", ["ID"])
    return rejects.select("patient_id")
