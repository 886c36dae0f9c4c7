"""Queries: association statistics, MI, ranking, correlation, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from horizonkit.functions import coerce as K
from horizonkit.operators import association as A
from horizonkit.operators import features as FE
from horizonkit.operators import mutual_info as MI
from horizonkit.plans import oracle_cte as Q
from horizonkit.plans import roles as R
from horizonkit.plans.registry import query

# ------------------------------------------------------------------ inputs
# (name, is_numeric, spark expression builder, duckdb expression)
LINE_FEATURES = [
    ("qty", True, lambda: F.when(F.col("l_orderkey") % 13 != 0, F.col("l_quantity")),
     "CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity END"),
    ("price", True, lambda: F.col("l_extendedprice"), "l_extendedprice"),
    ("disc", True, lambda: F.col("l_discount"), "l_discount"),
    ("tax", True, lambda: F.col("l_tax"), "l_tax"),
    ("line", True, lambda: F.col("l_linenumber"), "l_linenumber"),
    ("status", False, lambda: F.col("l_linestatus"), "l_linestatus"),
    ("const", True, lambda: F.lit(1), "1"),
]
LINE_TARGET = (lambda: F.when(F.col("l_returnflag") == "R", 1).otherwise(0), "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")

EMB_CATS = [
    ("c_sign", False, lambda: F.when(F.col("embedding")[0] > 0, "pos").otherwise("neg"),
     "CASE WHEN embedding[1] > 0 THEN 'pos' ELSE 'neg' END"),
    ("c_bin", True, lambda: F.floor(F.col("embedding")[1] * 10).cast("int"),
     "CAST(floor(embedding[2] * 10) AS INTEGER)"),
]
EMB_FEATURES = [(f"f{i}", True, (lambda i=i: F.col("embedding")[i].cast("double")),
                 f"CAST(embedding[{i + 1}] AS DOUBLE)") for i in range(R.N_EMB)] + EMB_CATS
EMB_TARGET = (lambda: F.when(F.col("label") < 5, 1).otherwise(0), "CASE WHEN label < 5 THEN 1 ELSE 0 END")


def _wide(spark, d, table, feats, target):
    t = R.table(spark, d, table)
    return t.select(target[0]().alias("y"), *[e().alias(n) for n, _, e, _ in feats])


def _emb_long(spark, d):
    """The embeddings as (feature, is_num, x, level, y): posexplode, not 66 columns."""
    e = R.table(spark, d, "embeddings").select(EMB_TARGET[0]().alias("y"), "embedding")
    vec = e.select("y", F.posexplode("embedding").alias("pos", "v")).select(
        F.format_string("f%d", F.col("pos")).alias("feature"), F.lit(True).alias("is_num"),
        K.nan_to_null(F.col("v").cast("double")).alias("x"), F.lit(None).cast("string").alias("level"), "y")
    cats = e.select("y", F.explode(F.array(
        F.struct(F.lit("c_sign").alias("feature"), F.lit(False).alias("is_num"),
                 F.lit(None).cast("double").alias("x"), EMB_CATS[0][2]().alias("level")),
        F.struct(F.lit("c_bin").alias("feature"), F.lit(True).alias("is_num"),
                 EMB_CATS[1][2]().cast("double").alias("x"), F.lit(None).cast("string").alias("level"))
    )).alias("kv")).select("kv.*", "y")
    return vec.unionByName(cats)


def _assoc(spark, d, which):
    if which == "line":
        return A.associate(_wide(spark, d, "lineitem", LINE_FEATURES, LINE_TARGET), "y")
    numeric = {n: num for n, num, _, _ in EMB_FEATURES}
    return A.associate_long(_emb_long(spark, d), numeric)


def _assoc_sql(table, feats, target) -> str:
    """DuckDB long form + routes + numeric + categorical CTEs."""
    cols = ", ".join(f"{e} AS {n}" for n, _, _, e in feats)
    parts = []
    for n, num, _, _ in feats:
        x = f"CAST({n} AS DOUBLE)" if num else "NULL"
        parts.append(f"SELECT '{n}' AS feature, {str(num).upper()} AS is_num, {x} AS x, "
                     f"CAST({n} AS VARCHAR) AS level, y FROM src WHERE {n} IS NOT NULL")
    long = "\n  UNION ALL ".join(parts)
    return f"""
src AS (SELECT {target[1]} AS y, {cols} FROM {table}),
long AS (
  {long}),
routes AS (
  SELECT feature, count(*) AS n, count(DISTINCT level) AS n_unique,
         CASE WHEN count(DISTINCT level) <= 1 THEN 'skip'
              WHEN bool_and(is_num) AND count(DISTINCT level) >= 10 THEN 'numeric'
              ELSE 'categorical' END AS kind
  FROM long GROUP BY feature),
num AS (SELECT l.* FROM long l JOIN routes r ON l.feature = r.feature WHERE r.kind = 'numeric'),
tot AS (SELECT feature, corr(x, CAST(y AS DOUBLE)) AS r, avg(x) AS m, count(*) AS n FROM num GROUP BY feature),
cls AS (SELECT feature, y, count(*) AS nc, avg(x) AS mc, var_pop(x) AS vc FROM num GROUP BY feature, y),
ss AS (SELECT c.feature, sum(c.nc * (c.mc - t.m) * (c.mc - t.m)) AS ssb, sum(c.nc * c.vc) AS ssw,
              count(*) AS k
       FROM cls c JOIN tot t ON c.feature = t.feature GROUP BY c.feature),
numres AS (SELECT t.feature, t.n, t.r, abs(t.r) AS abs_r,
                  CASE WHEN s.ssw > 0 THEN (s.ssb / (s.k - 1)) / (s.ssw / (t.n - s.k)) END AS anova_f
           FROM tot t JOIN ss s ON t.feature = s.feature),
cells AS (SELECT l.feature, l.level, l.y, count(*) AS o FROM long l JOIN routes r ON l.feature = r.feature
          WHERE r.kind = 'categorical' GROUP BY l.feature, l.level, l.y),
rws AS (SELECT feature, level, sum(o) AS rs FROM cells GROUP BY feature, level),
cls2 AS (SELECT feature, y, sum(o) AS cs FROM cells GROUP BY feature, y),
dims AS (SELECT a.feature, a.nr, a.n, b.nc FROM
           (SELECT feature, count(*) AS nr, sum(rs) AS n FROM rws GROUP BY feature) a
           JOIN (SELECT feature, count(*) AS nc FROM cls2 GROUP BY feature) b ON a.feature = b.feature),
grid AS (SELECT r.feature, r.level, c.y, coalesce(x.o, 0) AS o, r.rs * c.cs / d.n AS e,
                (d.nr - 1) * (d.nc - 1) AS dof, d.n, d.nr, d.nc
         FROM rws r JOIN cls2 c ON r.feature = c.feature
         LEFT JOIN cells x ON x.feature = r.feature AND x.level = r.level AND x.y = c.y
         JOIN dims d ON d.feature = r.feature),
catres AS (
  SELECT feature, n, dof,
         sum(CASE WHEN dof > 0 THEN
               power(CASE WHEN dof = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END, 2) / e
             ELSE 0 END) AS chi2,
         sqrt(sum(CASE WHEN dof > 0 THEN
               power(CASE WHEN dof = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END, 2) / e
             ELSE 0 END) / (n * CASE WHEN least(nr, nc) - 1 > 0 THEN least(nr, nc) - 1 ELSE 1 END))
           AS cramers_v
  FROM grid GROUP BY feature, n, dof, nr, nc)"""


LINE_SQL = _assoc_sql("lineitem", LINE_FEATURES, LINE_TARGET)
EMB_SQL = _assoc_sql("embeddings", EMB_FEATURES, EMB_TARGET)


# ------------------------------------------------------------------ E1-E5
@query("feature_router", sql=f"WITH {LINE_SQL}\nSELECT feature, CAST(n AS BIGINT) AS n, "
                             "CAST(n_unique AS BIGINT) AS n_unique, kind FROM routes")
def feature_router(spark, d):
    """Pairwise-missing removal, exact distinct counts, routing."""
    routes, _, _ = _assoc(spark, d, "line")
    return routes


@query("feature_kinds", sql=f"WITH {LINE_SQL}\nSELECT feature, CAST(n AS BIGINT) AS n, n_unique <= 1 AS \"constant\", kind FROM routes")
def feature_kinds(spark, d):
    """The router's decision without counting the distinct values of wide columns."""
    return A.bounded_kinds(A.to_long(_wide(spark, d, "lineitem", LINE_FEATURES, LINE_TARGET), "y", [n for n, *_ in LINE_FEATURES]))


@query("point_biserial", sql=f"WITH {EMB_SQL}\nSELECT feature, round(r, 6) AS r, round(abs_r, 6) AS abs_r FROM numres")
def point_biserial(spark, d):
    """R between each numeric feature and the binary target."""
    _, num, _ = _assoc(spark, d, "emb")
    return num.select("feature", K.r6("r").alias("r"), K.r6("abs_r").alias("abs_r"))


@query("anova_f", sql=f"WITH {LINE_SQL}\nSELECT feature, CAST(n AS BIGINT) AS n, round(anova_f, 6) AS anova_f FROM numres")
def anova_f(spark, d):
    """One-way ANOVA F per numeric feature."""
    _, num, _ = _assoc(spark, d, "line")
    return num.select("feature", "n", K.r6("anova_f").alias("anova_f"))


@query("chi2_yates", sql=f"WITH {LINE_SQL}\nSELECT feature, CAST(n AS BIGINT) AS n, CAST(dof AS BIGINT) AS dof, "
                         "round(chi2, 6) AS chi2 FROM catres")
def chi2_yates(spark, d):
    """Chi-square on the full contingency grid, Yates on 2x2."""
    _, _, cat = _assoc(spark, d, "line")
    return cat.select("feature", "n", "dof", K.r6("chi2").alias("chi2"))


@query("cramers_v", sql=f"WITH {EMB_SQL}\nSELECT feature, round(cramers_v, 6) AS cramers_v FROM catres")
def cramers_v(spark, d):
    """E5: Cramér's V per categorical feature."""
    _, _, cat = _assoc(spark, d, "emb")
    return cat.select("feature", K.r6("cramers_v").alias("cramers_v"))


_TAILS_SQL = f"""
WITH {LINE_SQL},
f0 AS (SELECT n.feature, n.anova_f AS f, (s.k - 1)::DOUBLE AS d1, (n.n - s.k)::DOUBLE AS d2 FROM numres n JOIN ss s ON n.feature = s.feature),
f1 AS (SELECT feature, d2 / 2 AS a, d1 / 2 AS b, d2 / (d2 + d1 * f) AS x, d1 * f / (d2 + d1 * f) AS r FROM f0),
f2 AS (SELECT feature, x >= (a + 1) / (a + b + 2) AS turn, a, b, x, r FROM f1),
f3 AS (SELECT feature, turn, CASE WHEN turn THEN b ELSE a END AS a, CASE WHEN turn THEN a ELSE b END AS b,
              CASE WHEN turn THEN r ELSE x END AS x, CASE WHEN turn THEN x ELSE r END AS r FROM f2),
f4 AS (SELECT *, list_reduce([1.0::DOUBLE] || list_transform(range(0, 200 + 8 * ceil(sqrt(greatest(a, b)))::BIGINT),
                lambda i: (200 + 8 * ceil(sqrt(greatest(a, b)))::BIGINT - i)::DOUBLE),
              lambda v, m: 1 + (CASE WHEN m % 2 = 1 THEN -(a + floor(m / 2)) * (a + b + floor(m / 2)) ELSE floor(m / 2) * (b - floor(m / 2)) END)
                                * x / ((a + m - 1) * (a + m)) / v) AS fraction FROM f3),
f5 AS (SELECT feature, turn, exp(a * ln(x) + b * ln(r) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a / fraction AS share FROM f4),
c1 AS (SELECT feature, dof / 2.0 AS a, chi2 / 2 AS x, 200 + 8 * ceil(sqrt(dof / 2.0))::BIGINT AS terms FROM catres WHERE dof > 0 AND chi2 > 0),
c2 AS (SELECT *, exp(a * ln(x) - x - lgamma(a)) AS lead, list_transform(range(0, terms), lambda i: (terms - i)::DOUBLE) AS ms FROM c1),
c3 AS (SELECT feature, CASE WHEN x < a + 1 THEN 1 - lead / a * list_reduce([1.0::DOUBLE] || ms, lambda v, m: 1 + v * x / (a + m))
              ELSE lead / list_reduce([(x + 2 * terms + 1 - a)::DOUBLE] || ms, lambda v, m: x + 2 * m - 1 - a - m * (m - a) / v) END AS p FROM c2)
SELECT feature, 'anova' AS test, round(CASE WHEN turn THEN 1 - share ELSE share END, 6) + 0.0 AS p_value FROM f5
UNION ALL SELECT c.feature, 'chi2', round(coalesce(p, 1.0), 6) + 0.0 FROM catres c LEFT JOIN c3 ON c.feature = c3.feature"""


@query("association_pvalues", sql=_TAILS_SQL)
def association_pvalues(spark, d):
    """E3/E4 p-values: tails of the F and chi-square distributions."""
    _, num, cat = _assoc(spark, d, "line")
    n2, c2 = A.with_pvalues(num, cat)
    a = n2.select("feature", F.lit("anova").alias("test"), K.r6("p_anova").alias("p_value"))
    b = c2.select("feature", F.lit("chi2").alias("test"), K.r6("p_chi2").alias("p_value"))
    return a.unionByName(b)


# ------------------------------------------------------------------ E6/E8
def _rank_sql(src: str, score: str, kind: str, n: int, asc: bool) -> str:
    o = "ASC" if asc else "DESC"
    return (f"SELECT '{kind}' AS \"table\", feature, round({score}, 6) AS score, "
            f"CAST(row_number() OVER (ORDER BY {score} {o}, feature) AS INTEGER) AS rank "
            f"FROM {src} QUALIFY rank <= {n}")


def _ranks(spark, d, asc: bool):
    _, num, cat = _assoc(spark, d, "emb")
    parts = [A.rank(num, "anova_f", 20, asc, "anova_f"), A.rank(num, "abs_r", 20, asc, "abs_r"),
             A.rank(cat, "cramers_v", 20, asc, "cramers_v")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("table", "feature", K.r6("score").alias("score"), F.col("rank").cast("int"))


def _ranks_sql(asc: bool) -> str:
    return (f"WITH {EMB_SQL}\n" + _rank_sql("numres", "anova_f", "anova_f", 20, asc)
            + "\nUNION ALL " + _rank_sql("numres", "abs_r", "abs_r", 20, asc)
            + "\nUNION ALL " + _rank_sql("catres", "cramers_v", "cramers_v", 20, asc))


@query("rank_features", sql=_ranks_sql(False))
def rank_features(spark, d):
    """Strongest 20 by F, by |r| and by Cramér's V."""
    return _ranks(spark, d, False)


@query("weakest_features", sql=_ranks_sql(True))
def weakest_features(spark, d):
    """E6 (weakest variant): the 20 lowest by each score."""
    return _ranks(spark, d, True)


# ------------------------------------------------------------------ E7
_MI_SQL = f"""
WITH {Q.FEATURES_LONG},
ncs AS (SELECT feature, label AS y, count(*) AS nc FROM features_long GROUP BY feature, label),
p0 AS (SELECT f.vec_id, f.feature, f.x, f.label AS y, n.nc, least(3, n.nc - 1) AS k
       FROM features_long f JOIN ncs n ON f.feature = n.feature AND f.label = n.y WHERE n.nc > 1),
w AS (SELECT *, lag(x, 1) OVER w1 AS l1, lag(x, 2) OVER w1 AS l2, lag(x, 3) OVER w1 AS l3,
             lead(x, 1) OVER w1 AS r1, lead(x, 2) OVER w1 AS r2, lead(x, 3) OVER w1 AS r3
      FROM p0 WINDOW w1 AS (PARTITION BY feature, y ORDER BY x, vec_id)),
rr AS (SELECT *, CASE k
   WHEN 3 THEN least(CASE WHEN r3 IS NOT NULL THEN greatest(0, r3 - x) END,
                     CASE WHEN l1 IS NOT NULL AND r2 IS NOT NULL THEN greatest(x - l1, r2 - x) END,
                     CASE WHEN l2 IS NOT NULL AND r1 IS NOT NULL THEN greatest(x - l2, r1 - x) END,
                     CASE WHEN l3 IS NOT NULL THEN greatest(x - l3, 0) END)
   WHEN 2 THEN least(CASE WHEN r2 IS NOT NULL THEN greatest(0, r2 - x) END,
                     CASE WHEN l1 IS NOT NULL AND r1 IS NOT NULL THEN greatest(x - l1, r1 - x) END,
                     CASE WHEN l2 IS NOT NULL THEN greatest(x - l2, 0) END)
   ELSE least(CASE WHEN r1 IS NOT NULL THEN greatest(0, r1 - x) END,
              CASE WHEN l1 IS NOT NULL THEN greatest(x - l1, 0) END) END AS r FROM w),
mm AS (SELECT a.vec_id, a.feature, a.k, a.nc, count(*) AS m FROM rr a JOIN rr b ON a.feature = b.feature
         AND ((a.r > 0 AND b.x < a.x + a.r AND b.x > a.x - a.r) OR (a.r = 0 AND b.x = a.x))
       GROUP BY a.vec_id, a.feature, a.k, a.nc),
harm AS (SELECT i + 1 AS n, sum(CAST(1 AS DOUBLE) / i) OVER (ORDER BY i) AS h FROM range(1, 100000) t(i)
         UNION ALL SELECT 1, 0.0),
agg AS (SELECT m.feature, count(*) AS nn, avg(hk.h) AS hk, avg(hn.h) AS hn, avg(hm.h) AS hm
        FROM mm m JOIN harm hk ON hk.n = m.k JOIN harm hn ON hn.n = m.nc JOIN harm hm ON hm.n = m.m
        GROUP BY m.feature),
mi AS (SELECT a.feature, greatest(0, hN.h + a.hk - a.hn - a.hm) AS mi
       FROM agg a JOIN harm hN ON hN.n = a.nn)"""


def _mi_long(spark, d):
    return R.features_long(spark, d).select(F.col("vec_id").alias("id"), "feature", "x",
                                             F.col("label").alias("y"))


@query("mutual_info_knn", sql=_MI_SQL + "\nSELECT feature, round(mi, 6) AS mi FROM mi")
def mutual_info_knn(spark, d):
    """K-NN mutual information (k = 3) per feature."""
    return MI.mi_knn(_mi_long(spark, d)).select("feature", K.r6("mi").alias("mi"))


@query("select_k", sql=_MI_SQL + """
SELECT feature, round(mi, 6) AS mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank
FROM mi QUALIFY rank <= 10""")
def select_k(spark, d):
    """SelectKBest(mutual information), k = 10, names returned."""
    s = MI.select_k(MI.mi_knn(_mi_long(spark, d)), 10)
    return s.select("feature", K.r6("mi").alias("mi"), F.col("rank").cast("int"))


@query("score_table", sql=_MI_SQL + """
SELECT feature, round(mi, 6) AS score, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank
FROM mi QUALIFY rank <= 20""")
def score_table(spark, d):
    """The selector's score table, top 20."""
    s = MI.select_k(MI.mi_knn(_mi_long(spark, d)), 20)
    return s.select("feature", K.r6("mi").alias("score"), F.col("rank").cast("int"))


@query("mutual_info_binned", sql=f"""
WITH {Q.FEATURES_LONG},
b AS (SELECT feature, label AS y, ntile(10) OVER (PARTITION BY feature ORDER BY x, vec_id) AS bin
      FROM features_long),
n AS (SELECT feature, count(*) AS n FROM b GROUP BY feature),
c AS (SELECT feature, bin, y, count(*) AS c FROM b GROUP BY feature, bin, y),
pb AS (SELECT feature, bin, sum(c) AS cb FROM c GROUP BY feature, bin),
py AS (SELECT feature, y, sum(c) AS cy FROM c GROUP BY feature, y)
SELECT c.feature, round(sum((c.c / n.n) * ln(c.c * n.n / (pb.cb * py.cy))), 6) AS mi
FROM c JOIN pb ON c.feature = pb.feature AND c.bin = pb.bin JOIN py ON c.feature = py.feature AND c.y = py.y
JOIN n ON c.feature = n.feature GROUP BY c.feature""")
def mutual_info_binned(spark, d):
    """E7 (b): plug-in MI on 10 equal-frequency bins."""
    return MI.mi_binned(_mi_long(spark, d)).select("feature", K.r6("mi").alias("mi"))


# ------------------------------------------------------------------ E9-E11, D17
@query("correlation_reducer", sql=f"""
WITH {Q.FEATURES_LONG},
fl AS (SELECT vec_id, feature, CAST(substr(feature, 2) AS INTEGER) AS idx, x FROM features_long),
pairs AS (SELECT a.feature AS fi, b.feature AS fj, b.idx AS j, corr(a.x, b.x) AS r
          FROM fl a JOIN fl b ON a.vec_id = b.vec_id AND a.idx < b.idx GROUP BY a.feature, b.feature, b.idx)
SELECT 'f0' AS feature, 0 AS idx, CAST(NULL AS DOUBLE) AS max_abs_corr, 1 AS kept
UNION ALL
SELECT fj, j, round(max(abs(r)), 6), CASE WHEN max(abs(r)) > 0.12 THEN 0 ELSE 1 END
FROM pairs GROUP BY fj, j""")
def correlation_reducer(spark, d):
    """Drop a column correlated above 0.12 with any earlier column."""
    w = R.features_wide(spark, d)
    cols = [f"f{i}" for i in range(R.N_EMB)]
    out = FE.correlation_reducer(w, cols, 0.12)
    return out.select("feature", "idx", K.r6("max_abs_corr").alias("max_abs_corr"), "kept")


@query("standardize", sql=f"""
WITH {Q.FEATURES_LONG},
st AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM features_long GROUP BY feature)
SELECT f.vec_id, f.feature,
       round(CASE WHEN st.s > 0 THEN (f.x - st.m) / st.s ELSE f.x - st.m END, 6) AS z
FROM features_long f JOIN st ON f.feature = st.feature""")
def standardize(spark, d):
    """Z-scores with population std (sklearn scaler)."""
    z = FE.standardize(R.features_long(spark, d))
    return z.select("vec_id", "feature", K.r6("z").alias("z"))


@query("selection_overlap", sql=f"""
WITH {EMB_SQL},
{Q.FEATURES_LONG.strip()},
binned AS (SELECT feature, label AS y, ntile(10) OVER (PARTITION BY feature ORDER BY x, vec_id) AS bin
           FROM features_long),
bn AS (SELECT feature, count(*) AS n FROM binned GROUP BY feature),
bc AS (SELECT feature, bin, y, count(*) AS c FROM binned GROUP BY feature, bin, y),
bpb AS (SELECT feature, bin, sum(c) AS cb FROM bc GROUP BY feature, bin),
bpy AS (SELECT feature, y, sum(c) AS cy FROM bc GROUP BY feature, y),
bmi AS (SELECT bc.feature, sum((bc.c / bn.n) * ln(bc.c * bn.n / (bpb.cb * bpy.cy))) AS mi
        FROM bc JOIN bpb ON bc.feature = bpb.feature AND bc.bin = bpb.bin
        JOIN bpy ON bc.feature = bpy.feature AND bc.y = bpy.y JOIN bn ON bc.feature = bn.feature
        GROUP BY bc.feature),
vr AS (SELECT feature, var_pop(x) AS v FROM features_long GROUP BY feature),
sel AS (
  SELECT 'anova' AS model, feature FROM numres WHERE feature LIKE 'f%' QUALIFY row_number() OVER (ORDER BY anova_f DESC, feature) <= 10
  UNION ALL SELECT 'binned_mi', feature FROM bmi QUALIFY row_number() OVER (ORDER BY mi DESC, feature) <= 10
  UNION ALL SELECT 'variance', feature FROM vr QUALIFY row_number() OVER (ORDER BY v DESC, feature) <= 10),
per AS (SELECT feature, string_agg(model, '|' ORDER BY model) AS models FROM sel GROUP BY feature)
SELECT models, CAST(count(*) AS BIGINT) AS n_features, string_agg(feature, ',' ORDER BY feature) AS features
FROM per GROUP BY models""")
def selection_overlap(spark, d):
    """Features chosen by several selectors (data behind an UpSet plot)."""
    _, num, _ = _assoc(spark, d, "emb")
    long = _mi_long(spark, d)
    a = A.rank(num.where(F.col("feature").startswith("f")), "anova_f", 10).select(
        F.lit("anova").alias("model"), "feature")
    b = MI.select_k(MI.mi_binned(long), 10).select(F.lit("binned_mi").alias("model"), "feature")
    v = long.groupBy("feature").agg(F.var_pop("x").alias("v"))
    c = MI.select_k(v, 10, "v").select(F.lit("variance").alias("model"), "feature")
    return FE.selection_overlap(a.unionByName(b).unionByName(c))
