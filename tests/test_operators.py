"""Edge cases and properties of the operators (hand-made fixtures, SURVEY §5)."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from horizonkit.functions import coerce as K
from horizonkit.functions import tails as TL
from horizonkit.operators import association as A
from horizonkit.operators import clean as CL
from horizonkit.operators import cohort as C
from horizonkit.operators import evaluation as EV
from horizonkit.operators import features as FE
from horizonkit.operators import hrv as H
from horizonkit.operators import ml as ML
from horizonkit.operators import mutual_info as MI
from horizonkit.operators import prefix as P
from horizonkit.operators import split as SP
from horizonkit.operators.quantiles import exact_percentile

D = dt.datetime


# ---------------------------------------------------------------- cohort
def test_null_safe_merge_fan_out_and_death_lookup(spark):
    study = spark.createDataFrame(
        [(1, "ana", D(2010, 1, 5, 9), 1), (2, None, D(2010, 2, 1), 0), (3, "bia", D(2012, 3, 3), 1),
         (4, "caio", D(2011, 1, 1), None)],
        "ID long, Name string, exam timestamp_ntz, Obito int")
    clin = spark.createDataFrame(
        [("ana", D(2010, 1, 5, 23, 59, 59), None, 1.0, 1, 1),        # same day, other time
         ("ana", D(2010, 1, 5), D(2013, 1, 4), 2.0, 1, 2),           # fan-out; first death date
         ("ana", D(2015, 1, 1), D(2014, 1, 1), 3.0, 2, 1),           # later visit, other date
         (None, D(2010, 2, 1), None, 4.0, 3, 1),                     # null name matches null name
         ("bia", D(2000, 1, 1), None, 5.0, 4, 1)],                   # death without date
        "Name string, visit timestamp_ntz, death timestamp_ntz, imc double, o1 int, o2 int")
    m = C.clinical_merge(study, clin, name_col="Name", study_date_col="exam", clinical_date_col="visit",
                         event_col="Obito", death_date_col="death", order_cols=["o1", "o2"],
                         clinical_cols=["imc"], lead=2)
    assert m.columns == ["ID", "Name", "Data_MSC", "Tempo", "imc", "exam", "Obito"]
    rows = {(r.ID, r.imc): r for r in m.collect()}
    assert len(rows) == 5                       # ana x2, null x1, bia x1, caio x1
    assert rows[(2, 4.0)].Name is None
    assert rows[(1, 1.0)].Data_MSC == D(2013, 1, 4)
    # floor((2013-01-04 - 2010-01-05 09:00) days) = 1094 -> 1094/365.25 = 2.995...
    assert rows[(1, 1.0)].Tempo == round(1094 / 365.25, 2)
    assert rows[(3, None)].Data_MSC is None
    rep = C.merge_report(m, "Obito").first()
    assert (rep.deaths, rep.dates_found, rep.missing) == (3, 2, 1)
    assert [r.Name for r in C.unresolved_names(m, "Name", "Obito").collect()] == ["bia"]


def test_horizon_labels_strict_and_nan(spark):
    df = spark.createDataFrame(
        [(1, 1, 2.99), (2, 1, 3.0), (3, 1, 3.01), (4, 1, -1.0), (5, 1, None), (6, 1, float("nan")),
         (7, 0, None), (8, None, 4.0), (9, 0, 1.0)], "id int, ev int, t double")
    lab = C.label_horizons(df, event_col="ev", time_col="t", horizons=(3,), keep_unlabelled=True)
    got = {r.id: r.Target for r in lab.collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1, 5: None, 6: None, 7: 0, 8: 0, 9: 0}
    st = C.horizon_stats(lab).first()
    assert (st.n, st.n_class0, st.n_class1, st.n_dropped) == (7, 5, 2, 2)


def test_study_filter_and_flag(spark):
    df = spark.createDataFrame([(1, 1, 4.99), (2, 1, 5.0), (3, 0, 7.0), (4, 1, 6.0), (5, None, 5.0),
                                (6, 1, None)], "ID int, ev int, t double")
    f = C.study_filter(df, "ev", "t")
    assert sorted(r.ID for r in f.collect()) == [1, 2, 3, 5]
    flags = {r.ID: r.e for r in f.select("ID", C.event_flag("ev", "t").alias("e")).collect()}
    assert flags == {1: 1, 2: 0, 3: 0, 5: 0}


def test_first_row_per_key_and_rejects(spark):
    pat = spark.createDataFrame([(7, 3, 1), (7, 1, 0), (8, 5, 1)], "pid long, ord int, ev int")
    ids = spark.createDataFrame([(7,), (9,)], "patient_id long")
    m, rej = C.lookup_first_match(ids, pat, "patient_id", "pid", ["ord"])
    assert [(r.patient_id, r.ord) for r in m.collect()] == [(7, 1)]
    assert [r.patient_id for r in rej.collect()] == [9]


# ---------------------------------------------------------------- cleaning
def test_coercions(spark):
    df = spark.createDataFrame([("27,5",), ("1.234,5",), ("abc",), (" ",), (None,), ("1d",), ("NaN",), ("2.5e1",)],
                               "s string")
    got = [r.v for r in df.select(K.decimal_comma("s").alias("v")).collect()]
    assert got == [27.5, None, None, None, None, None, None, 25.0]
    o = spark.createDataFrame([("I",), ("IV",), ("3",), ("V",), ("x",)], "s string")
    assert [r.v for r in o.select(K.ordinal("s").alias("v")).collect()] == [1, 4, 3, None, None]
    b = spark.createDataFrame([("M",), ("Feminino",), ("1",), ("X",)], "s string")
    assert [r.v for r in b.select(K.binary_recode("s").alias("v")).collect()] == [0.0, 1.0, 1.0, None]


def test_one_hot_levels_by_type(spark):
    df = spark.createDataFrame([(1, 3.0, 3), (2, 0.0, 0), (3, None, None), (4, float("nan"), 3)],
                               "id int, d double, i int")
    out = CL.one_hot(df, ["d", "i"])
    assert out.columns == ["id", "d_0.0", "d_3.0", "i_0", "i_3"]
    r = {x.id: x for x in out.collect()}
    assert (r[3]["d_0.0"], r[3]["d_3.0"], r[3]["i_0"], r[3]["i_3"]) == (0, 0, 0, 0)
    assert r[4]["d_3.0"] == 0 and r[4]["i_3"] == 1


def test_impute_median_even_count_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None)],
                               "a double, b double")
    out, kept = CL.impute_median(df, ["a", "b"])
    assert kept == ["a"] and out.columns == ["a"]
    assert [r.a for r in out.collect()] == [1.0, 2.0, 3.0, 10.0, 2.5]


def test_exact_percentile_narrowing_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.lognormal(size=3000), np.full(2000, 1.5)])   # a hot value
    rows = [("a", float(v)) for v in vals] + [("b", float(v)) for v in vals[:1001]]
    df = spark.createDataFrame(rows, "k string, x double")
    for p in (0.5, 0.2, 0.9):
        got = {r.k: r.q for r in exact_percentile(df, ["k"], "x", p, out="q").collect()}
        assert math.isclose(got["a"], float(np.percentile(vals, p * 100)), rel_tol=1e-12)
        assert math.isclose(got["b"], float(np.percentile(vals[:1001], p * 100)), rel_tol=1e-12)


def test_drop_guard(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 1.0, True, 1)], "ID int, Name string, Tempo double, f double, flag boolean, Target int")
    out, rep = CL.prepare_model_table(df, "Target", ["ID", "Name", "Target", "absent"])
    assert out.columns == ["f", "Target"]
    assert rep["leakage"] == ["Tempo"] and "flag" in rep["non_numeric"]
    with pytest.raises(ValueError):
        CL.require_column(out, "nope")


# ---------------------------------------------------------------- metrics
def test_one_class_confusion_and_weights(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 1)], "label int, pred int")
    c = EV.confusion(df).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (0, 2, 0, 1)
    w = SP.balanced_weights(spark.createDataFrame([(0,), (0,), (0,)], "y int"), "y")
    assert [r.weight for r in w.collect()] == [1.0, 1.0, 1.0]
    w2 = SP.balanced_weights(spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int"), "y")
    assert math.isclose(sum(r.weight for r in w2.collect()), 4.0)


def test_gmean_all_negative_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    m = EV.metrics_table(EV.confusion(df)).first()
    assert m.gmean_score == 0.0 and m.recall == 0.0


def test_threshold_sweep_matches_99_pass_loop_with_ties(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), round(rng.random(), 2)) for i in range(400)] + [(400, 1, 0.29), (401, 0, 0.29)]
    df = spark.createDataFrame(rows, "id int, label int, p double")
    sw = {r.i: r for r in EV.threshold_sweep(df).collect()}
    y = np.array([r[1] for r in rows]); p = np.array([r[2] for r in rows])
    best_t, best_s = 0.5, 0.0
    for i, t in enumerate(np.arange(0.01, 1.0, 0.01), start=1):
        pr = (p >= t).astype(int)
        tp = int(((pr == 1) & (y == 1)).sum()); fp = int(((pr == 1) & (y == 0)).sum())
        fn = int(((pr == 0) & (y == 1)).sum()); tn = int(((pr == 0) & (y == 0)).sum())
        assert (sw[i].tp, sw[i].fp, sw[i].fn, sw[i].tn) == (tp, fp, fn, tn)
        s = math.sqrt((tp / (tp + fn) if tp + fn else 0) * tn / (tn + fp + 1e-8))
        if s > best_s:
            best_s, best_t = s, t
    b = EV.best_threshold(EV.threshold_sweep(df)).first()
    assert b.best_threshold == best_t and math.isclose(b.best_score, best_s)


def test_auc_trapezoid_equals_rank_auc(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 1), round(rng.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label int, p double")
    auc = EV.auc_from_points(EV.roc_points(df, rows_per_bucket=2)).first().auc
    pos = [r[2] for r in rows if r[1] == 1]; neg = [r[2] for r in rows if r[1] == 0]
    mw = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(auc, mw, rel_tol=1e-12)


def test_report_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "label int, pred int")
    r = {x["class"]: x for x in EV.classification_report(df).collect()}
    assert r["1"].precision == 0.0 and r["1"].f1 == 0.0 and r["accuracy"].f1 == pytest.approx(2 / 3)


def test_remap_anomaly(spark):
    df = spark.createDataFrame([(1, -1), (0, 1)], "label int, pred int")
    assert [r.pred for r in CL.remap_anomaly(df, "pred").collect()] == [1, 0]
    df2 = spark.createDataFrame([(1, 1), (0, 0)], "label int, pred int")
    assert [r.pred for r in CL.remap_anomaly(df2, "pred").collect()] == [1, 0]


# ---------------------------------------------------------------- splits
def test_split_sizes_and_folds(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1000)], "id long, y int")
    s = SP.stratified_split(df, "id", "y")
    cnt = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    n1 = 143
    assert cnt[(1, "test")] == int(0.2 * n1 + 0.5) and cnt[(0, "test")] == int(0.2 * (1000 - n1) + 0.5)
    f = SP.stratified_folds(df, "id", "y").cache()
    assert f.select("id").distinct().count() == 1000
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2 and len(sizes) == 5


def test_bucketed_row_number_equals_window(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randint(0, 2), rng.random(), i) for i in range(2000)], "g int, x double, id int")
    b = df.withColumn("b", F.floor(F.col("x") * 16).cast("int"))
    got = {r.id: r.rn for r in P.bucketed_row_number(b, ["g"], [F.col("x"), F.col("id")], "b").collect()}
    w = Window.partitionBy("g").orderBy("x", "id")
    exp = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp


# ---------------------------------------------------------------- association
def test_chi2_yates_2x2_and_plain_2x3(spark):
    # 2x2 table [[10, 20], [30, 5]] -> scipy (Yates) chi2 = 17.2357...
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 5
    df = spark.createDataFrame(rows, "c string, y int")
    routes, _, cat = A.associate(df, "y")
    r = cat.first()
    o = np.array([[10, 20], [30, 5]]); e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    yates = (((np.abs(o - e) - 0.5) ** 2) / e).sum()
    assert r.dof == 1 and math.isclose(r.chi2, yates, rel_tol=1e-12)
    rows3 = [("a", 1)] * 10 + [("b", 0)] * 20 + [("c", 1)] * 5 + [("c", 0)] * 7      # zero cells
    cat3 = A.associate(spark.createDataFrame(rows3, "c string, y int"), "y")[2].first()
    o = np.array([[0, 10], [20, 0], [7, 5]]); e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert cat3.dof == 2 and math.isclose(cat3.chi2, (((o - e) ** 2) / e).sum(), rel_tol=1e-12)
    assert math.isclose(cat3.cramers_v, math.sqrt(cat3.chi2 / (42 * 1)), rel_tol=1e-12)


def test_numeric_f_equals_r_identity(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1) + y, y, float(i)) for i, y in ((i, rng.randint(0, 1)) for i in range(300))]
    df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "x double, y int, const_free double")
    routes, num, _ = A.associate(df.drop("const_free"), "y")
    r = num.first()
    assert math.isclose(r.anova_f, r.r ** 2 * (r.n - 2) / (1 - r.r ** 2), rel_tol=1e-9)


def test_router_skips_constant_and_routes_low_cardinality(spark):
    df = spark.createDataFrame([(1.0, i % 3, float(i), i % 2) for i in range(40)], "k double, c int, x double, y int")
    kinds = {r.feature: r.kind for r in A.associate(df, "y")[0].collect()}
    assert kinds == {"k": "skip", "c": "categorical", "x": "numeric"}


def test_tail_probabilities(spark):
    """Against closed forms: even degrees of freedom, one degree by the error function, an exact F."""
    even = lambda x, d: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))
    cases = [("c", x, 0.0, d, even(x, d)) for x in (0.01, 1.0, 5.991464547107979, 40.0, 300.0) for d in (2, 4, 10, 60)]
    cases += [("c", x, 0.0, 1, math.erfc(math.sqrt(x / 2))) for x in (1e-6, 0.3, 3.841458820694124, 25.0, 200.0)]
    # F with two degrees above: (1 + 2 f / d2) ** (-d2 / 2); with one and one: 1 - 2 / pi * atan(sqrt(f))
    cases += [("f", f, 2, d2, (1 + 2 * f / d2) ** (-d2 / 2)) for f in (1e-4, 0.7, 3.0, 50.0) for d2 in (1, 7, 498, 10 ** 6)]
    cases += [("f", f, 1, 1, 1 - 2 / math.pi * math.atan(math.sqrt(f))) for f in (0.2, 4.0, 900.0)]
    cases += [("f", 4.0, 1, 10 ** 9, math.erfc(math.sqrt(2.0))), ("c", 0.0, 0.0, 3, 1.0), ("c", 5.0, 0.0, 0, 1.0), ("f", math.inf, 1, 5, 0.0),
              ("f", 0.0, 1, 5, 1.0), ("f", 2.0, 0, 5, None), ("c", None, 0.0, 2, None), ("f", None, 1, 2, None)]
    df = spark.createDataFrame([(i, k, float(x) if x is not None else None, float(a), float(b)) for i, (k, x, a, b, _) in enumerate(cases)],
                               "i int, k string, x double, a double, b double")
    p = F.when(F.col("k") == "f", TL.f_tail(F.col("x"), F.col("a"), F.col("b"))).otherwise(TL.chi2_tail(F.col("x"), F.col("b")))
    got = {r["i"]: r["p"] for r in df.select("i", p.alias("p")).collect()}
    for i, (*_, want) in enumerate(cases):
        if want is None:
            assert got[i] is None
        else:
            assert math.isclose(got[i], want, rel_tol=1e-6, abs_tol=1e-300), cases[i]



@pytest.mark.parametrize("hot", [False, True])
def test_mi_knn_brute_force(spark, hot):
    rng = random.Random(4)
    rows = [(i, "f", round(rng.gauss(y, 1), 1), y) for i, y in ((i, rng.randint(0, 2)) for i in range(120))]
    if hot:   # one value held by a third of all rows, spread over the classes
        rows += [(1000 + i, "f", 0.5, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, feature string, x double, y int")
    got = MI.mi_knn(df).first().mi
    assert math.isclose(MI.mi_knn(df, rows_per_bucket=8, block_rows=7).first().mi, got, rel_tol=1e-9)  # many blocks, same result
    xs = np.array([r[2] for r in rows]); ys = np.array([r[3] for r in rows])
    from math import fsum
    def psi(n): return fsum(1.0 / k for k in range(1, n)) - 0.5772156649015329
    N = len(xs); acc_k = acc_n = acc_m = 0.0
    for i in range(N):
        same = np.sort(np.abs(xs[ys == ys[i]] - xs[i]))
        nc = len(same); k = min(3, nc - 1)
        r = same[k]                                   # same[0] is the point itself
        m = int(((xs > xs[i] - r) & (xs < xs[i] + r)).sum()) if r > 0 else int((xs == xs[i]).sum())
        acc_k += psi(k); acc_n += psi(nc); acc_m += psi(m)
    exp = max(0.0, psi(N) + acc_k / N - acc_n / N - acc_m / N)
    assert math.isclose(got, exp, rel_tol=1e-9, abs_tol=1e-12)


def test_wide_columns_are_proven_numeric(spark):
    """Ten occupied cells of a hash prove ten values; other columns are counted exactly."""
    rows = [(float(i), i % 9, float(i % 10), "ab"[i % 2], i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "wide double, nine int, ten double, text string, y int")
    long = A.to_long(df, "y", ["wide", "nine", "ten", "text"])
    numeric = {"wide": True, "nine": True, "ten": True, "text": False}
    found = A.proven_numeric(long)
    assert "wide" in {r.feature for r in found.collect()} and "nine" not in {r.feature for r in found.collect()}
    kinds = {r.feature: r.kind for r in A.kinds(long, numeric).collect()}
    assert kinds == {"wide": "numeric", "nine": "categorical", "ten": "numeric", "text": "categorical"}
    assert kinds == {r.feature: r.kind for r in A.associate(df, "y")[0].collect()}


def test_csv_types_are_inferred(spark, tmp_path):
    from horizonkit.sources import tables as TB
    (tmp_path / "t.csv").write_text("a,b,c,d,e,f\n1,1,1.5,True,x,NA\n2,NA,-2e3,false,3,\n3,4,inf,TRUE,NA,null\n")
    df = TB.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "double", "d": "boolean", "e": "string", "f": "double"}
    rows = sorted(df.collect(), key=lambda r: r.a)
    assert [r.b for r in rows] == [1.0, None, 4.0] and [r.d for r in rows] == [True, False, True]
    assert [r.c for r in rows] == [1.5, -2000.0, float("inf")] and [r.e for r in rows] == ["x", "3", None]
    (tmp_path / "none.csv").write_text("a,b\n")
    assert dict(TB.read_table(spark, str(tmp_path / "none.csv")).dtypes) == {"a": "string", "b": "string"}


def test_correlation_reducer_constant_column_kept(spark):
    rows = [(float(i), 2.0 * i + 1, 5.0, float((i * 7) % 11)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    out = {r.feature: r.kept for r in FE.correlation_reducer(df, ["a", "b", "c", "d"], 0.9).collect()}
    assert out == {"a": 1, "b": 0, "c": 1, "d": 1}


def test_bounded_kinds_is_the_router(spark):
    rows = [(i % 2, float(i % 10), i % 9, 3, -0.0 if i % 3 else 0.0, i, str(i), "one", None if i % 4 else "few") for i in range(400)]
    df = spark.createDataFrame(rows, "y int, ten double, nine int, same int, zeros double, wide int, text string, alone string, gaps string")
    names = df.columns[1:]
    long = A.to_long(df, "y", names)
    numeric = {c: c not in ("text", "alone", "gaps") for c in names}
    want = {r.feature: (r.n, r.n_unique <= 1, r.kind) for r in A.route(A.raw_cells(long), numeric).collect()}
    assert {r.feature: (r.n, r.constant, r.kind) for r in A.bounded_kinds(long).collect()} == want
    assert want["ten"][2] == "numeric" and want["nine"][2] == "categorical" and want["zeros"][1] and want["gaps"][0] == 100


# ---------------------------------------------------------------- HRV
def test_tumble_tail_dropped_and_one_window_std(spark):
    rows = [(1, i, float(i)) for i in range(10)] + [(2, i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, idx long, v double")
    t = H.tumble_index(df, "k", "idx", 4)
    assert sorted({(r.k, r.window_idx) for r in t.collect()}) == [(1, 0), (1, 1)]
    numbered = H.sample_index(df.withColumn("ts", F.timestamp_seconds("idx")), "k", "ts", "idx", chunk_seconds=3, total="n")
    assert {(r.k, r.n) for r in numbered.collect()} == {(1, 10), (2, 3)}
    got = H.tumble_index(numbered.drop("idx"), "k", "sample_idx", 4, total="n")
    assert sorted((r.k, r.sample_idx, r.window_idx) for r in got.collect()) == [(1, i, i // 4) for i in range(8)] and "n" not in got.columns
    feats = spark.createDataFrame([(1, 0, 800.0)], "k int, w int, MeanNN double")
    s = H.patient_stats(feats, "k", ["MeanNN"]).first()
    assert s.HRV_MeanNN == 800.0 and s.std_HRV_MeanNN is None


def test_poincare_identity_and_time_features(spark):
    rr = [800.0, 810.0, 790.0, 850.0, 820.0, 805.0, 795.0]
    df = spark.createDataFrame([(1, i + 1, float(i), v) for i, v in enumerate(rr)], "k int, beat int, t_s double, rr double")
    t = H.hrv_time(df, ["k"]).first()
    d = np.diff(rr)
    assert math.isclose(t.RMSSD, math.sqrt((d ** 2).mean()), rel_tol=1e-12)
    assert math.isclose(t.IQRNN, np.percentile(rr, 75) - np.percentile(rr, 25), rel_tol=1e-12)
    p = H.poincare(H.hrv_time(df, ["k"]), ["k"]).first()
    assert math.isclose(p.SD1 ** 2, t.SDSD ** 2 / 2, rel_tol=1e-12)


def test_lomb_scargle_peak_at_sine_frequency(spark):
    f0 = 0.1
    ts = np.cumsum(np.full(300, 0.8))
    rr = 800 + 50 * np.sin(2 * np.pi * f0 * ts)
    df = spark.createDataFrame([(1, float(t), float(v)) for t, v in zip(ts, rr)], "k int, t_s double, rr double")
    ps = H.lomb_scargle(df, ["k"], f_lo=0.02, f_hi=0.5, n_freq=49).orderBy(F.col("power").desc()).first()
    assert abs(ps.freq - f0) < 0.011


def test_sample_entropy_matches_brute_force(spark):
    rng = random.Random(9)
    x = [800 + rng.gauss(0, 30) for _ in range(80)]
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(x)], "k int, beat int, rr double")
    got = H.sample_entropy(df, ["k"]).first().SampEn
    r = 0.2 * np.std(x, ddof=1); n = len(x); m = 2
    B = A_ = 0
    for i in range(n - m):
        for j in range(i + 1, n - m):
            if all(abs(x[i + k] - x[j + k]) <= r for k in range(m)):
                B += 1
                if abs(x[i + m] - x[j + m]) <= r:
                    A_ += 1
    assert math.isclose(got, -math.log(A_ / B), rel_tol=1e-12)


def test_zero_denominators_give_null_not_errors(spark):
    """ANSI mode raises on x / 0; ratios with a zero denominator are NULL."""
    rr = spark.createDataFrame([(1, i + 1, float(i), 800.0) for i in range(6)], "k int, beat int, t_s double, rr double")
    t = H.hrv_time(rr, ["k"])
    p = H.poincare(t, ["k"]).first()
    assert p.SD1 == 0.0 and p.CSI is None
    only_pos = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.7)], "id int, label int, p double")
    pts = EV.roc_points(only_pos).collect()
    assert all(r.fpr is None for r in pts)
    assert EV.auc_from_points(EV.roc_points(only_pos)).first().auc is None
    mc = EV.model_comparison(only_pos.withColumn("Model", F.lit("m")).withColumn("pred", F.lit(1)))
    assert {r.Metric: r.Score for r in mc.collect()}["Specificity"] is None


def test_reducer_stage_and_custom_sweep_metric(spark):
    rows = [(float(i), 2.0 * i + 1, float((i * 7) % 11)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, d double")
    m = FE.CorrelationReducer(inputCols=["a", "b", "d"], threshold=0.9).fit(df)
    assert m.transform(df).columns == ["a", "d"]
    sc = spark.createDataFrame([(1, 1, 0.8), (2, 0, 0.2), (3, 1, 0.6)], "id int, label int, p double")
    acc = lambda: (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    best = EV.best_threshold(EV.threshold_sweep(sc, metric=acc)).first()
    assert best.best_score == 1.0 and 0.2 < best.best_threshold <= 0.6


def test_exact_percentile_extremes(spark):
    """Values over 120 orders of magnitude, infinities, a hot value, null keys: one path, no rounds."""
    rng = np.random.default_rng(1)
    a = [10.0 ** e for e in range(-60, 61)]
    b = [*rng.normal(size=9000), *([0.25] * 6000), math.inf, -math.inf]
    c = [-math.inf, math.inf, math.inf]
    rows = [(k, float(v)) for k, vs in (("a", a), ("b", b), ("c", c), (None, a[:7])) for v in vs] + [("a", None), ("a", math.nan), ("z", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    for p in (0.0, 0.0003, 0.2, 0.5, 0.9, 1.0):
        got = {r.k: r.q for r in exact_percentile(df, ["k"], "x", p, out="q").collect()}
        assert set(got) == {"a", "b", "c", None}
        assert got["a"] == float(np.percentile(a, 100 * p)) or math.isclose(got["a"], float(np.percentile(a, 100 * p)), rel_tol=1e-9)
        assert math.isclose(got[None], float(np.percentile(a[:7], 100 * p)), rel_tol=1e-9)
        if 0 < p < 1:
            assert math.isclose(got["b"], float(np.percentile(b, 100 * p)), rel_tol=1e-9)
    assert got["c"] == math.inf


def test_split_and_weights_without_class_cap(spark):
    df = spark.createDataFrame([(i, i % 1500) for i in range(6000)] + [(9000, None)], "id long, y long")
    s = SP.stratified_split(df, "id", "y", test_size=0.25)
    assert s.where("split = 'test'").groupBy("y").count().where("count = 1").count() == 1500
    assert s.where("id = 9000").first().split == "train"
    w = SP.balanced_weights(df, "y")
    assert {round(r.weight, 9) for r in w.where("y is not null").select("weight").distinct().collect()} == {1.0}
    a, b = (SP.stratified_folds(df, "id", "y", seed=x).orderBy("id").collect() for x in (1, 2))
    assert [r.fold for r in a] != [r.fold for r in b]
    levels = spark.createDataFrame([(str(i),) for i in range(300)], "c string")
    assert len(CL.one_hot(levels, ["c"]).columns) == 300


def test_signal_blank_lines_in_any_split(spark, tmp_path):
    from horizonkit.sources.signals import read_signal_dir
    lines = []
    for i in range(400):
        lines.append(str(i))
        if i % 3 == 0:
            lines += [""] * (i % 4)
    (tmp_path / "sinal7.txt").write_text("\n".join(["", *lines, "", ""]))
    whole = sorted(map(tuple, read_signal_dir(spark, str(tmp_path), mode="whole")[0].collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("40", "133", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted(map(tuple, read_signal_dir(spark, str(tmp_path))[0].collect()))
            assert got == whole and [r[1] for r in got] == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_class_and_missing_labels(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(20)], "x double, y int")
    _, num, _ = A.associate(df, "y")
    assert [r.anova_f for r in num.collect()] == [None]
    apart = spark.createDataFrame([(float(i % 2), i % 2, float(i)) for i in range(40)], "x double, y int, z double")
    f = A.numeric_tests(A.to_long(apart, "y", ["x"]), spark.createDataFrame([("x", "numeric")], "feature string, kind string"))
    assert [r.anova_f for r in f.collect()] == [math.inf]
    p = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.999)], "label int, p double")
    assert math.isclose(EV.log_loss(p).first().log_loss, -math.log(0.9), rel_tol=1e-12)


def test_study_prepare_repairs_text(spark):
    from horizonkit.operators.study import prepare
    rows = [(f"{i},5", "II" if i % 2 else "4", "M" if i % 3 else "Feminino", "a" if i % 2 else None, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "`AE diam.` string, NYHA string, Sex string, `Dist Cond InterVent` string, y int")
    data, feats = prepare(df, "y", [], [])
    assert feats[:3] == ["AE diam.", "NYHA", "Sex"] and any(c.startswith("Dist Cond InterVent_") for c in feats)
    got = {r["AE diam."]: (r["NYHA"], r["Sex"]) for r in data.collect()}
    assert got[1.5] == (2.0, 0.0) and got[0.5] == (4.0, 1.0)


def test_search_ranks_once_and_refits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 2), i % 3, *[float(v) for v in (i % 2 + rng.normal(size=1) * 0.3).tolist() + rng.normal(size=2).tolist()])
            for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label double, fold int, a double, b double, c double").cache()
    draws = [{"n_estimators": 3, "max_depth": 2, "k": 1}, {"n_estimators": 3, "max_depth": 2, "k": 3}]
    best, score, scores, model = ML.search(df, "RandomForest", ["a", "b", "c"], draws, n_folds=3)
    assert len(scores) == 2 and 0.8 < score <= 1 and best in draws
    assert "a" in model.stages[0].getOrDefault("selected") and "prediction" in model.transform(df).columns
    imp = ML.permutation_importance(ML.predicted_by(model), df.withColumn("label", F.col("label").cast("int")), ["a", "b"], repeats=4)
    got = {r.feature: r.importance for r in imp.collect()}
    assert got["a"] > 0.2 > abs(got["b"])
    copies = ML.permuted_copies(df, ["a", "b"], repeats=3).where("__f = 'a'").groupBy("__r")
    values = [sorted(r.v) for r in copies.agg(F.collect_list("a").alias("v")).collect()]
    assert all(v == sorted(r[3] for r in rows) for v in values)


def test_quantile_buckets_are_even_whatever_the_values(spark):
    """Heavy-tailed values: no bucket holds more than three times its share, and buckets keep the order."""
    from horizonkit.operators.prefix import with_quantile_bucket
    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in rng.pareto(0.4, 20_000)] + [("b", float(v)) for v in rng.normal(size=3_000)]
    rows += [("b", None), (None, 1.0), (None, 2.0), ("c", None)]
    got = with_quantile_bucket(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", rows_per_bucket=500).collect()
    assert len(got) == len(rows)
    for k, share in (("a", 20_000 / 41), ("b", 3_000 / 41)):
        own = sorted((r["x"], r["__vb"]) for r in got if r["k"] == k and r["x"] is not None)
        assert [b for _, b in own] == sorted(b for _, b in own)
        sizes = np.bincount([b for _, b in own])
        assert len(sizes) == 41 and sizes.max() <= 3 * share
    assert [r["__vb"] for r in got if r["x"] is None] == [0, 0]


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_binned_information_with_a_hot_value(spark, rows_per_bucket):
    """A value held by a third of the rows lies over several bins; its rows are dealt by their ids."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random(907) < 0.34, 0.5, rng.pareto(0.7, 907))
    y = ((x > 0.7) ^ (rng.random(907) < 0.2)).astype(int)
    df = spark.createDataFrame([(i, "f", float(x[i]), int(y[i])) for i in range(907)] + [(i, "g", 1.0 * (i % 2), i % 2) for i in range(7)],
                               "id long, feature string, x double, y int")

    def plain(x, y):
        n = len(x)
        order = np.lexsort((np.arange(n), x))
        sizes = [n // 10 + (i < n % 10) for i in range(10)]
        b = np.empty(n, int)
        b[order] = np.repeat(np.arange(10), sizes)
        return sum(c / n * math.log(c * n / ((b == i).sum() * (y == j).sum())) for i in range(10) for j in (0, 1)
                   if (c := ((b == i) & (y == j)).sum()))

    got = {r["feature"]: r["mi"] for r in MI.mi_binned(df, rows_per_bucket=rows_per_bucket).collect()}
    assert math.isclose(got["f"], plain(x, y), rel_tol=1e-9)
    assert math.isclose(got["g"], plain(np.arange(7) % 2, np.arange(7) % 2), rel_tol=1e-9)


def test_percentile_and_ranks_in_many_buckets(spark):
    from horizonkit.operators.quantiles import exact_percentile
    rng = np.random.default_rng(5)
    x = rng.pareto(0.5, 1001)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [(None, float(v)) for v in x[:10]] + [("a", None)], "k string, x double")
    got = {r["k"]: r["percentile"] for r in exact_percentile(df, ["k"], "x", 0.3, rows_per_bucket=50).collect()}
    assert math.isclose(got["a"], np.percentile(x, 30), rel_tol=1e-12) and math.isclose(got[None], np.percentile(x[:10], 30), rel_tol=1e-12)
    rows = spark.createDataFrame([(i, i % 3) for i in range(600)], "id long, label int")
    one, many = (sorted(map(tuple, SP.class_rank(rows, "id", "label", rows_per_bucket=n).collect())) for n in (1_000_000, 10))
    assert one == many


@pytest.mark.parametrize("null_safe", [True, False])
def test_skew_safe_join(spark, null_safe):
    """A third of the names null, a hot name on each side, one on both: the same rows as a plain join, dealt to many tasks."""
    rng = random.Random(11)
    left = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"n{i % 40}") for i in range(900)]
    right = [(100 + i, rng.choice([None, "hot", "busy", "n1", "n2", "n77"])) for i in range(260)] + [(7, "n5"), (7, "n5")]
    a, b = spark.createDataFrame(left, "id long, name string"), spark.createDataFrame(right, "v long, name string")
    got = C.skew_safe_left_join(a, b, ["name"], null_safe, hot_rows=25)
    assert got.columns == ["id", "name", "v"]
    want = []
    for i, name in left:
        hits = [v for v, n in right if n == name and (null_safe or name is not None)]
        want += [(i, name, v) for v in hits] or [(i, name, None)]
    key = lambda r: (r[0], r[1] or "", -1 if r[2] is None else r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    hot = C.hot_keys(a, ["name"], 25)
    assert {k for k, _ in hot} == {None, "hot"} and all(t == 12 for _, t in hot)


def test_no_task_of_the_join_holds_a_hot_key(spark):
    """Rows of the join per task: none above three times its share, where a plain join puts a third of them into one."""
    a = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("name"))
    b = spark.range(60).select(F.when(F.col("id") > 2, F.col("id")).alias("name"), F.col("id").alias("v"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in (("spark.sql.shuffle.partitions", "16"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
            spark.conf.set(k, v)
        sizes = {}
        for name, got in (("dealt", C.skew_safe_left_join(a, b, ["name"], True, hot_rows=200)), ("plain", C.null_safe_left_join(a, b, ["name"]))):
            rows = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
            sizes[name] = [r["count"] for r in rows]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes["dealt"]) == sum(sizes["plain"]) == 20_000 + 3 * 10_000
    assert max(sizes["dealt"]) <= 3 * 50_000 / 16 < max(sizes["plain"])


@pytest.mark.parametrize("n", [1, 2, 12, 97, 360])
def test_multipliers_make_permutations(n):
    for a, b in ML.multipliers(n, 10):
        assert sorted((a * i + b) % n for i in range(n)) == list(range(n))
    assert n < 90 or len({m for m in ML.multipliers(n, 10)}) == 10


def test_block_correlation(spark):
    """Blocks that don't divide the columns, several passes, a constant column and one with a null."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 11)) + 1000
    x[:, 4] = 0.6 * x[:, 1] + 0.1 * rng.normal(size=70)
    x[:, 7] = 3.0
    x[:, 10] = -x[:, 9]
    rows = [[float(v) for v in r] for r in x]
    rows[5][2] = None
    cols = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    assert [len(p) for p in FE.block_pairs(11, 3, 27)] == [3, 3, 3, 1]
    r = np.abs(np.corrcoef(x.T))
    good = [i for i in range(11) if i not in (2, 7)]
    for block, held in ((256, 1 << 23), (3, 27)):
        got = FE.strongest_earlier(df, cols, block, held)
        assert set(got) == {j for j in good if j}
        assert all(math.isclose(got[j], max(r[i, j] for i in good if i < j), rel_tol=1e-9) for j in got)
    kept = {v["feature"]: v["kept"] for v in FE.correlation_reducer(df, cols).collect()}
    assert [c for c in cols if not kept[c]] == ["c4", "c10"]


def test_auc_of_classes_whose_product_passes_an_int(spark):
    df = spark.range(100_000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 97 / 97).alias("p"))
    auc = EV.auc_from_points(EV.roc_points(df)).first().auc
    assert 0.49 < auc < 0.51


def test_each_repeat_has_a_shuffle_of_its_own(spark):
    """Ranks by the repeat's own hash; no repeat is a stride through the order of another."""
    import hashlib
    ids = [7 * i + 3 for i in range(60)]
    order = lambda s: sorted(ids, key=lambda i: (int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:8], 16), i))
    df = spark.createDataFrame([(i, 100 + i) for i in ids], "id long, a int").repartition(3)
    got = {(r["__r"], r.id): r.a - 100 for r in ML.permuted_copies(df, ["a"], repeats=4).collect()}
    own = order(42 + 10_007)
    assert got == {(r, i): s for r in range(4) for i, s in zip(own, order(42 + r), strict=True)}


def test_signals_of_many_patients_take_few_folders_and_one_reading(spark, tmp_path):
    from horizonkit.sources import signals as SG
    rows = [(p, i, p + i / 8) for p in range(600) for i in range(1 + p % 3)]
    path = str(tmp_path / "signals")
    SG.write_signal_dir(spark.createDataFrame(rows, "user_id long, sample_idx long, value double").repartition(3), path, "user_id", "sample_idx", "value")
    folders = [x for x in (tmp_path / "signals").iterdir() if x.is_dir()]
    assert len(folders) <= SG.GROUPS       # a listing has a task for each
    tasks = {x.name.split("-")[1] for x in (tmp_path / "signals").rglob("part-*.txt")}
    assert len(tasks) == 8                 # a shuffle's partitions, few as the bytes are
    samples, rejects = SG.read_signal_dir(spark, path, r"user_id=(\d+)/", on="path", recursive=True)
    assert sorted(map(tuple, samples.collect())) == rows and rejects.count() == 0
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan        # the counts and the numbering come from one scan of the files


def test_horizons_are_written_with_open_files_not_sorted(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from horizonkit.sources import sinks as SK
    name, seen, save = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.save
    before = spark.conf.get(name)

    def noted(self, *a, **k):
        seen.append(int(spark.conf.get(name)))
        return save(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "save", noted)
    rows = [(i, h, (i + (h or 0)) % 2) for i in range(50) for h in (3, 5, 7, None)]
    df = spark.createDataFrame(rows, "id long, horizon int, target int").repartition(2)
    for fmt in ("parquet", "csv"):
        SK.write_horizons(df, str(tmp_path / fmt), fmt=fmt)
    assert seen == [SK.OPEN_HORIZONS] * 2 and spark.conf.get(name) == before
    back = spark.read.parquet(str(tmp_path / "parquet")).select("id", "horizon", "target").collect()
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted(map(tuple, back), key=key) == sorted(rows, key=key)
    text = spark.read.option("header", True).csv(str(tmp_path / "csv" / "horizon=5"))
    assert sorted((int(r.id), int(r.target)) for r in text.collect()) == [(i, (i + 5) % 2) for i in range(50)]
