"""Queries: signal windows and HRV features on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from horizonkit.functions import coerce as K
from horizonkit.operators import hrv as H
from horizonkit.plans import roles as R
from horizonkit.plans.registry import query
from horizonkit.session import cut_lineage

W_SAMPLES = 16              # samples per window on the events fixture
W_SECONDS = 259_200         # 3 days: <= 10 windows per user over 30 days
T_SCALE = 1 / 30000         # hours between events -> ~1 s between beats
TS_SQL = repr(T_SCALE)


def _indexed(spark, d):
    s = R.signal(spark, d)
    return H.tumble_index(H.sample_index(s, "user_id", "ts", "event_id", total="n"), "user_id", "sample_idx", W_SAMPLES, total="n")


_IDX_SQL = f"""
WITH ix AS (SELECT user_id, event_id, ts, value,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
                   count(*) OVER (PARTITION BY user_id) AS n FROM events),
win AS (SELECT user_id, event_id, ts, value, sample_idx,
               CAST(floor(sample_idx / {W_SAMPLES}) AS BIGINT) AS window_idx FROM ix
        WHERE floor(sample_idx / {W_SAMPLES}) < floor(n / {W_SAMPLES}))"""


@query("tumble_index", sql=_IDX_SQL + "\nSELECT user_id, event_id, sample_idx, window_idx FROM win")
def tumble_index(spark, d):
    """G1: windows of 16 samples from sample 0; incomplete tail dropped."""
    return _indexed(spark, d).select("user_id", "event_id", "sample_idx", "window_idx")


W_LONG = 864_000            # 10 days: <= 3 windows per user for the spectral / non-linear features


def _time_cte(seconds: int, name: str = "twin") -> str:
    us = float(seconds) * 1e6
    return f"""
WITH sp AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY user_id),
tw AS (SELECT e.user_id, e.event_id, e.ts,
              CAST(floor((epoch_us(e.ts) - epoch_us(sp.t0)) / {us}) AS BIGINT) AS window_idx,
              floor((epoch_us(sp.t1) - epoch_us(sp.t0)) / {us}) AS full_n
       FROM events e JOIN sp ON e.user_id = sp.user_id),
{name} AS (SELECT user_id, event_id, ts, window_idx FROM tw WHERE window_idx < full_n)"""


_TIME_SQL = _time_cte(W_SECONDS)
_LONG_SQL = _time_cte(W_LONG)


@query("tumble_time", sql=_TIME_SQL + "\nSELECT user_id, event_id, window_idx FROM twin")
def tumble_time(spark, d):
    """G1 (time variant): 3-day windows from each user's first event."""
    return H.tumble_time(R.signal(spark, d), "user_id", "ts", W_SECONDS).select("user_id", "event_id", "window_idx")


_CLEAN_SQL = _IDX_SQL + """,
cl AS (SELECT *, avg(value) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx
                                  ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
                - avg(value) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx
                                  ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS clean FROM win)"""


def _cleaned(spark, d):
    return H.clean_signal(_indexed(spark, d), ["user_id", "window_idx"], "sample_idx", "value", a=1, b=3)


@query("signal_clean", sql=_CLEAN_SQL + "\nSELECT user_id, event_id, round(clean, 6) AS clean FROM cl")
def signal_clean(spark, d):
    """Difference of two centred moving averages inside each window."""
    return _cleaned(spark, d).select("user_id", "event_id", K.r6("clean").alias("clean"))


@query("peak_detect", sql=_CLEAN_SQL + """,
d1 AS (SELECT *, clean - lag(clean) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx) AS d FROM cl),
en AS (SELECT *, avg(d * d) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx
                                  ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS e FROM d1),
th AS (SELECT *, 1.0 * avg(e) OVER (PARTITION BY user_id, window_idx) AS thr,
              max(e) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx
                           RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mx,
              max(e) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx
                           RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mxl FROM en)
SELECT user_id, window_idx, sample_idx FROM th
WHERE e > thr AND e = mx AND (mxl IS NULL OR mxl < e)""")
def peak_detect(spark, d):
    """Energy peaks above 1.0 x window mean, refractory 3 samples."""
    p = H.detect_peaks(_cleaned(spark, d), ["user_id", "window_idx"], "sample_idx", c=2, k=1.0, refractory=3)
    return p.select("user_id", "window_idx", "sample_idx")


def _rr_windows(spark, d):
    tw = H.tumble_time(R.signal(spark, d), "user_id", "ts", W_SECONDS)
    return H.rr_intervals(tw, ["user_id", "window_idx"], "ts", T_SCALE)


def _rr_long(spark, d):
    """RR per (user, 10-day window): every ordered step stays inside a window."""
    tw = H.tumble_time(R.signal(spark, d), "user_id", "ts", W_LONG)
    return H.rr_intervals(tw, ["user_id", "window_idx"], "ts", T_SCALE)


def _rr_sql(keys: str, src: str) -> str:
    return f"""
rr0 AS (SELECT {keys}, ts,
               row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS beat,
               (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY {keys}))) / 1e6 * {TS_SQL} AS t_s,
               ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {keys} ORDER BY ts))) / 1000.0) * {TS_SQL} AS rr
        FROM {src}),
rr AS (SELECT {keys}, beat, t_s, rr FROM rr0 WHERE rr IS NOT NULL)"""


def _time_sql(keys: str) -> str:
    return f"""
dd AS (SELECT *, rr - lag(rr) OVER (PARTITION BY {keys} ORDER BY beat) AS d FROM rr),
base AS (SELECT {keys}, avg(rr) AS MeanNN, stddev_samp(rr) AS SDNN, sqrt(avg(d * d)) AS RMSSD,
                stddev_samp(d) AS SDSD, quantile_cont(rr, 0.5) AS MedianNN,
                quantile_cont(rr, 0.25) AS p25, quantile_cont(rr, 0.75) AS p75,
                quantile_cont(rr, 0.2) AS Prc20NN, quantile_cont(rr, 0.8) AS Prc80NN,
                sum(CASE WHEN abs(d) > 50 THEN 1 ELSE 0 END) * 100.0 / count(rr) AS pNN50,
                sum(CASE WHEN abs(d) > 20 THEN 1 ELSE 0 END) * 100.0 / count(rr) AS pNN20, min(rr) AS MinNN, max(rr) AS MaxNN
         FROM dd GROUP BY {keys}),
mad AS (SELECT {", ".join("r." + k.strip() for k in keys.split(","))},
               1.4826 * quantile_cont(abs(r.rr - b.MedianNN), 0.5) AS MadNN
        FROM rr r JOIN base b USING ({keys}) GROUP BY {", ".join("r." + k.strip() for k in keys.split(","))}),
tf AS (SELECT b.*, m.MadNN, SDNN / MeanNN AS CVNN, RMSSD / MeanNN AS CVSD, m.MadNN / MedianNN AS MCVNN,
              p75 - p25 AS IQRNN FROM base b JOIN mad m USING ({keys}))"""


_TF_COLS = ", ".join(f"round({f}, 4) AS {f}" for f in H.TIME_FEATURES)


@query("hrv_time", sql=_TIME_SQL + ","
       + _rr_sql("user_id, window_idx", "twin") + "," + _time_sql("user_id, window_idx")
       + f"\nSELECT user_id, window_idx, {_TF_COLS} FROM tf")
def hrv_time(spark, d):
    """Time-domain HRV per (user, 3-day window)."""
    t = H.hrv_time(_rr_windows(spark, d), ["user_id", "window_idx"])
    return t.select("user_id", "window_idx", *[K.r6(f, 4).alias(f) for f in H.TIME_FEATURES])


_PS_COLS = ", ".join(
    [f"round(avg({f}), 4) AS HRV_{f}" for f in H.TIME_FEATURES]
    + [f"round(stddev_samp({f}), 4) AS std_HRV_{f}" for f in H.TIME_FEATURES])


@query("hrv_patient_stats", sql=_TIME_SQL + ","
       + _rr_sql("user_id, window_idx", "twin") + "," + _time_sql("user_id, window_idx")
       + f"\nSELECT user_id, CAST(count(*) AS BIGINT) AS n_windows, {_PS_COLS} FROM tf GROUP BY user_id")
def hrv_patient_stats(spark, d):
    """Per-user mean and sample std over windows, std_ prefix."""
    t = H.hrv_time(_rr_windows(spark, d), ["user_id", "window_idx"])
    s = H.patient_stats(t, "user_id", H.TIME_FEATURES)
    return s.select("user_id", "n_windows", *[K.r6(c, 4).alias(c) for c in s.columns if c not in ("user_id", "n_windows")])


_N_FREQ = 64
_F_LO, _F_HI = 0.0033, 0.5
_STEP = (_F_HI - _F_LO) / (_N_FREQ - 1)
_BAND_SQL = ",\n".join(
    f"sum(CASE WHEN freq >= {lo} AND (freq < {hi}{' OR freq <= ' + str(hi) if n == 'VHF' else ''}) "
    f"THEN power * {_STEP!r} ELSE 0 END) AS {n}" for n, (lo, hi) in H.BANDS.items())


_K = "user_id, window_idx"
_RRL = _LONG_SQL + "," + _rr_sql(_K, "twin")


_FREQ_CTES = f"""
x AS (SELECT user_id, window_idx, rr, (({_F_LO} + j * {_STEP!r}) * {2 * 3.141592653589793!r}) * t_s AS wt, j
      FROM rr, range(0, {_N_FREQ}) g(j)),
s AS (SELECT user_id, window_idx, j, count(*) AS n, avg(rr) AS m,
             sum(rr * cos(wt)) AS rc, sum(cos(wt)) AS c1, sum(rr * sin(wt)) AS rs, sum(sin(wt)) AS s1,
             sum(cos(2 * wt)) AS c2, sum(sin(2 * wt)) AS s2 FROM x GROUP BY user_id, window_idx, j),
t AS (SELECT user_id, window_idx, j, n, rc - m * c1 AS c, rs - m * s1 AS sn, c2, s2, atan2(s2, c2) AS tw FROM s),
u AS (SELECT user_id, window_idx, j, (n + c2 * cos(tw) + s2 * sin(tw)) / 2 AS cc,
             n - (n + c2 * cos(tw) + s2 * sin(tw)) / 2 AS ss,
             c * cos(tw / 2) + sn * sin(tw / 2) AS ct, sn * cos(tw / 2) - c * sin(tw / 2) AS st FROM t),
ps AS (SELECT user_id, window_idx, {_F_LO} + j * {_STEP!r} AS freq,
              0.5 * (CASE WHEN cc > 0 THEN ct * ct / cc ELSE 0 END + CASE WHEN ss > 0 THEN st * st / ss ELSE 0 END)
                AS power FROM u),
b AS (SELECT user_id, window_idx, {_BAND_SQL} FROM ps GROUP BY user_id, window_idx)"""


@query("hrv_frequency", sql=_RRL + "," + _FREQ_CTES + """
SELECT user_id, window_idx, round(VLF, 3) AS VLF, round(LF, 3) AS LF, round(HF, 3) AS HF, round(VHF, 3) AS VHF,
       round(VLF + LF + HF + VHF, 3) AS TP, round(LF / HF, 6) AS LFHF,
       round(LF / (VLF + LF + HF + VHF), 6) AS LFn, round(HF / (VLF + LF + HF + VHF), 6) AS HFn,
       round(CASE WHEN HF > 0 THEN ln(HF) END, 6) AS LnHF FROM b""")
def hrv_frequency(spark, d):
    """Lomb-Scargle band powers per (user, 10-day window)."""
    f = H.hrv_frequency(_rr_long(spark, d), ["user_id", "window_idx"], f_lo=_F_LO, f_hi=_F_HI, n_freq=_N_FREQ)
    return f.select("user_id", "window_idx", *[K.r6(F.round(c, 3), 6).alias(c) for c in ("VLF", "LF", "HF", "VHF", "TP")],
                    *[K.r6(c).alias(c) for c in ("LFHF", "LFn", "HFn", "LnHF")])


@query("hrv_nonlinear", sql=_RRL + "," + _time_sql(_K) + """,
pc AS (SELECT user_id, window_idx, SDSD / sqrt(2) AS SD1,
              CASE WHEN 2 * SDNN * SDNN - (SDSD / sqrt(2)) * (SDSD / sqrt(2)) >= 0
                   THEN sqrt(2 * SDNN * SDNN - (SDSD / sqrt(2)) * (SDSD / sqrt(2))) END AS SD2 FROM tf)
SELECT user_id, window_idx, round(SD1, 6) AS SD1, round(SD2, 6) AS SD2, round(SD1 / SD2, 6) AS SD1SD2,
       round(pi() * SD1 * SD2, 6) AS S, round(SD2 / SD1, 6) AS CSI,
       round(CASE WHEN SD1 * SD2 > 0 THEN log10(16 * SD1 * SD2) END, 6) AS CVI FROM pc""")
def hrv_nonlinear(spark, d):
    """Poincaré descriptors per (user, 10-day window)."""
    keys = ["user_id", "window_idx"]
    p = H.poincare(H.hrv_time(_rr_long(spark, d), keys), keys)
    return p.select(*keys, *[K.r6(c).alias(c) for c in H.POINCARE_FEATURES])


@query("sample_entropy", sql=_RRL + """,
tp AS (SELECT user_id, window_idx, beat, rr AS x0,
              lead(rr, 1) OVER (PARTITION BY user_id, window_idx ORDER BY beat) AS x1,
              lead(rr, 2) OVER (PARTITION BY user_id, window_idx ORDER BY beat) AS x2 FROM rr),
sd AS (SELECT user_id, window_idx, 0.2 * stddev_samp(rr) AS r FROM rr GROUP BY user_id, window_idx),
t2 AS (SELECT tp.*, sd.r FROM tp JOIN sd USING (user_id, window_idx) WHERE x2 IS NOT NULL),
pr AS (SELECT a.user_id, a.window_idx,
              count_if(abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r) AS B,
              count_if(abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r AND abs(a.x2 - b.x2) <= a.r) AS A
       FROM t2 a JOIN t2 b ON a.user_id = b.user_id AND a.window_idx = b.window_idx AND b.beat > a.beat
       GROUP BY a.user_id, a.window_idx)
SELECT sd.user_id, sd.window_idx, round(CASE WHEN pr.A > 0 AND pr.B > 0 THEN -ln(pr.A / pr.B) END, 6) AS SampEn
FROM sd LEFT JOIN pr USING (user_id, window_idx)""")
def sample_entropy(spark, d):
    """Sample entropy (m = 2, r = 0.2 SDNN) per window via a grid candidate join."""
    keys = ["user_id", "window_idx"]
    return H.sample_entropy(_rr_long(spark, d), keys).select(*keys, K.r6("SampEn").alias("SampEn"))


@query("dfa_alpha1", sql=_RRL + """,
y0 AS (SELECT *, rr - avg(rr) OVER (PARTITION BY user_id, window_idx) AS dev,
              count(*) OVER (PARTITION BY user_id, window_idx) AS n FROM rr),
y AS (SELECT *, sum(dev) OVER (PARTITION BY user_id, window_idx ORDER BY beat ROWS UNBOUNDED PRECEDING) AS yk,
             row_number() OVER (PARTITION BY user_id, window_idx ORDER BY beat) AS k FROM y0),
bx AS (SELECT user_id, window_idx, s, floor((k - 1) / s) AS box, yk, CAST(k AS DOUBLE) AS kd
       FROM y, range(4, 17) t(s) WHERE floor((k - 1) / s) < floor(n / s)),
ss0 AS (SELECT user_id, window_idx, s, box, regr_syy(yk, kd) AS syy, regr_syy(yk, kd) - CASE WHEN regr_sxx(yk, kd) > 0
                   THEN power(regr_sxy(yk, kd), 2) / regr_sxx(yk, kd) ELSE 0 END AS ss
       FROM bx GROUP BY user_id, window_idx, s, box),
ss AS (SELECT user_id, window_idx, s, box, CASE WHEN ss > 1e-9 * syy THEN ss ELSE 0 END AS ss FROM ss0),
fs AS (SELECT user_id, window_idx, s, sqrt(sum(ss) / (s * count(*))) AS fs FROM ss GROUP BY user_id, window_idx, s)
SELECT user_id, window_idx, round(regr_slope(ln(fs), ln(CAST(s AS DOUBLE))), 4) AS DFA_alpha1
FROM fs WHERE fs > 0 GROUP BY user_id, window_idx""")
def dfa_alpha1(spark, d):
    """DFA short-term exponent (box sizes 4..16) per window."""
    keys = ["user_id", "window_idx"]
    a = H.dfa_alpha1(_rr_long(spark, d), keys)
    return a.select(*keys, K.r6(F.round("DFA_alpha1", 4)).alias("DFA_alpha1"))


_FAM_COLS = ", ".join([f"round(t.{f}, 4) AS {f}" for f in H.TIME_FEATURES]
                      + [f"round(fq.{c}, 3) AS {c}" for c in ("VLF", "LF", "HF", "VHF", "TP")]
                      + [f"round(fq.{c}, 6) AS {c}" for c in ("LFHF", "LFn", "HFn", "LnHF")]
                      + [f"round(p.{c}, 6) AS {c}" for c in H.POINCARE_FEATURES])


def _families(spark, d):
    keys = ["user_id", "window_idx"]
    rr = _rr_long(spark, d)
    t = H.hrv_time(rr, keys)
    fq = H.hrv_frequency(rr, keys, f_lo=_F_LO, f_hi=_F_HI, n_freq=_N_FREQ)
    p = H.poincare(t, keys)
    return H.assemble_families(keys, t, fq, p)


@query("hrv_window_features", sql=_RRL + "," + _time_sql(_K) + "," + _FREQ_CTES + """,
pc AS (SELECT user_id, window_idx, SDSD / sqrt(2) AS SD1,
              CASE WHEN 2 * SDNN * SDNN - (SDSD / sqrt(2)) * (SDSD / sqrt(2)) >= 0
                   THEN sqrt(2 * SDNN * SDNN - (SDSD / sqrt(2)) * (SDSD / sqrt(2))) END AS SD2 FROM tf),
p AS (SELECT user_id, window_idx, SD1, SD2, SD1 / SD2 AS SD1SD2, pi() * SD1 * SD2 AS S, SD2 / SD1 AS CSI,
             CASE WHEN SD1 * SD2 > 0 THEN log10(16 * SD1 * SD2) END AS CVI FROM pc),
fq AS (SELECT user_id, window_idx, VLF, LF, HF, VHF, VLF + LF + HF + VHF AS TP, LF / HF AS LFHF,
              LF / (VLF + LF + HF + VHF) AS LFn, HF / (VLF + LF + HF + VHF) AS HFn,
              CASE WHEN HF > 0 THEN ln(HF) END AS LnHF FROM b)
SELECT user_id, window_idx, """ + _FAM_COLS + """
FROM tf t FULL OUTER JOIN fq USING (user_id, window_idx) FULL OUTER JOIN p USING (user_id, window_idx)""")
def hrv_window_features(spark, d):
    """Time, frequency and Poincaré families side by side per window."""
    f = _families(spark, d)
    cols = ([K.r6(c, 4).alias(c) for c in H.TIME_FEATURES]
            + [K.r6(F.round(c, 3), 6).alias(c) for c in ("VLF", "LF", "HF", "VHF", "TP")]
            + [K.r6(c).alias(c) for c in ("LFHF", "LFn", "HFn", "LnHF")]
            + [K.r6(c).alias(c) for c in H.POINCARE_FEATURES])
    return f.select("user_id", "window_idx", *cols)


@query("hrv_rejects", sql=_LONG_SQL + "," + _rr_sql(_K, "twin") + """
SELECT DISTINCT user_id FROM events
WHERE user_id NOT IN (SELECT user_id FROM rr)""")
def hrv_rejects(spark, d):
    """Users without any RR interval in a complete 10-day window."""
    return H.feature_rejects(R.signal(spark, d), _rr_long(spark, d), "user_id")


# the feature job end to end, from samples to a labelled patient row
_W_JOB, _JOB_COLS = 32, [*H.TIME_FEATURES, "VLF", "LF", "HF", "VHF", "TP", *H.POINCARE_FEATURES, "SampEn", "DFA_alpha1"]
_JOB_SQL = _CLEAN_SQL.replace(f"/ {W_SAMPLES})", f"/ {_W_JOB})") + """,
d1 AS (SELECT *, clean - lag(clean) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx) AS d FROM cl),
en AS (SELECT *, avg(d * d) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx
                                  ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM d1),
th AS (SELECT *, 0.3 * avg(e) OVER (PARTITION BY user_id, window_idx) AS thr,
              max(e) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx
                           RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mx,
              max(e) OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx
                           RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS mxl FROM en),
pk AS (SELECT user_id, window_idx, sample_idx, row_number() OVER (PARTITION BY user_id, window_idx ORDER BY sample_idx) AS beat
       FROM th WHERE user_id % 11 <> 0 AND e > thr AND e = mx AND (mxl IS NULL OR mxl < e)),
rr0 AS (SELECT user_id, window_idx, beat, sample_idx / 1.0 AS t_s,
               (sample_idx - lag(sample_idx) OVER (PARTITION BY user_id, window_idx ORDER BY beat)) / 1.0 * 1000.0 AS rr FROM pk),
rr AS (SELECT * FROM rr0 WHERE rr IS NOT NULL),""" + _time_sql(_K) + "," + _FREQ_CTES + """,
pc AS (SELECT user_id, window_idx, SDSD / sqrt(2) AS SD1,
              CASE WHEN 2 * SDNN * SDNN - (SDSD / sqrt(2)) * (SDSD / sqrt(2)) >= 0
                   THEN sqrt(2 * SDNN * SDNN - (SDSD / sqrt(2)) * (SDSD / sqrt(2))) END AS SD2 FROM tf),
p AS (SELECT user_id, window_idx, SD1, SD2, CASE WHEN SD2 <> 0 THEN SD1 / SD2 END AS SD1SD2, pi() * SD1 * SD2 AS S,
             CASE WHEN SD1 <> 0 THEN SD2 / SD1 END AS CSI,
             CASE WHEN SD1 * SD2 > 0 THEN log10(16 * SD1 * SD2) END AS CVI FROM pc),
fq AS (SELECT user_id, window_idx, VLF, LF, HF, VHF, VLF + LF + HF + VHF AS TP FROM b),
tp AS (SELECT user_id, window_idx, beat, rr AS x0,
              lead(rr, 1) OVER (PARTITION BY user_id, window_idx ORDER BY beat) AS x1,
              lead(rr, 2) OVER (PARTITION BY user_id, window_idx ORDER BY beat) AS x2 FROM rr),
sd AS (SELECT user_id, window_idx, 0.2 * stddev_samp(rr) AS r FROM rr GROUP BY user_id, window_idx),
t2 AS (SELECT tp.*, sd.r FROM tp JOIN sd USING (user_id, window_idx) WHERE x2 IS NOT NULL),
pr AS (SELECT a.user_id, a.window_idx,
              count_if(abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r) AS B,
              count_if(abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r AND abs(a.x2 - b.x2) <= a.r) AS A
       FROM t2 a JOIN t2 b ON a.user_id = b.user_id AND a.window_idx = b.window_idx AND b.beat > a.beat
       GROUP BY a.user_id, a.window_idx),
se AS (SELECT user_id, window_idx, CASE WHEN pr.A > 0 AND pr.B > 0 THEN -ln(pr.A / pr.B) END AS SampEn
       FROM sd LEFT JOIN pr USING (user_id, window_idx)),
y0 AS (SELECT *, rr - avg(rr) OVER (PARTITION BY user_id, window_idx) AS dev,
              count(*) OVER (PARTITION BY user_id, window_idx) AS n FROM rr),
y AS (SELECT *, sum(dev) OVER (PARTITION BY user_id, window_idx ORDER BY beat ROWS UNBOUNDED PRECEDING) AS yk,
             row_number() OVER (PARTITION BY user_id, window_idx ORDER BY beat) AS k FROM y0),
bx AS (SELECT user_id, window_idx, s, floor((k - 1) / s) AS box, yk, CAST(k AS DOUBLE) AS kd
       FROM y, range(4, 17) q(s) WHERE floor((k - 1) / s) < floor(n / s)),
ss0 AS (SELECT user_id, window_idx, s, box, regr_syy(yk, kd) AS syy, regr_syy(yk, kd) - CASE WHEN regr_sxx(yk, kd) > 0
                   THEN power(regr_sxy(yk, kd), 2) / regr_sxx(yk, kd) ELSE 0 END AS ss
       FROM bx GROUP BY user_id, window_idx, s, box),
ss AS (SELECT user_id, window_idx, s, box, CASE WHEN ss > 1e-9 * syy THEN ss ELSE 0 END AS ss FROM ss0),
fs AS (SELECT user_id, window_idx, s, sqrt(sum(ss) / (s * count(*))) AS fs FROM ss GROUP BY user_id, window_idx, s),
df AS (SELECT user_id, window_idx, CASE WHEN count(*) > 1 THEN regr_slope(ln(fs), ln(CAST(s AS DOUBLE))) END AS DFA_alpha1
       FROM fs WHERE fs > 0 GROUP BY user_id, window_idx),
wf AS (SELECT * FROM tf LEFT JOIN fq USING (user_id, window_idx) LEFT JOIN p USING (user_id, window_idx)
       LEFT JOIN se USING (user_id, window_idx) LEFT JOIN df USING (user_id, window_idx)),
pa AS (SELECT o_orderkey AS ID, CASE WHEN o_orderkey % 53 <> 0 AND o_orderstatus = 'F'
                                      AND o_orderkey % 59 <> 0 AND 2001 - year(o_orderdate) < 5 THEN 1 ELSE 0 END AS event
       FROM orders WHERE o_orderkey % 7 <> 0)"""


_JOB_ARGS = {"clean": {"a": 1, "b": 3}, "peaks": {"c": 1, "k": 0.3, "refractory": 1}, "freq": {"f_lo": _F_LO, "f_hi": _F_HI, "n_freq": _N_FREQ}}


def _job_samples(spark, d):
    """Every 11th user's leads are silent, so it has no beats."""
    s = H.sample_index(R.signal(spark, d), "user_id", "ts", "event_id", total="n")
    return s.withColumn("value", F.when(F.col("user_id") % 11 == 0, 0.0).otherwise(F.col("value")))


def _job(spark, d):
    """Features per user and the patient table."""
    f = H.signal_features(_job_samples(spark, d), "user_id", "sample_idx", "value", _W_JOB, 1.0, total="n", **_JOB_ARGS)
    return f, R.study(spark, d).where(F.col("ID") % 7 != 0)


@query("signal_features", sql=_JOB_SQL + f"""
SELECT user_id, CAST(event AS INTEGER) AS event, CAST(count(*) AS BIGINT) AS n_windows,
       {", ".join(f"round(avg({c}), 3) AS HRV_{c}, round(stddev_samp({c}), 3) AS std_HRV_{c}" for c in _JOB_COLS)}
FROM wf JOIN pa ON ID = user_id GROUP BY user_id, event""")
def signal_features(spark, d):
    """Windows, cleaning, peaks, RR, all families, mean and std per patient, label."""
    f, patients = _job(spark, d)
    out = H.label_features(f, patients, "user_id", "ID", "Obito_MS", "Time")
    return out.select("user_id", "event", "n_windows",
                      *[K.r6(p + c, 3).alias(p + c) for c in _JOB_COLS for p in ("HRV_", "std_HRV_")])


@query("signal_feature_rejects", sql=_JOB_SQL + """
SELECT DISTINCT user_id, CASE WHEN user_id NOT IN (SELECT ID FROM pa) THEN 'not listed' ELSE 'no features' END AS reason
FROM events WHERE user_id NOT IN (SELECT ID FROM pa) OR user_id NOT IN (SELECT user_id FROM wf)""")
def signal_feature_rejects(spark, d):
    """Users that the patient table lacks, and listed ones without any feature window."""
    f, patients = _job(spark, d)
    users = R.signal(spark, d).select("user_id").distinct()
    listed = patients.select(F.col("ID").alias("user_id"))
    missing = users.join(listed, "user_id", "left_anti").withColumn("reason", F.lit("not listed"))
    bare = H.feature_rejects(users.join(listed, "user_id", "left_semi"), f, "user_id").withColumn("reason", F.lit("no features"))
    return missing.union(bare)


@query("signal_window_rejects", sql=_JOB_SQL + f""",
sz AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
al AS (SELECT user_id, unnest(range(0, n // {_W_JOB})) AS window_idx FROM sz)
SELECT user_id, n // {_W_JOB} AS window_idx, NULL AS family, 'incomplete window' AS reason FROM sz WHERE n % {_W_JOB} > 0
UNION ALL SELECT user_id, window_idx, NULL, 'no RR interval' FROM al ANTI JOIN wf USING (user_id, window_idx)
UNION ALL SELECT user_id, window_idx, unnest(list_filter([CASE WHEN SDNN IS NULL THEN 'time' END, CASE WHEN TP IS NULL THEN 'frequency' END,
  CASE WHEN SD1 IS NULL THEN 'poincare' END, CASE WHEN SampEn IS NULL THEN 'entropy' END, CASE WHEN DFA_alpha1 IS NULL THEN 'dfa' END],
  lambda f: f IS NOT NULL)), 'no value' FROM wf""")
def signal_window_rejects(spark, d):
    """Incomplete windows, windows without RR intervals, and families without a value, each with its reason."""
    s = _job_samples(spark, d)
    f = cut_lineage(H.signal_windows(s, "user_id", "sample_idx", "value", _W_JOB, 1.0, total="n", **_JOB_ARGS))
    return H.window_rejects(s, f, "user_id", _W_JOB)
