"""Cohort preparation: merge, death-date lookup, elapsed time, horizon labels.

All operators are declarative DataFrame plans; joins are left to Catalyst/AQE
(sort-merge by default, broadcast only when AQE measures a side under
``spark.sql.autoBroadcastJoinThreshold`` at run time).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horizonkit.functions.coerce import elapsed_years, nan_to_null, numeric_or_text_to_double

# The reference's four prediction horizons, in years.
DEFAULT_HORIZONS = (3, 5, 7, 10)


# --------------------------------------------------------------------- B1/B2
def study_filter(df: DataFrame, event_col: str, time_col: str, cutoff: float = 5.0) -> DataFrame:
    """Cohort filter: ``(event=1 & t<cutoff)`` bag-union ``(event=0 | t=cutoff)``.

    The two masks are disjoint, so one filter is the same bag as the
    reference's concat of the two slices; deaths after the cutoff fall out.
    """
    e, t = F.col(event_col), nan_to_null(F.col(time_col).cast("double"))
    c1 = (e == 1) & (t < cutoff)
    c0 = (e == 0) | (t == cutoff)
    return df.where(F.coalesce(c1, F.lit(False)) | F.coalesce(c0, F.lit(False)))


def event_flag(event_col: str, time_col: str, cutoff: float = 5.0) -> Column:
    """``1 if event == 1 and t < cutoff else 0``; unknown -> 0 (reference)."""
    cond = (F.col(event_col) == 1) & (nan_to_null(F.col(time_col).cast("double")) < cutoff)
    return F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)


# ------------------------------------------------------------------------ D1
def first_non_null_by(df: DataFrame, key: str, value: str, order_cols: list[str],
                      out: str | None = None) -> DataFrame:
    """First non-null ``value`` per ``key`` in ``order_cols`` order.

    ``min_by`` on a struct of the order columns is a partial + final
    aggregate (map-side combine), so a hot key costs one row per task before
    the shuffle. Rows with a null key are not looked up (groupby drops them).
    """
    ord_ = F.struct(*[F.col(c) for c in order_cols])
    return (df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
              .groupBy(key)
              .agg(F.min_by(F.col(value), ord_).alias(out or value)))


# ------------------------------------------------------------------------ C1
def null_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join where NULL keys match (pandas ``merge`` semantics).

    ``<=>`` is planned as an ordinary equi-join key, so it still shuffles /
    sort-merges on the keys. Right-side duplicates fan out, as in pandas.
    """
    rk = {k: f"__r_{k}" for k in keys}
    r = right.select(*[F.col(k).alias(rk[k]) if k in rk else F.col(f"`{k}`")
                       for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[rk[k]]) for k in keys])
    return left.join(r, cond, "left").drop(*rk.values())


#: Rows of one key on one side beyond which they are dealt to several tasks.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> list[tuple]:
    """``(*keys, tasks)`` of the keys with more than ``hot_rows`` rows: the largest, at most as many as a shuffle has partitions.

    More hot keys than partitions need no dealing: they fill all tasks anyway.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows)
    tasks = F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int")
    return [tuple(r) for r in counts.orderBy(F.col("__n").desc()).limit(most).select(*keys, tasks).collect()]


def skew_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool = True,
                        hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left equi-join, ``null_safe`` or not, in which no key is bound to one task.

    Rows per key are counted on both sides (the keys alone are read). A hot key's
    left rows are dealt to l tasks and its right rows to r: each of the l x r
    tasks joins one part with one part, so every pair of rows meets once. Only
    hot keys' rows are copied. Parts go by a hash of the whole row, so a task
    that is run again deals alike. Without ``null_safe``, rows with a null key match nothing and are
    spread over all tasks. The columns are ``left``'s and ``right``'s without its keys; right duplicates fan out.
    """
    spark = left.sparkSession
    same = [left.select(*keys).schema[k].dataType == right.schema[k].dataType for k in keys]
    if not all(same):
        raise ValueError(f"keys of different types: {keys}")
    known = lambda df: df if null_safe else df.dropna(subset=keys)
    of = [{r[:-1]: r[-1] for r in hot_keys(known(df), keys, hot_rows)} for df in (left, right)]
    parts = [(*k, of[0].get(k, 1), of[1].get(k, 1)) for k in dict.fromkeys([*of[0], *of[1]])]
    fields = [left.schema[k] for k in keys]
    hot = spark.createDataFrame(parts, T.StructType([T.StructField(f"__h{i}", f.dataType) for i, f in enumerate(fields)]
                                                    + [T.StructField(c, T.IntegerType()) for c in ("__l", "__r")]))

    def dealt(df: DataFrame, own: str, other: str, mine: str, its: str, nulls: Column | None) -> DataFrame:
        on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot[f"__h{i}"]) for i, k in enumerate(keys)])
        out = df.join(F.broadcast(hot), on, "left").drop(*[f"__h{i}" for i in range(len(keys))])  # two rows a partition at most
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        spread = F.coalesce(own, F.lit(1)) if nulls is None else F.when(nulls, F.lit(512)).otherwise(F.coalesce(own, F.lit(1)))
        out = out.withColumn(mine, F.pmod(row, spread).cast("int"))
        return out.withColumn(its, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    none = None if null_safe else reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    a = dealt(left, F.col("__l"), F.col("__r"), "__i", "__j", none).drop("__l").withColumnRenamed("__r", "__copies")
    b = dealt(known(right), F.col("__r"), F.col("__l"), "__j", "__i", None).drop("__l", "__r").withColumn("__hit", F.lit(True))
    b = b.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, "__i", "__j"]})
    cond = (a["__i"] == b["__k___i"]) & (a["__j"] == b["__k___j"])
    for k in keys:
        cond = cond & (a[k].eqNullSafe(b[f"__k_{k}"]) if null_safe else a[k] == b[f"__k_{k}"])
    # a copied left row has a match in some part of its key's right rows; in the others it gives no row
    out = a.join(b, cond, "left").where((F.coalesce("__copies", F.lit(1)) == 1) | F.col("__hit").isNotNull())
    return out.drop("__copies", "__hit", "__i", "__j", *[f"__k_{k}" for k in [*keys, "__i", "__j"]])


# ------------------------------------------------------------- B14-B19, C2
def clinical_merge(study: DataFrame, clinical: DataFrame, *, name_col: str,
                   study_date_col: str, clinical_date_col: str, event_col: str,
                   death_date_col: str, order_cols: list[str], clinical_cols: list[str],
                   rename: dict[str, str] | None = None, lead: int = 15,
                   msc_col: str = "Data_MSC", tempo_col: str = "Tempo", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Study ⟕ clinical on (name, exam day) + global death date + elapsed years.

    * keys: ``to_date`` of both exam timestamps; NULL names match NULL names;
    * death date: first non-null per name over the *whole* clinical history
      (not only the matched visit), applied only where ``event == 1``;
    * ``Tempo`` = floor(days)/365.25 rounded to 2, negative allowed;
    * both depend on the study row alone and are joined before the visits fan it out;
    * a NULL name meets the visits of NULL names of its day (pandas ``merge``), and no death date;
    * output order: first ``lead`` study columns, ``Data_MSC``, ``Tempo``,
      clinical columns, the rest.
    """
    rename = rename or {}
    present = [c for c in clinical_cols if c in clinical.columns]          # B15
    taken = [*study.columns, msc_col, tempo_col]
    overlap = [rename.get(c, c) for c in present if rename.get(c, c) in taken]
    if overlap:
        raise ValueError(f"clinical columns already in the merged table: {overlap}")
    key_date = "__merge_date"
    c = clinical.withColumn(key_date, F.to_date(F.col(clinical_date_col)))  # B18
    deaths = first_non_null_by(c, name_col, death_date_col, order_cols, "__death")  # D1
    # Single-valued lookup by name; plain '=' (null names never looked up).
    looked = skew_safe_left_join(study, deaths, [name_col], False, hot_rows).withColumn(  # B19
        msc_col, F.when(F.col(event_col) == 1, F.col("__death")).cast("timestamp_ntz")).drop("__death")
    looked = looked.withColumn(tempo_col, elapsed_years(study_date_col, msc_col))  # B17
    looked = looked.withColumn(key_date, F.to_date(F.col(study_date_col)))
    sub = c.select(F.col(name_col), F.col(key_date),
                   *[F.col(f"`{x}`").alias(rename.get(x, x)) for x in present])  # B14
    looked = skew_safe_left_join(looked, sub, [name_col, key_date], True, hot_rows)  # C1

    orig = [x for x in study.columns]
    inserted = [msc_col, tempo_col] + [rename.get(x, x) for x in present]
    order = orig[:lead] + inserted + orig[lead:]                            # B16
    return looked.select(*[F.col(f"`{x}`") for x in order])


def merge_report(merged: DataFrame, event_col: str, msc_col: str = "Data_MSC") -> DataFrame:
    """Deaths flagged, dates recovered, still missing (after fan-out)."""
    return merged.agg(
        F.coalesce(F.sum(F.col(event_col).cast("long")), F.lit(0)).cast("long").alias("deaths"),
        F.count(F.col(msc_col)).cast("long").alias("dates_found"),
    ).withColumn("missing", F.col("deaths") - F.col("dates_found"))


def unresolved_names(merged: DataFrame, name_col: str, event_col: str,
                     msc_col: str = "Data_MSC") -> DataFrame:
    """Distinct names of deaths whose date was not found."""
    return (merged.where((F.col(event_col) == 1) & F.col(msc_col).isNull())
                  .select(name_col).distinct())


# ------------------------------------------------------------------------ B3
def label_horizons(df: DataFrame, *, event_col: str, time_col: str,
                   horizons=DEFAULT_HORIZONS, target: str = "Target",
                   horizon_col: str = "horizon", keep_unlabelled: bool = False) -> DataFrame:
    """All horizons in one pass: one output row per (input row, horizon).

    class 1: ``event == 1 and t < h`` (strict, as the code does);
    class 0: ``event == 0 or t >= h``; anything else (e.g. a death with an
    unknown time) gets NULL and is dropped unless ``keep_unlabelled``.
    The horizon list is a literal array, so ``explode`` stays inside the
    scan's codegen stage (no join, no shuffle).
    """
    t = numeric_or_text_to_double(df, time_col)
    e = F.col(event_col)
    h = F.col(horizon_col)
    out = (df.withColumn("__t", t)
             .withColumn(horizon_col, F.explode(F.array(*[F.lit(int(x)) for x in horizons])))
             .withColumn(target, F.when((e == 1) & (F.col("__t") < h), F.lit(1))
                                   .when((e == 0) | (F.col("__t") >= h), F.lit(0)))
             .drop("__t"))
    if not keep_unlabelled:
        out = out.where(F.col(target).isNotNull())
    return out


def horizon_stats(labelled: DataFrame, target: str = "Target",
                  horizon_col: str = "horizon") -> DataFrame:
    """N, n0, n1, event % per horizon (+ rows that got no class)."""
    y = F.col(target)
    n = F.count(y)
    n1 = F.count_if(y == 1)
    return (labelled.groupBy(horizon_col)
            .agg(n.cast("long").alias("n"),
                 F.count_if(y == 0).cast("long").alias("n_class0"),
                 n1.cast("long").alias("n_class1"),
                 F.count_if(y.isNull()).cast("long").alias("n_dropped"),
                 F.when(n > 0, F.round(n1 * 100.0 / n, 6)).alias("event_pct")))


# ------------------------------------------------------------ C3, B27, B28
def first_row_per_key(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """``dropDuplicates`` keeping the first row in ``order_cols`` order.

    ``max_by``/``min_by`` over a struct keeps this a partial aggregate, so a
    key holding a third of all rows is combined map-side instead of being
    sorted in one window task.
    """
    others = [c for c in df.columns if c != key]
    ord_ = F.struct(*[F.col(c) for c in order_cols])
    packed = F.struct(*[F.col(f"`{c}`") for c in others])
    return (df.groupBy(key).agg(F.min_by(packed, ord_).alias("__row"))
              .select(F.col(key), "__row.*"))


def lookup_first_match(ids: DataFrame, patients: DataFrame, id_col: str, key: str,
                       order_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Return (matched, rejects): first patient row per id; ids with none."""
    first = first_row_per_key(patients, key, order_cols)
    matched = ids.join(first, ids[id_col] == first[key], "inner")
    if id_col != key:
        matched = matched.drop(first[key])
    rejects = ids.join(first, ids[id_col] == first[key], "left_anti")
    return matched, rejects
