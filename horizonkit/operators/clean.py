"""Table-level cleaning: column guards, one-hot, median imputation, reshape.

Decisions that need the schema (numeric or text, present or absent) are made
on the driver from ``df.schema`` without scanning data; the only data-driven
decisions (one-hot levels, medians) run as distributed aggregates whose
results are bounded by the number of levels / columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horizonkit.functions import coerce as K
from horizonkit.operators.quantiles import exact_percentile


def q(name: str) -> str:
    """Backtick-quote a column name (dots, blanks and dashes are common)."""
    return "`" + name.replace("`", "``") + "`"


# ------------------------------------------------------------------ B10-B13
def drop_present(df: DataFrame, cols: list[str], target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop listed columns that exist, never the target."""
    gone = [c for c in cols if c in df.columns and c != target]
    return df.drop(*gone), gone


def drop_leakage(df: DataFrame, leakage: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Force-drop date / time-to-event columns; return what was dropped."""
    leakage = K.LEAKAGE_COLUMNS if leakage is None else leakage
    gone = [c for c in leakage if c in df.columns]
    return df.drop(*gone), gone


def require_column(df: DataFrame, name: str) -> None:
    """Target presence check (driver side, no scan)."""
    if name not in df.columns:
        raise ValueError(f"target column {name!r} not found")


def numeric_only(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Keep numeric columns (booleans excluded, as pandas does)."""
    keep = keep or []
    ok = [f.name for f in df.schema.fields
          if isinstance(f.dataType, T.NumericType) or f.name in keep]
    rest = [c for c in df.columns if c not in ok]
    return df.select(*[q(c) for c in ok]), rest


def prepare_model_table(df: DataFrame, target: str, drop_cols: list[str],
                        leakage: list[str] | None = None) -> tuple[DataFrame, dict]:
    """B10-B13 in the reference's order; returns the table and a report."""
    df, dropped = drop_present(df, drop_cols, target)
    df, leaked = drop_leakage(df, leakage)
    require_column(df, target)
    df, non_numeric = numeric_only(df, keep=[target])
    return df, {"dropped": dropped, "leakage": leaked, "non_numeric": non_numeric}


# ---------------------------------------------------------------------- B9
def level_text(df: DataFrame, name: str):
    """Category text as pandas ``astype(str)`` gives it ('3' for ints, '3.0' for doubles)."""
    c = F.col(q(name))
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = K.nan_to_null(c)
    return c.cast("string")


def discover_levels(df: DataFrame, cols: list[str], max_levels: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct non-null levels per column (one distributed distinct).

    Every level becomes a column, so they come to the driver as column names.
    A caller may set ``max_levels`` to refuse wider tables.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), level_text(df, c).alias("v")) for c in cols])).alias("kv"))
    lv = long.select("kv.c", "kv.v").where(F.col("v").isNotNull()).distinct().cache()
    for r in lv.groupBy("c").count().collect() if max_levels else []:      # one row per column
        if r["count"] > max_levels:
            lv.unpersist()
            raise ValueError(f"{r['c']}: {r['count']} levels exceed max_levels={max_levels}")
    out = {c: [] for c in cols}
    for r in lv.collect():                            # the new columns' names
        out[r["c"]].append(r["v"])
    lv.unpersist()
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, cols: list[str], levels: dict[str, list[str]] | None = None,
            max_levels: int | None = None) -> DataFrame:
    """All levels kept, missing -> all zeros, names ``col_level``, ints.

    Encoded columns are replaced by their dummies, appended at the end (as
    ``get_dummies`` does). Pass ``levels`` to skip the discovery job.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    levels = levels or discover_levels(df, cols, max_levels)
    keep = [q(c) for c in df.columns if c not in cols]
    dummies = []
    for c in cols:
        t = level_text(df, c)
        for lv in levels[c]:
            dummies.append(F.when(t == F.lit(lv), 1).otherwise(0).alias(f"{c}_{lv}"))
    return df.select(*keep, *dummies)


# The reference's columns for each cleaning step.
DECIMAL_TEXT = ["TSH", "AE diam.", "IMC", "FC", "FC media"]
ORDINAL_COLUMN, BINARY_COLUMN = "NYHA", "Sex"
NOMINAL = ["Dist Cond InterVent", "Dist Cond AtrioVent", "Dist Cond AtrioVent.1"]


def clean_categorical(df: DataFrame, decimal: list[str] | None = None, ordinal: list[str] | None = None,
                      binary: list[str] | None = None, nominal: list[str] | None = None,
                      levels: dict[str, list[str]] | None = None) -> DataFrame:
    """B6-B9 as one step: comma repair of text columns, ordinal and binary text to numbers, one-hot.

    Columns that are absent are passed over; a column that is a number already
    keeps its values. Unreadable text becomes NULL. Other columns stay.
    """
    decimal = DECIMAL_TEXT if decimal is None else decimal
    ordinal = [ORDINAL_COLUMN] if ordinal is None else ordinal
    binary = [BINARY_COLUMN] if binary is None else binary
    out = []
    for f in df.schema.fields:
        c, text = F.col(q(f.name)), isinstance(f.dataType, T.StringType)
        if f.name in decimal and text:
            c = K.decimal_comma(c)
        elif f.name in ordinal:
            c = K.ordinal(c).cast("double") if text else K.nan_to_null(c.cast("double"))
        elif f.name in binary and text:
            c = K.binary_recode(c)
        out.append(c.alias(f.name))
    return one_hot(df.select(*out), NOMINAL if nominal is None else nominal, levels)


# ----------------------------------------------------------------------- D9
def column_medians(df: DataFrame, cols: list[str], **kw) -> DataFrame:
    """Exact (interpolated) median per column, long form ``(column, median)``."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), K.nan_to_null(F.col(q(c)).cast("double")).alias("x"))
        for c in cols])).alias("kv")).select("kv.column", "kv.x")
    return exact_percentile(long, ["column"], "x", 0.5, out="median", **kw)


def impute_median(df: DataFrame, cols: list[str], fit_df: DataFrame | None = None,
                  **kw) -> tuple[DataFrame, list[str]]:
    """Fill NULL/NaN with the column median learnt on ``fit_df`` (default: df).

    Columns that are entirely missing in ``fit_df`` are dropped by name (the
    imputer drops them) and the surviving list is returned, so names never
    shift. The medians come back as one small row per column.
    """
    fit_df = df if fit_df is None else fit_df
    med = {r["column"]: r["median"] for r in column_medians(fit_df, cols, **kw).collect()}
    kept = [c for c in cols if med.get(c) is not None]
    out = df.select(*[
        (F.coalesce(K.nan_to_null(F.col(q(c)).cast("double")), F.lit(med[c])).alias(c)
         if c in med and c in kept else F.col(q(c)))
        for c in df.columns if c in kept or c not in cols])
    return out, kept


# ------------------------------------------------------------------- B23
def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "Metric",
         val: str = "Score") -> DataFrame:
    """Wide -> long (``melt(id_vars=...)``)."""
    return df.unpivot(ids, values, var, val)


# ------------------------------------------------------------------- B25
def remap_anomaly(df: DataFrame, pred: str) -> DataFrame:
    """If any prediction is -1 (over the whole set), -1 -> 1 and all else -> 0.

    The "any" test is one short job that stops at the first -1 row; only a
    boolean reaches the driver.
    """
    has_neg = len(df.where(F.col(pred) == -1).select(pred).take(1)) > 0
    if not has_neg:
        return df
    return df.withColumn(pred, (F.col(pred) == -1).cast("int"))


# ------------------------------------------------------------------- B20
def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """``dropna(subset=...)`` treating NaN as missing."""
    cond = None
    for c in subset:
        dt = df.schema[c].dataType
        ok = F.col(q(c)).isNotNull()
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            ok = ok & ~F.isnan(F.col(q(c)))
        cond = ok if cond is None else cond & ok
    return df.where(cond) if cond is not None else df
