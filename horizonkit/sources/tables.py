"""Table scans: format dispatch, pandas-like CSV missing values, fallback paths."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strings pandas' CSV reader treats as missing by default.
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

#: A number in text: decimals and exponents, or an infinity.
NUMBER = r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))"

_FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc", ".txt": "text"}


def format_of(path: str) -> str:
    """A3: format by suffix; spreadsheets must be exported first (not built)."""
    p = path.rstrip("/").lower()
    if p.endswith((".xlsx", ".xls")):
        raise ValueError("spreadsheet files are not read directly; export the sheet to CSV or Parquet")
    for suf, fmt in _FORMATS.items():
        if p.endswith(suf):
            return fmt
    return "parquet"


def na_to_null(df: DataFrame, na: list[str] | None = None) -> DataFrame:
    """Every string column: pandas' NA spellings -> NULL."""
    na = NA_STRINGS if na is None else na
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(na), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def infer_types(df: DataFrame) -> DataFrame:
    """A2: text columns get the type pandas would infer, from one pass over all rows.

    Whole numbers without missing values become ``long``; numbers otherwise,
    and columns without any value, ``double``; True / False without missing values
    ``boolean``; all else stays text.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df

    def every(c: str, ok) -> Column:
        return F.count_if(F.col(f"`{c}`").isNotNull() & ~F.coalesce(ok, F.lit(False))) == 0

    aggs = []
    for c in text:
        v = F.trim(F.col(f"`{c}`"))
        aggs.append(F.struct(
            (F.count_if(F.col(f"`{c}`").isNull()) == 0).alias("full"),
            every(c, v.rlike(r"^[+-]?[0-9]+$") & v.try_cast("long").isNotNull()).alias("whole"),
            every(c, v.rlike(f"^{NUMBER}$")).alias("number"),
            every(c, F.lower(F.col(f"`{c}`")).isin("true", "false")).alias("truth"), F.count("*").alias("rows")))
    found = df.agg(*[a.alias(str(i)) for i, a in enumerate(aggs)]).first()  # one row
    types = {}
    for i, c in enumerate(text):
        t = found[str(i)]
        if t["rows"]:
            types[c] = ("long" if t["whole"] and t["full"] else "double" if t["number"] else
                        "boolean" if t["truth"] and t["full"] else "string")
    return df.select(*[F.trim(F.col(f"`{c}`")).cast(types[c]).alias(c) if types.get(c, "string") != "string"
                       else F.col(f"`{c}`") for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """A1-A3: one entry point for the exported tables. CSV without a schema gets inferred types."""
    fmt = fmt or format_of(path)
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        # read every field as text, then apply the pandas NA set
        r = r.option("header", True).option("nullValue", "\u0000").option("emptyValue", "")
        df = na_to_null(r.load(path))
        return df if schema is not None else infer_types(df)
    return r.load(path)


def load_first(spark: SparkSession, paths: list[str], **kw) -> DataFrame | None:
    """The first path that loads; ``None`` when none does (caller skips)."""
    for p in paths:
        try:
            df = read_table(spark, p, **kw)
            df.schema  # noqa: B018 — resolves the path now
            return df
        except (AnalysisException, ValueError):
            continue
    return None
