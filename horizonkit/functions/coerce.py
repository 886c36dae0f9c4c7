"""Column-level coercion helpers (JVM-side expressions only).

Every helper returns a ``Column``; none of them scans data. They keep
pandas' "bad value becomes missing" semantics while mapping NaN to SQL NULL,
so three-valued logic then gives the same rows as the pandas masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal number (optional sign, digits, optional
# fraction, optional exponent). Spark's cast also accepts '1d', '1.5f',
# 'NaN' and 'Infinity'; pandas' to_numeric does not parse the suffixed forms.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Ordinal classes I-IV and their digit forms (reference map).
ORDINAL_MAP = {"I": 1, "II": 2, "III": 3, "IV": 4, "1": 1, "2": 2, "3": 3, "4": 4}

# Binary recode (reference map); other values are kept and
# then coerced to a number.
BINARY_MAP = {"M": 0, "F": 1, "Masculino": 0, "Feminino": 1}

# The reference's leakage columns, always dropped.
LEAKAGE_COLUMNS = ["Data_MSC", "Tempo", "Date Holter"]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL for floating columns (pandas treats NaN as missing)."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def to_double(c) -> Column:
    """``pd.to_numeric(errors='coerce')`` for a text column: bad -> NULL."""
    s = F.trim(col_of(c).cast("string"))
    return nan_to_null(F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double")))


def numeric_or_text_to_double(df: DataFrame, name: str) -> Column:
    """Coerce by the column's type: numbers pass (NaN nulled), text parsed."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return nan_to_null(F.col(name).cast("double"))
    if isinstance(dt, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(dt, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    return to_double(name)


def decimal_comma(c) -> Column:
    """Decimal-comma repair: every ',' becomes '.', then strict parse.

    ``'27,5'`` -> 27.5; ``'1.234,5'`` -> ``'1.234.5'`` -> NULL (as the
    reference's literal replace does).
    """
    return to_double(F.replace(col_of(c).cast("string"), F.lit(","), F.lit(".")))


def ordinal(c, mapping: dict[str, int] | None = None) -> Column:
    """Ordinal text -> int via a literal map; unmapped -> NULL."""
    mapping = mapping or ORDINAL_MAP
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[F.trim(col_of(c).cast("string"))].cast("int")


def binary_recode(c, mapping: dict[str, int] | None = None) -> Column:
    """Replace mapped labels, keep the rest, then coerce to a number."""
    mapping = mapping or BINARY_MAP
    s = col_of(c).cast("string")
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[s].cast("double"), to_double(s))


def to_ts(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp coercion, bad -> NULL (one format per column)."""
    return F.try_to_timestamp(col_of(c).cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def elapsed_years(start, end, digits: int = 2) -> Column:
    """``round(floor(days)/365.25, 2)`` with days floored toward -inf.

    Works on whole microseconds, so differing times of day behave like the
    pandas ``timedelta.days`` the reference uses (not ``datediff``).
    """
    us = F.timestamp_diff("MICROSECOND", col_of(start), col_of(end))
    days = F.floor(us / F.lit(86_400_000_000))
    return F.round(days / F.lit(365.25), digits)


def portable_hash(c, seed: int = 42) -> Column:
    """First 32 bits of ``md5('<id>:<seed>')`` as a number.

    Both engines compute it alike, and another seed gives another order (a
    hash that only adds the seed would keep the order).
    """
    text = F.concat(col_of(c).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def r6(c, digits: int = 6) -> Column:
    """Rounding used by the query outputs (``-0.0`` folded to ``0.0``)."""
    return F.round(col_of(c).cast("double"), digits) + F.lit(0.0)
