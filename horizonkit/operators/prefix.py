"""Exact ordered row numbers and running sums without one-task windows.

A ``Window.orderBy`` over a whole group sorts that group in one task. When a
*bucket* column is available that never decreases along the order (high bits
of a hash, a clipped score bin, a time chunk), the same result is:

    offset(bucket) = rows/sums of all earlier buckets   (small table: groups x buckets)
    value(row)     = offset + window inside (group, bucket)

so a group holding a third of all rows is still spread over ``buckets``
window partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(df: DataFrame, part: list[str], bucket: str, sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """Sums of the earlier buckets, and over all of a partition's (``totals``: name of the sum -> column)."""
    agg = df.groupBy(*part, bucket).agg(*[e.alias(k) for k, e in sums.items()])
    w = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    return agg.select(*part, bucket, *[
        F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"__off_{k}") for k in sums],
        *[F.sum(k).over(whole).alias(c) for k, c in (totals or {}).items()])


def _joined(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``small``'s other columns beside ``df``'s, a null key being a key."""
    named = small.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(named[f"__of_{k}"])
    return df.join(named, on).drop(*[f"__of_{k}" for k in keys])


def bucketed_row_number(df: DataFrame, part: list[str], order: list, bucket: str,
                        out: str = "rn", total: str | None = None) -> DataFrame:
    """``row_number() over (partition by part order by order)``, exactly.

    ``bucket`` must be non-decreasing in ``order`` within each partition.
    ``total``: a column for the partition's row count, which the offsets table holds anyway.
    """
    offs = _offsets(df, part, bucket, {"n": F.count("*")}, {"n": total} if total else None)
    w = Window.partitionBy(*part, bucket).orderBy(*order)
    return (_joined(df, offs, part + [bucket])
              .withColumn(out, F.col("__off_n") + F.row_number().over(w))
              .drop("__off_n"))


def bucketed_running_sum(df: DataFrame, part: list[str], order: list, bucket: str,
                         values: dict[str, str]) -> DataFrame:
    """Inclusive running sums ``{out: sum(src) over (... rows unbounded..current)}``."""
    offs = _offsets(df, part, bucket, {k: F.sum(v) for k, v in values.items()})
    w = (Window.partitionBy(*part, bucket).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, 0))
    out = _joined(df, offs, part + [bucket])
    for k, v in values.items():
        out = out.withColumn(k, F.col(f"__off_{k}") + F.sum(v).over(w)).drop(f"__off_{k}")
    return out


def hash_bits_for(rows: int, rows_per_bucket: int = 1_000_000) -> int:
    """Bits of a hash that deal so many rows to buckets of at most about ``rows_per_bucket``."""
    return min(31, (rows // rows_per_bucket).bit_length())


def hash_bucket(h: Column, bits: int, hash_bits: int = 32) -> Column:
    """High ``bits`` of a non-negative ``hash_bits``-bit hash (monotone in h)."""
    return F.floor(h / F.lit(1 << (hash_bits - bits))).cast("int")


def lower_bound(bounds: Column, x: Column, size: int) -> Column:
    """How many of at most ``size`` ascending ``bounds`` are below ``x``: a binary search inside the row; 0 for a null."""
    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        more = (s["lo"] < s["hi"]) & (F.get(bounds, mid) < x)
        less = (s["lo"] < s["hi"]) & ~F.coalesce(more, F.lit(False))
        return F.struct(F.when(more, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less, mid).otherwise(s["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(0), F.lit(max(1, size).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(rounds, start, step, lambda s: s["lo"])


def with_quantile_bucket(df: DataFrame, part: list[str], col: str, out: str = "__vb", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Buckets of nearly equal row counts, monotone in ``col`` (a number), whatever its distribution.

    A sketch per partition key gives the boundaries, as many as the largest
    partition needs for ``rows_per_bucket`` rows each, so buckets grow in number and not in size. Rows of
    one value share a bucket: collapse repeated values first. Nulls stand in the first bucket; a null key is a key.
    """
    x = F.col(col).cast("double")
    most = df.groupBy(*part).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    buckets = 1 + most // rows_per_bucket
    if buckets == 1:
        return df.withColumn(out, F.lit(0))
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = df.groupBy(*part).agg(F.percentile_approx(x, probs, max(10_000, 20 * buckets)).alias("__bounds"))
    own = F.coalesce("__bounds", F.array().cast("array<double>"))        # a key without a number has none
    return _joined(df, bounds, part).withColumn(out, lower_bound(own, x, buckets)).drop("__bounds")
