"""Stratified hold-out, stratified folds and balanced class weights.

Order within a class is a portable hash of (id, seed) with the id as
tie-break; row numbers come from ``prefix.bucketed_row_number`` so a class
holding most rows is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.functions.coerce import portable_hash
from horizonkit.operators.clean import q
from horizonkit.operators.prefix import bucketed_row_number, hash_bits_for, hash_bucket


def class_rank(df: DataFrame, id_col: str, label: str, seed: int = 42, out: str = "__rn",
               rows_per_bucket: int = 1_000_000) -> DataFrame:
    """1-based position of each row inside its class in seeded-hash order; as many buckets as the largest class asks for."""
    most = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0  # one number
    h = df.withColumn("__h", portable_hash(id_col, seed))
    h = h.withColumn("__hb", hash_bucket(F.col("__h"), hash_bits_for(most, rows_per_bucket)))
    return bucketed_row_number(h, [label], [F.col("__h"), F.col(id_col)], "__hb", out).drop("__hb", "__h")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """``(label, __nc)``: rows per class, null not a class."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__nc"))


def stratified_split(df: DataFrame, id_col: str, label: str, test_size: float = 0.2,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """F1: per class, the first ``floor(test_size*n_c + 0.5)`` rows are test; null labels train."""
    n_test = F.floor(F.lit(float(test_size)) * F.col("__nc") + 0.5)
    known, rest = df.where(F.col(q(label)).isNotNull()), df.where(F.col(q(label)).isNull())
    r = class_rank(known, id_col, label, seed).join(class_counts(known, label), label)
    part = F.when(F.col("__rn") <= n_test, "test").otherwise("train")
    return (r.withColumn(out, part).select(*[F.col(q(c)) for c in df.columns], out)
            .union(rest.withColumn(out, F.lit("train"))))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """``fold = (rank - 1) mod k`` inside each class; null labels have no fold."""
    known, rest = df.where(F.col(q(label)).isNotNull()), df.where(F.col(q(label)).isNull())
    r = class_rank(known, id_col, label, seed)
    return (r.withColumn(out, ((F.col("__rn") - 1) % k).cast("int")).select(*[F.col(q(c)) for c in df.columns], out)
            .union(rest.withColumn(out, F.lit(None).cast("int"))))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``n / (k * n_c)`` per row; 1.0 when fewer than two classes, null without a label."""
    counts = class_counts(df, label)
    total = counts.agg(F.sum("__nc").alias("n"), F.count("*").alias("k")).first()   # one row
    if (total["k"] or 0) < 2:
        return df.withColumn(out, F.lit(1.0))
    w = F.lit(float(total["n"])) / (F.lit(float(total["k"])) * F.col("__nc"))
    return df.join(counts, label, "left").withColumn(out, w).select(*[F.col(q(c)) for c in df.columns], out)
