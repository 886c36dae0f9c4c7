"""Role mapping of the driver's tables onto the reference's data model.

Each function reads whole tables and returns a DataFrame in the shape an
operator expects; the SQL oracles in ``plans.oracle`` build the same roles
with the same expressions. Missing values are injected by deterministic
rules on keys (the driver tables have none) so that the null paths run.

* study    = orders            (exam per order; name = customer)
* clinical = lineitem ⋈ orders (visit per line; death date on returned lines)
* signal   = events            (patient = user, beat/sample order = ts)
* features = embeddings        (64 float features, binary target label < 5)
* scores   = documents ⋈ labels (deterministic score p, label = toxic)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_EMB = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _name(key: str, custkey: str = "o_custkey"):
    return F.when(F.col(key) % 101 != 0, F.col(custkey))


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID, Name (null every 101st order), exam ts, Obito_MS (null every 53rd),
    follow-up Time in whole years (null every 59th), and two attributes."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("ID"),
        _name("o_orderkey").alias("Name"),
        F.col("o_orderdate").alias("exam_ts"),
        F.when(F.col("o_orderkey") % 53 != 0,
               F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("Obito_MS"),
        F.when(F.col("o_orderkey") % 59 != 0,
               (F.lit(2001) - F.year("o_orderdate")).cast("double")).alias("Time"),
        F.col("o_totalprice"),
        F.col("o_orderpriority"),
    )


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visit per line item; death date = ship date of returned lines."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        _name("o_orderkey").alias("Name"),
        F.col("o_orderdate").alias("visit_ts"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("death_ts"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_orderkey").alias("ord_key"),
        F.col("l_linenumber").alias("ord_line"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, p): a deterministic score, so metrics need no model."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (d.join(lab, "doc_id")
             .select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"),
                     ((F.col("n_chars") % 101) / 100.0).alias("p")))


def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label (0/1 = label < 5), f0..f63 as DOUBLE."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if {n["a"], n["b"]} != {N_EMB}:     # never cut a longer vector silently
        raise ValueError(f"embeddings of {n['a']} to {n['b']} values; the role has {N_EMB} columns")
    return e.select(
        F.col("vec_id"),
        F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(N_EMB)],
    )


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, feature, x — the long form (no 64-wide aggregates)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id"),
        F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
        F.posexplode("embedding").alias("pos", "v"),
    ).select("vec_id", "label", F.format_string("f%d", F.col("pos")).alias("feature"),
             F.col("v").cast("double").alias("x"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, ts, value — the signal / beat-time role."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
