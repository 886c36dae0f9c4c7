"""Queries: cleaning and coercion."""

from __future__ import annotations

from pyspark.sql import functions as F

from horizonkit.functions import coerce as K
from horizonkit.operators import clean as CL
from horizonkit.operators import cohort as C
from horizonkit.plans import oracle_cte as Q
from horizonkit.plans import roles as R
from horizonkit.plans.q_cohort import merged
from horizonkit.plans.registry import query

NUM_RE = K.NUMERIC_PATTERN


def _dirty_price():
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    return (F.when(k == 0, F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(",")))
             .when(k == 1, F.format_string("%.2f", "l_extendedprice"))
             .when(k == 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".234,5")))
             .when(k == 3, F.lit(" "))
             .when(k == 4, F.lit("abc")))


@query("clean_decimal", sql=f"""
SELECT l_orderkey, l_linenumber, raw,
       CASE WHEN regexp_full_match(replace(raw, ',', '.'), '{NUM_RE}')
            THEN TRY_CAST(trim(replace(raw, ',', '.')) AS DOUBLE) END AS value
FROM (SELECT l_orderkey, l_linenumber,
        CASE (l_orderkey + l_linenumber) % 6
          WHEN 0 THEN replace(printf('%.2f', l_extendedprice), '.', ',')
          WHEN 1 THEN printf('%.2f', l_extendedprice)
          WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.234,5'
          WHEN 3 THEN ' '
          WHEN 4 THEN 'abc' END AS raw
      FROM lineitem) t""")
def clean_decimal(spark, d):
    """Decimal-comma repair, strict numeric parse, bad -> NULL."""
    li = R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _dirty_price().alias("raw"))
    return li.select("l_orderkey", "l_linenumber", "raw", K.decimal_comma("raw").alias("value"))


@query("clean_ordinal", sql="""
SELECT o_orderkey, raw,
       CASE trim(raw) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4
                      WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 END AS nyha
FROM (SELECT o_orderkey,
        CASE WHEN o_orderkey % 4 = 0 THEN substr(o_orderpriority, 1, 1)
             ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'I' WHEN '2' THEN 'II'
                  WHEN '3' THEN 'III' WHEN '4' THEN 'IV' WHEN '5' THEN 'V' END END AS raw
      FROM orders) t""")
def clean_ordinal(spark, d):
    """Ordinal text (roman or digit) -> 1..4, other -> NULL."""
    o = R.table(spark, d, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    roman = F.create_map(*[F.lit(x) for x in ("1", "I", "2", "II", "3", "III", "4", "IV", "5", "V")])
    raw = F.when(F.col("o_orderkey") % 4 == 0, digit).otherwise(roman[digit])
    return o.select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw",
                                                          K.ordinal("raw").alias("nyha"))


@query("clean_binary", sql=f"""
SELECT c_custkey, raw,
       CASE raw WHEN 'M' THEN 0.0 WHEN 'F' THEN 1.0 WHEN 'Masculino' THEN 0.0 WHEN 'Feminino' THEN 1.0
            ELSE CASE WHEN regexp_full_match(raw, '{NUM_RE}') THEN TRY_CAST(trim(raw) AS DOUBLE) END
       END AS sex
FROM (SELECT c_custkey,
        CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'Masculino'
             WHEN 3 THEN 'Feminino' WHEN 4 THEN CAST(c_custkey % 3 AS VARCHAR) ELSE 'X' END AS raw
      FROM customer) t""")
def clean_binary(spark, d):
    """M/Masculino -> 0, F/Feminino -> 1, others kept then coerced."""
    c = R.table(spark, d, "customer")
    k = F.col("c_custkey") % 6
    raw = (F.when(k == 0, "M").when(k == 1, "F").when(k == 2, "Masculino")
            .when(k == 3, "Feminino").when(k == 4, (F.col("c_custkey") % 3).cast("string"))
            .otherwise("X"))
    return c.select("c_custkey", raw.alias("raw")).select("c_custkey", "raw",
                                                         K.binary_recode("raw").alias("sex"))


@query("coerce_ts", sql="""
SELECT event_id, raw, try_strptime(raw, '%Y-%m-%d %H:%M:%S') AS parsed,
       CAST(try_strptime(raw, '%Y-%m-%d %H:%M:%S') AS DATE) AS day
FROM (SELECT event_id,
        CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not a date'
             WHEN 2 THEN '2024-02-30 10:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw
      FROM events) t""")
def coerce_ts(spark, d):
    """Timestamp parse with one format, bad -> NULL; day key."""
    e = R.table(spark, d, "events")
    k = F.col("event_id") % 5
    raw = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "not a date")
            .when(k == 2, "2024-02-30 10:00:00")
            .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    x = e.select("event_id", raw.alias("raw")).withColumn("parsed", K.to_ts("raw"))
    return x.withColumn("day", F.to_date("parsed"))


_PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", sql="""
SELECT o_orderkey, o_totalprice,
""" + ",\n".join(
    [f"  CASE WHEN prio = '{lv}' THEN 1 ELSE 0 END AS \"prio_{lv}\"" for lv in _PRIORITY_LEVELS]
    + [f"  CASE WHEN o_orderstatus = '{lv}' THEN 1 ELSE 0 END AS \"o_orderstatus_{lv}\"" for lv in "FOP"]
    + [f"  CASE WHEN CAST(size AS VARCHAR) = '{lv}' THEN 1 ELSE 0 END AS \"size_{lv}\""
       for lv in ["0.0", "1.0", "2.0"]]) + """
FROM (SELECT o_orderkey, o_totalprice, o_orderstatus,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS prio,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS size
      FROM orders) t""")
def one_hot(spark, d):
    """Levels discovered by one distinct job, then one column per level."""
    o = R.table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("prio"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 3).cast("double")).alias("size"))
    return CL.one_hot(o, ["prio", "o_orderstatus", "size", "not_there"])


@query("drop_guard", sql=f"""
WITH {Q.MERGED}
SELECT quantity, disc, tax, o_totalprice,
       CASE WHEN Obito_MS = 1 AND Tempo < 5 THEN 1 ELSE 0 END AS Target
FROM merged WHERE (Obito_MS = 1 AND Tempo < 5) OR (Obito_MS = 0 OR Tempo >= 5)""")
def drop_guard(spark, d):
    """Drop list (never the target), leakage guard, numeric only."""
    lab = C.label_horizons(merged(spark, d), event_col="Obito_MS", time_col="Tempo", horizons=(5,))
    lab = lab.drop("horizon").withColumnRenamed("exam_ts", "Date Holter")
    out, _ = CL.prepare_model_table(lab, "Target", ["ID", "Name", "Obito_MS", "Time", "Target", "Nat"])
    return out


@query("impute_median", sql="""
WITH src AS (
  SELECT event_id,
         CASE WHEN event_id % 9 <> 0 THEN value END AS value,
         CASE WHEN event_id % 4 <> 0
              THEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) END AS k
  FROM events)
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM src)), 6) AS value,
       round(coalesce(k, (SELECT median(k) FROM src)), 6) AS k
FROM src""")
def impute_median(spark, d):
    """Exact medians (distributed narrowing), all-missing column dropped."""
    e = R.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 4 != 0,
               F.regexp_extract("props", r'"k": (\d+)', 1).cast("double")).alias("k"),
        F.lit(None).cast("double").alias("empty"))
    out, kept = CL.impute_median(e, ["value", "k", "empty"])
    return out.select("event_id", *[K.r6(c).alias(c) for c in kept])


_CC_NOMINAL = "Dist Cond InterVent"
_CC_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("clean_categorical", sql=f"""
WITH x AS (
  SELECT l_orderkey, l_linenumber, o_orderpriority,
         CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN replace(printf('%.2f', l_extendedprice), '.', ',')
              WHEN 1 THEN printf('%.2f', l_extendedprice) WHEN 2 THEN 'n.d.' END AS tsh,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN '3' WHEN '4' THEN 'IV' ELSE 'V' END AS nyha,
         CASE l_linenumber % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'Masculino' WHEN 3 THEN 'Feminino' ELSE '?' END AS sex
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber,
       CASE WHEN regexp_full_match(replace(tsh, ',', '.'), '{NUM_RE}') THEN TRY_CAST(replace(tsh, ',', '.') AS DOUBLE) END AS TSH,
       CAST(CASE nyha WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN '3' THEN 3 WHEN 'IV' THEN 4 END AS DOUBLE) AS NYHA,
       CAST(CASE sex WHEN 'M' THEN 0 WHEN 'Masculino' THEN 0 WHEN 'F' THEN 1 WHEN 'Feminino' THEN 1 END AS DOUBLE) AS Sex,
       {", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS " + chr(34) + f"{_CC_NOMINAL}_{v}" + chr(34) for v in _CC_LEVELS)}
FROM x""")
def clean_categorical(spark, d):
    """B6-B9 as one operator, on text as dirty as the reference's."""
    li = R.table(spark, d, "lineitem")
    x = li.join(R.table(spark, d, "orders"), li.l_orderkey == F.col("o_orderkey"))
    k, n = (F.col("l_orderkey") + F.col("l_linenumber")) % 4, F.col("l_linenumber") % 5
    price, digit = F.format_string("%.2f", "l_extendedprice"), F.substring("o_orderpriority", 1, 1)
    x = x.select(
        "l_orderkey", "l_linenumber",
        F.when(k == 0, F.replace(price, F.lit("."), F.lit(","))).when(k == 1, price).when(k == 2, "n.d.").alias("TSH"),
        F.when(digit == "1", "I").when(digit == "2", "II").when(digit == "3", "3").when(digit == "4", "IV").otherwise("V").alias("NYHA"),
        F.when(n == 0, "M").when(n == 1, "F").when(n == 2, "Masculino").when(n == 3, "Feminino").otherwise("?").alias("Sex"),
        F.col("o_orderpriority").alias(_CC_NOMINAL))
    return CL.clean_categorical(x, levels={_CC_NOMINAL: _CC_LEVELS})
