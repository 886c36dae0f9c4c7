"""Feature-target association in long form (one pass for all features).

The reference loops over columns, filtering pairs and calling a test per
column. Here the table is unpivoted once to ``(feature, x, level, y)`` and
every statistic is a ``groupBy(feature, ...)`` with partial aggregation, so
work spreads over features *and* rows, and a wide table never becomes a
single wide aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horizonkit.functions import tails as TL
from horizonkit.functions.coerce import nan_to_null
from horizonkit.session import cut_lineage

# A numeric column with at least this many distinct values is
# tested as numeric, otherwise as categorical (reference rule).
MIN_NUMERIC_LEVELS = 10


def to_long(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """``(feature, is_num, x, level, y)`` with missing pairs removed.

    ``x`` holds numeric values, ``level`` text values (the other is NULL).
    """
    structs = []
    for c in features:
        dt = df.schema[c].dataType
        num = isinstance(dt, T.NumericType)
        v = F.col(f"`{c}`")
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            v = nan_to_null(v)
        structs.append(F.struct(
            F.lit(c).alias("feature"), F.lit(num).alias("is_num"),
            (v.cast("double") if num else F.lit(None).cast("double")).alias("x"),
            (F.lit(None).cast("string") if num else v.cast("string")).alias("level")))
    y = F.col(f"`{target}`")
    if isinstance(df.schema[target].dataType, (T.DoubleType, T.FloatType)):
        y = nan_to_null(y)
    long = df.select(y.alias("y"), F.explode(F.array(*structs)).alias("kv"))
    return (long.select("kv.*", "y")
                .where(F.col("y").isNotNull() & (F.col("x").isNotNull() | F.col("level").isNotNull())))


def raw_cells(long: DataFrame) -> DataFrame:
    """Observed cells keyed by the raw value: ``(feature, x, level, y, o)``.

    Numeric values are grouped as doubles (so -0.0 and 0.0 are one level, as
    in pandas); routing and the contingency table both read this one
    aggregate, so a plan that needs both shares its shuffle.
    """
    return long.groupBy("feature", "x", "level", "y").agg(F.count("*").alias("o"))


def contingency(cells: DataFrame) -> DataFrame:
    """``(feature, level, y, o)``; numeric levels become text only here."""
    return cells.select("feature", F.coalesce(F.col("level"), F.col("x").cast("string")).alias("level"),
                        "y", "o")


def route(cells: DataFrame, numeric: dict[str, bool]) -> DataFrame:
    """``(feature, n, n_unique, kind)``; kind numeric / categorical / skip.

    The distinct count is exact (from the per-level table), so a column is
    never flipped across the 1 / 10 limits by an approximate sketch. Whether a
    column is numeric comes from the schema (``numeric``), not from a scan.
    """
    per_level = cells.groupBy("feature", "x", "level").agg(F.sum("o").alias("n"))
    uniq = per_level.groupBy("feature").agg(F.count("*").alias("n_unique"), F.sum("n").alias("n"))
    names = [x for k, v in numeric.items() for x in (F.lit(k), F.lit(bool(v)))]
    is_num = F.coalesce(F.create_map(*names)[F.col("feature")], F.lit(False))
    kind = (F.when(F.col("n_unique") <= 1, "skip")
             .when(is_num & (F.col("n_unique") >= MIN_NUMERIC_LEVELS), "numeric")
             .otherwise("categorical"))
    return uniq.select("feature", F.col("n").cast("long").alias("n"),
                       F.col("n_unique").cast("long").alias("n_unique"), kind.alias("kind"))


def proven_numeric(long: DataFrame) -> DataFrame:
    """``(feature)`` of numeric columns that surely have ``MIN_NUMERIC_LEVELS`` values.

    Each value sets one bit of 64; that many set bits need that many values.
    One word per feature leaves a task, whatever the column holds; a column
    that isn't proven here is counted exactly elsewhere.
    """
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(x + 0.0D), 64) as int))")  # -0.0 and 0.0 are one value
    return (long.where(F.col("is_num")).groupBy("feature").agg(F.bit_or(bit).alias("bits"))
                .where(F.bit_count("bits") >= MIN_NUMERIC_LEVELS).select("feature"))


def doubtful_cells(long: DataFrame, proven: DataFrame) -> DataFrame:
    """Raw cells of the other columns. ``proven`` has a row per column of the table, so it is broadcast."""
    return raw_cells(long.join(F.broadcast(proven), "feature", "left_anti"))


def kinds(long: DataFrame, numeric: dict[str, bool], proven: DataFrame | None = None,
          cells: DataFrame | None = None) -> DataFrame:
    """``(feature, kind)`` as ``route`` gives it, raw values grouped only where the kind is in doubt."""
    proven = proven if proven is not None else proven_numeric(long)
    cells = cells if cells is not None else doubtful_cells(long, proven)
    return (proven.select("feature", F.lit("numeric").alias("kind"))
                  .unionByName(route(cells, numeric).select("feature", "kind")))


def bounded_kinds(long: DataFrame) -> DataFrame:
    """``(feature, n, constant, kind)`` as ``route`` gives it, without an exchange on the values of wide columns.

    One aggregate of fixed size per feature: ten set bits of 64 prove ten
    values, and two hashes prove two. Only a numeric column that shows
    fewer bits than ``MIN_NUMERIC_LEVELS``, and a text column that shows one hash,
    have their values grouped, and few values are few groups.
    """
    value = F.when(F.col("is_num"), F.xxhash64(F.expr("x + 0.0D"))).otherwise(F.xxhash64("level"))  # -0.0 and 0.0 are one value
    per = cut_lineage(long.withColumn("h", value).groupBy("feature", "is_num").agg(
        F.count("*").alias("n"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 64) as int))"))).alias("bits"),
        (F.bit_or("h") == F.bit_and("h")).alias("alike")))  # a row per column of the table
    doubt = per.where(F.when(F.col("is_num"), F.col("bits") < MIN_NUMERIC_LEVELS).otherwise(F.col("alike"))).select("feature")
    levels = (long.join(F.broadcast(doubt), "feature", "left_semi").groupBy("feature", F.expr("x + 0.0D"), "level").count()
              .groupBy("feature").agg(F.count("*").alias("levels")))
    many = (F.col("bits") >= MIN_NUMERIC_LEVELS) | (F.col("levels") >= MIN_NUMERIC_LEVELS)
    out = per.join(levels, "feature", "left").withColumn("constant", F.coalesce(F.col("levels") == 1, F.lit(False)))
    kind = F.when(F.col("constant"), "skip").when(F.col("is_num") & many, "numeric").otherwise("categorical")
    return out.select("feature", "n", "constant", kind.alias("kind"))


def numeric_tests(long: DataFrame, routes: DataFrame) -> DataFrame:
    """Point-biserial r, |r|, ANOVA F per numeric feature, one pass.

    A single ``groupBy(feature, y)`` gives per-class counts, means and
    population variances (stable aggregates); everything else is algebra on
    that small table: ``SSB = Σ n_c (m_c - m)²``, ``SSW = Σ n_c var_c``,
    ``cov(x, y) = Σ n_c (m_c - m)(y_c - ȳ) / n``, ``var(x) = (SSB + SSW) / n``.
    """
    # aggregate every numeric-typed feature first; the route filter is applied
    # to the small per-feature result, so this scan does not wait for routing
    num = long.where(F.col("is_num"))
    cls = num.groupBy("feature", "y").agg(F.count("*").alias("nc"), F.avg("x").alias("mc"),
                                          F.var_pop("x").alias("vc"))
    yc = F.col("y").cast("double")
    wf = Window.partitionBy("feature")                 # one row per class: tiny partitions
    j = (cls.withColumn("n", F.sum("nc").over(wf))
            .withColumn("m", F.sum(F.col("nc") * F.col("mc")).over(wf) / F.col("n"))
            .withColumn("my", F.sum(F.col("nc") * yc).over(wf) / F.col("n"))
            .withColumn("k", F.count("*").over(wf)))
    ss = j.groupBy("feature", "n", "k").agg(
        F.sum(F.col("nc") * (F.col("mc") - F.col("m")) ** 2).alias("ssb"),
        F.sum(F.col("nc") * F.col("vc")).alias("ssw"),
        F.sum(F.col("nc") * (F.col("mc") - F.col("m")) * (yc - F.col("my"))).alias("sxy"),
        F.sum(F.col("nc") * (yc - F.col("my")) ** 2).alias("syy"))
    sxx = F.col("ssb") + F.col("ssw")
    r = F.when((sxx > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(sxx * F.col("syy")))
    d1 = F.col("k") - 1
    d2 = F.col("n") - F.col("k")
    # one class: no test (NULL); classes apart without any spread inside: infinitely significant
    f = F.when(F.col("ssw") > 0, F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2))
               ).when((F.col("ssb") > 0) & (d1 > 0), F.lit(float("inf")))
    out = ss.select("feature", F.col("n").cast("long").alias("n"), r.alias("r"), F.abs(r).alias("abs_r"),
                    f.alias("anova_f"), d1.cast("double").alias("df1"), d2.cast("double").alias("df2"))
    return out.join(routes.where(F.col("kind") == "numeric").select("feature"), "feature")


def categorical_tests(cells: DataFrame, routes: DataFrame) -> DataFrame:
    """Chi-square over the full level x class grid, Yates when dof = 1,
    and Cramér's V. Unobserved cells are materialised by joining the level
    and class margins of each feature (levels x classes rows, not pairs)."""
    cats = routes.where(F.col("kind") == "categorical").select("feature")
    cells = contingency(cells.join(cats, "feature"))
    rows = cells.groupBy("feature", "level").agg(F.sum("o").alias("rs"))
    cols = cells.groupBy("feature", "y").agg(F.sum("o").alias("cs"))
    dims = (rows.groupBy("feature").agg(F.count("*").alias("nr"), F.sum("rs").alias("n"))
                .join(cols.groupBy("feature").agg(F.count("*").alias("nc")), "feature"))
    grid = (rows.join(cols, "feature")
                .join(cells, ["feature", "level", "y"], "left")
                .join(dims, "feature")
                .withColumn("o", F.coalesce(F.col("o"), F.lit(0)))
                .withColumn("e", F.col("rs") * F.col("cs") / F.col("n"))
                .withColumn("dof", (F.col("nr") - 1) * (F.col("nc") - 1)))
    dev = F.abs(F.col("o") - F.col("e"))
    adj = F.when(F.col("dof") == 1, dev - F.least(F.lit(0.5), dev)).otherwise(dev)
    chi = grid.groupBy("feature", "n", "nr", "nc", "dof").agg(
        F.sum(F.when(F.col("dof") > 0, adj * adj / F.col("e")).otherwise(0.0)).alias("chi2"))
    min_dim = F.least(F.col("nr"), F.col("nc")) - 1
    v = F.sqrt(F.col("chi2") / (F.col("n") * F.when(min_dim > 0, min_dim).otherwise(1)))
    return chi.select("feature", F.col("n").cast("long").alias("n"), F.col("dof").cast("long").alias("dof"),
                      "chi2", v.alias("cramers_v"))


def with_pvalues(num: DataFrame | None = None, cat: DataFrame | None = None):
    """Add p-values (column expressions on the per-feature rows)."""
    out = []
    if num is not None:
        out.append(num.withColumn("p_anova", TL.f_tail(F.col("anova_f"), F.col("df1"), F.col("df2"))))
    if cat is not None:
        out.append(cat.withColumn("p_chi2", TL.chi2_tail(F.col("chi2"), F.col("dof"))))
    return out


def associate_long(long: DataFrame, numeric: dict[str, bool]):
    """Same as ``associate`` for data already in long form
    ``(feature, is_num, x, level, y)`` (e.g. an exploded array column).

    The exact distinct counts of the routes table group raw values of every
    column; the two test tables need the kind alone and don't.
    """
    long = long.where(F.col("y").isNotNull() & (F.col("x").isNotNull() | F.col("level").isNotNull()))
    proven = proven_numeric(long)
    cells = doubtful_cells(long, proven)
    kind = kinds(long, numeric, proven, cells)
    return route(raw_cells(long), numeric), numeric_tests(long, kind), categorical_tests(cells, kind)


def associate(df: DataFrame, target: str, ignore: list[str] | None = None):
    """The whole per-column loop: returns (routes, numeric table, categorical table)."""
    ignore = set(ignore or []) | {target}
    feats = [c for c in df.columns if c not in ignore]
    numeric = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in feats}
    return associate_long(to_long(df, target, feats), numeric)


def rank(table: DataFrame, score: str, n: int = 20, ascending: bool = False,
         label: str | None = None) -> DataFrame:
    """Top-n by score (feature name breaks ties)."""
    o = F.col(score).asc() if ascending else F.col(score).desc()
    top = table.orderBy(o, F.col("feature").asc()).limit(n)
    w = Window.orderBy(o, F.col("feature").asc())          # over <= n rows
    out = top.select("feature", F.col(score).alias("score"), F.row_number().over(w).alias("rank"))
    return out.withColumn("table", F.lit(label or score)) if label is not None else out
