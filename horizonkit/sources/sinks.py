"""Sinks: feature tables, per-horizon data, fitted pipelines, summaries, reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, order: list[str], fmt: str = "parquet",
                   mode: str = "overwrite") -> None:
    """A5: fixed column order, header once (CSV); overwrite by default."""
    w = df.select(*[F.col(f"`{c}`") for c in order]).write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


#: Folders that a task writes side by side; beyond them its other rows are sorted by folder.
OPEN_HORIZONS = 16
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def write_horizons(df: DataFrame, path: str, horizon_col: str = "horizon", fmt: str = "parquet") -> None:
    """One folder per horizon (partition pruning replaces per-file names).

    A task holds a file open for each horizon instead of sorting its rows by horizon, which
    took memory by the rows of a task. Open Parquet files hold row groups of 32 MB at most.
    """
    conf = df.sparkSession.conf
    before = conf.get(_OPEN)
    w = df.write.mode("overwrite").partitionBy(horizon_col)
    w = w.option("header", True) if fmt == "csv" else w.option("parquet.block.size", 32 << 20)
    conf.set(_OPEN, str(max(OPEN_HORIZONS, int(before))))
    try:
        w.format(fmt).save(path)
    finally:
        conf.set(_OPEN, before)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A merged table."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_test_split(test: DataFrame, features: list[str], folder: str) -> None:
    """The held-out rows of a horizon, and the names of its features in their order."""
    write_table(test, f"{folder}/test")
    names = test.sparkSession.createDataFrame(list(enumerate(features)), "place int, feature string")
    write_table(names.coalesce(1), f"{folder}/features")


def read_test_split(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    names = spark.read.parquet(f"{folder}/features").orderBy("place").collect()  # a row for each column
    return spark.read.parquet(f"{folder}/test"), [r["feature"] for r in names]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``(horizon_dir, model_dir)`` of the folders that hold both a summary and a fitted pipeline.

    Only file names are read; a folder with one of the two is left out.
    """
    def dirs(pattern: str, inner: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*/{pattern}").select("path")
        found = [F.regexp_extract("path", rf"/([^/]+)/([^/]+)/{inner}/[^/]*$", i) for i in (1, 2)]
        return files.select(found[0].alias("horizon_dir"), found[1].alias("model_dir")).distinct()

    return dirs("summary/*.json", "summary").join(dirs("pipeline/metadata/part-*", "pipeline/metadata"), ["horizon_dir", "model_dir"])


def read_report(spark: SparkSession, root: str) -> DataFrame:
    """The text reports below ``root/<horizon>/<model>/report``, tagged by path."""
    schema = "class string, precision double, recall double, f1 double, support long"
    df = spark.read.option("header", True).schema(schema).csv(f"{root.rstrip('/')}/*/*/report")
    p = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(p, r"/([^/]+)/([^/]+)/report/", 1).alias("horizon_dir"),
                     F.regexp_extract(p, r"/([^/]+)/report/", 1).alias("model_dir"), "*")


def save_pipeline(model: PipelineModel, path: str) -> None:
    """A10."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


SUMMARY_SCHEMA = ("model_name string, best_k_features int, optimal_threshold string, threshold double, "
                  "best_hyperparameters map<string,string>, selected_features array<string>, "
                  "classification_report array<struct<class:string,precision:double,recall:double,"
                  "f1:double,support:long>>")


def summary_frame(spark: SparkSession, model_name: str, k: int, threshold: float, params: dict,
                  features: list[str], report: DataFrame) -> DataFrame:
    """One summary row; the report (classes + 3 rows) is nested in it."""
    rep = [(r["class"], r["precision"], r["recall"], r["f1"], r["support"])
           for r in report.select("class", "precision", "recall", "f1", "support").collect()]
    return spark.createDataFrame(
        [(model_name, int(k), f"{threshold:.4f}", float(threshold),
          {str(a): str(b) for a, b in params.items()}, list(features), rep)], SUMMARY_SCHEMA)


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Discover ``root/<horizon>/<model>/summary*`` and tag rows by path."""
    df = spark.read.schema(SUMMARY_SCHEMA).json(f"{root.rstrip('/')}/*/*/summary")
    p = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(p, r"/([^/]+)/([^/]+)/summary/", 1).alias("horizon_dir"),
                     F.regexp_extract(p, r"/([^/]+)/summary/", 1).alias("model_dir"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as a small CSV (one file)."""
    report.select("class", "precision", "recall", "f1", "support").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
