"""Signal text files: one float per line, one file per patient.

Files are read line by line in parallel splits (or whole, optionally); the
sample order is rebuilt from split offsets. The patient id comes from the
file name by a pattern; files whose name does not match are returned as
rejects instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The reference's signal file naming.
DEFAULT_ID_PATTERN = r"^sinal(\d+)\.txt$"
#: Folders over the patients' folders: a listing has a task for each, not one for each patient.
GROUPS = 256


def read_signal_dir(spark: SparkSession, path: str | list[str], id_pattern: str = DEFAULT_ID_PATTERN,
                    on: str = "name", recursive: bool = False,
                    mode: str = "lines") -> tuple[DataFrame, DataFrame]:
    """Return ``(samples, rejects)`` of the files of a folder, or of the named files.

    samples: ``(patient_id LONG, sample_idx LONG, value FLOAT)``; bad tokens
    give NULL values (kept, so indices stay aligned); blank lines are not
    samples. ``on`` = ``"name"`` matches the file name, ``"path"`` the full
    path (partitioned folders).

    ``mode="lines"`` (default) reads files split by split in parallel and
    rebuilds the sample index from each split's start offset: lines inside a
    split arrive in order, so index = lines in earlier splits of the file +
    position inside the split. Several files of one patient are one signal, in the
    order of their names. ``mode="whole"`` reads each file as one value (and numbers each by itself).
    """
    src = F.col("_metadata.file_name") if on == "name" else F.col("_metadata.file_path")
    if mode == "whole":
        # text() sets its own defaults for these, so they are passed as arguments
        r = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=recursive)
        files = r.select(src.alias("file"), F.trim(F.col("value")).alias("body"))
        files = files.withColumn("__pid", F.regexp_extract(F.col("file"), id_pattern, 1))
        ok = files.where(F.col("__pid") != "")
        toks = (ok.select(F.col("__pid").cast("long").alias("patient_id"),
                          F.posexplode(F.filter(F.split(F.col("body"), r"\s+"), lambda t: t != "")).alias("sample_idx", "tok")))
    else:
        r = spark.read.text(path, pathGlobFilter="*.txt", recursiveFileLookup=recursive)
        lines = (r.select(src.alias("file"), F.col("_metadata.file_block_start").alias("__blk"),
                          F.monotonically_increasing_id().alias("__mid"), F.trim("value").alias("tok"))
                  .withColumn("__pid", F.regexp_extract(F.col("file"), id_pattern, 1)))
        files = lines.select("file", "__pid")
        ok = lines.where((F.col("__pid") != "") & (F.col("tok") != ""))
        # dealt once: as the count names every column that the numbering needs, both read one shuffle and a file is opened once
        ok = ok.repartition("file", "__blk")
        blocks = ok.groupBy("__pid", "file", "__blk").agg(F.count_if((F.col("tok") != "") & (F.col("__mid") >= 0)).alias("__n"))
        # splits of a patient: its files in the order of their names, and inside a file by offset
        w = Window.partitionBy("__pid").orderBy("file", "__blk").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__pid")
        # numbered after blank lines are gone, inside one split of one file
        place = F.row_number().over(Window.partitionBy("file", "__blk").orderBy("__mid")) - 1
        toks = (ok.withColumn("__at", place).join(blocks, ["file", "__blk"])
                  .select(F.col("__pid").cast("long").alias("patient_id"),
                          (F.col("__off") + F.col("__at")).alias("sample_idx"), "tok"))
    rejects = files.where(F.col("__pid") == "").select("file").distinct()
    samples = toks.select("patient_id", F.col("sample_idx").cast("long").alias("sample_idx"),
                          F.col("tok").try_cast("float").alias("value"))
    return samples, rejects


def write_signal_dir(df: DataFrame, path: str, key: str, idx: str, value: str, fmt: str | None = None) -> None:
    """Write one text folder per patient (``__group=<g>/key=<id>/part-<task>-*.txt``), samples in order.

    Values keep all their digits unless ``fmt`` is given. Rows are dealt to tasks by ranges of
    (group, patient, sample): a long signal is written by several tasks, and as a
    file's name begins with its task's number, the names' order is the samples'.
    Patients are dealt to at most ``GROUPS`` folders, by a hash. There are as many tasks as a shuffle has
    partitions however short the samples are, as it is the number of files that takes the time.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.xxhash64(F.col(key)), F.lit(GROUPS)).alias("__group")
    (df.select(group, key, idx, (F.format_string(fmt, F.col(value)) if fmt else F.col(value).cast("string")).alias("value"))
       .repartitionByRange(tasks, "__group", key, idx).sortWithinPartitions("__group", key, idx)
       .drop(idx).write.mode("overwrite").partitionBy("__group", key).text(path))
