"""Session construction and the shared folder used for lineage cuts / sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "horizonkit",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session tuned for the library.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    settings below only fill what the cluster left unset.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cfg = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.ansi.enabled": "true",
    }
    if master and master.startswith("local"):  # one JVM: the driver's heap is all there is
        cfg["spark.driver.memory"] = os.environ.get("HORIZONKIT_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        cfg["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    submitted = SparkConf()  # what spark-submit or spark-defaults already set
    for k, v in cfg.items():
        if not submitted.contains(k):
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Read from the session. Where it is unset, a local session (one machine,
    as in tests) gets a scratch folder; a cluster gets an error, because a
    machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="horizonkit-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() or d).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for one write."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    The input is persisted for the duration of the checkpoint: a reliable
    checkpoint writes its files in a second job, which would otherwise
    recompute the whole input.
    """
    shared_dir(df.sparkSession)
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = p.checkpoint(eager=eager)
    if eager:
        p.unpersist()
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, written once and reread.

    Cuts lineage like ``cut_lineage`` with one job and compressed columns;
    a lost executor costs no recomputation of what stands before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
