"""Incremental signal-feature job (Structured Streaming).

The reference processes a folder of signal files in one batch. Here the same
batch job runs per micro-batch over files as they arrive: every file is
one patient's complete signal, so each micro-batch is independent (no state
across batches) and ``foreachBatch`` writes the per-patient features as one
``batch_id`` partition of a table in the shared folder. The stream carries
file names alone; a batch reads its files line by line in parallel splits. The streaming
checkpoint makes the job restart where it stopped; a batch that is replayed
overwrites its own partition, so no row appears twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from horizonkit.operators import hrv as H
from horizonkit.session import shared_dir
from horizonkit.sources import signals as SG
from horizonkit.sources.signals import DEFAULT_ID_PATTERN

_FILE = "path string, modificationTime timestamp, length long, content binary"


def features_from_files(spark: SparkSession, files: list[str], window_samples: int, rate: float, id_pattern: str = DEFAULT_ID_PATTERN,
                        clean_args: dict | None = None, peak_args: dict | None = None,
                        freq_args: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Signal files -> ``(features, rejects)``: mean and std of all window families per patient, and the files whose name is no patient's."""
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in files]  # a name is no pattern
    samples, rejects = SG.read_signal_dir(spark, plain, id_pattern)
    return H.signal_features(samples, "patient_id", "sample_idx", "value", window_samples, rate,
                             clean_args, peak_args, freq_args), rejects


def start(spark: SparkSession, in_dir: str, out_dir: str, *, window_samples: int = 259_200,
          rate: float = 480.0, id_pattern: str = DEFAULT_ID_PATTERN, checkpoint: str | None = None,
          available_now: bool = True, clean_args: dict | None = None, peak_args: dict | None = None,
          freq_args: dict | None = None, files_per_batch: int = 1000, rejects_dir: str | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    A batch takes at most ``files_per_batch`` files, whose names alone come to
    the driver; the other files wait for the next batch. ``rejects_dir``:
    where the names of files without a patient are written, by batch too.
    """
    checkpoint = checkpoint or f"{shared_dir(spark)}/signal-stream-checkpoint"
    src = (spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.txt")
                .option("maxFilesPerTrigger", files_per_batch).load(in_dir).select("path"))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        files = sorted(r["path"] for r in batch.distinct().collect())
        if not files:
            return
        out, rejects = features_from_files(batch.sparkSession, files, window_samples, rate, id_pattern, clean_args, peak_args, freq_args)
        out.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={epoch_id}")
        if rejects_dir:
            rejects.write.mode("overwrite").parquet(f"{rejects_dir.rstrip('/')}/batch_id={epoch_id}")

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
