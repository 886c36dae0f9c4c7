"""The incremental signal-feature job processes arriving files once each."""

import math
import os
import tempfile

import numpy as np

from horizonkit.streaming import signal_stream as SS


def _write_signal(path, n, period, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = np.where(t % period == 0, 10.0, 0.0) + rng.normal(0, 0.05, n)
    with open(path, "w") as f:
        f.write("\n".join(f"{v:.4f}" for v in x))


def test_stream_appends_features_per_file(spark):
    root = tempfile.mkdtemp(prefix="hk-stream-")
    src, out, ck = (os.path.join(root, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    _write_signal(os.path.join(src, "sinal1.txt"), 400, 20, 1)
    _write_signal(os.path.join(src, "sinal2.txt"), 300, 25, 2)
    _write_signal(os.path.join(src, "other.txt"), 300, 25, 3)          # rejected by name
    args = dict(window_samples=100, rate=100.0, checkpoint=ck,
                clean_args={"a": 0, "b": 3}, peak_args={"c": 1, "k": 1.5, "refractory": 5})
    args |= dict(rejects_dir=os.path.join(root, "rejects"), files_per_batch=2)
    q = SS.start(spark, src, out, **args)
    q.awaitTermination()
    assert [r.file for r in spark.read.parquet(args["rejects_dir"]).collect()] == ["other.txt"]
    assert {r.batch_id for r in spark.read.parquet(out).collect()} <= {0, 1}
    rows = {r.patient_id: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].n_windows == 4 and rows[2].n_windows == 3
    assert math.isclose(rows[1].HRV_MeanNN, 200.0, rel_tol=0.05)       # ~20 samples at 100 Hz
    assert math.isclose(rows[2].HRV_MeanNN, 250.0, rel_tol=0.05)
    # every family, as the batch job over the folder gives it
    from horizonkit.operators import hrv as H
    from horizonkit.sources import signals as SG
    samples, _ = SG.read_signal_dir(spark, src)
    batch = H.signal_features(samples, "patient_id", "sample_idx", "value", 100, 100.0, args["clean_args"], args["peak_args"])
    for r in batch.collect():
        for c in batch.columns:
            assert (r[c] is None and rows[r.patient_id][c] is None) or math.isclose(r[c], rows[r.patient_id][c], rel_tol=1e-9, abs_tol=1e-9), c
    # a second run with no new files appends nothing
    SS.start(spark, src, out, **args).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_signal_scan_lines_equals_whole_across_splits(spark):
    """Line mode rebuilds the sample order across many small splits."""
    from horizonkit.sources import signals as SG
    root = tempfile.mkdtemp(prefix="hk-sig-")
    vals = {3: [float(i % 17) + 0.25 for i in range(5000)], 12: [float(i) for i in range(700)]}
    for pid, vs in vals.items():
        with open(os.path.join(root, f"sinal{pid}.txt"), "w") as f:
            f.write("\n".join(f"{v:.2f}" for v in vs) + "\n\n")
    with open(os.path.join(root, "notes.txt"), "w") as f:
        f.write("1\n2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")          # force many splits per file
    try:
        lines, rej = SG.read_signal_dir(spark, root, mode="lines")
        got = {(r.patient_id, r.sample_idx): r.value for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole, _ = SG.read_signal_dir(spark, root, mode="whole")
    exp = {(r.patient_id, r.sample_idx): r.value for r in whole.collect()}
    assert got == exp and len(got) == 5700
    assert [r.file for r in rej.collect()] == ["notes.txt"]
