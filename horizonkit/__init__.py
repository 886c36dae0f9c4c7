"""horizonkit — cohort and time-series feature analytics as Spark jobs.

Sub-packages:

* ``sources``   — table, signal-file and result scans; sinks.
* ``functions`` — column expressions (coercion, metrics, tail probabilities).
* ``operators`` — DataFrame -> DataFrame operators (cohort merge, cleaning,
  statistics, association, evaluation, splits, HRV windows, ML stages).
* ``plans``     — named queries over the driver tables and their SQL oracles.
* ``streaming`` — incremental driver for the signal-feature job.
"""

from horizonkit.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
