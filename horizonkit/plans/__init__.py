"""Named queries over the driver tables (``queries``) and DuckDB oracles."""

from __future__ import annotations

import importlib

from horizonkit.plans.registry import ORACLES, QUERIES

_MODULES = ["q_cohort", "q_clean", "q_metrics", "q_assoc", "q_hrv", "q_ml", "q_io"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"horizonkit.plans.{m}")


def all_queries():
    load_all()
    return dict(QUERIES)


def all_oracles():
    load_all()
    return dict(ORACLES)
