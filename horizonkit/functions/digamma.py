"""Digamma at positive integers as a JVM expression, and of an array.

psi(n) = H(n-1) - gamma. Small n use the exact harmonic numbers (built by
rule below); larger n use the asymptotic series, accurate to ~1e-13 there.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329
_EXACT_UPTO = 20


def _harmonic(n: int) -> float:
    return math.fsum(1.0 / k for k in range(1, n + 1))


def digamma_int(n: Column) -> Column:
    x = n.cast("double")
    table = F.create_map(*[v for i in range(1, _EXACT_UPTO + 1)
                           for v in (F.lit(i), F.lit(_harmonic(i - 1) - EULER_GAMMA))])
    asym = (F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4))
            - 1 / (252 * F.pow(x, 6)))
    return F.when(n <= _EXACT_UPTO, table[n.cast("int")]).otherwise(asym)


def digamma_of(n: np.ndarray) -> np.ndarray:
    """The same values for an array of integers; 0 below 1, where there is none."""
    x = np.maximum(n, 1).astype(np.float64)
    table = np.array([0.0, *(_harmonic(i - 1) - EULER_GAMMA for i in range(1, _EXACT_UPTO + 1))])
    asym = np.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6)
    return np.where(n <= _EXACT_UPTO, table[np.clip(n, 0, _EXACT_UPTO)], asym)
