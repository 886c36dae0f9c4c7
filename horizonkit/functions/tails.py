"""Tail probabilities of the F and chi-square distributions as column expressions.

The regularised incomplete beta and gamma functions by their continued
fractions (and, left of the mean, the gamma function's series), taken from the
last term back to the first. The number of terms follows the parameters: a
fraction needs a few times the square root of the larger one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms taken at least, and for each unit of the square root of the larger parameter.
TERMS, PER_ROOT = 200, 8
#: Steps by which an argument is moved up before Stirling's series is taken.
SHIFT = 8


def _terms(larger: Column) -> Column:
    return (F.lit(TERMS) + PER_ROOT * F.ceil(F.sqrt(larger))).cast("int")


def _backward(terms: Column, start: Column, step) -> Column:
    """``step(value, m)`` for m from the last term down to 1."""
    return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), start, lambda v, m: step(v, m.cast("double")))


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0, by Stirling's series at ``z + SHIFT``."""
    w = z + SHIFT
    odd = F.lit(1.0) / w
    series = sum(((F.lit(c) * F.pow(odd, F.lit(float(p)))) for c, p in
                  ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9))), F.lit(0.0))
    down = sum((F.log(z + i) for i in range(SHIFT)), F.lit(0.0))
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - down


def beta_share(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function of x at (a, b), with ``rest`` = 1 - x given apart."""
    turn = x >= (a + 1) / (a + b + 2)                      # the fraction is quick left of the mean
    p, q = (F.when(turn, v).otherwise(u) for u, v in ((a, b), (b, a)))
    y, z = (F.when(turn, v).otherwise(u) for u, v in ((x, rest), (rest, x)))

    def term(m: Column) -> Column:
        j = F.floor(m / 2)
        return F.when(m % 2 == 1, -(p + j) * (p + q + j)).otherwise(j * (q - j)) * y / ((p + m - 1) * (p + m))

    fraction = _backward(_terms(F.greatest(p, q)), F.lit(1.0), lambda v, m: 1.0 + term(m) / v)
    lead = F.exp(p * F.log(y) + q * F.log(z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    share = F.when(turn, 1.0 - lead / fraction).otherwise(lead / fraction)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(share)


def gamma_rest(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function of x at a."""
    lead = F.exp(a * F.log(x) - x - log_gamma(a))
    terms = _terms(a)
    series = _backward(terms, F.lit(1.0), lambda v, m: 1.0 + v * x / (a + m)) / a
    fraction = _backward(terms, x + 2.0 * terms.cast("double") + 1.0 - a, lambda v, m: x + 2.0 * m - 1.0 - a - m * (m - a) / v)
    return F.when(x <= 0, 1.0).when(x < a + 1, 1.0 - lead * series).otherwise(lead / fraction)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) for d1 and d2 degrees of freedom; null without any, 0 for an infinite f."""
    f, d1, d2 = (c.cast("double") for c in (f, d1, d2))
    whole = d2 + d1 * f
    share = beta_share(d2 / 2, d1 / 2, d2 / whole, d1 * f / whole)
    return F.when((d1 <= 0) | (d2 <= 0) | F.isnan(f), None).when(f <= 0, 1.0).when(f == float("inf"), 0.0).when(f.isNotNull(), share)


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X > x) for ``dof`` degrees of freedom; without any the test says 1."""
    x, dof = (c.cast("double") for c in (x, dof))
    return F.when(F.isnan(x), None).when(dof <= 0, 1.0).when(x.isNotNull(), gamma_rest(dof / 2, x / 2))
