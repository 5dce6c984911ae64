"""Tails of distributions as column expressions, for the p-values of tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fractions and of the series.
STEPS = 200
#: By how much the argument of the logarithm of the gamma function is raised before its series is used.
RAISED = 10


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by the asymptotic series of a raised argument."""
    below = F.lit(0.0)
    for k in range(RAISED):
        below = below + F.ln(x + k)
    y = x + RAISED
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its end: d_k / (1 + ...)."""
    def step(f: Column, i: Column) -> Column:
        k = F.lit(STEPS) - i
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.lit(1.0) + F.when(k % 2 == 0, even).otherwise(odd) / f

    return 1 / F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), F.lit(1.0), step)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function, 0 <= x <= 1."""
    front = F.exp(a * F.ln(x) + b * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    near = front * _fraction(a, b, x) / a
    far = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def student(t: Column, df: Column) -> Column:
    """The two-sided p-value of Student's t; null where there are no degrees of freedom."""
    t, df = t.cast("double"), df.cast("double")
    return F.when(df > 0, incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5)))


def normal(z: Column) -> Column:
    """The two-sided p-value of a standard normal deviate."""
    x = F.abs(z.cast("double")) / math.sqrt(2)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(x.alias("term"), x.alias("sum")), lambda s, n: F.struct((s["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * n + 1)).alias("sum")))
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * terms["sum"]
    far = F.exp(-x * x) / math.sqrt(math.pi) / F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), x, lambda f, i: x + (F.lit(STEPS) - i) / 2 / f)
    return F.when(x < 2, near).otherwise(far)
