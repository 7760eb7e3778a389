"""Digamma, trigamma and the inverse of trigamma as column expressions.

Recurrence up to x + 6, then the asymptotic series (Abramowitz & Stegun 6.3.18,
6.4.12). Pass a plain column: the argument appears many times in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SHIFT = 6


def _shifted_sum(x: Column, power: int) -> Column:
    total = F.lit(0.0)
    for i in range(_SHIFT):
        total = total + F.lit(1.0) / F.pow(x + float(i), F.lit(float(power)))
    return total


def digamma(x: Column) -> Column:
    z = x + float(_SHIFT)
    r = F.lit(1.0) / (z * z)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132)))))
    return F.ln(z) - F.lit(0.5) / z - series - _shifted_sum(x, 1)


def trigamma(x: Column) -> Column:
    z = x + float(_SHIFT)
    r = F.lit(1.0) / (z * z)
    series = F.lit(1.0) + r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66)))))
    return series / z + F.lit(0.5) * r + _shifted_sum(x, 2)


def tetragamma(x: Column) -> Column:
    z = x + float(_SHIFT)
    r = F.lit(1.0) / (z * z)
    series = F.lit(0.5) - r * (1 / 6 - r * (1 / 6 - r * (3 / 10 - r * (5 / 6))))
    return -r - r / z - r * r * series - F.lit(2.0) * _shifted_sum(x, 3)


def trigamma_inverse(x: Column, steps: int = 8) -> Column:
    """y with trigamma(y) = x, by a fixed number of Newton steps.

    The loop is an array fold, so each step sees its predecessor as a bound
    variable and the expression does not grow with the number of steps.
    """

    def step(y: Column, _: Column) -> Column:
        tri = trigamma(y)
        return y + tri * (F.lit(1.0) - tri / x) / tetragamma(y)

    newton = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.lit(0.5) + F.lit(1.0) / x, step
    )
    return (
        F.when(x > 1e7, F.lit(1.0) / F.sqrt(x))
        .when(x < 1e-6, F.lit(1.0) / x)
        .otherwise(newton)
    )
