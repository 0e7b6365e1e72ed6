"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is zero or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines do: times a power of ten, to the nearest whole number (halves away from zero), divided again.

    ``F.round`` rounds the shortest decimal text instead: 1.005 becomes 1.01 there, and 1.0 here, as 1.005 * 100 is below 100.5.
    """
    power = F.lit(10.0**digits)
    out = F.round(x * power) / power
    return F.when(F.abs(out) == float("inf"), x).otherwise(out)


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, with minus zero as zero: for comparisons between engines."""
    return F.round(x, digits) + F.lit(0.0)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the Abramowitz-Stegun polynomial 7.1.26 (error below 1e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)
