"""The normal distribution as columns, by rational approximations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of published approximations. The distribution's error is
# below 7.5e-8, that of its inverse below 1.2e-9 of the result.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_SCALE = 0.2316419
MIDDLE_UP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
MIDDLE_DOWN = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
ENDS_UP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ENDS_DOWN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
ENDS = 0.02425


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """By falling powers."""
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def cdf(x: Column) -> Column:
    t = 1 / (F.abs(x) * TAIL_SCALE + 1)
    upper = F.exp(-x * x / 2) / F.sqrt(F.lit(2) * F.pi()) * polynomial(t, (*reversed(TAIL), 0.0))
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def quantile(p: Column) -> Column:
    """Null outside (0, 1)."""
    q = p - 0.5
    r = q * q
    middle = polynomial(r, MIDDLE_UP) * q / polynomial(r, MIDDLE_DOWN)
    end = lambda share: (lambda s: polynomial(s, ENDS_UP) / polynomial(s, ENDS_DOWN))(F.sqrt(F.log(share) * -2))
    inside = (p > 0) & (p < 1)
    return F.when(inside & (p < ENDS), end(p)).when(inside & (p > 1 - ENDS), -end(1 - p)).when(inside, middle)
