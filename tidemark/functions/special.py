"""Special functions as native column expressions: normal and chi-square distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation to the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_ppf(p: Column) -> Column:
    """The standard normal quantile, to about 1e-9 relative; null outside (0, 1)."""
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    r = q * q
    return F.when(p < 0.02425, _poly(low, _C) / _poly(low, _D)).when(p <= 1 - 0.02425, _poly(r, _A) * q / _poly(r, _B)).otherwise(-_poly(high, _C) / _poly(high, _D))


def normal_ppf_sql(p: str) -> str:
    """The same as SQL text."""

    def poly(x: str, coefficients) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))", f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    return f"CASE WHEN {p} < 0.02425 THEN {poly(low, _C)} / {poly(low, _D)} WHEN {p} <= 1 - 0.02425 THEN {poly(r, _A)} * {q} / {poly(r, _B)} ELSE -{poly(high, _C)} / {poly(high, _D)} END"


def erfc(x: Column) -> Column:
    """Complementary error function by a continued Chebyshev fit (fractional error below 1.2e-7)."""
    # Coefficients of the fit.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    t = 1 / (1 + 0.5 * F.abs(x))
    y = t * F.exp(-x * x + _poly(t, fit))
    return F.when(x >= 0, y).otherwise(2 - y)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def chi2_cdf_even(x: Column, half: int) -> Column:
    """The chi-square distribution function with 2 * half degrees of freedom: 1 - exp(-x/2) * sum (x/2)^i / i!."""
    term, out = F.lit(1.0), F.lit(1.0)
    for i in range(1, half):
        term = term * (x / 2) / i
        out = out + term
    return 1 - F.exp(-x / 2) * out
