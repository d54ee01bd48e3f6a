"""Functions that Spark lacks: log-gamma and the normal quantile, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Rational approximation of the normal quantile (relative error below 1.2e-9).
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def gamma(x: Column) -> Column:
    """Gamma for x > 0.5 (Lanczos)."""
    z = x - 1
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + k)
    t = z + 7.5
    return F.sqrt(F.lit(2 * 3.141592653589793)) * F.pow(t, z + 0.5) * F.exp(-t) * series


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    q = F.when((p > 0) & (p < 1), p)
    tail = F.sqrt(-2 * F.ln(F.least(q, 1 - q)))
    outer = _horner(tail, _C) / (_horner(tail, _D) * tail + 1)
    r = (q - 0.5) * (q - 0.5)
    inner = _horner(r, _A) * (q - 0.5) / (_horner(r, _B) * r + 1)
    return F.when(q < 0.02425, outer).when(q > 1 - 0.02425, -outer).otherwise(inner)
