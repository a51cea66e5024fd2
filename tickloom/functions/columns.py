"""Column helpers shared by every operator. NULL is the only missing value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def number(name: str) -> Column:
    """A numeric reading of any column; text that is no number becomes NULL."""
    return clean(F.col(name).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b with a zero or missing base giving NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def is_true(cond: Column) -> Column:
    """A condition on missing values is false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def clip(x: Column, lo: float | None, hi: float | None) -> Column:
    """Limit to [lo, hi]; missing stays missing."""
    out = x
    if lo is not None:
        out = F.when(out.isNull(), None).otherwise(F.greatest(out, F.lit(float(lo))))
    if hi is not None:
        out = F.when(out.isNull(), None).otherwise(F.least(out, F.lit(float(hi))))
    return out


def both_min(a: Column, b: Column) -> Column:
    """Smaller of two; missing if either is missing (``least`` would skip the missing one)."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.least(a, b))


def both_max(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.greatest(a, b))


def signed_power(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(p)))


def add_filled(a: Column, b: Column, fill: float = 0.0, op: str = "+") -> Column:
    """The lenient arithmetic rule: when exactly one side is missing it counts as ``fill``."""
    fa, fb = F.coalesce(a, F.lit(fill)), F.coalesce(b, F.lit(fill))
    value = {"+": fa + fb, "-": fa - fb, "*": fa * fb}[op]
    return F.when(a.isNull() & b.isNull(), None).otherwise(value)


#: Doubles from here on are whole numbers.
WHOLE = 2.0**52


def _nearest(y: Column) -> Column:
    """The nearest whole number below ``WHOLE``, halves away from zero, in plain arithmetic: ``round`` goes by decimal text."""
    return F.signum(y) * F.shiftright(F.floor(F.abs(y) * 2) + 1, 1).cast("double")


def rounded(x: Column, places: int) -> Column:
    """Half away from zero on the scaled double, as SQL engines do; ``round`` reads the shortest decimal text instead."""
    scale = F.lit(10.0 ** abs(places))
    y = x * scale if places >= 0 else x / scale
    near = F.when(F.abs(y) < WHOLE, _nearest(y)).otherwise(y) + F.lit(0.0)
    return near / scale if places >= 0 else near * scale


def rounded_mean(x: Column, places: int, known: int = 6) -> Column:
    """Aggregate: the mean of values of at most ``known`` decimals, rounded half away from zero.

    The sum is one of whole numbers, so a mean that is an exact half is rounded as such, whatever the order of the rows.
    """
    units = F.sum(rounded(x * F.lit(10.0**known), 0).cast("long"))
    step = F.count(x) * F.lit(10 ** (known - places))  # units of one step of the result, over all rows
    steps = F.floor(F.try_divide(2 * F.abs(units) + step, 2 * step))
    return F.signum(units) * steps.cast("double") / F.lit(10.0**places) + F.lit(0.0)


def tidy(x: Column) -> Column:
    """Round by magnitude so that results compare equal across engines; kills -0.0.

    The tiny stretch moves exact decimal halves off the rounding edge, where engines disagree.
    """
    x = x * F.lit(1.00000000001)
    a = F.abs(x)
    small, middle = _nearest(x * F.lit(1e6)) / F.lit(1e6), _nearest(x * F.lit(100.0)) / F.lit(100.0)
    return F.when(a < 100, small).when(a < 1e6, middle).otherwise(rounded(x, -3)) + F.lit(0.0)


# -- normal distribution ------------------------------------------------------------------

# Coefficients of the rational approximations (Acklam's inverse normal; Hart's
# normal distribution function).
_ICDF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_ICDF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_ICDF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_ICDF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coef: tuple, x: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


_CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_CDF_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def bind(x: Column, body) -> Column:
    """Evaluate ``x`` once and hand it to ``body``: keeps long formulas from copying their input."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function to double precision (Hart's rational form)."""

    def body(v: Column) -> Column:
        z = F.abs(v)
        e = F.exp(-z * z / 2)
        near = e * _poly(_CDF_TOP, z) / _poly(_CDF_LOW, z)
        far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / F.lit(math.sqrt(2 * math.pi))
        tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
        return F.when(v > 0, 1 - tail).otherwise(tail)

    return F.when(x.isNotNull(), bind(x, body))


def normal_icdf(p: Column) -> Column:
    """Inverse of the standard normal distribution function (relative error about 1e-9); NULL outside (0, 1)."""
    return bind(p, _icdf)


def _icdf(p: Column) -> Column:
    q = p - F.lit(0.5)
    r = q * q
    centre = _poly(_ICDF_A, r) * q / (_poly(_ICDF_B, r) * r + F.lit(1.0))
    t_low = F.sqrt(F.lit(-2.0) * F.ln(p))
    low = _poly(_ICDF_C, t_low) / (_poly(_ICDF_D, t_low) * t_low + F.lit(1.0))
    t_high = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    high = -_poly(_ICDF_C, t_high) / (_poly(_ICDF_D, t_high) * t_high + F.lit(1.0))
    return F.when((p <= 0) | (p >= 1) | p.isNull(), None).when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(centre)
