"""The normal distribution function in SQL, for twins."""

from __future__ import annotations

from tickloom.functions.columns import _CDF_LOW, _CDF_TOP


def _horner(coef, x):
    out = repr(coef[0])
    for c in coef[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def normal_sql(z):
    """Φ of a column in SQL, from the same fixed coefficients."""
    a = f"abs({z})"
    near = f"{_horner(_CDF_TOP, a)} / {_horner(_CDF_LOW, a)}"
    far = f"1 / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / sqrt(2 * pi())"
    tail = f"exp(-{z} * {z} / 2) * CASE WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"
