"""The 101 formulaic alphas on daily bars.

Fixed values: windows, weights and thresholds are those of the published formulas, with the
daily-bar approximations users already rely on (78, 85 and 94 keep the base and only the sign of
the exponent; 84 limits the exponent to ±3; VWAP falls back to the close).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import clean
from tickloom.functions.factor import (
    Factor, absolute, argmax, argmin, col, const, corr, cov, decay, delay, delta, emax, emin, filled, highest,
    ln, lowest, mean, power, product, rank, returns, scale, sign, signed_power, sqrt, std, total, truth, ts_rank, where,
)
from tickloom.plans.factors import Layout, evaluate

O, H, L, C, V = (col(c) for c in ("open", "high", "low", "close", "volume"))
VWAP = filled(col("amount") / V, C)
RET = returns(C)
LOGV = ln(emax(V, 1.0))
ADV20 = mean(V, 20)
D1 = delta(C, 1)
MID = (H + L) / 2.0
ONE, NIL = const(1.0), const(0.0)

#: These need an industry class or a market value that daily bars do not carry.
NOT_COMPUTED = (48, 56, 58, 59, 63, 67, 69, 76, 79, 80, 82, 87, 89, 90, 91, 93, 97, 100)


def adv(n: int) -> Factor:
    return mean(V, n)


def below(left: Factor, right: Factor, value: float = -1.0) -> Factor:
    """``value`` where left < right, else 0; unknown comparisons are 0."""
    return truth(left < right) * value


def slope_turn() -> Factor:
    """Slope of the older ten days minus slope of the newer ten."""
    return (delay(C, 20) - delay(C, 10)) / 10.0 - (delay(C, 10) - C) / 10.0


def _signed_move(n: int) -> Factor:
    """Trend-following when the last n moves agree, else contrarian."""
    return where(highest(D1, n) < NIL, D1, where(lowest(D1, n) <= NIL, -D1, D1))


def _alpha7() -> Factor:
    move = delta(C, 7)
    return where(ADV20 < V, -ts_rank(absolute(move), 60) * sign(move), -1.0)


def _alpha21() -> Factor:
    m8, s8, m2 = mean(C, 8), std(C, 8), mean(C, 2)
    inside = (m2 >= m8 - s8) & (m8 + s8 >= m2) & (V / ADV20 >= 1.0)
    return where((m2 < m8 - s8) | inside, 1.0, -1.0)


def _alpha24() -> Factor:
    drift = delta(mean(C, 20), 20) / delay(C, 20)
    return where(drift <= 0.05, -delta(C, 3), -(C - lowest(C, 10)))


def _alpha46() -> Factor:
    d = slope_turn()
    return where(d > 0.25, -1.0, where(d < 0.0, 1.0, where((d <= 0.25) & (d >= 0.0), -D1, 0.0)))


def _alpha84() -> Factor:
    base = ts_rank(VWAP - highest(VWAP, 15), 21)
    return sign(base) * power(absolute(base) + 1e-12, emin(emax(delta(C, 5), -3.0), 3.0))


FORMULAS: dict[int, Callable[[], Factor]] = {
    1: lambda: -rank(argmax(power(where(RET < 0.0, std(RET, 20), where(RET >= 0.0, C, std(RET, 20))), 2.0), 5)),
    2: lambda: -corr(rank(delta(LOGV, 2)), rank((C - O) / O), 6),
    3: lambda: -corr(rank(O), rank(V), 10),
    4: lambda: -ts_rank(rank(L), 9),
    5: lambda: rank(O - mean(VWAP, 10)) * -rank(absolute(C - VWAP)),
    6: lambda: -corr(O, V, 10),
    7: _alpha7,
    8: lambda: -rank(delta(total(O, 5) * total(RET, 5), 10)),
    9: lambda: _signed_move(5),
    10: lambda: rank(_signed_move(4)),
    11: lambda: (rank(highest(VWAP - C, 3)) + rank(lowest(VWAP - C, 3))) * rank(delta(V, 3)),
    12: lambda: -sign(delta(V, 1)) * D1,
    13: lambda: -rank(cov(rank(C), rank(V), 5)),
    14: lambda: -rank(delta(RET, 3)) * corr(O, V, 10),
    15: lambda: -total(rank(corr(rank(H), rank(V), 3)), 3),
    16: lambda: -rank(cov(rank(H), rank(V), 5)),
    17: lambda: -rank(ts_rank(C, 10)) * rank(delta(D1, 1)) * rank(ts_rank(V / ADV20, 5)),
    18: lambda: -rank(std(absolute(C - O), 5) + (C - O) + corr(C, O, 10)),
    19: lambda: -sign((C - delay(C, 7)) + delta(C, 7)) * (1.0 + rank(total(RET, 60))),
    20: lambda: -rank(O - delay(H, 1)) * rank(O - delay(C, 1)) * rank(O - delay(L, 1)),
    21: _alpha21,
    22: lambda: -delta(corr(H, V, 5), 5) * rank(std(C, 20)),
    23: lambda: where(mean(H, 20) < H, -delta(H, 2), 0.0),
    24: _alpha24,
    25: lambda: rank(-RET * ADV20 * VWAP * (H - C)),
    26: lambda: -highest(corr(ts_rank(V, 5), ts_rank(H, 5), 5), 3),
    27: lambda: where(rank(mean(corr(rank(V), rank(VWAP), 6), 2)) > 0.5, -1.0, 1.0),
    28: lambda: scale(corr(ADV20, L, 5) + MID - C),
    29: lambda: rank(-delta(C, 5)) * rank(V / ADV20),
    30: lambda: (1.0 - rank(sign(D1) + sign(delay(D1, 1)) + sign(delay(D1, 2)))) * total(V, 5) / total(V, 20),
    31: lambda: rank(rank(rank(decay(-rank(rank(delta(C, 10))), 10)))) + rank(-delta(C, 3)) + sign(scale(corr(ADV20, L, 12))),
    32: lambda: scale(mean(C, 7) - C) + 20.0 * scale(corr(VWAP, delay(C, 5), 230)),
    33: lambda: rank(-(1.0 - O / C)),
    34: lambda: rank((1.0 - rank(std(RET, 2) / std(RET, 5))) + (1.0 - rank(D1))),
    35: lambda: ts_rank(V, 32) * (1.0 - ts_rank(C + H - L, 16)) * (1.0 - ts_rank(RET, 32)),
    36: lambda: 2.21 * rank(corr(C - O, delay(V, 1), 15)) + 0.7 * rank(O - C) + 0.73 * rank(ts_rank(delay(-RET, 6), 5))
    + rank(absolute(corr(VWAP, ADV20, 6))) + 0.6 * rank((mean(C, 200) - O) * (C - O)),
    37: lambda: rank(corr(delay(O - C, 1), C, 200)) + rank(O - C),
    38: lambda: -rank(ts_rank(C, 10)) * rank(C / O),
    39: lambda: -rank(delta(C, 7) * (1.0 - rank(decay(V / ADV20, 9)))) * (1.0 + rank(total(RET, 250))),
    40: lambda: -rank(std(H, 10)) * corr(H, V, 10),
    41: lambda: sqrt(emax(H, 0.0) * emax(L, 0.0)) - VWAP,
    42: lambda: rank(VWAP - C) / rank(VWAP + C),
    43: lambda: ts_rank(V / ADV20, 20) * ts_rank(-delta(C, 7), 8),
    44: lambda: -corr(H, rank(V), 5),
    45: lambda: -(rank(mean(delay(C, 5), 20)) * corr(C, V, 2) * rank(corr(total(C, 5), total(C, 20), 2))),
    46: _alpha46,
    47: lambda: rank(1.0 / C) * V / ADV20 * (H * rank(H - C) / mean(H, 5)) - rank(VWAP - delay(VWAP, 5)),
    49: lambda: where(slope_turn() < -0.1, 1.0, -D1),
    50: lambda: -highest(rank(corr(rank(V), rank(VWAP), 5)), 5),
    51: lambda: where(slope_turn() < -0.05, 1.0, -D1),
    52: lambda: (delay(lowest(L, 5), 5) - lowest(L, 5)) * rank((total(RET, 240) - total(RET, 20)) / 220.0) * ts_rank(V, 5),
    53: lambda: -delta(((C - L) - (H - C)) / (C - L), 9),
    54: lambda: -((L - C) * power(O, 5.0)) / ((L - H) * power(C, 5.0)),
    55: lambda: -corr(rank((C - lowest(L, 12)) / (highest(H, 12) - lowest(L, 12))), rank(V), 6),
    57: lambda: -(C - VWAP) / decay(rank(argmax(C, 30)), 2),
    60: lambda: -(2.0 * scale(rank(((C - L) - (H - C)) / (H - L) * V)) - scale(rank(argmax(C, 10)))),
    61: lambda: below(rank(VWAP - lowest(VWAP, 16)), rank(corr(VWAP, adv(180), 18)), 1.0),
    62: lambda: below(rank(corr(VWAP, total(ADV20, 22), 10)), rank(truth(2.0 * rank(O) < rank(MID) + rank(H)))),
    64: lambda: below(
        rank(corr(total(O * 0.178 + L * 0.822, 13), total(adv(120), 13), 17)), rank(delta(MID * 0.178 + VWAP * 0.822, 4))
    ),
    65: lambda: below(rank(corr(O * 0.0085 + VWAP * 0.9915, total(adv(60), 9), 6)), rank(O - lowest(O, 14))),
    66: lambda: -(rank(decay(delta(VWAP, 4), 7)) + ts_rank(decay((L * 0.96 - VWAP) / (O - MID), 11), 7)),
    68: lambda: below(ts_rank(corr(rank(H), rank(adv(15)), 9), 14), rank(delta(C * 0.518 + L * 0.482, 1))),
    70: lambda: -power(rank(delta(VWAP, 1)), ts_rank(corr(C, adv(50), 18), 18)),
    71: lambda: emax(
        ts_rank(decay(corr(ts_rank(C, 3), ts_rank(adv(180), 12), 18), 4), 16),
        ts_rank(decay(power(rank(L + O - 2.0 * VWAP), 2.0), 16), 4),
    ),
    72: lambda: rank(decay(corr(MID, adv(40), 9), 10)) / rank(decay(corr(ts_rank(VWAP, 4), ts_rank(V, 19), 7), 3)),
    73: lambda: -emax(
        rank(decay(delta(VWAP, 5), 3)),
        ts_rank(decay(-delta(O * 0.147 + L * 0.853, 2) / (O * 0.147 + L * 0.853), 16), 17),
    ),
    74: lambda: below(rank(corr(C, total(adv(30), 37), 15)), rank(corr(rank(H * 0.0261 + VWAP * 0.9739), rank(V), 11))),
    75: lambda: below(rank(corr(VWAP, V, 4)), rank(corr(rank(L), rank(adv(50)), 12)), 1.0),
    77: lambda: emin(rank(decay(MID + H - VWAP - H, 20)), rank(decay(corr(MID, adv(40), 3), 6))),
    78: lambda: signed_power(rank(corr(total(L * 0.352 + VWAP * 0.648, 20), total(adv(40), 20), 7)), 1.0)
    * sign(rank(corr(rank(VWAP), rank(V), 6))),
    81: lambda: below(
        rank(ln(emax(product(rank(power(rank(corr(VWAP, total(adv(10), 50), 8)), 4.0)), 15), 1e-12))),
        rank(corr(rank(VWAP), rank(V), 5)),
    ),
    83: lambda: rank(delay((H - L) / mean(C, 5), 2)) * rank(rank(V)) / ((H - L) / mean(C, 5) / (VWAP - C)),
    84: _alpha84,
    85: lambda: signed_power(rank(corr(H * 0.876 + C * 0.124, adv(30), 10)), 1.0)
    * sign(rank(corr(ts_rank(MID, 4), ts_rank(V, 10), 7))),
    86: lambda: below(ts_rank(corr(C, total(ADV20, 15), 6), 20), rank((O + C) - (VWAP + O))),
    88: lambda: emin(
        rank(decay(rank(O) + rank(L) - rank(H) - rank(C), 8)),
        ts_rank(decay(corr(ts_rank(C, 8), ts_rank(adv(60), 21), 8), 7), 3),
    ),
    92: lambda: emin(
        ts_rank(decay(truth(MID + C < L + O), 15), 19), ts_rank(decay(corr(rank(L), rank(adv(30)), 8), 7), 7)
    ),
    94: lambda: -signed_power(rank(VWAP - lowest(VWAP, 12)), 1.0)
    * sign(ts_rank(corr(ts_rank(VWAP, 20), ts_rank(adv(60), 4), 18), 3)),
    95: lambda: below(
        rank(O - lowest(O, 12)), ts_rank(power(rank(corr(total(MID, 19), total(adv(40), 19), 13)), 5.0), 12), 1.0
    ),
    96: lambda: -emax(
        ts_rank(decay(corr(rank(VWAP), rank(V), 4), 4), 8),
        ts_rank(decay(argmax(corr(ts_rank(C, 7), ts_rank(adv(60), 4), 4), 13), 14), 13),
    ),
    98: lambda: rank(decay(corr(VWAP, total(adv(5), 26), 5), 7))
    - rank(decay(ts_rank(argmin(corr(rank(O), rank(adv(15)), 21), 9), 7), 8)),
    99: lambda: below(rank(corr(total(MID, 20), total(adv(60), 20), 9)), rank(corr(L, V, 6))),
    101: lambda: (C - O) / ((H - L) + 0.001),
}


def alpha_name(number: int) -> str:
    return f"alpha{number:03d}"


def alphas(numbers: list[int] | None = None) -> dict[str, Factor]:
    picked = sorted(numbers) if numbers is not None else list(FORMULAS)
    return {alpha_name(n): FORMULAS[n]() for n in picked if n in FORMULAS}


def alpha101(panel: DataFrame, numbers: list[int] | None = None, layout: Layout | None = None) -> DataFrame:
    """Wide alphas; numbers that cannot be computed from bars are NULL double columns."""
    picked = sorted(numbers) if numbers is not None else list(range(1, 102))
    wide = evaluate(panel, alphas([n for n in picked if n in FORMULAS]), layout)
    for n in picked:
        if n not in FORMULAS:
            wide = wide.withColumn(alpha_name(n), F.lit(None).cast("double"))
    return wide.select("symbol", "trade_date", *[alpha_name(n) for n in picked])


def coverage(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Share of finite values per factor: one aggregate, then rows."""
    shares = wide.agg(*[F.avg(clean(F.col(c)).isNotNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot([], columns, "factor_name", "finite_ratio")
