"""Eighty daily price-volume factors in eight families (fixed names and windows)."""

from __future__ import annotations

import math

from tickloom.functions.factor import (
    Factor, absolute, col, const, corr, delay, filled, highest, kurt, ln, lowest, mean, only, power, returns,
    skew, sqrt, std, total, where,
)

O, H, L, C, V, A = (col(c) for c in ("open", "high", "low", "close", "volume", "amount"))
NIL = const(0.0)
FAMILIES = ("mmt", "vol", "shape", "liq", "corr", "doc", "crowd", "trade")


def vwap_or_unknown() -> Factor:
    """Turnover per share; a day without trading takes the close, unpublished turnover stays unknown."""
    return where(filled(V, 0.0) <= NIL, C, A / V)


def position(x: Factor, n: int) -> Factor:
    return (x - lowest(L, n)) / (highest(H, n) - lowest(L, n))


def cicc80() -> dict[str, Factor]:
    pc, ret, vwap = delay(C, 1), returns(C), vwap_or_unknown()
    dv, da = returns(V), returns(A)
    span, clv = (H - L) / pc, ((C - L) - (H - C)) / (H - L)
    flow, intraday = clv * A, C / O - 1.0
    gain, loss = only(ret > NIL, ret), only(ret < NIL, ret)
    f: dict[str, Factor] = {}

    for n in (1, 3, 5, 10, 20):
        f[f"mmt_ret_{n}d"] = returns(C, n)
    for n in (1, 3, 5):
        f[f"mmt_reversal_{n}d"] = -returns(C, n)
    f["mmt_range_position_20d"] = position(C, 20)
    f["mmt_vwap_gap"] = C / vwap - 1.0

    for n in (5, 10, 20, 60):
        f[f"vol_return_std_{n}d"] = std(ret, n)
    f["vol_upside_std_20d"] = std(gain, 20)
    f["vol_downside_std_20d"] = std(loss, 20)
    f["vol_range_mean_20d"] = mean(span, 20)
    f["vol_range_std_20d"] = std(span, 20)
    f["vol_intraday_std_20d"] = std(intraday, 20)
    f["vol_parkinson_20d"] = sqrt(mean(power(ln(H / L), 2.0), 20) / (4.0 * math.log(2.0)))

    for n in (10, 20, 60):
        f[f"shape_skew_{n}d"] = skew(ret, n)
        f[f"shape_kurt_{n}d"] = kurt(ret, n)
    f["shape_return_z_20d"] = (ret - mean(ret, 20)) / std(ret, 20)
    f["shape_tail_ratio_20d"] = highest(absolute(ret), 20) / mean(absolute(ret), 20)

    for n in (5, 20, 60):
        f[f"liq_amihud_{n}d"] = mean(absolute(ret) / (only(A > NIL, A) / 1e8), n)
    f["liq_amount_mean_20d"] = mean(A, 20)
    f["liq_amount_z_20d"] = (A - mean(A, 20)) / std(A, 20)
    f["liq_volume_z_20d"] = (V - mean(V, 20)) / std(V, 20)
    for n in (5, 20):
        f[f"liq_volume_concentration_{n}d"] = V / total(V, n)
        f[f"liq_amount_turnover_{n}d"] = A / total(A, n)

    for n in (5, 10, 20):
        f[f"corr_ret_volchg_{n}d"] = corr(ret, dv, n)
        f[f"corr_close_volume_{n}d"] = corr(C, V, n)
    for n in (10, 20):
        f[f"corr_ret_amountchg_{n}d"] = corr(ret, da, n)
        f[f"corr_ret_lag_volchg_{n}d"] = corr(ret, delay(dv, 1), n)

    for n in (20, 60, 120):
        f[f"doc_close_pct_{n}d"] = position(C, n)
    f["doc_vwap_pct_20d"] = position(vwap, 20)
    f["doc_drawdown_60d"] = C / highest(C, 60) - 1.0
    f["doc_gain_to_min_60d"] = C / lowest(C, 60) - 1.0
    for label, x in (("close", C), ("vwap", vwap)):
        f[f"doc_{label}_to_high_20d"] = x / highest(H, 20) - 1.0
        f[f"doc_{label}_to_low_20d"] = x / lowest(L, 20) - 1.0

    for n in (5, 10, 20):
        f[f"crowd_volume_conc_{n}d"] = highest(V / mean(V, n), n)
    f["crowd_amount_conc_20d"] = highest(A / mean(A, 20), 20)
    f["crowd_volume_autocorr_20d"] = corr(V, delay(V, 1), 20)
    f["crowd_amount_autocorr_20d"] = corr(A, delay(A, 1), 20)
    f["crowd_turnover_spike_20d"] = V / mean(V, 20)
    f["crowd_range_amount_corr_20d"] = corr(span, A, 20)
    f["crowd_up_volume_ratio_20d"] = total(only(ret > NIL, V), 20) / total(V, 20)
    f["crowd_down_volume_ratio_20d"] = total(only(ret < NIL, V), 20) / total(V, 20)

    for n in (5, 10, 20):
        f[f"trade_money_flow_{n}d"] = total(flow, n) / total(absolute(A), n)
    for n in (5, 20):
        f[f"trade_clv_{n}d"] = mean(clv, n)
    for label, x in (
        ("open_gap_amount", (O / pc - 1.0) * A),
        ("close_strength", (C / vwap - 1.0) * A),
        ("smart_money_proxy", ret * A),
    ):
        f[f"trade_{label}_20d"] = total(x, 20) / total(A, 20)
    f["trade_high_return_volume_20d"] = total(only(mean(ret, 20) < ret, V), 20) / total(V, 20)
    f["trade_low_return_volume_20d"] = total(only(ret < mean(ret, 20), V), 20) / total(V, 20)
    f["trade_amount_momentum_20d"] = mean(A, 5) / mean(A, 20) - 1.0
    f["trade_tail_amount_ratio_20d"] = A / highest(A, 20)
    assert len(f) == 80, len(f)
    return {f"cicc_{k}": v for k, v in f.items()}


def direction(name: str) -> int:
    """-1 for the families where low values are preferred."""
    return -1 if name.split("_")[1] in {"vol", "liq", "crowd"} else 1


__all__ = ["cicc80", "direction", "vwap_or_unknown", "FAMILIES"]
