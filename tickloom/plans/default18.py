"""The eighteen starter factors; those on optional columns are NULL where the panel lacks them."""

from __future__ import annotations

from tickloom.functions.factor import Factor, col, const, delta, log_floor, mean, optional, rank, returns, std

O, H, L, C, V, A = (col(c) for c in ("open", "high", "low", "close", "volume", "amount"))


def default18() -> dict[str, Factor]:
    r1 = returns(C, 1)
    return {
        "momentum_5": rank(mean(r1, 5)),
        "reversal_1": -rank(r1),
        "volatility_20": rank(std(r1, 20)),
        "volume_z_5": (V - mean(V, 5)) / std(V, 5),
        "momentum_20": rank(mean(r1, 20)),
        "reversal_5": -rank(returns(C, 5)),
        "volatility_60": rank(std(r1, 60)),
        "liquidity_amount_20": rank(log_floor(mean(A, 20))),
        "intraday_range_5": rank(mean((H - L) / C, 5)),
        "price_volume_divergence_5": rank(delta(C, 5)) - rank(delta(V, 5)),
        "turnover_rate_20": rank(mean(optional("turnover_rate"), 20)),
        "valuation_pe_inverse": rank(const(1.0) / optional("pe_ttm")),
        "valuation_pb_inverse": rank(const(1.0) / optional("pb")),
        "quality_roe": rank(optional("roe")),
        "growth_revenue_delta_4": rank(delta(optional("revenue"), 4)),
        "profitability_gross_margin": rank(optional("gross_margin")),
        "leverage_low_debt_to_asset": -rank(optional("debt_to_asset")),
        "cashflow_operating_cash_flow": rank(optional("operating_cash_flow")),
    }
