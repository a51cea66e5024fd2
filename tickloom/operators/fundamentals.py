"""Statement tables and the measures built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import normal_cdf, ratio
from tickloom.operators.cross import group_zscore, pct_rank, split_rank, winsorise_quantile


def merge_statements(left: DataFrame, right: DataFrame, keys: list[str], coalesce: list[str], presence: str | None = None) -> DataFrame:
    """Full outer merge on the statement keys; clashing columns take the left value first."""
    a = left.withColumn("_l", F.lit(1)).withColumnsRenamed({c: f"_a_{c}" for c in coalesce})
    b = right.withColumn("_r", F.lit(1)).withColumnsRenamed({c: f"_b_{c}" for c in coalesce})
    out = a.join(b, keys, "full_outer").withColumns({c: F.coalesce(f"_a_{c}", f"_b_{c}") for c in coalesce})
    if presence:
        side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
        out = out.withColumn(presence, side)
    return out.drop("_l", "_r", *[f"_a_{c}" for c in coalesce], *[f"_b_{c}" for c in coalesce])


def report_growth(df: DataFrame, values: list[str], key: str = "symbol", order: str = "report_period") -> DataFrame:
    """Trailing four-report sum, change, and growth one and four reports back."""
    w = Window.partitionBy(key).orderBy(order)
    f = w.rowsBetween(-3, 0)
    cols = {}
    for v in values:
        x = F.col(v)
        cols[f"{v}_ttm"] = F.when(F.count(x).over(f) == 4, F.sum(x).over(f))
        cols[f"{v}_change"] = x - F.lag(x).over(w)
        cols[f"{v}_qoq"] = ratio(x - F.lag(x).over(w), F.abs(F.lag(x).over(w)))
        cols[f"{v}_yoy"] = ratio(x - F.lag(x, 4).over(w), F.abs(F.lag(x, 4).over(w)))
    return df.withColumns(cols)


def key_metrics(df: DataFrame) -> DataFrame:
    """Margins, return on equity and invested capital, debt ratio, DuPont parts; zero bases give NULL."""
    rev, cost, cash, assets, debt = (F.col(c).cast("double") for c in ("revenue", "cost", "cash", "assets", "debt"))
    income, equity = rev - cost, assets - debt
    return df.withColumns({
        "gross_margin": ratio(rev - cost, rev), "roe": ratio(income, equity), "roic": ratio(income * 0.75, equity + debt), "debt_to_asset": ratio(debt, assets),
        "cash_to_income": ratio(cash, income), "net_margin": ratio(income, rev), "asset_turnover": ratio(rev, assets), "leverage": ratio(assets, equity),
        "dupont_roe": ratio(income, rev) * ratio(rev, assets) * ratio(assets, equity),
    })


def piotroski(df: DataFrame, columns: dict[str, Column], key: str = "symbol", order: str = "report_period") -> DataFrame:
    """Nine yes/no tests against the previous report; unknown comparisons count as no.

    ``columns`` gives net_income, operating_cash_flow, roa, leverage, current_ratio, shares, gross_margin and
    asset_turnover. The count is also mapped to 0-100.
    """
    w = Window.partitionBy(key).orderBy(order)
    now = lambda c: columns[c].cast("double")
    old = lambda c: F.lag(now(c)).over(w)
    tests = [now("net_income") > 0, now("operating_cash_flow") > 0, now("operating_cash_flow") > now("net_income"), now("leverage") < old("leverage"), now("shares") <= old("shares")]
    tests += [now(c) > old(c) for c in ("roa", "current_ratio", "gross_margin", "asset_turnover")]
    score = sum((F.coalesce(c, F.lit(False)).cast("int") for c in tests), F.lit(0))
    return df.withColumn("f_score", score).withColumn("f_score_100", F.col("f_score") / F.lit(9.0) * 100)


def beneish_m(df: DataFrame, columns: dict[str, Column], key: str = "symbol", order: str = "report_period") -> DataFrame:
    """Eight-ratio manipulation score against the previous report, weights as published (1999).

    ``columns`` gives receivables, sales, cogs, current_assets, ppe, total_assets, depreciation, sga, leverage,
    net_income and operating_cash_flow. Without positive sales and assets in both reports, or with a zero base in any
    ratio, there is no score.
    """
    w = Window.partitionBy(key).orderBy(order)
    now = lambda c: columns[c].cast("double")
    old = lambda c: F.lag(now(c)).over(w)

    def pair(of) -> tuple[Column, Column]:
        return of(now), of(old)

    recv, recv0 = pair(lambda v: ratio(v("receivables"), v("sales")))
    margin, margin0 = pair(lambda v: ratio(v("sales") - v("cogs"), v("sales")))
    soft, soft0 = pair(lambda v: 1 - ratio(v("current_assets") + v("ppe"), v("total_assets")))
    wear, wear0 = pair(lambda v: ratio(v("depreciation"), v("depreciation") + v("ppe")))
    cost, cost0 = pair(lambda v: ratio(v("sga"), v("sales")))
    parts = {
        0.92: ratio(recv, recv0), 0.528: ratio(margin0, margin), 0.404: ratio(soft, soft0), 0.892: ratio(now("sales"), old("sales")), 0.115: ratio(wear0, wear),
        -0.172: ratio(cost, cost0), 4.679: ratio(now("net_income") - now("operating_cash_flow"), now("total_assets")), -0.327: ratio(now("leverage"), old("leverage")),
    }
    score = sum((F.lit(weight) * part for weight, part in parts.items()), F.lit(-4.84))
    ok = (now("sales") > 0) & (old("sales") > 0) & (now("total_assets") > 0) & (old("total_assets") > 0)
    return df.withColumn("m_score", F.when(ok, score))


def distress_percentile(z: Column) -> Column:
    """Z score to 5-95, higher is more distressed; unknown is 50."""
    return F.when(z.isNull(), 50.0).when(z >= 2.99, 5.0).when(z <= 1.81, 95.0).otherwise(95.0 - (z - 1.81) / (2.99 - 1.81) * 90.0)


def fraud_percentile(m: Column) -> Column:
    """M score to 1-99, higher is riskier, with the published threshold as the step; unknown is 50."""
    reach = (m + 1.78) * 20.0
    return F.when(m.isNull(), 50.0).when(m >= -1.78, F.least(F.lit(99.0), 70.0 + reach)).otherwise(F.greatest(F.lit(1.0), 50.0 + reach))


def altman_z(working: Column, retained: Column, ebit: Column, equity: Column, debt: Column, sales: Column, assets: Column) -> Column:
    """Fixed published weights of the Z score."""
    return 1.2 * ratio(working, assets) + 1.4 * ratio(retained, assets) + 3.3 * ratio(ebit, assets) + 0.6 * ratio(equity, debt) + 1.0 * ratio(sales, assets)


FORENSIC = ["receivable_gap", "inventory_gap", "accrual_ratio", "cfo_shortfall", "capex_pressure", "goodwill_risk", "debt_pressure", "related_party_risk"]


def forensic(df: DataFrame, columns: dict[str, Column], key: str = "symbol", order: str = "report_period") -> DataFrame:
    """Eight warning ratios and the mean of their percent ranks over all rows.

    ``columns`` gives receivables, revenue, inventory, cogs, net_income, operating_cash_flow, total_assets, capex,
    goodwill, short_term_debt, cash and related_party_amount; goodwill left out counts as zero, others as unknown.
    Ranks cover the whole table, so they are split by value and no task holds it.
    """
    w = Window.partitionBy(key).orderBy(order)
    now = lambda c: columns.get(c, F.lit(0.0 if c == "goodwill" else None)).cast("double")
    grown = lambda c: ratio(now(c), F.lag(now(c)).over(w)) - 1
    out = df.withColumns({
        "receivable_gap": grown("receivables") - grown("revenue"), "inventory_gap": grown("inventory") - grown("cogs"),
        "accrual_ratio": ratio(now("net_income") - now("operating_cash_flow"), now("total_assets")), "cfo_shortfall": -ratio(now("operating_cash_flow"), now("net_income")),
        "capex_pressure": ratio(F.abs(now("capex")), now("operating_cash_flow")), "goodwill_risk": ratio(now("goodwill"), now("total_assets")),
        "debt_pressure": ratio(now("short_term_debt"), now("cash")), "related_party_risk": ratio(now("related_party_amount"), now("revenue")),
    })
    ranked = split_rank(out, {f"_p_{c}": F.col(c) for c in FORENSIC}, [], [key, order])
    shares = F.array_compact(F.array(*[F.col(f"_p_{c}") for c in FORENSIC]))
    total = F.aggregate(shares, F.lit(0.0), lambda s, v: s + v)
    return ranked.withColumn("fraud_risk_composite", ratio(total, F.size(shares))).drop(*[f"_p_{c}" for c in FORENSIC])


def bucket_rank(df: DataFrame, axes: dict[str, tuple[float, int]], by: list[str]) -> DataFrame:
    """Percent rank per axis inside (date, bucket), flipped where low is better, weighted over the known axes."""
    ranked = {}
    for a, (_, direction) in axes.items():
        r = pct_rank(F.col(a), *by)
        ranked[f"{a}_rank"] = r if direction > 0 else 1 - r
    out = df.withColumns(ranked)
    num = sum((F.lit(w) * F.coalesce(f"{a}_rank", F.lit(0.0)) for a, (w, _) in axes.items()), F.lit(0.0))
    den = sum((F.when(F.col(f"{a}_rank").isNotNull(), F.lit(w)).otherwise(0.0) for a, (w, _) in axes.items()), F.lit(0.0))
    return out.withColumn("composite", ratio(num, den))


def normal_axes(df: DataFrame, axes: dict[str, tuple[float, int]], by: list[str]) -> DataFrame:
    """Axis clipped to its group's 1–99 % range, standardised, mapped through Φ, flipped when lower is better."""
    clipped = winsorise_quantile(df, list(axes), by)
    z = {a: normal_cdf(group_zscore(F.col(a), *by)) for a in axes}
    scored = clipped.withColumns({f"{a}_score": z[a] if d > 0 else 1 - z[a] for a, (_, d) in axes.items()})
    num = sum((F.lit(w) * F.coalesce(f"{a}_score", F.lit(0.0)) for a, (w, _) in axes.items()), F.lit(0.0))
    den = sum((F.when(F.col(f"{a}_score").isNotNull(), F.lit(w)).otherwise(0.0) for a, (w, _) in axes.items()), F.lit(0.0))
    return scored.withColumn("composite", ratio(num, den))


def dcf_value(cash: Column, growth: Column, discount: Column, terminal: float = 0.02, years: int = 5) -> Column:
    """Explicit-period plus terminal value; NULL unless the discount rate exceeds terminal growth."""
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda s, k: s + cash * F.pow(1 + growth, k) / F.pow(1 + discount, k))
    last = cash * F.pow(1 + growth, F.lit(years)) * (1 + terminal) / (discount - terminal) / F.pow(1 + discount, F.lit(years))
    return F.when(discount > terminal, flows + last)


def reverse_dcf(price: Column, cash: Column, discount: Column, terminal: float = 0.02, years: int = 5, lo: float = -0.5, hi: float = 1.0, steps: int = 60) -> Column:
    """Growth rate at which the DCF equals the price, by bisection over a fixed number of steps.

    A value is cash times a polynomial in (1 + growth) / (1 + discount), so a step is a few array operations for all
    rows of a batch and no power is taken.
    """

    @F.pandas_udf("double")
    def root(p: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        p, c, d = (x.to_numpy(dtype="float64", na_value=np.nan) for x in (p, c, d))
        a, b = np.full(len(p), lo), np.full(len(p), hi)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                mid = (a + b) / 2
                q = (1 + mid) / (1 + d)
                value = (1 + terminal) / (d - terminal)
                for _ in range(years):
                    value = (value + 1) * q
                low = c * value < p
                a, b = np.where(low, mid, a), np.where(low, b, mid)
        return pd.Series((a + b) / 2)

    return F.when((cash > 0) & (discount > terminal), root(price.cast("double"), cash.cast("double"), discount.cast("double")))


def peg(pe: Column, growth: Column) -> tuple[Column, Column]:
    """Price/earnings to growth (in percent) and its band; no growth or earnings, no ratio."""
    value = F.when((pe > 0) & (growth > 0), pe / (growth * 100))
    band = F.when(value.isNull(), "not_meaningful").when(value < 1, "cheap").when(value < 2, "fair").otherwise("expensive")
    return value, band
