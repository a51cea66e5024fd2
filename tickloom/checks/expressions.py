"""The expression vocabulary, one query per operator family."""

from __future__ import annotations

from tickloom.checks.libraries import factor_query
from tickloom.checks.registry import query
from tickloom.functions import factor as f
from tickloom.functions.columns import add_filled, tidy
from tickloom.functions.factor import col
from tickloom.plans.factors import evaluate
from tickloom.plans.inputs import BARS_SQL, bars, bars_layout, tidy_sql

C, V, H, L, O, A = (col(c) for c in ("close", "volume", "high", "low", "open", "amount"))

factor_query("expr_arithmetic", {
    "spread": C - O, "ratio": (C - O) / (H - L), "absolute": f.absolute(C - O), "signed": f.sign(C - O),
    "log": f.log_floor(V - 25.0), "signed_power": f.signed_power(C - O, 0.5), "smaller": f.emin(O, C), "larger": f.emax(O, C),
})
factor_query("expr_delay_delta_returns", {"delay_3": f.delay(C, 3), "delta_5": f.delta(C, 5), "returns_5": f.returns(C, 5)})
factor_query("expr_rolling_moments", {
    "mean_10": f.mean(C, 10), "std_10": f.std(C, 10), "sum_10": f.total(V, 10), "max_10": f.highest(H, 10),
    "min_10": f.lowest(L, 10), "mean_20_min5": f.mean(C, 20, 5),
})
factor_query("expr_rolling_rank", {
    "ts_rank_10": f.ts_rank(C, 10), "argmax_10": f.argmax(C, 10), "argmin_10": f.argmin(V, 10),
    "since_high_20": f.since_high(H, 20), "since_low_20": f.since_low(L, 20),
})
factor_query("expr_rolling_pairs", {"corr_10": f.corr(C, V, 10), "cov_10": f.cov(C, V, 10)})
factor_query("expr_decay_product", {"decay_10": f.decay(C, 10), "product_5": f.product(1.0 + f.returns(C), 5)})
factor_query("expr_recursive_mean", {"sma_12_1": f.sma(C, 12, 1), "ema_12": f.span_ewm(f.returns(C), 12)})
factor_query("expr_conditional_sums", {
    "up_days_12": f.count_true(f.delay(C) < C, 12), "up_volume_26": f.sum_if(V, f.delay(C) < C, 26),
})
factor_query("expr_cross_section", {
    "rank": f.rank(V), "zscore": f.zscore(C), "scaled": f.scale(C - O), "demeaned": f.demean(C),
})


@query("expr_fill_arithmetic", f"""WITH {BARS_SQL},
lagged AS (SELECT *, lag(close, 3) OVER (PARTITION BY symbol ORDER BY trade_date) AS past,
  CASE WHEN volume > 25 THEN volume END AS big FROM bars)
SELECT symbol, trade_date,
  {tidy_sql("CASE WHEN past IS NULL AND big IS NULL THEN NULL ELSE coalesce(past, 0) + coalesce(big, 0) END")} AS added,
  {tidy_sql("CASE WHEN past IS NULL AND big IS NULL THEN NULL ELSE coalesce(past, 0) - coalesce(big, 0) END")} AS subtracted,
  {tidy_sql("CASE WHEN past IS NULL AND big IS NULL THEN NULL ELSE coalesce(past, 1) * coalesce(big, 1) END")} AS multiplied
FROM lagged""")
def expr_fill_arithmetic(spark, root):
    """The lenient rule: one missing side counts as 0 in sums and as 1 in products."""
    from pyspark.sql import functions as F

    panel = evaluate(
        bars(spark, root), {"past": f.delay(C, 3), "big": f.only(V > 25.0, V)}, bars_layout(spark, root)
    )
    a, b = F.col("past"), F.col("big")
    return panel.select(
        "symbol", "trade_date", tidy(add_filled(a, b)).alias("added"), tidy(add_filled(a, b, op="-")).alias("subtracted"),
        tidy(add_filled(a, b, 1.0, "*")).alias("multiplied"),
    )


@query("rank_ic_momentum", f"""WITH {BARS_SQL},
r AS (SELECT symbol, trade_date, close / lag(close) OVER w - 1 AS ret, lead(close, 5) OVER w / close - 1 AS fwd
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
m AS (SELECT symbol, trade_date, fwd, CASE WHEN count(ret) OVER w5 = 5 THEN avg(ret) OVER w5 END AS mom FROM r
      WINDOW w5 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
k AS (SELECT trade_date, round_even(mom * 1e10, 0) AS mom, round_even(fwd * 1e10, 0) AS fwd FROM m WHERE mom IS NOT NULL AND fwd IS NOT NULL),
z AS (SELECT trade_date,
  rank() OVER (PARTITION BY trade_date ORDER BY mom) + (count(*) OVER (PARTITION BY trade_date, mom) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY trade_date, fwd) - 1) / 2.0 AS b FROM k)
SELECT trade_date, count(*)::BIGINT AS pairs,
  CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) + 0.0 END AS rank_ic
FROM z GROUP BY trade_date""")
def rank_ic_momentum(spark, root):
    """Flagship: bars → 5-day momentum → 5-day forward return → rank IC per date."""
    from pyspark.sql import functions as F

    from tickloom.operators.evaluate import ic_by_date

    panel = evaluate(bars(spark, root), {"mom": f.mean(f.returns(C), 5), "fwd": f.lead(C, 5) / C - 1.0})
    return ic_by_date(panel, "mom", "fwd").select(
        "trade_date", "pairs", (F.round("ic", 6) + F.lit(0.0)).alias("rank_ic")
    )


