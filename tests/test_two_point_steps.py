"""Two-point correlations of rolling sums (alpha045) where closes return to an earlier value, so that a step is zero but for float noise."""

import numpy as np
import pandas as pd

from tickloom.functions import factor as f
from tickloom.functions.factor import col
from tickloom.plans.factors import Layout, evaluate

X = col("close")
TREES = {"steps": f.corr(f.total(X, 5), f.total(X, 20), 2)}


def returning_panel(spark):
    """Symbols 0 to 3 with other histories, each twice (number + 10), and closes that return after 5 or 20 sessions."""
    rng = np.random.default_rng(11)
    rows = []
    for symbol in range(4):
        closes = [float(round(100 + rng.integers(900, 2100) / 1e4 * (1 + rng.integers(0, 9) / 200), 8)) for _ in range(90 + 7 * symbol)]
        for t in range(25, len(closes)):
            if rng.random() < 0.5:
                closes[t] = closes[t - (5 if rng.random() < 0.5 else 20)]
        for name in (symbol, symbol + 10):
            rows += [(name, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=t)).date(), c) for t, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol long, trade_date date, close double")


def test_zero_steps_depend_on_the_own_series_alone(spark):
    """Equal series get equal values, whichever rows lie beside them and whichever plan the size picks."""
    p = returning_panel(spark).cache()
    value = lambda layout: {(r.symbol, r.trade_date): r.steps for r in evaluate(p, TREES, layout).collect()}
    plain = value(None)
    assert set(plain.values()) == {None, 1.0, -1.0}
    assert all(plain[s, d] == plain[s % 10, d] for s, d in plain)
    assert value(Layout(split_series=True, split_dates=True, chunk_rows=13, rank_buckets=3)) == plain
    alone = {(r.symbol, r.trade_date): r.steps for r in evaluate(p.where("symbol = 12"), TREES).collect()}
    assert all(plain[k] == v for k, v in alone.items()) and len(alone) == 104
