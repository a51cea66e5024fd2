"""Array stages give what window columns give, on series with gaps, ties and constant stretches, in bounded batches."""

import numpy as np
import pandas as pd
import pyarrow as pa

from tests.test_split_plans import same
from tickloom.functions import factor as f
from tickloom.functions.factor import col
from tickloom.plans.arrays import whole_groups
from tickloom.plans.factors import Layout, evaluate


def odd_panel(spark):
    rng = np.random.default_rng(7)
    rows = []
    for symbol in range(6):
        for day in range(5 + 9 * symbol):
            x = None if rng.random() < 0.08 else float(round(rng.normal(), 1))
            y = 3.0 if 10 <= day < 25 else float(rng.integers(0, 50))
            rows.append((symbol, pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=day), x, y, "a" if symbol % 2 else "b"))
    return spark.createDataFrame(rows, "symbol long, trade_date date, x double, y double, g string")


X, Y = col("x"), col("y")
TREES = {
    "mean": f.mean(X, 4, 2), "std": f.std(Y, 5), "pstd": f.pstd(X, 4, 2), "sum": f.total(X, 3, 1), "min": f.lowest(X, 4, 2), "max": f.highest(Y, 4), "skew": f.skew(Y, 6), "kurt": f.kurt(Y, 6), "tsrank": f.ts_rank(Y, 5),
    "argmax": f.argmax(Y, 5), "argmin": f.argmin(Y, 5), "corr": f.corr(f.filled(X), Y, 6), "corr2": f.corr(X, Y, 2), "cov": f.cov(Y, f.delay(Y, 1), 5), "decay": f.decay(Y, 4), "product": f.product(Y / 10.0, 3),
    "rank": f.rank(X), "zscore": f.group_zscore(Y, "g"), "scale": f.scale(X, 2.0), "demean": f.demean(X, "g"), "xmean": f.cross_mean(X), "count": f.cross_count(X),
    "mixed": f.mean(f.rank(f.delta(Y, 2)), 3) / f.std(Y, 3), "where": f.where((X < 0.0) & (Y > 3.0), f.ln(Y - 4.0), f.sqrt(X)), "ewm": f.ewm(X, 0.3, 2),
}


def test_array_stages_match_windows(spark):
    p = odd_panel(spark).cache()
    windows = Layout(split_series=True, split_dates=True, chunk_rows=11, rank_buckets=3)
    same(evaluate(p, TREES), evaluate(p, TREES, windows), ["symbol", "trade_date"], list(TREES))


def test_one_exchange_and_sort_a_stage(spark):
    """No window is left: its frames were evaluated anew for every row, its ranks sorted a date once a column."""
    out = evaluate(odd_panel(spark), {"a": f.rank(f.ts_rank(Y, 5)), "b": f.rank(f.corr(X, Y, 6))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 2 and plan.count("Sort ") == 2


def test_running_and_leading_values(spark):
    got = {(r.symbol, r.trade_date): r for r in evaluate(odd_panel(spark), {"top": f.running_max(X), "all": f.running_sum(X), "next": f.lead(Y, 2), "ahead": f.delay(Y, 1)}).collect()}
    pdf = odd_panel(spark).toPandas().sort_values(["symbol", "trade_date"])
    for symbol, part in pdf.groupby("symbol"):
        want = pd.DataFrame({"top": part["x"].expanding().max(), "all": part["x"].expanding().sum(), "next": part["y"].shift(-2), "ahead": part["y"].shift(1)})
        for day, row in zip(part["trade_date"], want.to_dict("records")):
            for c, v in row.items():
                have = got[symbol, day][c]
                assert (have is None) == bool(np.isnan(v)) and (have is None or abs(have - v) < 1e-9)


def test_groups_are_never_cut():
    table = pa.table({"k": ["a"] * 25 + ["b"] * 3 + [None] * 9 + ["c"], "v": list(range(38))})
    parts = [t.to_pydict() for t in whole_groups(iter(table.to_batches(4)), "k", 8)]
    assert [v for p in parts for v in p["v"]] == list(range(38))
    assert sum(len(set(p["k"])) for p in parts) == 4 and len(parts) > 1
