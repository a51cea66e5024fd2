"""Factor semantics: missing values, no look-ahead, and independent pandas versions of the hard operators."""

import numpy as np
import pandas as pd
import pytest

from tickloom.functions import factor as f
from tickloom.functions.factor import col
from tickloom.plans.alpha101 import FORMULAS, NOT_COMPUTED, alpha101, alphas, coverage
from tickloom.plans.cicc80 import cicc80, direction
from tickloom.plans.factors import evaluate
from tickloom.plans.gtja import gtja
from tickloom.plans.registry import FactorMeta, FactorSet, from_definition

SCHEMA = "symbol long, trade_date date, open double, high double, low double, close double, volume double, amount double"


def make_panel(symbols=5, days=90, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        close = 10 + s
        for d in pd.bdate_range("2024-01-01", periods=days):
            close *= 1 + rng.normal(0, 0.02)
            o, h, lo = close * 0.995, close * 1.01, close * 0.985
            v = float(rng.integers(100, 2000))
            rows.append((s, d.date(), o, h, lo, close, v, v * close))
    df = pd.DataFrame(rows, columns=["symbol", "trade_date", "open", "high", "low", "close", "volume", "amount"])
    flat = (df.symbol == 1) & df.index.isin(df[df.symbol == 1].index[30:50])
    df.loc[flat, ["open", "high", "low", "close"]] = 11.0
    df.loc[df[df.symbol == 2].index[20:22], ["volume", "amount"]] = 0.0
    return df


@pytest.fixture(scope="module")
def pdf():
    return make_panel()


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return spark.createDataFrame(pdf, SCHEMA).cache()


def collect(df):
    return df.toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True)


def agree(got, want):
    got, want = np.asarray(got, float), np.asarray(want, float)
    assert (np.isnan(got) == np.isnan(want)).all()
    np.testing.assert_allclose(got[~np.isnan(got)], want[~np.isnan(want)], rtol=1e-8, atol=1e-9)


def test_series_operators_against_pandas(panel, pdf):
    C, V = col("close"), col("volume")
    got = collect(evaluate(panel, {
        "tsrank": f.ts_rank(C, 8), "argmax": f.argmax(C, 8), "decay": f.decay(C, 6), "std": f.std(C, 10), "ema": f.span_ewm(f.returns(C), 12), "skew": f.skew(f.returns(C), 10), "kurt": f.kurt(f.returns(C), 10), "thin": f.mean(C, 20, 5),
    }))
    p = pdf.sort_values(["symbol", "trade_date"]).reset_index(drop=True)
    g = p.groupby("symbol").close
    ret = g.pct_change()
    roll = lambda s, n, fn: s.groupby(p.symbol).transform(lambda x: x.rolling(n).apply(fn, raw=True))
    agree(got.tsrank, roll(p.close, 8, lambda x: pd.Series(x).rank().iloc[-1] / len(x)))
    agree(got.argmax, roll(p.close, 8, lambda x: np.argmax(x) + 1))
    agree(got.decay, roll(p.close, 6, lambda x: np.dot(x, np.arange(1, 7)) / 21))
    agree(got["std"].fillna(-1), g.transform(lambda x: x.rolling(10).apply(lambda v: np.std(v, ddof=1), raw=True)).fillna(-1))
    agree(got.ema, ret.groupby(p.symbol).transform(lambda x: x.ewm(span=12, adjust=False).mean()))
    agree(got.thin, g.transform(lambda x: x.rolling(20, min_periods=5).mean()))
    varied = got["skew"].notna()
    agree(got["skew"][varied], ret.groupby(p.symbol).transform(lambda x: x.rolling(10).apply(lambda v: pd.Series(v).skew(), raw=True))[varied])
    agree(got["kurt"][varied], ret.groupby(p.symbol).transform(lambda x: x.rolling(10).apply(lambda v: pd.Series(v).kurt(), raw=True))[varied])


def test_cross_rank_is_average_tie_share(panel, pdf):
    got = collect(evaluate(panel, {"r": f.rank(col("volume"))}))
    p = pdf.sort_values(["symbol", "trade_date"]).reset_index(drop=True)
    agree(got.r, p.groupby("trade_date").volume.rank(pct=True))


def test_missing_sides(panel):
    got = collect(evaluate(panel, {"div0": col("close") / (col("volume") - col("volume")), "min": f.emin(f.delay(col("close"), 3), col("close")), "less": f.truth(f.delay(col("close"), 3) < col("close"))}))
    assert got.div0.isna().all() and got["min"].isna().sum() == 15 and got.less.notna().all()


def test_no_lookahead(spark, pdf):
    last = pdf.trade_date.max()
    moved = pdf.copy()
    moved.loc[moved.trade_date == last, ["open", "high", "low", "close", "volume", "amount"]] *= 3.0
    trees = {**alphas([1, 5, 12, 31, 41]), **{k: v for k, v in gtja().items() if k in ("gtja009", "gtja028", "gtja133")}, **{k: v for k, v in cicc80().items() if "corr" in k}}
    a = collect(evaluate(spark.createDataFrame(pdf, SCHEMA), trees))
    b = collect(evaluate(spark.createDataFrame(moved, SCHEMA), trees))
    for name in trees:
        agree(a[a.trade_date < last][name], b[b.trade_date < last][name])


def test_alpha_twelve_and_placeholders(panel, pdf):
    got = collect(alpha101(panel, [12, 41, 48, 101]))
    p = pdf.sort_values(["symbol", "trade_date"]).reset_index(drop=True)
    dv, dc = p.groupby("symbol").volume.diff(), p.groupby("symbol").close.diff()
    agree(got.alpha012, -np.sign(dv) * dc)
    agree(got.alpha101, (p.close - p.open) / (p.high - p.low + 0.001))
    vwap = (p.amount / p.volume.replace(0, np.nan)).fillna(p.close)
    agree(got.alpha041, np.sqrt(p.high * p.low) - vwap)
    assert got.alpha048.isna().all()
    assert len(FORMULAS) == 83 and len(NOT_COMPUTED) == 18


def test_library_sizes_and_coverage(panel):
    assert len(gtja()) == 64 and len(cicc80()) == 80
    assert direction("cicc_vol_return_std_5d") == -1
    share = {r.factor_name: r.finite_ratio for r in coverage(alpha101(panel, [41, 48]), ["alpha041", "alpha048"]).collect()}
    assert share == {"alpha041": 1.0, "alpha048": 0.0}


def test_registry(panel):
    s = FactorSet()
    s.add(FactorMeta("m", "momentum"), f.returns(col("close"), 3))
    s.add_function(FactorMeta("v", "volume"), lambda df: df.selectExpr("symbol", "trade_date", "volume as v"))
    with pytest.raises(ValueError):
        s.add(FactorMeta("m", "momentum"), col("close"))
    assert s.long(panel).count() == 2 * panel.count()
    with pytest.raises(KeyError):
        s.wide(panel, ["nope"])
    assert from_definition({"op": "delay", "args": ["close"], "params": [2]}).key == f.delay(col("close"), 2).key
