"""Style factors, regressions, slow waves, skylines and pattern matching against plain versions."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import applicability
from tickloom.operators import attribution as AT
from tickloom.operators import frontier as FR
from tickloom.operators import highfreq as HF
from tickloom.operators import matching as MA
from tickloom.operators import stats as ST


def panel(days=70, names=30):
    rng = np.random.default_rng(2)
    idx = pd.MultiIndex.from_product([pd.date_range("2024-01-01", periods=days), range(names)], names=["trade_date", "symbol"])
    p = pd.DataFrame({"ret": rng.normal(0, 0.02, len(idx)), "book": rng.normal(size=len(idx)), "equity": rng.lognormal(size=len(idx))}, index=idx).reset_index()
    p.loc[rng.random(len(p)) < 0.05, "book"] = np.nan
    p.loc[rng.random(len(p)) < 0.02, "ret"] = np.nan
    return p


def plain_spread(p, column, sign):
    w = p.sort_values(["symbol", "trade_date"]).copy()
    w["x"] = w.groupby("symbol")[column].shift(1)
    out = {}
    for d, g in w.groupby("trade_date"):
        g = g[["x", "ret"]].dropna()
        if len(g) >= 20:
            r = g["x"].rank(pct=True)
            out[d] = sign * (g.loc[r >= 0.7, "ret"].mean() - g.loc[r <= 0.3, "ret"].mean())
    return out


def test_style_factors_and_ladder(spark):
    p = panel()
    p["trade_date"] = p["trade_date"].dt.date
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "trade_date date, symbol long, ret double, book double, equity double")
    factors, status = AT.style_factors(df, book="book", equity="equity", lookback=20, skip=3)
    got = factors.toPandas().set_index("trade_date").sort_index()
    w = p.sort_values(["symbol", "trade_date"]).copy()
    wealth = w.groupby("symbol")["ret"].transform(lambda s: np.log1p(s.fillna(0)).cumsum())
    w["um"] = np.expm1(wealth.groupby(w["symbol"]).shift(3) - wealth.groupby(w["symbol"]).shift(20))
    for name, column, sign in (("smb", "equity", -1), ("hml", "book", 1), ("umd", "um", 1)):
        want = plain_spread(w, column, sign)
        known = got[name].dropna()
        assert set(known.index) == set(want)
        np.testing.assert_allclose(known, [want[d] for d in known.index], rtol=1e-8, atol=1e-12)
    np.testing.assert_allclose(got["mkt"], p.groupby("trade_date")["ret"].mean(), rtol=1e-9)

    rng = np.random.default_rng(5)
    strat = [(s, d, float(0.002 + b * got.loc[d, "mkt"] + 0.003 * rng.normal())) for s, b in (("x", 1.2), ("y", -0.4)) for d in got.index] + [("short", d, 0.01) for d in got.index[:5]]
    returns = spark.createDataFrame(strat, "book string, trade_date date, ret double")
    told = {(r.book, r.model): r for r in AT.attribution(returns, factors, status, "book").collect()}
    sp = pd.DataFrame(strat, columns=["book", "trade_date", "ret"])
    for book, (model, needed) in itertools.product(("x", "y"), AT.LADDER.items()):
        g = sp[sp["book"] == book].set_index("trade_date")["ret"].to_frame().join(got[list(needed)]).dropna()
        design = np.column_stack([np.ones(len(g)), g[list(needed)]])
        beta, *_ = np.linalg.lstsq(design, g["ret"], rcond=None)
        e = g["ret"].to_numpy() - design[:, 1:] @ beta[1:]
        c, n = e - e.mean(), len(e)
        lag = max(1, int(4 * (n / 100) ** (2 / 9)))
        var = c @ c / n + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
        r = told[book, model]
        np.testing.assert_allclose([r.alpha_annual, r.alpha_t, r.beta_mkt], [(1 + beta[0]) ** 244 - 1, e.mean() / np.sqrt(max(var, 1e-12) / n), beta[1]], rtol=1e-6)
        assert r.n == n and r.status == "measured" and r.strictest == (model == "carhart4")
    assert all(told["short", m].status == "unavailable" and told["short", m].missing == "insufficient_overlap" for m in AT.LADDER)
    without = AT.style_factors(df, lookback=20, skip=3)[1]
    assert without == {"mkt": "constructed", "smb": "unavailable", "hml": "unavailable", "umd": "constructed"}


@pytest.mark.parametrize("bars", [5, 8, 9, 48, 241])
def test_slow_wave_share_is_the_spectrum(spark, bars):
    rng = np.random.default_rng(bars)
    v = rng.integers(0, 1000, bars).astype(float)
    rows = [("a", dt.datetime(2024, 1, 2, 9) + dt.timedelta(minutes=i), 1.0, 1.0 + i, float(x), 2.0 * float(x)) for i, x in enumerate(v)]
    rows += [("z", r[1], 1.0, 1.0, 3.0, 1.0) for r in rows]
    df = spark.createDataFrame(rows, "symbol string, bar_time timestamp, open double, close double, volume double, amount double").withColumn("trade_date", F.to_date("bar_time"))
    got = {r.symbol: r.crowding_fft_ratio for r in HF.intraday_shape(df).collect()}
    power = np.abs(np.fft.rfft(v - v.mean())) ** 2
    assert got["a"] is None if bars < 8 else abs(got["a"] - power[1:3].sum() / power[1:].sum()) < 1e-9
    assert got["z"] == (None if bars < 8 else 0.0)


def test_shape_matches_pandas(spark):
    rng = np.random.default_rng(1)
    rows = [(s, dt.datetime(2024, 1, 2, 9) + dt.timedelta(days=d, minutes=i), float(o), float(o + rng.normal(0, 0.1)), float(rng.integers(1, 9)), float(rng.random() * 1e4)) for s in "ab" for d in range(3) for i, o in enumerate(10 + rng.random(40))]
    df = spark.createDataFrame(rows, "symbol string, bar_time timestamp, open double, close double, volume double, amount double").withColumn("trade_date", F.to_date("bar_time"))
    got = HF.intraday_shape(df, edge=30).toPandas().set_index(["symbol", "trade_date"]).sort_index()
    p = df.toPandas()
    p["r"] = p.groupby(["symbol", "trade_date"])["close"].pct_change().fillna(p["close"] / p["open"] - 1)
    for key, g in p.groupby(["symbol", "trade_date"]):
        top = g.loc[g["volume"].idxmax()]
        want = [top["close"] / top["open"] - 1, g["r"].skew(), g["r"].kurt(), (g["r"].abs() / (g["amount"] / 1e6)).mean(), g["amount"].head(30).sum() / g["amount"].sum(), g["amount"].tail(30).sum() / g["amount"].sum()]
        np.testing.assert_allclose(got.loc[key, ["top_volume_bar_return", "intraday_skew", "intraday_kurtosis", "amihud_1min", "opening_flow_ratio", "closing_flow_ratio"]].astype(float), want, rtol=1e-8)


@pytest.mark.parametrize("block", [FR.BLOCK, 40])
@pytest.mark.parametrize("kind", ["random", "front", "ties"])
def test_skyline_matches_plain(spark, monkeypatch, block, kind):
    monkeypatch.setattr(FR, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = {"random": rng.random((600, 3)), "front": np.column_stack([np.arange(300), -np.arange(300), np.zeros(300)]), "ties": rng.integers(0, 4, (500, 3))}[kind].astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(-1, None, 1.0, 1.0)], "id int, a double, b double, c double").repartition(9)
    got = FR.pareto_front(df, {"a": 1, "b": 1, "c": -1})
    y = x * [1, 1, -1]
    want = {i for i in range(len(y)) if not ((y >= y[i]).all(1) & (y > y[i]).any(1)).any()}
    assert {r.id for r in got.collect()} == want | {-1}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("at_once", [50_000, 2])
def test_matched_patterns(spark, at_once):
    texts = ["red bolt", "boltbolt", "", None, "nothing", "he she hers", "äöü bolt ü"]
    words = ["bolt", "red bolt", "he", "she", "hers", "ü", "", None, "bolt"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, p int")
    got = {r.id: r.matched for r in MA.matched(df, "text", spark.createDataFrame([(w,) for w in words], "pattern string"), at_once=at_once).collect()}
    assert got == {i: None if t is None else sorted({w for w in words if w and w in t}) for i, t in enumerate(texts)}
    none = MA.matched(df, "text", spark.createDataFrame([], "pattern string")).collect()
    assert all(r.matched == (None if texts[r.id] is None else []) for r in none)


def test_block_length_and_common_calendar(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=400)
    x = np.array([e[max(0, i - 6) : i + 1].sum() for i in range(400)])
    got = ST.block_length(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, v double"), "t", "v").first()
    n, c = len(x), x - x.mean()
    auto = [c[k:] @ c[:-k] / (c @ c) for k in range(1, min(n - 1, int(8 * (n / 100) ** (1 / 3)) + 1) + 1)]
    g, s = 0.0, c @ c / n
    for k, r in enumerate(auto, 1):
        if abs(r) < 2 * np.sqrt(np.log10(n) / n):
            break
        g, s = g + 2 * k * r, s + 2 * r
    assert got.n == 400 and got.block == max(1, min(n // 2, round((2 * g * g / s**2) ** (1 / 3) * n ** (1 / 3)))) > 1
    rows = [("a", i, 0.1) for i in range(40)] + [("b", i, 0.2 * (-1) ** i) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "name string, t int, r double").withColumn("r", F.col("r") + F.rand(1) * 0.01)
    assert ST.superior_ability(df, "name", "t", "r", 50).first().best_candidate == "a"


def test_slice_metrics_fold_whole_dates_as_the_long_form_does(spark):
    """Whole dates and the long form agree, also with ties and unknown slices; a slice's rows never reach a shuffle."""
    rows = [(d, s, None if s % 7 == 3 else "ab"[s % 2], float((s * 7 + d * d) % 5), float((s * s + 3 * d) % 11) if (s + d) % 9 else None, s / 8.0) for d in range(12) for s in range(40)]
    panel = spark.createDataFrame(rows, "d int, symbol long, concept string, x double, y double, z double").selectExpr("date_add(DATE '2020-01-01', d) AS trade_date", "*")
    whole = applicability.panel_metrics(panel, ["x", "z"], {1: "y", 5: "x"}, ["concept"])
    long = applicability.slice_metrics(applicability.sliced(panel, ["x", "z"], {1: "y", 5: "x"}, ["concept"]))
    said = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*long.columns).collect()], key=repr)
    assert said(whole) == said(long) and len(said(whole)) == 12
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("MapInArrow") == 1
