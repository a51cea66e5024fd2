"""Indicators against pandas, regressions and orthogonal factors against numpy, scores against plain arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_factors import SCHEMA, agree, collect, make_panel
from tickloom.operators import fundamentals as FU
from tickloom.operators import preprocess as P
from tickloom.plans import technical as T
from tickloom.plans.factors import evaluate


@pytest.fixture(scope="module")
def pdf():
    return make_panel(days=70).sort_values(["symbol", "trade_date"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return spark.createDataFrame(pdf, SCHEMA).cache()


def test_oscillators(panel, pdf):
    got = collect(evaluate(panel, T.oscillators()))
    close = pdf.groupby("symbol").close
    mid, sd = close.transform(lambda s: s.rolling(20).mean()), close.transform(lambda s: s.rolling(20).apply(np.std, raw=True))
    agree(got.boll_bandwidth_20, 4 * sd / mid)
    step = close.diff().fillna(0.0)
    smooth = lambda s: s.groupby(pdf.symbol).transform(lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    gain, loss = smooth(step.clip(lower=0)), smooth((-step).clip(lower=0))
    agree(got.rsi_14, 100 - 100 / (1 + gain / loss))
    ema = lambda s, n: s.groupby(pdf.symbol).transform(lambda x: x.ewm(span=n, adjust=False, min_periods=n).mean())
    line = ema(pdf.close, 12) - ema(pdf.close, 26)
    agree(got.macd_hist_12_26_9, line - ema(line, 9))


def test_rsi_of_rising_and_flat_series(spark):
    days = pd.bdate_range("2024-01-01", periods=30)
    rows = [(s, d.date(), *[p] * 4, 1.0, p) for s, step in ((1, 1.0), (2, 0.0)) for i, d in enumerate(days) for p in [10.0 + i * step]]
    got = collect(evaluate(spark.createDataFrame(rows, SCHEMA), {"rsi": T.wilder_rsi(), "pb": T.band_position()}))
    assert set(got[got.symbol == 1].rsi.dropna()) == {100.0} and set(got[got.symbol == 2].rsi.dropna()) == {50.0}
    assert got[got.symbol == 2].pb.isna().all() and got.groupby("symbol").rsi.count().eq(17).all()


def test_advanced(panel, pdf):
    got = collect(evaluate(panel, T.advanced()))
    roll = lambda s, n: s.groupby(pdf.symbol).transform(lambda x: x.rolling(n).mean())
    before = pdf.groupby("symbol").close.shift()
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - before).abs(), (pdf.low - before).abs()], axis=1).max(axis=1)
    agree(got.atr_14d, roll(tr, 14))
    up, down = pdf.groupby("symbol").high.diff(), -pdf.groupby("symbol").low.diff()
    di = [100 * roll(a.where((a > b) & (a > 0), 0.0), 14) * 14 / (roll(tr, 14) * 14 + 1e-12) for a, b in ((up, down), (down, up))]
    agree(got.plus_di_14d, di[0])
    agree(got.adx_14d, roll(100 * (di[0] - di[1]).abs() / (di[0] + di[1] + 1e-12), 14))
    agree(got.donchian_high_20d, pdf.groupby("symbol").high.transform(lambda x: x.rolling(20).max().shift(1)))


def prepared(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i % 2, i, None if i % 17 == 0 else float(rng.normal()), float(rng.normal()), float(rng.normal()), None if i % 23 == 0 else "abc"[i % 3]) for i in range(n)]
    return spark.createDataFrame([(d, i, y, a, b, a * 2, g) for d, i, y, a, b, g in rows], "day int, id int, y double, a double, b double, twice double, g string")


@pytest.mark.parametrize("exposures", [["a", "b"], ["a", "twice", "b"], []])
def test_neutralise_is_least_squares(spark, exposures):
    got = P.neutralise(prepared(spark), "y", exposures, ["day"], "g").toPandas().sort_values("id")
    for _, day in got.groupby("day"):
        g = day.g.fillna("a")
        x = np.column_stack([np.ones(len(day)), *[day[c] for c in exposures], *[(g == c).astype(float) for c in "bc"]])
        ok = day.y.notna().to_numpy()
        beta = np.linalg.lstsq(x[ok], day.y.to_numpy()[ok], rcond=None)[0]
        want = np.where(ok, day.y - x @ beta, np.nan)
        agree(day.y_neutral, want)


def test_neutralise_needs_more_rows_than_coefficients(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 1.0)], "day int, y double, a double")
    assert [r.y_neutral for r in P.neutralise(df, "y", ["a"], ["day"]).collect()] == [None, None]
    assert P.neutralise(df.limit(0), "y", ["a"], ["day"]).count() == 0


def test_orthogonal_factors_match_qr(spark):
    got = P.orthogonalise(prepared(spark), ["a", "y", "b"], ["day"]).toPandas().sort_values("id")
    for _, day in got.groupby("day"):
        ok = day.y.notna()
        x = day.loc[ok, ["a", "y", "b"]].to_numpy()
        q, r = np.linalg.qr(x - x.mean(axis=0))
        agree(day.loc[ok, ["a_orth", "y_orth", "b_orth"]].to_numpy().ravel(), (q * np.sign(np.diag(r))).ravel())
        assert day.loc[~ok, "a_orth"].isna().all()


def test_normal_score_mask_and_pipeline(spark):
    df = spark.createDataFrame([(1, 1.0, True), (1, 2.0, None), (1, 2.0, True), (1, None, True), (2, 5.0, True)], "day int, y double, ok boolean")
    scores = [r.s for r in df.select("day", "y", P.normal_score(F.col("y"), "day").alias("s")).orderBy("day", F.col("y").asc_nulls_first()).collect()]
    assert scores[0] is None and scores[4] is None and scores[2] == scores[3] and scores[1] == pytest.approx(-0.967421566, abs=1e-7)
    assert sorted(r.y for r in P.mask_untradable(df, ["y"], F.col("ok")).collect() if r.y is not None) == [1.0, 2.0, 5.0]
    out = P.factor_pipeline(prepared(spark), ["y"], ["day"], fill_by="g", exposures=["a"], category="g").toPandas()
    assert out.groupby("day").y.mean().abs().max() < 1e-9 and out.groupby("day").y.std(ddof=0).sub(1).abs().max() < 1e-9


def test_score_maps(spark):
    df = spark.createDataFrame([(3.5,), (1.0,), (2.4,), (None,)], "z double").select("z", FU.distress_percentile(F.col("z")).alias("d"), FU.fraud_percentile(F.col("z") - 4).alias("m"))
    rows = df.collect()
    assert [r.d for r in rows] == pytest.approx([5.0, 95.0, 95.0 - 0.59 / 1.18 * 90, 50.0])
    assert [r.m for r in rows] == pytest.approx([70 + 1.28 * 20, 50 - 1.22 * 20, 70 + 0.18 * 20, 50.0])
