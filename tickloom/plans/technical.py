"""Technical indicators as factor trees: bands, oscillators, trend strength, channels, volume scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import factor as f
from tickloom.functions.columns import ratio
from tickloom.functions.factor import Factor, col

O, H, L, C, V, A = (col(c) for c in ("open", "high", "low", "close", "volume", "amount"))
EPS = 1e-12


def band_position(n: int = 20, width: float = 2.0) -> Factor:
    """Place of the close between the lower band (0) and the upper band (1)."""
    reach = width * f.pstd(C, n)
    return (C - (f.mean(C, n) - reach)) / (2.0 * reach)


def band_width(n: int = 20, width: float = 2.0) -> Factor:
    return 2.0 * width * f.pstd(C, n) / f.mean(C, n)


def wilder_rsi(n: int = 14) -> Factor:
    """Relative strength by recursive means; 100 without losses, 50 for a flat series."""
    step = f.filled(f.delta(C))
    gain, loss = f.ewm(f.emax(step, 0.0), 1.0 / n, n), f.ewm(f.emax(-step, 0.0), 1.0 / n, n)
    value = 100.0 - 100.0 / (1.0 + gain / loss)
    return f.where(loss.eq(0.0), f.where(gain.eq(0.0), 50.0, 100.0), value)


def simple_rsi(n: int = 14) -> Factor:
    """Relative strength by plain rolling means."""
    step = f.delta(C)
    return 100.0 - 100.0 / (1.0 + f.mean(f.emax(step, 0.0), n) / (f.mean(f.emax(-step, 0.0), n) + EPS))


def macd(fast: int = 12, slow: int = 26, warm: bool = False) -> Factor:
    return f.span_ewm(C, fast, fast if warm else 1) - f.span_ewm(C, slow, slow if warm else 1)


def macd_histogram(fast: int = 12, slow: int = 26, signal: int = 9, warm: bool = True) -> Factor:
    line = macd(fast, slow, warm)
    return line - f.span_ewm(line, signal, signal if warm else 1)


def widest(*parts: Factor) -> Factor:
    """Largest known part."""
    low = f.const(-1e300)
    out = f.filled(parts[0], low)
    for p in parts[1:]:
        out = f.emax(out, f.filled(p, low))
    return f.only(low < out, out)


def true_range() -> Factor:
    before = f.delay(C)
    return widest(H - L, f.absolute(H - before), f.absolute(L - before))


def directional(n: int = 14) -> dict[str, Factor]:
    """Average directional index and both directional indicators."""
    up, down = f.delta(H), -f.delta(L)
    plus = f.where((up > down) & (up > 0.0), up, 0.0)
    minus = f.where((down > up) & (down > 0.0), down, 0.0)
    base = f.mean(true_range(), n) * float(n) + EPS
    p, m = 100.0 * f.total(plus, n) / base, 100.0 * f.total(minus, n) / base
    dx = 100.0 * f.absolute(p - m) / (p + m + EPS)
    return {"adx_14d": f.mean(dx, n), "plus_di_14d": p, "minus_di_14d": m}


def level_score(x: Factor, n: int = 20) -> Factor:
    return (x - f.mean(x, n)) / (f.std(x, n) + EPS)


def oscillators() -> dict[str, Factor]:
    """Band position and width, Wilder strength, histogram in price units and per unit of price."""
    return {
        "boll_percent_b_20": band_position(), "boll_bandwidth_20": band_width(), "rsi_14": wilder_rsi(),
        "macd_hist_12_26_9": macd_histogram(), "macd_hist_norm_12_26_9": macd_histogram() / C,
    }


def advanced() -> dict[str, Factor]:
    """The daily strategy set."""
    r1, typical = f.returns(C), (H + L + C) / 3.0
    short, long = f.std(r1, 5), f.std(r1, 20)
    line, hist = macd(), macd_histogram(warm=False)
    mid, sd = f.mean(C, 20), f.std(C, 20)
    return {
        "ret_1d": r1, "rv_5d": short, "rv_20d": long, "rv_ratio_5_20": short / (long + EPS), "rsi_14d": simple_rsi(),
        "macd_line": line, "macd_signal": f.span_ewm(line, 9), "macd_hist": hist, "macd_hist_delta": f.delta(hist),
        "ma_20": mid, "bb_upper_20_2": mid + 2.0 * sd, "bb_lower_20_2": mid - 2.0 * sd, "bollinger_zscore_20d": (C - mid) / (sd + EPS),
        "atr_14d": f.mean(true_range(), 14), **directional(),
        "donchian_high_20d": f.delay(f.highest(H, 20)), "donchian_low_20d": f.delay(f.lowest(L, 20)),
        "vwap_20d": f.total(typical * V, 20) / (f.total(V, 20) + EPS), "volume_zscore_20d": level_score(V), "amount_zscore_20d": level_score(A),
        "amount_mean_20d": f.mean(A, 20), "amihud_20d": f.mean(f.absolute(r1) / (A + EPS), 20),
    }


def daily() -> dict[str, Factor]:
    """Returns, volatility, level scores and gaps to moving averages."""
    r1 = f.returns(C)
    return {
        "ret_1d": r1, "ret_5d": f.returns(C, 5), "ret_20d": f.returns(C, 20), "volatility_20d": f.std(r1, 20),
        "volume_zscore_20d": level_score(V), "amount_zscore_20d": level_score(A), "ma_gap_5d": C / f.mean(C, 5) - 1.0, "ma_gap_20d": C / f.mean(C, 20) - 1.0,
        "bollinger_zscore_20d": (C - f.mean(C, 20)) / (f.std(C, 20) + EPS), "rsi_14d": simple_rsi(),
    }


def with_benchmark(features: DataFrame, benchmark: DataFrame, date: str = "trade_date", close: str = "close") -> DataFrame:
    """Adds the one-day return of a single benchmark series by date; the series is as long as the calendar."""
    before = F.lag(close).over(Window.orderBy(date))
    series = benchmark.select(date, (ratio(F.col(close), before) - 1).alias("benchmark_ret_1d"))
    return features.join(series, date, "left")
