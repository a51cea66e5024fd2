"""Day factors from minute bars: shape and edges of a day, and how much of its volume swings in slow waves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.cross import group_zscore
from tickloom.operators.series import rolling, rolling_corr

DAY = ["symbol", "trade_date"]
DAILY = ("last_30min_return", "daily_amihud", "close_volume_corr", "lead_lag_price_volume_corr", "turnover_concentration", "amount_zscore", "money_flow_strength", "opening_flow_ratio", "closing_flow_ratio")
INTRADAY = ("top_volume_bar_return", "intraday_skew", "intraday_kurtosis", "amihud_1min", "crowding_fft_ratio", "opening_flow_ratio", "closing_flow_ratio")


def daily_bars(bars: DataFrame, time: str = "bar_time") -> DataFrame:
    return bars.groupBy(*DAY).agg(
        F.min_by("open", time).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", time).alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    )


def traded_price(amount: Column, volume: Column, close: Column) -> Column:
    """Turnover per share; the close where nothing traded, unknown where turnover is."""
    return F.when(F.coalesce(volume, F.lit(0.0)) <= 0, close).otherwise(ratio(amount, volume))


def daily_microstructure(daily: DataFrame, window: int = 20) -> DataFrame:
    """The nine factors that daily bars can tell, one row per (symbol, trade_date). A zero divisor makes a value unknown."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    c, o, v, a = (F.col(x) for x in ("close", "open", "volume", "amount"))
    wide = daily.withColumns({"_pc": F.lag("close").over(w), "_vwap": traded_price(a, v, c), "_am": rolling("mean", a, w, window), "_vs": rolling("sum", v, w, window)})
    wide = wide.withColumns({"_r": ratio(c, F.col("_pc")) - 1, "_dv": ratio(v, F.lag("volume").over(w)) - 1}).withColumn("_ldv", F.lag("_dv").over(w))
    busy, late = ratio(a, F.col("_am")), ratio(c, F.col("_vwap")) - 1
    return wide.select(
        *DAY, late.alias("last_30min_return"), ratio(F.abs("_r"), ratio(a, F.lit(1e8))).alias("daily_amihud"),
        rolling_corr(F.col("_r"), F.col("_dv"), w, window).alias("close_volume_corr"), rolling_corr(F.col("_r"), F.col("_ldv"), w, window).alias("lead_lag_price_volume_corr"),
        ratio(v, F.col("_vs")).alias("turnover_concentration"), group_zscore(a, "trade_date").alias("amount_zscore"),
        (ratio(c - o, F.col("high") - F.col("low")) * busy).alias("money_flow_strength"), ((ratio(o, F.col("_pc")) - 1) * busy).alias("opening_flow_ratio"), (late * busy).alias("closing_flow_ratio"),
    )


def slow_wave_share(k: int = 2) -> Column:
    """Share of the volume's power at the ``k`` slowest frequencies of a day, as an aggregate over its bars.

    A frequency's power comes from one sum of cosines and one of sines; the power of all frequencies is the variance,
    by Parseval's identity, with the fastest one of an even number of bars counted once. So no spectrum is gathered.
    """
    n, m = F.max("_n"), F.max("_mean")
    v, at = F.coalesce(F.col("volume"), F.lit(0.0)) - F.col("_mean"), F.col("_t") - 1

    def power(freq: int) -> Column:
        angle = 2 * math.pi * freq * at / F.col("_n")
        return F.pow(F.sum(v * F.cos(angle)), F.lit(2.0)) + F.pow(F.sum(v * F.sin(angle)), F.lit(2.0))

    fastest = F.when(n % 2 == 0, F.pow(F.sum(F.when(at % 2 == 0, v).otherwise(-v)), F.lit(2.0))).otherwise(0.0)
    every = (n * F.sum(v * v) + fastest) / 2
    return F.when((n < 8) | (m <= 0), None).when(every <= m * m * 1e-18, 0.0).otherwise(ratio(sum((power(f) for f in range(2, k + 1)), power(1)), every))


def intraday_shape(bars: DataFrame, time: str = "bar_time", edge: int = 30) -> DataFrame:
    """Seven factors of a day from its minute bars, one row per (symbol, trade_date).

    A bar's return is from the bar before, the first one's from its own open. Skew and excess kurtosis are the unbiased
    ones, from central moments. A day's bars are few whatever the panel's size, so windows over a day are bounded.
    """
    day, w = Window.partitionBy(*DAY), Window.partitionBy(*DAY).orderBy(time)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = ratio(F.col("close"), F.col("open")) - 1
    told = bars.withColumns({
        "_r": F.coalesce(ratio(F.col("close"), F.lag("close").over(w)) - 1, own), "_own": own, "_t": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole),
        "_mean": F.avg(F.coalesce(F.col("volume"), F.lit(0.0))).over(whole),
    }).withColumn("_mu", F.avg("_r").over(day))
    d, n = F.col("_r") - F.col("_mu"), F.count("_r")
    m2, m3, m4 = (F.avg(F.pow(d, F.lit(float(p)))) for p in (2, 3, 4))
    skew = F.when((n > 2) & (m2 > 0), ratio(m3, F.pow(m2, F.lit(1.5))) * F.sqrt(n * (n - 1)) / (n - 2))
    kurtosis = F.when((n > 3) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (ratio(m4, m2 * m2) - 3) + 6))
    total = F.sum("amount")
    return told.groupBy(*DAY).agg(
        F.max_by("_own", F.when(F.col("volume").isNotNull(), F.struct(F.col("volume"), -F.col("_t")))).alias("top_volume_bar_return"), skew.alias("intraday_skew"), kurtosis.alias("intraday_kurtosis"),
        F.avg(ratio(F.abs("_r"), ratio(F.col("amount"), F.lit(1e6)))).alias("amihud_1min"), slow_wave_share().alias("crowding_fft_ratio"),
        F.when(total > 0, F.sum(F.when(F.col("_t") <= edge, F.col("amount"))) / total).alias("opening_flow_ratio"),
        F.when(total > 0, F.sum(F.when(F.col("_t") > F.col("_n") - edge, F.col("amount"))) / total).alias("closing_flow_ratio"),
    )


def high_frequency_factors(bars: DataFrame, window: int = 20, edge: int = 30, time: str = "bar_time") -> DataFrame:
    """All fourteen day factors of minute bars; where both know one, the minute bars' edge ratios stand."""
    daily = daily_microstructure(daily_bars(bars, time), window).drop("opening_flow_ratio", "closing_flow_ratio")
    return daily.join(intraday_shape(bars, time, edge), DAY)
