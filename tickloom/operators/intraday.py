"""Session bars and day factors from minute or tick rows; the bar operator also runs on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import count_if, ratio, rounded
from tickloom.operators.cross import pct_rank

# Continuous-trading sessions as (start minute, end minute).
SESSIONS = (("morning", 570, 690), ("afternoon", 780, 900))


def bar_end(ts: Column, minutes: int) -> Column:
    """End of the session-anchored, right-closed bar a time falls in; NULL outside the sessions."""
    day = F.date_trunc("day", ts)
    second = F.unix_timestamp(ts) - F.unix_timestamp(day) + (F.unix_micros(ts) % 1_000_000 > 0).cast("int")
    out = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for _, lo, hi in SESSIONS:
        slot = F.ceil((second - lo * 60) / F.lit(minutes * 60.0)).cast("long")
        end = lo * 60 + slot * minutes * 60
        out = out.when((second > lo * 60) & (second <= hi * 60) & (end <= hi * 60), F.timestamp_seconds(F.unix_timestamp(day) + end))
    return out


def session_bars(rows: DataFrame, minutes: int, ts: str, price: str, size: str, keep_partial: bool = True) -> DataFrame:
    """OHLCV per (symbol, bar end); partially aggregated, so one busy symbol stays cheap."""
    t = rows.withColumn("bar_end", bar_end(F.col(ts), minutes)).where("bar_end is not null")
    bars = t.groupBy("symbol", "bar_end").agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"),
        F.sum(size).alias("volume"), F.sum(F.col(price) * F.col(size)).alias("amount"), F.max(ts).alias("last_seen"),
    )
    if keep_partial:
        return bars
    # a bar is complete once its session has been seen up to its end
    half = (F.hour("bar_end") >= 12).cast("int")
    bars = bars.withColumns({"_d": F.to_date("bar_end"), "_h": half})
    seen = bars.groupBy("symbol", "_d", "_h").agg(F.max("last_seen").alias("_seen"))
    return bars.join(seen, ["symbol", "_d", "_h"]).where(F.col("bar_end") <= F.col("_seen")).drop("_d", "_h", "_seen")


def day_factors(bars: DataFrame, edge: int = 6, top: int = 10) -> DataFrame:
    """Per symbol-day: edge returns, VWAP gap, range position, buy pressure, concentration, spikes, shares.

    ``bars`` holds one day's bars per group (bounded by the session length), so small arrays are safe.
    """
    w = Window.partitionBy("symbol", "trade_date").orderBy("bar_end")
    g = Window.partitionBy("symbol", "trade_date")
    b = bars.withColumn("trade_date", F.to_date("bar_end"))
    b = b.withColumns({
        "_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(g), "_r": ratio(F.col("close"), F.lag("close").over(w)) - 1,
        "_med": F.median("volume").over(g),
    })
    total = F.sum("volume")
    first_n, last_from = F.least(F.lit(edge), F.col("_n")), F.greatest(F.lit(1), F.col("_n") - edge + 1)
    open_, close_ = F.min_by("open", "_i"), F.max_by("close", "_i")
    biggest = F.slice(F.sort_array(F.collect_list("volume"), asc=False), 1, top)
    hi, lo = F.max("high"), F.min("low")
    up = F.sum(F.when(F.col("_r") > 0, F.col("volume")).otherwise(0.0))
    down = F.sum(F.when(F.col("_r") < 0, F.col("volume")).otherwise(0.0))
    half = F.floor(F.col("_n") / 2)
    out = b.groupBy("symbol", "trade_date").agg(
        F.count(F.lit(1)).alias("bars"),
        (ratio(F.max(F.when(F.col("_i") == first_n, F.col("close"))), open_) - 1).alias("first_return"),
        (ratio(close_, F.max(F.when(F.col("_i") == last_from, F.col("close")))) - 1).alias("last_return"),
        (ratio(close_, ratio(F.sum(F.col("close") * F.col("volume")), total)) - 1).alias("vwap_deviation"),
        F.when(hi - lo > 1e-12, (close_ - lo) / (hi - lo)).otherwise(0.5).alias("range_position"),
        ratio(up - down, total).alias("net_buy_pressure"),
        F.when(F.count(F.lit(1)) >= top, ratio(F.aggregate(biggest, F.lit(0.0), lambda a, v: a + v), total)).alias("volume_concentration"),
        count_if(F.col("volume") > 3 * F.col("_med")).alias("spike_bars"),
        ratio(F.sum(F.when(F.col("_i") > half, F.col("volume"))), F.sum(F.when(F.col("_i") <= half, F.col("volume")))).alias("pm_am_ratio"),
        ratio(F.sum(F.when(F.col("_i") <= first_n, F.col("volume"))), total).alias("opening_share"),
        ratio(F.sum(F.when(F.col("_i") >= last_from, F.col("volume"))), total).alias("closing_share"),
        F.avg(ratio(F.abs(F.ln(1 + F.col("_r"))), F.col("amount") / 1e6)).alias("amihud"),
    )
    return out


def causal_features(bars: DataFrame, looks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Running VWAP, high, low and trailing returns within the day: nothing after the bar is read."""
    w = Window.partitionBy("symbol", F.to_date("bar_end")).orderBy("bar_end")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cols = {
        "running_vwap": ratio(F.sum("amount").over(run), F.sum("volume").over(run)),
        "running_high": F.max("high").over(run), "running_low": F.min("low").over(run),
    }
    for k in looks:
        cols[f"return_{k}"] = ratio(F.col("close"), F.lag("close", k).over(w)) - 1
    return bars.withColumns(cols)


def relative_strength(bars: DataFrame, returns: str, sector: str) -> DataFrame:
    """Return minus the market's and the sector's mean at the same bar."""
    return bars.withColumns({
        "vs_market": F.col(returns) - F.avg(returns).over(Window.partitionBy("bar_end")),
        "vs_sector": F.col(returns) - F.avg(returns).over(Window.partitionBy("bar_end", sector)),
    })


def round_trips(bars: DataFrame, take: float, stop: float, cost: float) -> DataFrame:
    """Per bar: first touch of take-profit or stop in the rest of the day, else the day's close, net of cost."""
    w = Window.partitionBy("symbol", F.to_date("bar_end")).orderBy("bar_end")
    rest = w.rowsBetween(1, Window.unboundedFollowing)
    path = F.collect_list(F.struct(F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))).over(rest)
    work = bars.withColumn("_path", path)
    c = F.col("close")
    hit = F.filter("_path", lambda s: (s["h"] >= c * (1 + take)) | (s["l"] <= c * (1 - stop)))
    work = work.withColumn("_hit", F.get(hit, F.lit(0))).withColumn("_end", F.get("_path", F.size("_path") - 1))
    outcome = F.when(F.col("_hit.l") <= c * (1 - stop), "stop").when(F.col("_hit").isNotNull(), "take").when(F.col("_end").isNotNull(), "close")
    gain = F.when(outcome == "stop", F.lit(-stop)).when(outcome == "take", F.lit(take)).otherwise(F.col("_end.c") / c - 1)
    return work.withColumns({"outcome": outcome, "net_return": gain - cost}).drop("_path", "_hit", "_end")


def depth_features(df: DataFrame, bids: str, asks: str) -> DataFrame:
    """Imbalance, spread and sums from level arrays."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    b, a = add(F.col(bids)), add(F.col(asks))
    return df.withColumns({
        "bid_depth": b, "ask_depth": a, "imbalance": ratio(b - a, F.abs(b) + F.abs(a)), "spread": F.get(asks, F.lit(0)) - F.get(bids, F.lit(0)),
    })


def flow_features(trades: DataFrame, buys: Column, at: str, sequence: str, price: str, size: str, closing: int = 30) -> DataFrame:
    """Per symbol-day of trades: net buying, range position, largest trade's share, VWAP gap, closing share.

    Trades fold to minutes first, so the closing share (the last ``closing`` minutes up to the day's last trade) needs
    the last minute of at most 1,440 rows. A day of empty trades has NaN shares, no VWAP gap and no closing share.
    """
    day = ["symbol", "trade_date"]
    signed = F.when(buys, F.col(size)).otherwise(-F.col(size))
    minutes = trades.groupBy("symbol", F.to_date(at).alias("trade_date"), F.date_trunc("minute", F.col(at)).alias("_at")).agg(
        F.sum(signed).alias("_net"), F.sum(size).alias("_all"), F.max(size).alias("_top"), F.sum(F.col(price) * F.col(size)).alias("_paid"),
        F.max(price).alias("_hi"), F.min(price).alias("_lo"), F.max_by(price, sequence).alias("_close"), F.max(sequence).alias("_id"),
    )
    last = F.max("_at").over(Window.partitionBy(*day))
    minutes = minutes.withColumn("_late", F.col("_at") > last - F.make_dt_interval(mins=F.lit(closing)))
    total, close_, lo = F.sum("_all"), F.max_by("_close", "_id"), F.min("_lo")
    share = lambda a: rounded(F.when(total == 0, float("nan")).otherwise(F.try_divide(a, total)), 8)
    return minutes.groupBy(*day).agg(
        share(F.sum("_net")).alias("net_buy_pressure"), rounded(ratio(close_ - lo, F.max("_hi") - lo), 8).alias("range_position"), share(F.max("_top")).alias("volume_concentration"),
        rounded(ratio(close_, ratio(F.sum("_paid"), total)) - 1, 8).alias("vwap_deviation"), rounded(ratio(F.sum(F.when(F.col("_late"), F.col("_all")).otherwise(0.0)), total), 8).alias("closing_share"),
    )


def microstructure_guard(day: DataFrame) -> DataFrame:
    """Sweep-dump, pressure-sell and wash-volume risks of each name from its percent ranks of the date, and what to do.

    A name whose feature is unknown ranks in the middle. Sweep and pressure are acute: either avoids a name.
    """
    rank = lambda x: F.coalesce(pct_rank(x, "trade_date"), F.lit(0.5))
    features = ("net_buy_pressure", "range_position", "volume_concentration", "vwap_deviation", "closing_share")
    r = day.withColumns({c: rank(F.col(c)) for c in features} | {"_flat": rank(F.abs("vwap_deviation"))})
    nb, pos, vc, vd, c30 = (F.col(c) for c in features)
    risk = {
        "sweep_dump_risk": 0.4 * (1 - pos) + 0.35 * (1 - nb) + 0.25 * vc,
        "pressure_sell_risk": 0.4 * c30 + 0.3 * (1 - nb) + 0.3 * (1 - vd),
        "wash_volume_risk": 0.6 * vc + 0.4 * (1 - F.col("_flat")),
    }
    s = r.select("symbol", "trade_date", *[rounded(x * 1.00000000001, 3).alias(c) for c, x in risk.items()])
    acute = F.greatest("sweep_dump_risk", "pressure_sell_risk")
    action = F.when(acute >= 0.8, "avoid").when((acute >= 0.65) | (F.col("wash_volume_risk") >= 0.8), "caution").otherwise("ok")
    return s.withColumn("guard_action", action)
