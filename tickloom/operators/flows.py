"""Capital-flow tables: one schema for many sources, features and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.series import rolling

# Quality and horizon of each flow source.
SOURCE_QUALITY = {
    "northbound_holding": 0.85, "northbound_net_buy": 0.80, "dragon_tiger": 0.70, "main_money_flow": 0.60, "margin_financing": 0.65,
    "etf_fund_flow": 0.75, "block_trade": 0.60, "institutional_research": 0.55, "public_fund_holding": 0.70,
}
FROM_LEVEL = ("northbound_holding", "margin_financing", "public_fund_holding")


def normalise_flow(frame: DataFrame, source: str, value: str) -> DataFrame:
    """One source in the common schema; level sources become changes per symbol."""
    x = F.col(value).cast("double")
    if source in FROM_LEVEL:
        net = x - F.lag(x).over(Window.partitionBy("symbol").orderBy("trade_date"))
    else:
        net = x
    return frame.select("trade_date", "symbol", F.lit(source).alias("source"), net.alias("net_amount")).select(
        "*", F.greatest("net_amount", F.lit(0.0)).alias("buy_amount"), F.greatest(-F.col("net_amount"), F.lit(0.0)).alias("sell_amount"),
        F.lit(SOURCE_QUALITY.get(source, 0.5)).alias("evidence_quality"),
    )


def flow_features(flows: DataFrame, window: int = 20) -> DataFrame:
    """z, acceleration, sign persistence, reversal, concentration, imbalance and pressure per (source, symbol)."""
    least = max(3, window // 4)
    w = Window.partitionBy("source", "symbol").orderBy("trade_date")
    x = F.col("net_amount")
    day = Window.partitionBy("trade_date", "source")
    f = flows.withColumns({
        "flow_zscore": ratio(x - rolling("mean", x, w, window, least), rolling("std", x, w, window, least)),
        "flow_acceleration": x - F.lag(x).over(w),
        "flow_persistence": rolling("mean", F.signum(x), w, window, least),
        "flow_reversal": -(x - F.lag(x, window).over(w)),
        "flow_concentration": ratio(F.abs(x), F.sum(F.abs(x)).over(day)),
        "institution_retail_imbalance": ratio(F.col("buy_amount") - F.col("sell_amount"), F.col("buy_amount") + F.col("sell_amount")),
    })
    return f.withColumn("large_order_pressure", F.col("flow_zscore") * F.col("flow_concentration"))


def flow_signals(features: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Latest row per (source, symbol), kept when z or pressure is large, squashed to a score."""
    last = features.groupBy("source", "symbol").agg(F.max_by(F.struct("trade_date", "flow_zscore", "large_order_pressure", "evidence_quality"), "trade_date").alias("s"))
    last = last.select("source", "symbol", "s.trade_date", F.coalesce("s.flow_zscore", F.lit(0.0)).alias("z"), F.coalesce("s.large_order_pressure", F.lit(0.0)).alias("p"), "s.evidence_quality")
    loud = (F.abs("z") >= threshold) | (F.abs("p") >= threshold * 0.05)
    score = F.tanh(0.6 * F.col("z") + 4.0 * F.col("p"))
    return last.where(loud).select("source", "symbol", "trade_date", score.alias("score"), F.least(F.abs(score), F.lit(1.0)).alias("confidence"), "evidence_quality")
