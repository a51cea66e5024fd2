"""The order-flow guard: all three scores, and the action that any of them asks for."""

import math

import pandas as pd

from tickloom.operators import intraday as I

FEATURES = ["net_buy_pressure", "range_position", "volume_concentration", "vwap_deviation", "closing_share"]


def test_every_score_counts(spark):
    rows = [("a", 0.9, 0.9, 0.1, 0.05, 0.1), ("b", -0.9, 0.8, 0.2, -0.05, 0.9), ("c", 0.8, 0.7, 0.9, 0.0, 0.2), ("d", 0.7, None, 0.3, 0.03, 0.3), ("e", 0.6, 0.5, 0.4, None, 0.4)]
    day = spark.createDataFrame([(s, "2024-01-02", *x) for s, *x in rows], "symbol string, trade_date string, " + ", ".join(f"{c} double" for c in FEATURES))
    got = {r["symbol"]: r for r in I.microstructure_guard(day).collect()}
    frame = pd.DataFrame(rows, columns=["symbol", *FEATURES]).set_index("symbol")
    r = frame.rank(pct=True).fillna(0.5)
    flat = 1 - frame["vwap_deviation"].abs().rank(pct=True).fillna(0.5)
    sweep = 0.4 * (1 - r["range_position"]) + 0.35 * (1 - r["net_buy_pressure"]) + 0.25 * r["volume_concentration"]
    press = 0.4 * r["closing_share"] + 0.3 * (1 - r["net_buy_pressure"]) + 0.3 * (1 - r["vwap_deviation"])
    wash = 0.6 * r["volume_concentration"] + 0.4 * flat
    for s in frame.index:
        for c, want in (("sweep_dump_risk", sweep), ("pressure_sell_risk", press), ("wash_volume_risk", wash)):
            assert math.isclose(got[s][c], want[s], abs_tol=5.1e-4), (s, c)
        acute = max(got[s]["sweep_dump_risk"], got[s]["pressure_sell_risk"])
        assert got[s]["guard_action"] == ("avoid" if acute >= 0.8 else "caution" if acute >= 0.65 or got[s]["wash_volume_risk"] >= 0.8 else "ok")
    assert got["b"]["sweep_dump_risk"] < 0.65 and got["b"]["guard_action"] == "avoid"  # by late selling alone
    assert got["c"]["guard_action"] == "caution"  # by wash volume alone


def test_closing_share_and_gap_of_a_day(spark):
    trades = [(1, "2024-01-02 10:00:00", 1, 10.0, 4.0), (1, "2024-01-02 14:30:30", 2, 11.0, 2.0), (1, "2024-01-02 14:31:10", 3, 12.0, 1.0), (1, "2024-01-02 15:00:59", 4, 11.0, 3.0), (1, "2024-01-02 15:00:01", 5, 10.0, 0.0)]
    df = spark.createDataFrame(trades, "symbol long, ts string, id long, price double, size double").selectExpr("*", "size > 2 AS buy").withColumn("ts", I.F.col("ts").cast("timestamp"))
    row = I.flow_features(df, I.F.col("buy"), "ts", "id", "price", "size").first()
    assert row["closing_share"] == 0.4  # from 14:31 on
    assert row["vwap_deviation"] == round(10.0 / (107.0 / 10.0) - 1, 8)
    assert (row["net_buy_pressure"], row["range_position"], row["volume_concentration"]) == (0.4, 0.0, 0.4)
