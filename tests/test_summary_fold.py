"""The summary's dates are folded once: same figures as by windows, and the long panel moves nowhere."""

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import evaluate as E


def panel(spark, symbols=60, days=40):
    rng, n = np.random.default_rng(9), symbols * days
    gap = lambda x, share: np.where(rng.random(n) < share, np.nan, x)
    pdf = pd.DataFrame({"symbol": np.tile(np.arange(symbols), days), "d": np.repeat(np.arange(days), symbols), "a": gap(rng.normal(size=n), 0.1), "b": gap(rng.integers(0, 6, n).astype(float), 0.1), "y": gap(rng.normal(size=n), 0.1)})
    pdf.loc[pdf["d"] == 3, "a"] = np.nan  # a date without values
    pdf.loc[pdf["d"] == 4, "b"] = 2.0  # a constant one
    pdf.loc[(pdf["d"] == 5) & (pdf["symbol"] > 1), "y"] = np.nan  # too few pairs
    df = spark.createDataFrame(pdf)
    known = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}"
    return df.selectExpr("symbol", "date_add(date'2024-01-01', cast(d as int)) AS trade_date", known("a"), known("b"), known("y"))


def test_both_ways_agree(spark, monkeypatch):
    p = panel(spark).cache()
    one = {r["factor_name"]: r.asDict() for r in E.factor_summary(p, ["a", "b"], "y", horizon=3).collect()}
    monkeypatch.setattr(E, "GROUP_ROWS", 10)
    two = {r["factor_name"]: r.asDict() for r in E.factor_summary(p, ["a", "b"], "y", horizon=3).collect()}
    assert one.keys() == two.keys() == {"a", "b"}
    for name in one:
        for c, v in one[name].items():
            assert v == (pytest.approx(two[name][c], rel=1e-9) if isinstance(v, float) else two[name][c]), (name, c)


def test_little_is_moved(spark):
    """With long rows sorted once a statistic 129 bytes a row were written for two factors."""
    p = panel(spark, 300, 100).cache()
    p.count()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    E.factor_summary(p, ["a", "b"], "y").collect()
    assert 0 < written() - before < 40 * 30_000, (written() - before) / 30_000
