"""The factor panel most evaluation queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.checks.factor_sql import factor_sql
from tickloom.functions import factor as f
from tickloom.functions.factor import col
from tickloom.plans.factors import evaluate
from tickloom.plans.inputs import BARS_SQL, bars, bars_layout

C, O, V, H, L = (col(c) for c in ("close", "open", "volume", "high", "low"))
PANEL_FACTORS = {
    "mom": f.mean(f.returns(C), 5),
    "vlm": f.rank(V),
    "gap": (C - O) / C,
    "ret": f.returns(C),
    "fwd1": f.lead(C, 1) / C - 1.0,
    "fwd5": f.lead(C, 5) / C - 1.0,
}
KEEP = ("close", "amount", "volume")


def factor_panel(spark: SparkSession, root: str) -> DataFrame:
    return evaluate(bars(spark, root), PANEL_FACTORS, bars_layout(spark, root), keep=list(KEEP), tidied=True)


PANEL_SQL = f"panel AS MATERIALIZED ({factor_sql(BARS_SQL, PANEL_FACTORS, keep=KEEP)})"


def rk(x: str, keys: str) -> str:
    """Average-tie rank over non-null rows."""
    t = f"round_even({x} * 1e10, 0)"
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {t}) + (count(*) OVER (PARTITION BY {keys}, {t}) - 1) / 2.0)"
