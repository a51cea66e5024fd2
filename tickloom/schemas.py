"""Declared schemas and the checks a frame must pass before it is used."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = "symbol long, trade_date date, open double, high double, low double, close double, volume double, amount double"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
ADJUSTMENTS = "symbol long, effective_date date, hfq_factor double"
INTERVALS = "symbol long, effective_start date, effective_end date"
STATEMENTS = "symbol long, report_period date, available_at timestamp, revenue double, cost double, cash double, assets double, debt double"


@dataclass(frozen=True)
class Contract:
    """Required and optional columns of one kind of table, and the key that must be unique."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    min_coverage: dict[str, float] = field(default_factory=dict)


DAILY = Contract("daily_bars", ("symbol", "trade_date", "open", "high", "low", "close", "volume"), ("amount",), ("symbol", "trade_date"))


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [c for c in contract.required if c not in df.columns]


def check_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per declared column: present, missing-value share, and whether its coverage bound holds."""
    present = [c for c in (*contract.required, *contract.optional) if c in df.columns]
    facts = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in present]) if present else df.limit(0)
    rows = []
    for c in (*contract.required, *contract.optional):
        share = F.col(c) if c in present else F.lit(None).cast("double")
        bound = contract.min_coverage.get(c, 0.0)
        ok = F.lit(c in present or c in contract.optional) & F.coalesce(1 - share >= bound, F.lit(bound == 0.0))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(c in present).alias("present"), F.round(share, 6).alias("null_share"), ok.alias("ok")))
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pin_features(df: DataFrame, keys: list[str], pinned: list[str]) -> DataFrame:
    """Exactly the pinned feature list: missing columns become NULL, others are dropped."""
    return df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in pinned])


def feature_drift(df: DataFrame, pinned: list[str], keys: list[str]) -> dict[str, list[str]]:
    have = [c for c in df.columns if c not in keys]
    return {"missing": [c for c in pinned if c not in have], "extra": [c for c in have if c not in pinned]}


def feature_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """Numeric columns that are no keys and no labels."""
    numeric = ("double", "float", "int", "bigint", "smallint")
    return [c for c, t in df.dtypes if t in numeric and c not in keys and not c.startswith(("forward_", "future_", "label"))]
