"""Size checks that pick between a plan for bounded groups and a plan for unbounded ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows a side may hold before it is joined by shuffle and not by broadcast.
BROADCAST_ROWS = 200_000
#: Most rows one window group may hold before the split operators take over.
GROUP_ROWS = 2_000_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to shuffle (and AQE)."""
    return F.broadcast(df) if fits(df, rows) else df


def largest_group(df: DataFrame, *keys: str) -> int:
    """Rows in the largest key group: one partially aggregated pass, one number back."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


@dataclass(frozen=True)
class Layout:
    """How a panel keyed (series, date) is laid out for windows.

    ``split_series``: one series may be too long for one task, so it is cut into row chunks
    with a halo. ``split_dates``: one cross-section may be too wide for one task, so ranks
    are taken per value bucket and moments per partial aggregate.
    """

    series: str = "symbol"
    date: str = "trade_date"
    split_series: bool = False
    split_dates: bool = False
    chunk_rows: int = 100_000
    rank_buckets: int = 64

    @classmethod
    def measured(cls, panel: DataFrame, series: str = "symbol", date: str = "trade_date", limit: int = GROUP_ROWS) -> "Layout":
        """Choose by counting the largest series and the largest date of ``panel``."""
        return cls(
            series=series,
            date=date,
            split_series=largest_group(panel, series) > limit,
            split_dates=largest_group(panel, date) > limit,
        )

    @classmethod
    def bounded(cls, symbols: int, sessions: int, limit: int = GROUP_ROWS, **kw) -> "Layout":
        """Choose from known bounds (a daily panel has one row per symbol and session)."""
        return cls(split_series=sessions > limit, split_dates=symbols > limit, **kw)
