"""Runs of consecutive rows: gaps and islands, merged intervals, validity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, state: Column) -> DataFrame:
    """Closed runs of rows with equal ``state``: key, state, first and last order value, rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.select(*keys, order, state.alias("state"))
    turned = (F.lag("state").over(w).isNull() | ~F.col("state").eqNullSafe(F.lag("state").over(w))).cast("int")
    tagged = marked.withColumn("_turn", turned).withColumn("_run", F.sum("_turn").over(w))
    return tagged.groupBy(*keys, "_run", "state").agg(
        F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_rows")
    ).drop("_run")


def runs_where(df: DataFrame, keys: list[str], order: str, cond: Column) -> DataFrame:
    return runs(df, keys, order, F.coalesce(cond, F.lit(False))).where("state").drop("state")


def overlapping(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that begin before an earlier interval of the same key has ended."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    far = F.to_date(F.lit("9999-12-31"))
    reach = F.max(F.coalesce(F.col(end), far)).over(w)
    return intervals.withColumn("_reach", reach).where(F.col("_reach") >= F.col(start)).drop("_reach")
