"""Exact quantiles of groups of any size, by partial counts instead of one buffer per group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import stored


def ranked_counts(df: DataFrame, keys: list[str], value: str, buckets: int = 64) -> DataFrame:
    """Distinct values per group with the 0-based positions [_lo, _hi) they fill and the group size.

    ``percentile`` holds a whole group's distinct values in one buffer. Here equal values are
    counted with partial aggregation, mergeable sketches choose cut points, and only one bucket
    at a time is ordered. The rows and the cut points are stored: a sketch depends on the order in which its parts meet,
    so points computed anew for the offsets and for the values need not be the same.
    """
    one = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")) if keys else rows.select(
        F.lit(1).alias("_all"), F.col(value).cast("double").alias("_v")
    )
    rows = stored(rows, "quantiles")
    counts = rows.groupBy(*one, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = stored(rows.groupBy(*one).agg(
        F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts")
    ), "cuts")
    placed = counts.join(cuts, one).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    per = placed.groupBy(*one, "_b").agg(F.sum("_n").alias("_in"))
    group = Window.partitionBy(*one)
    below = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *one, "_b", F.coalesce(F.sum("_in").over(below), F.lit(0)).alias("_off"), F.sum("_in").over(group).alias("_all_n")
    )
    inside = Window.partitionBy(*one, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(offsets, [*one, "_b"]).withColumn("_hi", F.col("_off") + F.sum("_n").over(inside)).withColumn(
        "_lo", F.col("_hi") - F.col("_n")
    )
    return ranked


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int = 64) -> DataFrame:
    """Linear-interpolation quantiles per group (one row per group), as ``percentile`` gives."""
    one = keys or ["_all"]
    ranked = ranked_counts(df, keys, value, buckets)
    picks = []
    for name, q in probs.items():
        pos = (F.col("_all_n") - 1) * F.lit(float(q))
        k0 = F.floor(pos)
        k1 = F.least(k0 + 1, F.col("_all_n") - 1)
        at0 = F.max(F.when((F.col("_lo") <= k0) & (k0 < F.col("_hi")), F.col("_v")))
        at1 = F.max(F.when((F.col("_lo") <= k1) & (k1 < F.col("_hi")), F.col("_v")))
        picks.append((at0 + (at1 - at0) * F.max(pos - k0)).alias(name))
    out = ranked.groupBy(*one).agg(*picks)
    return out if keys else out.drop("_all")


def order_statistic(df: DataFrame, keys: list[str], value: str, position: Callable[[Column], Column], out: str) -> DataFrame:
    """The value at a 0-based position per group; ``position`` maps the group size to it."""
    one = keys or ["_all"]
    k = position(F.col("_all_n"))
    hit = F.max(F.when((F.col("_lo") <= k) & (k < F.col("_hi")), F.col("_v"))).alias(out)
    res = ranked_counts(df, keys, value).groupBy(*one).agg(hit)
    return res if keys else res.drop("_all")
