"""Cross-section statistics: one date at a time, with a plan for dates too wide for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.series import tie_key
from tickloom.session import stored

#: More rows than this with one value are not gathered by that value.
HOT_ROWS = 100_000


def mean_rank(x: Column, *keys: str | Column) -> Column:
    """Average-tie rank (1-based) among the known values of the group; one sort per ranked column."""
    k = tie_key(x)
    w = Window.partitionBy(*keys).orderBy(k.asc_nulls_last())
    upto = F.count(k).over(w.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2.0)


def group_count(x: Column, *keys: str | Column) -> Column:
    return F.count(x).over(Window.partitionBy(*keys))


def pct_rank(x: Column, *keys: str | Column) -> Column:
    """Average-tie percent rank of known values (Spark's ``percent_rank`` is another statistic)."""
    return mean_rank(x, *keys) / group_count(x, *keys)


def group_zscore(x: Column, *keys: str | Column, floor: float = 1e-12) -> Column:
    """(x - mean) / population deviation; a group without spread has no score."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > floor, (x - F.avg(x).over(w)) / sd)


def group_scale(x: Column, k: float, *keys: str | Column) -> Column:
    size = F.sum(F.abs(x)).over(Window.partitionBy(*keys))
    return F.when(size > 0, x * F.lit(k) / size)


def group_demean(x: Column, *keys: str | Column) -> Column:
    return x - F.avg(x).over(Window.partitionBy(*keys))


def unit_rank(x: Column, *keys: str | Column) -> Column:
    """Ranks stretched to [-1, 1]; missing values and lone values become 0."""
    n = group_count(x, *keys)
    return F.coalesce(F.when(n > 1, 2.0 * (mean_rank(x, *keys) - 1.0) / (n - 1.0) - 1.0), F.lit(0.0))


def group_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per group with the exact median of each column."""
    return df.groupBy(*keys).agg(*[F.median(c).alias(f"_med_{c}") for c in columns])


def winsorise_mad(df: DataFrame, columns: list[str], keys: list[str], n_mad: float = 5.0) -> DataFrame:
    """Clip each column to median ± n·1.4826·MAD of its group; groups without spread stay as they are."""
    med = group_medians(df, keys, columns)
    with_med = df.join(med, keys, "left")
    devs = with_med.select(*keys, *[F.abs(F.col(c) - F.col(f"_med_{c}")).alias(c) for c in columns])
    mad = group_medians(devs, keys, columns)
    mad = mad.select(*keys, *[F.col(f"_med_{c}").alias(f"_mad_{c}") for c in columns])
    joined = with_med.join(mad, keys, "left")
    out = {}
    for c in columns:
        reach = F.lit(1.4826 * n_mad) * F.col(f"_mad_{c}")
        lo, hi = F.col(f"_med_{c}") - reach, F.col(f"_med_{c}") + reach
        x = F.col(c)
        out[c] = F.when(x.isNull() | (F.col(f"_mad_{c}") <= 1e-12), x).otherwise(F.least(F.greatest(x, lo), hi))
    return joined.withColumns(out).drop(*[f"_med_{c}" for c in columns], *[f"_mad_{c}" for c in columns])


def robust_zscore(df: DataFrame, columns: list[str], keys: list[str], suffix: str = "_rz") -> DataFrame:
    """(x - median) / (1.4826·MAD + 1e-12) per group."""
    med = group_medians(df, keys, columns)
    with_med = df.join(med, keys, "left")
    devs = with_med.select(*keys, *[F.abs(F.col(c) - F.col(f"_med_{c}")).alias(c) for c in columns])
    mad = group_medians(devs, keys, columns).select(*keys, *[F.col(f"_med_{c}").alias(f"_mad_{c}") for c in columns])
    joined = with_med.join(mad, keys, "left")
    out = {
        f"{c}{suffix}": (F.col(c) - F.col(f"_med_{c}")) / (F.lit(1.4826) * F.col(f"_mad_{c}") + F.lit(1e-12))
        for c in columns
    }
    return joined.withColumns(out).drop(*[f"_med_{c}" for c in columns], *[f"_mad_{c}" for c in columns])


def winsorise_quantile(
    df: DataFrame, columns: list[str], keys: list[str], lower: float = 0.01, upper: float = 0.99
) -> DataFrame:
    """Clip each column to its group's exact lower and upper quantile."""
    bounds = df.groupBy(*keys).agg(
        *[F.percentile(c, F.lit(q)).alias(f"_{n}_{c}") for c in columns for n, q in (("lo", lower), ("hi", upper))]
    )
    joined = df.join(bounds, keys, "left")
    out = {
        c: F.when(F.col(c).isNull(), None).otherwise(
            F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))
        )
        for c in columns
    }
    return joined.withColumns(out).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def fill_group_median(df: DataFrame, columns: list[str], fine: list[str], coarse: list[str]) -> DataFrame:
    """Missing values take the median of the fine group, then of the coarse group."""
    inner = group_medians(df, fine, columns)
    outer = group_medians(df, coarse, columns)
    outer = outer.select(*coarse, *[F.col(f"_med_{c}").alias(f"_all_{c}") for c in columns])
    joined = df.join(inner, fine, "left").join(outer, coarse, "left")
    out = {c: F.coalesce(F.col(c), F.col(f"_med_{c}"), F.col(f"_all_{c}")) for c in columns}
    return joined.withColumns(out).drop(*[f"_med_{c}" for c in columns], *[f"_all_{c}" for c in columns])


def ols_residual(df: DataFrame, target: str, exposure: str, keys: list[str], out: str = "residual") -> DataFrame:
    """Residual of target on one exposure with intercept, per group, from partially aggregated sums."""
    y, x = F.col(target), F.col(exposure)
    pair = y.isNotNull() & x.isNotNull()
    fit = df.where(pair).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.count(F.lit(1)).alias("_n")
    )
    joined = df.join(fit, keys, "left")
    return joined.withColumn(
        out, F.when(pair & (F.col("_n") > 2), y - F.col("_a") - F.col("_b") * x)
    ).drop("_a", "_b", "_n")


# -- dates too wide for one task -----------------------------------------------------------


def split_rank(
    df: DataFrame,
    columns: dict[str, Column],
    key: list[str],
    row_id: list[str],
    buckets: int = 64,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``pct_rank`` of several columns without ever putting a whole group into one task.

    The columns are stacked into (group, name, value) rows. Approximate quantiles per (group,
    name) are mergeable sketches; they only choose cut points, so the result stays exact. Equal
    values are first counted together, then each bucket is ranked on its own and shifted by the
    rows in lower buckets. Ranks return to their rows by an equi-join on the value. A value that
    more than ``HOT_ROWS`` rows share is broadcast and its rows are spread by row id, so no task
    gathers them. Values and cut points are stored: a sketch depends on the order in which its
    parts meet, so points computed anew for the offsets need not be the same.
    """
    names = list(columns)
    wide = df.withColumns({f"_k_{i}": tie_key(columns[n]) for i, n in enumerate(names)})
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_k_{i}").alias("_v")) for i in range(len(names))]))
    long = wide.select(*key, *row_id, stack.alias("_s")).select(
        *key, *row_id, F.col("_s._c").alias("_c"), F.col("_s._v").alias("_v")
    ).where(F.col("_v").isNotNull())
    points = [i / buckets for i in range(1, buckets)]
    long = stored(long, "ranked")
    cuts = stored(long.groupBy(*key, "_c").agg(F.percentile_approx("_v", points, 10_000).alias("_cuts")), "cuts")
    values = long.groupBy(*key, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = values.join(cuts, [*key, "_c"]).withColumn(
        "_b", F.size(F.filter(F.col("_cuts"), lambda c: c < F.col("_v")))
    ).drop("_cuts")
    per_bucket = placed.groupBy(*key, "_c", "_b").agg(F.sum("_n").alias("_in"))
    group = Window.partitionBy(*key, "_c")
    below = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *key, "_c", "_b",
        F.coalesce(F.sum("_in").over(below), F.lit(0)).alias("_off"),
        F.sum("_in").over(group).alias("_all"),
    )
    inside = Window.partitionBy(*key, "_c", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(offsets, [*key, "_c", "_b"]).select(
        *key, "_c", "_v", "_n",
        ((F.col("_off") + F.sum("_n").over(inside) - F.col("_n") / 2.0 + 0.5) / F.col("_all")).alias("_r"),
    )
    ranked = stored(ranked, "ranks")
    shared = F.broadcast(ranked.where(F.col("_n") > hot_rows).select(*key, "_c", "_v", F.col("_r").alias("_hot")))  # rows / hot_rows values
    rest = ranked.where(F.col("_n") <= hot_rows).select(*key, "_c", "_v", F.lit(0).alias("_h"), "_r")
    spread = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*row_id), F.lit(1 << 20))).otherwise(0).cast("int")
    back = (
        long.join(shared, [*key, "_c", "_v"], "left").withColumn("_h", spread)
        .join(rest, [*key, "_c", "_v", "_h"], "left").withColumn("_r", F.coalesce("_hot", "_r"))
        .groupBy(*key, *row_id)
        .agg(*[F.max(F.when(F.col("_c") == i, F.col("_r"))).alias(n) for i, n in enumerate(names)])
    )
    return wide.drop(*[f"_k_{i}" for i in range(len(names))]).join(back, [*key, *row_id], "left")


def split_moments(df: DataFrame, key: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates attached to every row: partial aggregation, then a join by key."""
    stats = df.groupBy(*key).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, key, "left")
