"""Windows over one series, and the exact split of series too long for one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio

#: Values that agree to this many units are ties: float noise must not decide an order.
TIE_SCALE = 1e10


def tie_key(x: Column) -> Column:
    return F.rint(x * F.lit(TIE_SCALE)) + F.lit(0.0)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(value: Column, x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """``value`` only where the trailing n rows hold at least ``least`` known values of x (default: all n)."""
    return F.when(F.count(x).over(trailing(w, n)) >= (least or n), value)


def rolling(name: str, x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    f = trailing(w, n)
    if name in ("skew", "kurt"):
        m = float(n)
        if name == "skew":
            stat = F.skewness(x).over(f) * F.lit((m * (m - 1)) ** 0.5 / (m - 2))
        else:
            stat = F.lit((m - 1) / ((m - 2) * (m - 3))) * ((m + 1) * F.kurtosis(x).over(f) + F.lit(6.0))
        return full(F.when(F.min(x).over(f) < F.max(x).over(f), stat), x, w, n, least)
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "pstd": F.stddev_pop}[name]
    return full(fn(x).over(f), x, w, n, least)


def rolling_list(x: Column, w: WindowSpec, n: int) -> Column:
    """The trailing n values in row order, or NULL unless all n are known (collect_list drops NULLs)."""
    values = F.collect_list(x).over(trailing(w, n))
    return F.when(F.count(x).over(trailing(w, n)) == n, values)


def ts_rank(x: Column, w: WindowSpec, n: int) -> Column:
    """Average-tie rank of the newest value among the trailing n, as a share of n."""
    values = rolling_list(tie_key(x), w, n)
    now = tie_key(x)
    score = F.aggregate(
        values, F.lit(0.0), lambda s, v: s + F.when(v < now, 1.0).when(v == now, 0.5).otherwise(0.0)
    )
    return (score + F.lit(0.5)) / F.lit(float(n))


def ts_argmax(x: Column, w: WindowSpec, n: int) -> Column:
    values = rolling_list(tie_key(x), w, n)
    return F.array_position(values, F.array_max(values)).cast("double")


def ts_argmin(x: Column, w: WindowSpec, n: int) -> Column:
    values = rolling_list(tie_key(x), w, n)
    return F.array_position(values, F.array_min(values)).cast("double")


def decay_linear(x: Column, w: WindowSpec, n: int) -> Column:
    """Weights 1..n, newest heaviest, summed in a fixed order."""
    values = rolling_list(x, w, n)
    weights = F.array(*[F.lit(float(k)) for k in range(1, n + 1)])
    dot = F.aggregate(F.zip_with(values, weights, lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)
    return dot / F.lit(n * (n + 1) / 2.0)


def rolling_product(x: Column, w: WindowSpec, n: int) -> Column:
    return F.aggregate(rolling_list(x, w, n), F.lit(1.0), lambda s, v: s * v)


def rolling_median(x: Column, w: WindowSpec, n: int) -> Column:
    ordered = F.array_sort(rolling_list(x, w, n))
    lo, hi = (n + 1) // 2, n // 2 + 1
    return (F.element_at(ordered, lo) + F.element_at(ordered, hi)) / 2.0


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, x), F.when(known, y)


def rolling_cov(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    a, b = _pair(x, y)
    return full(F.covar_samp(a, b).over(trailing(w, n)), a, w, n)


def rolling_corr(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    """Pearson over n rows; a constant side has no correlation.

    Two points are correlated by the signs of their steps alone, which avoids dividing two
    nearly cancelled spreads.
    """
    a, b = _pair(x, y)
    if n == 2:
        step = F.signum(a - F.lag(a).over(w)) * F.signum(b - F.lag(b).over(w))
        return F.nullif(step, F.lit(0.0))
    f = trailing(w, n)
    varied = (F.min(a).over(f) < F.max(a).over(f)) & (F.min(b).over(f) < F.max(b).over(f))
    spread = F.stddev_pop(a).over(f) * F.stddev_pop(b).over(f)
    return full(F.when(varied, ratio(F.covar_pop(a, b).over(f), spread)), a, w, n)


# -- series too long for one task ----------------------------------------------------------


def number_rows(df: DataFrame, series: list[str], order: list[str], bucket: Column, out: str = "_row") -> DataFrame:
    """Exact 0-based position of each row inside its series, without sorting a series in one task.

    Rows are counted per (series, bucket), where ``bucket`` is a coarse non-decreasing function
    of the order (a month, an hour). The counts are small and their running sum gives each
    bucket's offset; positions inside a bucket come from a window over that bucket alone.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*series, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*series).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*series, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*series, "_bucket").orderBy(*order)
    return (
        tagged.join(offsets, [*series, "_bucket"])
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def over_chunks(
    df: DataFrame,
    series: list[str],
    order: list[str],
    lookback: int,
    apply: Callable[[DataFrame, WindowSpec], DataFrame],
    chunk_rows: int = 100_000,
    row: str = "_row",
) -> DataFrame:
    """Run trailing-window columns over fixed-size row chunks of each series.

    ``df`` carries the exact row position ``row``. The last ``lookback`` rows of a chunk are also
    sent to the next one as a halo, so every trailing window of at most ``lookback`` earlier rows
    is complete; halo rows are dropped afterwards. A series holding a third of the data becomes
    many tasks instead of one.
    """
    size = max(int(chunk_rows), int(lookback) + 1)
    home = F.floor(F.col(row) / F.lit(size)).cast("long")
    tail = (F.col(row) % F.lit(size)) >= F.lit(size - lookback)
    chunks = F.when(tail & F.lit(lookback > 0), F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(chunks))
    w = Window.partitionBy(*series, "_chunk").orderBy(*order)
    done = apply(spread, w)
    return done.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def carry_last(
    df: DataFrame, series: list[str], order: list[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Latest known ``value`` at or before each row, carried across buckets of a long series.

    Inside a (series, bucket) the value is filled by a window; what an earlier bucket leaves
    behind comes from one aggregated row per bucket, so no task sees a whole series.
    """
    tagged = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*series, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        tagged.where(F.col(value).isNotNull())
        .groupBy(*series, "_bucket")
        .agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    )
    grid = tagged.select(*series, "_bucket").distinct().join(ends, [*series, "_bucket"], "left")
    before = Window.partitionBy(*series).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select(*series, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    return (
        tagged.join(carried, [*series, "_bucket"], "left")
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_bucket", "_carried")
    )


def previous_value(df: DataFrame, series: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """The preceding row's ``value`` in a series of any length: ``lag`` inside buckets, a carried end between them."""
    tagged = df.withColumn("_bucket", bucket)
    ends = tagged.groupBy(*series, "_bucket").agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    w = Window.partitionBy(*series).orderBy("_bucket")
    carried = ends.select(*series, "_bucket", F.lag("_last").over(w).alias("_carried"))
    inside = Window.partitionBy(*series, "_bucket").orderBy(*order)
    first = F.row_number().over(inside) == 1
    return (
        tagged.join(carried, [*series, "_bucket"], "left")
        .withColumn(out, F.when(first, F.col("_carried")).otherwise(F.lag(value).over(inside)))
        .drop("_bucket", "_carried")
    )
