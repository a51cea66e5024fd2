"""Factor preparation by date: normal scores, neutralising, orthogonal factors, masks, and the pipeline of them.

Regressions are solved from sums that aggregate partially before the shuffle: one row of moments per date, joined
back, so a date may be as wide as the data. A column whose part is explained by earlier ones gets no weight. The
input is read once per pass: give a written or checkpointed table where it is costly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, normal_icdf, ratio
from tickloom.operators.cross import fill_group_median, group_count, group_zscore, mean_rank, winsorise_mad

#: Share of a column's spread below which what earlier columns leave of it counts as rounding.
RELATIVE_PIVOT = 1e-8
#: Share of a column's sum of squares below which its spread counts as rounding: a constant column.
RELATIVE_SPREAD = 1e-20


def normal_score(x: Column, *keys: str | Column) -> Column:
    """Average-tie ranks mapped to the normal curve; fewer than two known values have no score."""
    n = group_count(x, *keys)
    return F.when(n >= 2, normal_icdf(clip((mean_rank(x, *keys) - 0.5) / n, 1e-6, 1.0 - 1e-6)))


def mask_untradable(df: DataFrame, columns: list[str], tradable: Column) -> DataFrame:
    """Values only where ``tradable`` is true; unknown counts as not tradable."""
    ok = F.coalesce(tradable, F.lit(False))
    return df.withColumns({c: F.when(ok, F.col(c)) for c in columns})


def _eliminated(moments: DataFrame, k: int, sides: tuple[str, ...] = ()) -> DataFrame:
    """Forward elimination of the symmetric ``_g_i_j`` (i ≤ j) and right sides; ``_ok_i`` tells usable pivots."""
    out = moments.withColumns({f"_own_{i}": F.col(f"_g_{i}_{i}") for i in range(k)})
    for i in range(k):
        pivot = F.col(f"_g_{i}_{i}")
        out = out.withColumn(f"_ok_{i}", (pivot > F.col(f"_own_{i}") * RELATIVE_PIVOT) & (F.col(f"_own_{i}") > F.col(f"_raw_{i}") * RELATIVE_SPREAD))
        step = {}
        for j in range(i + 1, k):
            share = F.when(F.col(f"_ok_{i}"), ratio(F.col(f"_g_{i}_{j}"), pivot)).otherwise(0.0)
            step |= {f"_g_{j}_{m}": F.col(f"_g_{j}_{m}") - share * F.col(f"_g_{i}_{m}") for m in range(j, k)}
            step |= {f"{s}_{j}": F.col(f"{s}_{j}") - share * F.col(f"{s}_{i}") for s in sides}
        out = out.withColumns(step) if step else out
    return out


def neutralise(df: DataFrame, target: str, exposures: list[str], keys: list[str], category: str | None = None, out: str | None = None) -> DataFrame:
    """Residual of ``target`` on an intercept, the exposures and one dummy per category, by ``keys``.

    Dummies are taken out by centring inside (keys, category), which leaves the same residual. Rows without a
    category count to the first one. Known only where target and exposures are, and where a date has more such rows
    than coefficients.
    """
    out, k = out or f"{target}_neutral", len(exposures)
    names = [target, *exposures]
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull()
    if category:
        groups = df.groupBy(*keys).agg(F.min(category).alias("_first"), F.greatest(F.count_distinct(category), F.lit(1)).alias("_cats"))
        work = df.join(groups, keys, "left").withColumn("_cat", F.coalesce(F.col(category), F.col("_first")).cast("string"))
    else:
        work = df.withColumns({"_cat": F.lit(""), "_cats": F.lit(1)})
    work = work.withColumns({"_known": known, "_cat": F.coalesce("_cat", F.lit(""))})
    means = work.where("_known").groupBy(*keys, "_cat").agg(*[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(names)])
    work = work.join(means, [*keys, "_cat"], "left").withColumns({f"_d_{i}": F.when(F.col("_known"), F.col(c) - F.col(f"_m_{i}")) for i, c in enumerate(names)})
    x = lambda i: F.col(f"_d_{i + 1}")
    sums = [F.count(F.lit(1)).alias("_n")]
    sums += [F.sum(x(i) * x(j)).alias(f"_g_{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(x(i) * F.col("_d_0")).alias(f"_h_{i}") for i in range(k)]
    sums += [F.sum(F.col(c) * F.col(c)).alias(f"_raw_{i}") for i, c in enumerate(exposures)]
    fit = _eliminated(work.where("_known").groupBy(*keys).agg(*sums), k, ("_h",))
    for i in reversed(range(k)):
        rest = sum((F.col(f"_g_{i}_{j}") * F.col(f"_b_{j}") for j in range(i + 1, k)), F.lit(0.0))
        fit = fit.withColumn(f"_b_{i}", F.when(F.col(f"_ok_{i}"), ratio(F.col(f"_h_{i}") - rest, F.col(f"_g_{i}_{i}"))).otherwise(0.0))
    done = work.join(fit.select(*keys, "_n", *[f"_b_{i}" for i in range(k)]), keys, "left")
    fitted = sum((F.col(f"_b_{i}") * x(i) for i in range(k)), F.lit(0.0))
    value = F.when(F.col("_known") & (F.col("_n") > F.col("_cats") + F.lit(k)), F.col("_d_0") - fitted)
    rest = [c for c in df.columns if c != out]
    return done.withColumn("_out", value).select(*rest, F.col("_out").alias(out))


def orthogonalise(df: DataFrame, columns: list[str], keys: list[str], suffix: str = "_orth") -> DataFrame:
    """Centred factors made orthogonal in the given order, each of length one by ``keys``.

    The triangular factor comes from the moments; its diagonal is positive, which fixes the signs. Rows need all
    factors, and a date at least as many such rows as factors. A factor that earlier ones explain has no value.
    """
    k, known = len(columns), F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    work = df.withColumn("_known", known)
    means = work.where("_known").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(columns)])
    work = work.join(means, keys, "left").withColumns({f"_d_{i}": F.when(F.col("_known") & (F.col("_n") >= k), F.col(c) - F.col(f"_m_{i}")) for i, c in enumerate(columns)})
    grams = [F.sum(F.col(f"_d_{i}") * F.col(f"_d_{j}")).alias(f"_g_{i}_{j}") for i in range(k) for j in range(i, k)]
    grams += [F.sum(F.col(c) * F.col(c)).alias(f"_raw_{i}") for i, c in enumerate(columns)]
    fit = _eliminated(work.where("_known").groupBy(*keys).agg(*grams), k)
    for i in range(k):
        size = F.when(F.col(f"_ok_{i}"), F.sqrt(f"_g_{i}_{i}"))
        fit = fit.withColumns({f"_r_{i}_{j}": size if i == j else ratio(F.col(f"_g_{i}_{j}"), size) for j in range(i, k)})
    done = work.join(fit.select(*keys, *[f"_r_{i}_{j}" for i in range(k) for j in range(i, k)]), keys, "left")
    for i in range(k):
        left = F.col(f"_d_{i}") - sum((F.coalesce(F.col(f"_q_{j}") * F.col(f"_r_{j}_{i}"), F.lit(0.0)) for j in range(i)), F.lit(0.0))
        done = done.withColumn(f"_q_{i}", ratio(left, F.col(f"_r_{i}_{i}")))
    return done.select(*df.columns, *[F.col(f"_q_{i}").alias(f"{c}{suffix}") for i, c in enumerate(columns)])


def factor_pipeline(
    df: DataFrame, columns: list[str], keys: list[str], *, fill_by: str | None = None, n_mad: float | None = 5.0,
    exposures: list[str] | None = None, category: str | None = None, standardise: bool = True, tradable: Column | None = None,
) -> DataFrame:
    """Fill by group median, clip by MAD, neutralise, standardise, mask: each step only where asked for."""
    if fill_by:
        df = fill_group_median(df, columns, [*keys, fill_by], keys)
    if n_mad is not None:
        df = winsorise_mad(df, columns, keys, n_mad)
    if exposures or category:
        for c in columns:
            df = neutralise(df, c, exposures or [], keys, category, out=c)
    if standardise:
        df = df.withColumns({c: group_zscore(F.col(c), *keys) for c in columns})
    return df if tradable is None else mask_untradable(df, columns, tradable)
