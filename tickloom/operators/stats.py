"""Return statistics, risk, overfitting and covariance, per strategy or candidate."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import normal_cdf, normal_icdf, ratio
from tickloom.operators.cross import mean_rank
from tickloom.operators.evaluate import newey_west, pearson
from tickloom.operators.quantiles import order_statistic
from tickloom.session import cut_lineage

EULER = 0.5772156649
YEAR = 252


def sample_skew(x: str) -> Column:
    """Bias-corrected skewness as an aggregate, from central moments about the group mean ``_mu``."""
    n = F.count(x)
    m2, m3 = F.avg(F.pow(F.col(x) - F.col("_mu"), F.lit(2))), F.avg(F.pow(F.col(x) - F.col("_mu"), F.lit(3)))
    return F.when((n > 2) & (m2 > 0), ratio(m3, F.pow(m2, F.lit(1.5))) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: str) -> Column:
    n = F.count(x)
    m2, m4 = F.avg(F.pow(F.col(x) - F.col("_mu"), F.lit(2))), F.avg(F.pow(F.col(x) - F.col("_mu"), F.lit(4)))
    return F.when((n > 3) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (ratio(m4, m2 * m2) - 3) + 6))


def return_stats(returns: DataFrame, by: list[str], r: str = "ret", rf: float = 0.0) -> DataFrame:
    """Sharpe, Sortino, hit ratio, profit factor and volatility per strategy in one aggregate."""
    e = F.col(r) - F.lit(rf / YEAR)
    sd, down = F.stddev_samp(e), F.stddev_samp(F.when(e < 0, e))
    gains, losses = F.sum(F.when(F.col(r) > 0, F.col(r))), -F.sum(F.when(F.col(r) < 0, F.col(r)))
    root = F.lit(math.sqrt(YEAR))
    return returns.where(F.col(r).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(sd > 0, root * F.avg(e) / sd).alias("sharpe"),
        F.when(down > 0, root * F.avg(e) / down).alias("sortino"),
        F.avg((F.col(r) > 0).cast("double")).alias("hit_ratio"),
        F.when(losses > 0, gains / losses).alias("profit_factor"),
        (sd * root).alias("volatility"),
    )


def nav(returns: DataFrame, by: list[str], order: str, r: str = "ret") -> DataFrame:
    """Compounded value and drawdown from the running peak (one row per session and strategy)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("nav", F.exp(F.sum(F.ln(1 + F.coalesce(F.col(r), F.lit(0.0)))).over(w)))
    return grown.withColumn("drawdown", F.col("nav") / F.max("nav").over(w) - 1)


def drawdown_stats(navs: DataFrame, by: list[str], order: str) -> DataFrame:
    """Worst drawdown, growth per year and their ratio."""
    g = navs.groupBy(*by).agg(
        F.min("drawdown").alias("max_drawdown"), F.max_by("nav", order).alias("_z"), F.min_by("nav", order).alias("_a"), F.count(F.lit(1)).alias("_n")
    )
    cagr = F.pow(F.col("_z") / F.col("_a"), F.lit(float(YEAR)) / F.col("_n")) - 1
    return g.withColumn("cagr", cagr).withColumn("calmar", ratio(F.col("cagr"), F.abs("max_drawdown"))).drop("_z", "_a", "_n")


def value_at_risk(returns: DataFrame, by: list[str], r: str = "ret", alpha: float = 0.05) -> DataFrame:
    """Loss at the alpha percentile, mean loss beyond it, and the normal approximation."""
    rows = returns.where(F.col(r).isNotNull())
    cut = rows.groupBy(*by).agg(F.percentile(r, F.lit(alpha)).alias("_q"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    z = normal_icdf(F.lit(alpha))
    return rows.join(cut, by).groupBy(*by).agg(
        (-F.max("_q")).alias("var"), (-F.avg(F.when(F.col(r) <= F.col("_q"), F.col(r)))).alias("cvar"),
        (-(F.max("_m") + z * F.max("_s"))).alias("normal_var"),
    )


def probabilistic_sharpe(returns: DataFrame, by: list[str], r: str = "ret", benchmark: Column | float = 0.0) -> DataFrame:
    """Probability that the true Sharpe exceeds an annual benchmark, adjusted for skew and kurtosis."""
    rows = returns.where(F.col(r).isNotNull())
    mu = rows.groupBy(*by).agg(F.avg(r).alias("_mu"))
    m = rows.join(mu, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("_mu").alias("mean"), F.stddev_samp(r).alias("sd"),
        F.coalesce(sample_skew(r), F.lit(0.0)).alias("skew"), F.coalesce(sample_kurtosis(r), F.lit(0.0)).alias("kurt"),
    )
    bench = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    sr = F.col("mean") / F.col("sd")
    spread = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurt") + 2) / 4 * sr * sr, F.lit(1e-12)))
    z = (sr - bench / math.sqrt(YEAR)) * F.sqrt(F.col("n") - 1) / spread
    flat = F.when(F.col("mean") > bench / YEAR, 1.0).otherwise(0.0)
    psr = F.when(F.col("n") < 4, None).when(F.col("sd") <= 1e-12, flat).otherwise(normal_cdf(z))
    return m.withColumn("sr", sr).withColumn("psr", psr)


def deflated_sharpe(returns: DataFrame, by: list[str], r: str = "ret", trials: int | None = None) -> DataFrame:
    """PSR against the expected best of N trials; dispersion comes from the measured per-period Sharpes."""
    base = probabilistic_sharpe(returns, by, r)
    spread = base.where("sd > 0").agg(F.var_samp("sr").alias("_var"), F.count(F.lit(1)).alias("_k"))
    n = F.lit(float(trials)) if trials else F.col("_k").cast("double")
    best = F.sqrt("_var") * (
        (1 - EULER) * normal_icdf(1 - 1 / n) + EULER * normal_icdf(1 - 1 / (n * F.lit(math.e)))
    )
    bench = spread.select(F.when((F.col("_k") >= 2) & (F.col("_var") > 0), best * math.sqrt(YEAR)).alias("_bench"))
    out = base.crossJoin(F.broadcast(bench))  # one row
    sr = F.col("sr")
    dev = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurt") + 2) / 4 * sr * sr, F.lit(1e-12)))
    z = (sr - F.col("_bench") / math.sqrt(YEAR)) * F.sqrt(F.col("n") - 1) / dev
    return out.withColumn("dsr", F.when((F.col("n") >= 4) & F.col("_bench").isNotNull(), normal_cdf(z))).drop("_bench")


def capm(returns: DataFrame, by: list[str], r: str = "ret", market: str = "market", least: int = 20) -> DataFrame:
    """Slope, annualised intercept, R² and up/down capture against a benchmark column."""
    rows = returns.where(F.col(r).isNotNull() & F.col(market).isNotNull())
    beta = ratio(F.covar_pop(r, market), F.var_pop(market))
    enough = (F.count(F.lit(1)) >= least) & (F.var_pop(market) >= 1e-18)

    def grown(cond: Column, x: str) -> Column:
        return F.exp(F.sum(F.when(cond, F.ln(1 + F.col(x))))) - 1

    def capture(cond: Column) -> Column:
        base = grown(cond, market)
        return F.when((F.count(F.when(cond, 1)) >= 5) & (F.abs(base) >= 1e-9), grown(cond, r) / base)

    c = pearson(r, market)
    return rows.groupBy(*by).agg(
        F.when(enough, beta).alias("beta"),
        F.when(enough, F.pow(1 + F.avg(r) - beta * F.avg(market), F.lit(float(YEAR))) - 1).alias("alpha"),
        F.when(enough, c * c).alias("r2"),
        capture(F.col(market) > 0).alias("up_capture"), capture(F.col(market) < 0).alias("down_capture"),
    )


def overfitting_probability(perf: DataFrame, strategy: str, slot: str, value: str, partitions: int = 8) -> DataFrame:
    """Share of symmetric in/out splits whose in-sample best falls below the out-of-sample median.

    Time slots become ``partitions`` equal chunks (trailing remainder dropped); every split is a row
    of a small table, so one grouped job scores all C(S, S/2) splits × strategies.
    """
    spark = perf.sparkSession
    w = Window.partitionBy(strategy).orderBy(slot)
    sized = perf.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(strategy))})
    size = F.floor(F.col("_n") / partitions)
    chunked = sized.withColumn("_chunk", F.floor(F.col("_i") / size).cast("int")).where(F.col("_chunk") < partitions)
    chunks = chunked.groupBy(strategy, "_chunk").agg(F.avg(value).alias("_m"))
    rows = [(k, c, c in set(pick)) for k, pick in enumerate(combinations(range(partitions), partitions // 2)) for c in range(partitions)]
    splits = spark.createDataFrame(rows, "split int, _chunk int, inside boolean")
    scores = chunks.join(F.broadcast(splits), "_chunk").groupBy("split", strategy).agg(  # C(S, S/2) · S rows
        F.avg(F.when(F.col("inside"), F.col("_m"))).alias("_in"), F.avg(F.when(~F.col("inside"), F.col("_m"))).alias("_out")
    )
    ranked = scores.withColumns({
        "_rank": F.count(F.lit(1)).over(Window.partitionBy("split")) + 1 - mean_rank(F.col("_out"), "split"),
        "_k": F.count(F.lit(1)).over(Window.partitionBy("split")),
    })
    best = ranked.groupBy("split").agg(F.max_by(F.struct("_rank", "_k"), F.struct(F.round("_in", 12), F.col("_rank"))).alias("_b"))
    k = F.col("_b._k")
    share = (k - F.col("_b._rank")) / (k - 1)
    bounded = F.least(F.greatest(share, 1 / (k + 1.0)), 1 - 1 / (k + 1.0))
    return best.withColumn("logit", F.ln(bounded / (1 - bounded))).agg(
        F.count(F.lit(1)).alias("splits"), F.avg((F.col("logit") < 0).cast("double")).alias("pbo")
    )


def block_length(series: DataFrame, order: str, value: str) -> DataFrame:
    """One row (n, block): the stationary bootstrap's mean block length from the series' own autocorrelations.

    Autocorrelations count up to the first one inside the noise band, none beyond it. A series has one value a
    session, so its array is bounded by the calendar; short or constant series have blocks of 1.
    """
    packed = series.where(F.col(value).isNotNull()).groupBy().agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("_v"),
        F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"), F.count(F.lit(1)).alias("n"),
    )
    n = F.col("n")
    lags = F.least(n - 1, F.floor(8.0 * F.pow(n / 100.0, F.lit(1.0 / 3.0))) + 1).cast("int")
    work = packed.withColumns({"_c": F.transform("_v", lambda v: v - F.col("_mean")), "_lags": lags})

    def auto(k: Column) -> Column:
        pairs = F.zip_with(F.slice("_c", k + 1, F.col("n").cast("int") - k), F.slice("_c", F.lit(1), F.col("n").cast("int") - k), lambda x, y: x * y)
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / F.col("n") / F.col("_var")

    usable = (n >= 8) & (F.col("_var") > 1e-15)
    work = work.withColumn("_a", F.when(usable, F.transform(F.sequence(F.lit(1), F.col("_lags")), auto)))
    band = 2.0 * F.sqrt(F.log10(n.cast("double")) / n)
    quiet = F.array_position(F.transform("_a", lambda r: F.abs(r) < band), True)
    counted = F.when(quiet > 0, F.slice("_a", F.lit(1), (quiet - 1).cast("int"))).otherwise(F.col("_a"))
    work = work.withColumn("_s", counted)
    g = F.aggregate(F.transform("_s", lambda r, i: 2.0 * (i + 1) * r), F.lit(0.0), lambda s, v: s + v)
    sigma = F.aggregate("_s", F.col("_var"), lambda s, r: s + 2.0 * r)
    best = F.bround(F.pow(2.0 * g * g / (sigma * sigma), F.lit(1.0 / 3.0)) * F.pow(n.cast("double"), F.lit(1.0 / 3.0)))
    block = F.when(usable & (sigma > 1e-15), F.greatest(F.lit(1), F.least(F.floor(n / 2), best.cast("long")))).otherwise(1)
    return work.select("n", block.cast("int").alias("block"))


def portable_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts: any engine draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def superior_ability(excess: DataFrame, candidate: str, order: str, value: str, replicates: int = 500, block: int | None = None, seed: int = 7) -> DataFrame:
    """Stationary-bootstrap test that no candidate beats the benchmark (lower, consistent, upper p).

    Only sessions that every candidate has count, so one draw of sessions serves all. The mean block length is taken
    from the candidates' mean excess unless ``block`` is given. Draws are digests of (seed, replicate, place), so they
    do not depend on an engine's generator; replicate × session rows are drawn, folded and joined in the JVM.
    """
    spark = excess.sparkSession
    known = excess.where(F.col(value).isNotNull())
    every = known.agg(F.count_distinct(candidate).alias("_all"))
    common = known.groupBy(order).agg(F.count_distinct(candidate).alias("_k"), F.avg(value).alias("_mean")).join(F.broadcast(every)).where("_k = _all")
    calendar = cut_lineage(common.select(order, "_mean", (F.row_number().over(Window.orderBy(order)) - 1).cast("long").alias("_i")))  # one row per session
    numbered = cut_lineage(known.join(F.broadcast(calendar.select(order, "_i")), order).select(candidate, order, "_i", value))
    chosen = block_length(calendar, order, "_mean") if block is None else calendar.agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.lit(block))
    hac = newey_west(numbered, [candidate], order, value)
    stats = hac.select(candidate, F.col("n").alias("_n"), F.col("mean").alias("_mu"), (F.col("mean") / F.col("t_stat")).alias("_w"))
    stats = stats.where(F.col("_w") > 0)
    bound = -F.col("_w") * F.sqrt(F.greatest(2 * F.ln(F.ln(F.col("_n").cast("double"))), F.lit(0.0)))
    stats = stats.withColumns({
        "_upper": F.col("_mu"), "_cons": F.when(F.col("_mu") >= bound, F.col("_mu")).otherwise(0.0), "_lower": F.greatest("_mu", F.lit(0.0))
    })
    stats = cut_lineage(stats.select(candidate, "_w", "_mu", "_upper", "_cons", "_lower"))  # one row per candidate, read three times
    places = spark.range(replicates).select(F.col("id").alias("b")).join(F.broadcast(calendar.select("_i"))).join(F.broadcast(chosen))
    u = lambda what: portable_uniform(F.lit(seed), F.col("b"), F.col("_i"), F.lit(what))
    fresh = (F.col("_i") == 0) | (u("new") < 1.0 / F.col("block"))
    w = Window.partitionBy("b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(fresh, F.struct(F.floor(u("start") * F.col("n")).alias("s"), F.col("_i").alias("at"))), ignorenulls=True).over(w)
    drawn = places.withColumn("_f", begun).select("b", ((F.col("_f.s") + F.col("_i") - F.col("_f.at")) % F.col("n")).alias("_i"))
    draws = drawn.groupBy("b", "_i").agg(F.count(F.lit(1)).alias("_times"))
    sums = draws.join(numbered.select(candidate, "_i", value), "_i").groupBy("b", candidate).agg(
        (F.sum(F.col(value) * F.col("_times")) / F.sum("_times")).alias("_bm")
    )
    z = sums.join(stats, candidate).groupBy("b").agg(*[
        F.greatest(F.max((F.col("_bm") - F.col(c)) / F.col("_w")), F.lit(0.0)).alias(c) for c in ("_lower", "_cons", "_upper")
    ])
    observed = stats.agg(F.greatest(F.max(F.col("_mu") / F.col("_w")), F.lit(0.0)).alias("test_statistic"), F.max_by(candidate, F.col("_mu") / F.col("_w")).alias("best_candidate"))
    observed = observed.join(F.broadcast(chosen.select(F.col("block").alias("block_length"))))  # one row each
    return z.join(F.broadcast(observed)).groupBy("test_statistic", "best_candidate", "block_length").agg(*[
        F.avg((F.col(c) >= F.col("test_statistic") - 1e-9).cast("double")).alias(n) for c, n in (("_lower", "p_lower"), ("_cons", "p_consistent"), ("_upper", "p_upper"))
    ])


def covariance_pairs(returns: DataFrame, name: str, date: str, r: str, shrink: float = 0.0, span: int | None = None) -> DataFrame:
    """Covariance of every pair of series as rows; optionally shrunk to the diagonal or EWMA weighted.

    Pairs meet per date, which is the matrix the caller asks for: use it on strategies or factors
    (tens to hundreds of series), not on raw symbols.
    """
    rows = returns.where(F.col(r).isNotNull()).select(date, name, r)
    if span is None:
        # co-moments over the dates both series have
        pairs = rows.alias("a").join(rows.alias("b"), date).select(
            F.col(f"a.{name}").alias("left"), F.col(f"b.{name}").alias("right"), F.col(f"a.{r}").alias("_x"), F.col(f"b.{r}").alias("_y")
        ).where(F.col("left") <= F.col("right"))
        cov = pairs.groupBy("left", "right").agg(F.covar_samp("_x", "_y").alias("cov"))
    else:
        alpha = 2.0 / (span + 1.0)
        ages = rows.select(date).distinct().withColumn("_age", F.row_number().over(Window.orderBy(F.desc(date))) - 1)
        ages = ages.withColumn("_w", F.pow(F.lit(1.0 - alpha), F.col("_age")))
        ages = ages.withColumn("_w", F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(1))))
        centred = rows.withColumn(r, F.col(r) - F.avg(r).over(Window.partitionBy(name))).join(F.broadcast(ages), date)
        pairs = centred.alias("a").join(centred.alias("b"), date).where(F.col(f"a.{name}") <= F.col(f"b.{name}"))
        cov = pairs.groupBy(F.col(f"a.{name}").alias("left"), F.col(f"b.{name}").alias("right")).agg(
            F.sum(F.col("a._w") * F.col(f"a.{r}") * F.col(f"b.{r}")).alias("cov")
        )
    if shrink:
        cov = cov.withColumn("cov", F.when(F.col("left") == F.col("right"), F.col("cov")).otherwise((1 - shrink) * F.col("cov")))
    return cov


def ledoit_wolf(returns: DataFrame, name: str, date: str, r: str) -> DataFrame:
    """Constant-correlation shrinkage covariance: intensity and target from grouped sums of pair moments."""
    rows = returns.select(date, name, r)
    k = rows.select(name).distinct().agg(F.count(F.lit(1)).alias("_p"))
    full = rows.where(F.col(r).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(k)).where("_c = _p").select(date)
    x = rows.join(full, date).withColumn("_x", F.col(r) - F.avg(r).over(Window.partitionBy(name))).select(date, name, "_x")
    pairs = x.alias("a").join(x.alias("b"), date).select(
        F.col(f"a.{name}").alias("i"), F.col(f"b.{name}").alias("j"), F.col("a._x").alias("xi"), F.col("b._x").alias("xj")
    )
    m = pairs.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("xi") * F.col("xj")).alias("s"),
        F.avg(F.col("xi") ** 2 * F.col("xj") ** 2).alias("q"), F.avg(F.col("xi") ** 3 * F.col("xj")).alias("c3"),
    )
    d = m.where("i = j").select("i", F.col("s").alias("v"))
    m = m.join(d.withColumnRenamed("v", "vi"), "i").join(d.select(F.col("i").alias("j"), F.col("v").alias("vj")), "j")
    off = F.col("i") != F.col("j")
    avg = m.agg(F.avg(F.when(off, F.col("s") / F.sqrt(F.col("vi") * F.col("vj")))).alias("_r"))
    m = m.crossJoin(F.broadcast(avg)).withColumn("t", F.when(off, F.col("_r") * F.sqrt(F.col("vi") * F.col("vj"))).otherwise(F.col("vi")))
    phi = F.col("q") - F.col("s") ** 2
    rho = F.when(off, F.col("_r") * F.sqrt(F.col("vj") / F.col("vi")) * (F.col("c3") - F.col("vi") * F.col("s"))).otherwise(phi)
    fit = m.agg(F.sum(phi).alias("_phi"), F.sum(rho).alias("_rho"), F.sum((F.col("t") - F.col("s")) ** 2).alias("_g"), F.max("n").alias("_n"))
    shrink = F.when(F.col("_g") > 0, F.least(F.greatest((F.col("_phi") - F.col("_rho")) / F.col("_g") / F.col("_n"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return m.crossJoin(F.broadcast(fit.select(shrink.alias("shrinkage")))).select(
        F.col("i").alias("left"), F.col("j").alias("right"), (F.col("shrinkage") * F.col("t") + (1 - F.col("shrinkage")) * F.col("s")).alias("cov"), "shrinkage"
    )


def fold_robustness(folds: DataFrame, candidate: str, excess: str, sharpe: str) -> DataFrame:
    """Share of positive folds blended with stability, and the worst fold's Sharpe squashed to (0, 1)."""
    n, m, sd = F.count(excess), F.avg(excess), F.stddev_samp(excess)
    positive = F.avg((F.col(excess) > 0).cast("double"))
    stable = F.when(sd <= 1e-12, 1.0).otherwise(F.abs(m) / (F.abs(m) + sd))
    score = F.when(n == 0, 0.0).when(n == 1, 0.5 * positive).otherwise(0.6 * positive + 0.4 * stable)
    return folds.groupBy(candidate).agg(
        score.alias("fold_consistency"), F.coalesce(1 / (1 + F.exp(-F.min(sharpe))), F.lit(0.0)).alias("regime_consistency")
    )


def cross_section_ols(panel: DataFrame, target: str, exposures: list[str], by: str, out: list[str] | None = None) -> DataFrame:
    """OLS coefficients (no intercept) per group from aggregated normal equations.

    XᵀX and Xᵀy are k² + k partial sums per group; only those small sums reach the solver.
    """
    names = out or [f"b_{e}" for e in exposures]
    ok = F.col(target).isNotNull()
    for e in exposures:
        ok = ok & F.col(e).isNotNull()
    k = len(exposures)
    sums = [F.sum(F.col(exposures[i]) * F.col(exposures[j])).alias(f"_x{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col(e) * F.col(target)).alias(f"_y{i}") for i, e in enumerate(exposures)]
    grouped = panel.where(ok).groupBy(by).agg(*sums)
    by_type = dict(grouped.dtypes)[by]

    def solve(batches):
        for part in batches:
            xtx = np.zeros((len(part), k, k))
            for i in range(k):
                for j in range(i, k):
                    xtx[:, i, j] = xtx[:, j, i] = part[f"_x{i}_{j}"]
            xty = np.stack([part[f"_y{i}"] for i in range(k)], axis=1)
            beta = np.array([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(xtx, xty)]).reshape(len(part), k)
            yield pd.DataFrame({by: part[by], **{n: beta[:, i] for i, n in enumerate(names)}})

    return grouped.mapInPandas(solve, f"{by} {by_type}, " + ", ".join(f"{n} double" for n in names))


def conformal(predictions: DataFrame, calibration: DataFrame, pred: str, truth: str, by: list[str], alpha: float = 0.1) -> DataFrame:
    """Interval half-width = finite-sample quantile of absolute calibration residuals, per group."""
    res = calibration.where(F.col(pred).isNotNull() & F.col(truth).isNotNull()).select(*by, F.abs(F.col(truth) - F.col(pred)).alias("_e"))
    q = order_statistic(
        res, by, "_e", lambda n: F.least(F.greatest(F.ceil((n + 1) * F.lit(1 - alpha)), F.lit(1)), n) - 1, "half_width"
    )
    joined = predictions.join(q, by, "left") if by else predictions.crossJoin(F.broadcast(q))  # one row
    return joined.withColumns({"lower": F.col(pred) - F.col("half_width"), "upper": F.col(pred) + F.col("half_width")})
