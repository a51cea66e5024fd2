"""Style factors from a panel, and the ladder of factor models that a strategy's returns are explained with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.cross import group_count, mean_rank
from tickloom.operators.evaluate import newey_west
from tickloom.operators.stats import cross_section_ols

MARKET, SIZE, VALUE, MOMENTUM = "mkt", "smb", "hml", "umd"
#: The models, each with the factors it needs.
LADDER = {"capm": (MARKET,), "ff3": (MARKET, SIZE, VALUE), "carhart4": (MARKET, SIZE, VALUE, MOMENTUM)}
LEAST = 20
#: Sessions of a year, to state alpha per year.
ANN = 244


def compounded(r: Column, lookback: int, skip: int, symbol: str = "symbol", date: str = "trade_date") -> Column:
    """Return compounded from ``lookback`` to ``skip`` rows ago; a missing return counts as none."""
    w = Window.partitionBy(symbol).orderBy(date)
    part = F.sum(F.log1p(F.coalesce(r, F.lit(0.0)))).over(w.rowsBetween(-lookback + 1, -skip))
    return F.when(F.row_number().over(w) > lookback, F.expm1(part))


def long_short(panel: DataFrame, characteristics: dict[str, tuple[str, bool]], ret: str, quantile: float = 0.3, lag: int = 1, least: int = LEAST) -> DataFrame:
    """(trade_date, factor columns): daily return of the top less the bottom quantile of each characteristic.

    ``characteristics`` maps a factor to its column and whether high minus low is meant. Characteristics are those of
    ``lag`` rows ago, known before the return. All factors are stacked, so one ranking serves them; dates with under
    ``least`` known pairs have none.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    known = panel.select("trade_date", F.col(ret).alias("_r"), *[(F.lag(c, lag).over(w) if lag else F.col(c)).cast("double").alias(f) for f, (c, _) in characteristics.items()])
    stacked = known.unpivot(["trade_date", "_r"], list(characteristics), "_factor", "_x").where("_x IS NOT NULL AND NOT isnan(_x) AND _r IS NOT NULL")
    keys = ["_factor", "trade_date"]
    n = group_count(F.col("_x"), *keys)
    ranked = stacked.withColumn("_n", n).withColumn("_p", mean_rank(F.col("_x"), *keys) / F.col("_n")).where(F.col("_n") >= least)
    spread = F.avg(F.when(F.col("_p") >= 1 - quantile, F.col("_r"))) - F.avg(F.when(F.col("_p") <= quantile, F.col("_r")))
    daily = ranked.groupBy(*keys).agg(spread.alias("_s"))
    sign = {f: 1.0 if up else -1.0 for f, (_, up) in characteristics.items()}
    return daily.groupBy("trade_date").agg(*[(F.max(F.when(F.col("_factor") == f, F.col("_s"))) * sign[f]).alias(f) for f in characteristics])


def style_factors(
    panel: DataFrame, ret: str = "ret", book: str | None = None, equity: str | None = None, lookback: int = 244, skip: int = 20, quantile: float = 0.3, least: int = LEAST, rf: float = 0.0
) -> tuple[DataFrame, dict[str, str]]:
    """(trade_date, mkt, smb, hml, umd), one row per session, and each factor's status.

    The market is the mean return of all names less ``rf``. Size and value need their columns: without one its factor
    is ``unavailable`` and null, never proxied. Momentum compounds the returns themselves, not prices.
    """
    wide = panel.withColumn("_umd", compounded(F.col(ret), lookback, skip))
    found = {SIZE: (equity, False), VALUE: (book, True), MOMENTUM: ("_umd", True)}
    built = {f: (c, up) for f, (c, up) in found.items() if c is not None}
    market = panel.groupBy("trade_date").agg((F.avg(ret) - rf).alias(MARKET))
    spreads = long_short(wide, built, ret, quantile, 1, least)
    absent = {f: F.lit(None).cast("double") for f in found if f not in built}
    out = market.join(spreads, "trade_date", "left").withColumns(absent) if absent else market.join(spreads, "trade_date", "left")
    status = {MARKET: "constructed"} | {f: "constructed" if f in built else "unavailable" for f in found}
    return out.select("trade_date", MARKET, SIZE, VALUE, MOMENTUM), status


def regress(rows: DataFrame, by: str, ret: str, factors: tuple[str, ...], date: str = "trade_date", least: int = LEAST) -> DataFrame:
    """(by, alpha, alpha_t, betas, r_squared, n): least squares of ``ret`` on the factors for each ``by``.

    Moments fold before the shuffle and only they are solved. The t of alpha is that of the mean of residual plus
    alpha under a Bartlett kernel, so autocorrelated returns do not flatter it. Under ``least`` sessions: no row.
    """
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (ret, *factors)])
    known = rows.where(ok).withColumn("_one", F.lit(1.0))
    names = ["alpha", *[f"beta_{f}" for f in factors]]
    fit = cross_section_ols(known, ret, ["_one", *factors], by, names)
    fitted = sum((F.col(f"beta_{f}") * F.col(f) for f in factors), F.lit(0.0))
    own = known.join(fit, by).withColumn("_e", F.col(ret) - fitted)  # residual plus alpha
    stats = own.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("_e") - F.col("alpha"), F.lit(2.0))).alias("_res"), (F.var_pop(ret) * F.count(ret)).alias("_tot"),
    )
    t = newey_west(own, [by], date, "_e").select(by, F.col("t_stat").alias("alpha_t"))
    r2 = F.when(F.col("_tot") > 1e-18, 1 - F.col("_res") / F.col("_tot"))
    return fit.join(stats, by).join(t, by, "left").where(F.col("n") >= least).withColumn("r_squared", r2).select(by, *names, "alpha_t", "r_squared", "n")


def attribution(returns: DataFrame, factors: DataFrame, status: dict[str, str], by: str, ret: str = "ret", rf: float = 0.0, threshold: float = 2.0) -> DataFrame:
    """(by, model, status, missing, alpha_annual, alpha_t, beta_*, r_squared, n, strictest, survives) for every model.

    A model with an unavailable factor, or with too few sessions, is said to be unavailable and why. ``strictest`` marks
    the last measured model of the ladder; ``survives`` tells whether its alpha is positive with a t of at least
    ``threshold``.
    """
    rows = returns.withColumn("_y", F.col(ret) - rf).join(F.broadcast(factors), "trade_date")  # one row per session
    every = returns.select(by).distinct()
    parts = []
    for step, (model, needed) in enumerate(LADDER.items()):
        missing = [f for f in needed if status.get(f) == "unavailable"]
        betas = [f"beta_{f}" for f in (MARKET, SIZE, VALUE, MOMENTUM)]
        if missing:
            found = every.select(by, *[F.lit(None).cast("double").alias(c) for c in ("alpha", *betas, "alpha_t", "r_squared")], F.lit(None).cast("long").alias("n"))
        else:
            fit = every.join(regress(rows, by, "_y", needed), by, "left")
            found = fit.select(by, "alpha", *[F.col(c) if c[5:] in needed else F.lit(None).cast("double").alias(c) for c in betas], "alpha_t", "r_squared", "n")
        told = F.when(F.col("alpha").isNotNull(), "measured").otherwise("unavailable")
        why = F.lit(",".join(missing)) if missing else F.when(F.col("alpha").isNull(), "insufficient_overlap").otherwise("")
        annual = F.when(F.col("alpha") > -1, F.pow(1 + F.col("alpha"), F.lit(float(ANN))) - 1)
        parts.append(found.select(by, F.lit(step).alias("_step"), F.lit(model).alias("model"), told.alias("status"), why.alias("missing"), annual.alias("alpha_annual"), "alpha_t", *betas, "r_squared", "n"))
    out = reduce(DataFrame.unionByName, parts)
    last = F.max(F.when(F.col("status") == "measured", F.col("_step"))).over(Window.partitionBy(by))  # three rows
    out = out.withColumn("strictest", F.coalesce(F.col("_step") == last, F.lit(False)))
    alive = F.coalesce(F.col("strictest") & (F.col("alpha_annual") > 0) & (F.col("alpha_t") >= threshold), F.lit(False))
    return out.withColumn("survives", F.max(alive).over(Window.partitionBy(by))).drop("_step")
