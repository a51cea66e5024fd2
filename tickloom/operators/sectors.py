"""Sector maps, sector panels and rotation signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators import cross as X
from tickloom.operators.series import rolling


def pick_by_priority(rows: DataFrame, universe: DataFrame, key: str, order: list[str], values: list[str], missing: str) -> DataFrame:
    """Best row per key by ``order``; keys of the universe without any row get ``missing``.

    min_by aggregates partially, so many candidate rows per key never meet in one sort.
    """
    best = rows.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return universe.select(key).distinct().join(best, key, "left").select(
        key, *[F.coalesce(F.col(f"_v.{v}"), F.lit(missing)).alias(v) for v in values]
    )


def sector_report(members: DataFrame, sector: str, second: str) -> DataFrame:
    """Members and share per sector, and whether a sector carries more than one second label."""
    counts = members.groupBy(sector).agg(F.count(F.lit(1)).alias("members"), F.count_distinct(second).alias("_labels"))
    everyone = Window.partitionBy(F.lit(1))
    return counts.select(
        sector, "members", F.round(F.col("members") / F.sum("members").over(everyone), 6).alias("share"),
        ((F.col("members") > 1) & (F.col("_labels") > 1)).alias("conflicting"),
    )


def sector_panel(panel: DataFrame, least: int = 5) -> DataFrame:
    """Daily sector aggregates: equal- and prior-amount-weighted return, amount, members, breadth.

    One symbol window pass adds the member columns; the sector step is a partially aggregated
    group-by, so a sector holding most names is no hot task.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    close, r = F.col("close"), ratio(F.col("close"), F.lag("close").over(w)) - 1

    def above(n: int) -> Column:
        return (F.col("close") > rolling("mean", close, w, n)).cast("double")

    m = panel.withColumns({
        "ret": r, "_amt": F.greatest(F.coalesce(F.lag("amount").over(w), F.lit(0.0)), F.lit(0.0)), "_a20": above(20), "_a60": above(60),
        "_hi": (F.col("close") >= 0.999 * rolling("max", close, w, 60)).cast("double"),
    }).where("ret is not null")
    weighted = F.when(F.sum("_amt") > 0, F.sum(F.col("ret") * F.col("_amt")) / F.sum("_amt")).otherwise(F.avg("ret"))
    out = m.groupBy("trade_date", "sector").agg(
        F.avg("ret").alias("ret_eqw"), weighted.alias("ret_amtw"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_members"),
        F.avg((F.col("ret") > 0).cast("double")).alias("breadth_up"), F.avg("_a20").alias("breadth_ma20"), F.avg("_a60").alias("breadth_ma60"), F.avg("_hi").alias("breadth_high60"),
    )
    return out.where(F.col("n_members") >= least)


def sector_signals(panel: DataFrame, ret: str = "ret_eqw", spans: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Momentum, volatility, drawdown, turnover acceleration and relative strength per sector."""
    w = Window.partitionBy("sector").orderBy("trade_date")
    lr = F.ln(1 + F.greatest(F.col(ret), F.lit(-0.99)))
    excess = F.col(ret) - F.avg(ret).over(Window.partitionBy("trade_date"))
    work = panel.withColumns({"_lr": lr, "_ex": excess})
    cols = {}
    for n in spans:
        cols[f"mom_{n}"] = F.exp(rolling("sum", F.col("_lr"), w, n, n // 2)) - 1
        cols[f"vol_{n}"] = rolling("std", F.col(ret), w, n, n // 2)
        cols[f"rs_{n}"] = rolling("sum", F.col("_ex"), w, n, n // 2)
    cols["_nav"] = 1 + F.coalesce(F.exp(rolling("sum", F.col("_lr"), w, 252, 20)) - 1, F.lit(0.0))
    cols["amt_accel"] = rolling("mean", F.col("amount"), w, 5, 3) / (rolling("mean", F.col("amount"), w, 20, 10) + 1e-9) - 1
    work = work.withColumns(cols)
    peak = F.max("_nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = spans[-1]
    return work.withColumns({
        "drawdown": F.col("_nav") / peak - 1, f"rmom_{n}": F.col(f"mom_{n}") / (F.col(f"vol_{n}") * F.sqrt(F.lit(float(n))) + 1e-9),
    }).drop("_lr", "_ex", "_nav")


def rotation_inputs(panel: DataFrame, window: int = 20, limit_up: float = 0.03) -> DataFrame:
    """The seven per-date sector measures. Strength rolls over sector DATES (documented order), not member rows."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    m = panel.withColumn("_r", ratio(F.col("close"), F.lag("close").over(w)) - 1).withColumn("_f", ratio(F.col("close") - F.col("open"), F.col("open")) * F.col("amount"))
    d = m.groupBy("trade_date", "sector").agg(
        F.avg("_r").alias("_ret"), F.sum("_r").alias("_rs"), F.count("_r").alias("_rn"), F.sum("amount").alias("_amt"), F.sum("_f").alias("_flow"),
        F.avg((F.coalesce("_r", F.lit(0.0)) > 0).cast("double")).alias("sector_breadth"),
        F.sum((F.coalesce("_r", F.lit(0.0)) >= limit_up).cast("int")).alias("sector_limit_up_count"), F.avg((F.coalesce("_r", F.lit(0.0)) >= limit_up).cast("double")).alias("sector_limit_up_ratio"),
    )
    day = Window.partitionBy("trade_date")
    s = Window.partitionBy("sector").orderBy("trade_date")
    market = F.sum("_rs").over(day) / F.sum("_rn").over(day)
    d = d.withColumn("_rel", F.col("_ret") - F.when(F.sum("_rn").over(day) > 0, market))
    return d.select(
        "trade_date", "sector", rolling("mean", F.col("_ret"), s, window).alias("sector_return_strength"), rolling("mean", F.col("_rel"), s, window).alias("sector_relative_strength"),
        ratio(F.col("_amt"), rolling("mean", F.col("_amt"), s, window)).alias("sector_volume_expansion"), "sector_breadth", "sector_limit_up_count", "sector_limit_up_ratio",
        ratio(F.col("_amt"), F.sum("_amt").over(day)).alias("sector_turnover_share"), ratio(F.col("_flow"), F.sum(F.abs("_flow")).over(day)).alias("sector_money_flow_share"),
    )


ROTATION = ("sector_return_strength", "sector_relative_strength", "sector_volume_expansion", "sector_breadth", "sector_limit_up_ratio", "sector_turnover_share", "sector_money_flow_share")


def rotation_score(inputs: DataFrame, columns: tuple[str, ...] = ROTATION) -> DataFrame:
    """Mean of the per-date z-scores of the seven measures, over those that exist."""
    day = Window.partitionBy("trade_date")
    z = [F.when(F.stddev_pop(c).over(day) > 1e-12, (F.col(c) - F.avg(c).over(day)) / F.stddev_pop(c).over(day)) for c in columns]
    scored = inputs.withColumns({f"_z{i}": c for i, c in enumerate(z)})
    known = [F.col(f"_z{i}") for i in range(len(z))]
    total = sum((F.coalesce(k, F.lit(0.0)) for k in known), F.lit(0.0))
    n = sum((k.isNotNull().cast("int") for k in known), F.lit(0))
    return scored.withColumn("rotation_score", ratio(total, n)).drop(*[f"_z{i}" for i in range(len(z))])


def sector_heat(panel: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """Median member returns and distance from the 60-row high at a date, z-blended into heat and tags."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    c = F.col("close")
    m = panel.where(F.col("trade_date") <= F.lit(as_of).cast("date")).withColumns({
        **{f"_r{n}": ratio(c, F.lag("close", n).over(w)) - 1 for n in (5, 20, 60)}, "_h": c / F.max("close").over(w.rowsBetween(-59, 0)) - 1,
    })
    last = m.groupBy("symbol").agg(F.max_by(F.struct("sector", "_r5", "_r20", "_r60", "_h"), "trade_date").alias("s")).select("s.*")
    d = last.groupBy("sector").agg(
        F.median("_r5").alias("ret_5d"), F.median("_r20").alias("ret_20d"), F.median("_r60").alias("ret_60d"), F.median("_h").alias("pct_from_high"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= least)
    g = Window.partitionBy(F.lit(1))  # one row per sector

    def z(x: Column) -> Column:
        sd = F.stddev_samp(x).over(g)
        return F.when(sd > 1e-12, (x - F.avg(x).over(g)) / sd).otherwise(0.0)

    d = d.withColumns({"heat": z(F.col("ret_60d")) + z(F.col("pct_from_high")), "accel": F.col("ret_5d") - F.col("ret_20d") / 4.0})
    d = d.withColumn("rotation_score", -0.6 * z(F.col("heat")) + 0.4 * z(F.col("accel")))
    cuts = d.agg(F.percentile("heat", F.lit(0.66)).alias("_hi"), F.percentile("heat", F.lit(0.33)).alias("_lo"))
    tag = F.when(F.col("heat") > F.col("_hi"), "high").when(F.col("heat") < F.col("_lo"), "low").otherwise("middle")
    d = d.crossJoin(F.broadcast(cuts)).withColumn("regime_tag", tag).drop("_hi", "_lo")
    return d.withColumn("rotation_tag", F.when((F.col("regime_tag") == "low") & (F.col("accel") > 0), "low_turning_in").when((F.col("regime_tag") == "high") & (F.col("accel") < 0), "high_fading_out").otherwise("watch"))


def tier_pool(table: DataFrame, ic: str, core: float = 0.7, avoid: float = 0.3) -> DataFrame:
    """core / satellite / avoid by the share of sectors at or below in IC; only positive IC can be core."""
    from tickloom.operators.cross import pct_rank

    p = pct_rank(F.col(ic), F.lit(1))
    tier = F.when((p >= core) & (F.col(ic) > 0), "core").when((p <= avoid) | (F.col(ic) <= 0), "avoid").otherwise("satellite")
    out = table.withColumn("tier", tier)
    return out.withColumn("tier_weight", F.when(F.col("tier") == "core", 1.0).when(F.col("tier") == "satellite", 0.5).otherwise(0.0))


def blend_axes(table: DataFrame, axes: dict[str, float], by: str) -> DataFrame:
    """Axes stretched to [0, 1] per group, weighted over those present; confidence is the weight present."""
    w = Window.partitionBy(by)
    unit = {a: ratio(F.col(a) - F.min(a).over(w), F.max(a).over(w) - F.min(a).over(w)) for a in axes}
    t = table.withColumns({f"_u_{a}": u for a, u in unit.items()})
    num = sum((F.lit(wt) * F.coalesce(f"_u_{a}", F.lit(0.0)) for a, wt in axes.items()), F.lit(0.0))
    den = sum((F.when(F.col(f"_u_{a}").isNotNull(), F.lit(wt)).otherwise(0.0) for a, wt in axes.items()), F.lit(0.0))
    return t.withColumns({"axis_score": ratio(num, den), "confidence": den / F.lit(sum(axes.values()))}).drop(*[f"_u_{a}" for a in axes])
