"""Universe rules, weight tables, turnover, costs and trade analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import count_if, ratio
from tickloom.operators.series import tie_key
from tickloom.plans.factors import pinned


def target_liveness(weights: DataFrame, predictions: DataFrame, score: str, eps: float = 1e-9) -> DataFrame:
    """Gross exposure and live names per date beside prediction counts, with a reason for dead dates."""
    w = weights.groupBy("trade_date").agg(F.sum(F.abs("weight")).alias("gross"), count_if(F.abs("weight") > eps).alias("live"))
    p = predictions.groupBy("trade_date").agg(F.count(score).alias("predictions"))
    j = w.join(p, "trade_date", "full_outer").fillna(0, ["gross", "live", "predictions"])
    reason = F.when(F.col("live") > 0, None).when(F.col("predictions") == 0, "no_predictions").otherwise("all_weights_zero")
    return j.select("trade_date", (F.round("gross", 6) + F.lit(0.0)).alias("gross"), "live", "predictions", reason.alias("reason"))


# Daily price-limit ratios by board, and the dated rules around them.
ORDINARY_LIMIT = {"sh_main": 0.10, "sz_main": 0.10, "chinext": 0.20, "star": 0.20, "bse": 0.30}
ST_LIMIT_OLD = {"sh_main": 0.05, "sz_main": 0.05, "chinext": 0.20, "star": 0.20, "bse": 0.30}
ST_REFORM = "2026-07-06"
STAMP_HALVED = "2023-08-28"
STAMP_OLD, STAMP_NEW = 0.001, 0.0005


def _by_board(board: Column, values: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for b, v in values.items():
        out = out.when(board == b, F.lit(v))
    return out


def limit_ratio(board: Column, st: Column | None = None, date: Column | None = None) -> Column:
    """Legal daily move by board; flagged main-board names have a dated, tighter band."""
    normal = _by_board(board, ORDINARY_LIMIT)
    if st is None:
        return normal
    return F.when(st & (date < F.lit(ST_REFORM).cast("date")), _by_board(board, ST_LIMIT_OLD)).otherwise(normal)


def limit_band(previous_close: Column, ratio_: Column) -> tuple[Column, Column]:
    """Band prices rounded to the tick."""
    return F.round(previous_close * (1 + ratio_), 2), F.round(previous_close * (1 - ratio_), 2)


def market_flags(panel: DataFrame, ratio_: Column, min_names: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """Suspended (no volume and amount on a well-populated date), limit-up/down and one-price boards."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    names = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    move = ratio(F.col("close"), F.lag("close").over(w)) - 1
    work = panel.withColumns({"_n": names, "_move": move, "_lim": ratio_})
    busy = F.col("_n") >= min_names
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    up = F.coalesce(F.col("_move") >= F.col("_lim") - tolerance, F.lit(False))
    down = F.coalesce(F.col("_move") <= -(F.col("_lim") - tolerance), F.lit(False))
    dead = busy & (F.coalesce("volume", F.lit(0.0)) <= 0) & (F.coalesce("amount", F.lit(0.0)) <= 0)
    return work.withColumns({
        "is_suspended": dead, "is_limit_up": up, "is_limit_down": down, "is_one_price": flat & (up | down),
    }).drop("_n", "_move", "_lim")


def tradability(suspended: Column, up: Column, down: Column, held_today: Column) -> tuple[Column, Column, Column]:
    """can_buy, can_sell and the reasons against, as text."""
    reasons = F.array_join(F.array_compact(F.array(
        F.when(suspended, "suspended"), F.when(up, "limit_up_no_buy"), F.when(down, "limit_down_no_sell"), F.when(held_today, "t_plus_one"),
    )), ",")
    return ~(suspended | up), ~(suspended | down | held_today), reasons


def high_chase(panel: DataFrame, lookback: int = 5, max_gain: float = 0.30, max_ups: int = 3, combine: str = "and", up: float = 0.099) -> DataFrame:
    """Names already run up: trailing gain to yesterday and number of limit-ups in the window."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    gain = ratio(F.lag("close", 1).over(w), F.lag("close", 1 + lookback).over(w)) - 1
    ret = ratio(F.col("close"), F.lag("close").over(w)) - 1
    work = panel.withColumn("_up", (F.coalesce(ret, F.lit(0.0)) >= up).cast("int"))
    ups = F.sum("_up").over(w.rowsBetween(-lookback, -1))
    a, b = F.coalesce(gain > max_gain, F.lit(False)), F.coalesce(ups >= max_ups, F.lit(False))
    return work.withColumn("high_chase", a & b if combine == "and" else a | b).drop("_up")


def filter_universe(predictions: DataFrame, flags: DataFrame, score: str, min_amount: float, st_keep: float = 0.10) -> DataFrame:
    """First reason each prediction fails; flagged (ST) names survive only in the date's top share by score."""
    f = flags.dropDuplicates(["symbol", "trade_date"])
    return universe_reasons(predictions.join(f, ["symbol", "trade_date"], "left"), score, min_amount, st_keep)


def universe_reasons(flagged: DataFrame, score: str, min_amount: float, st_keep: float = 0.10) -> DataFrame:
    """``filter_universe`` for rows that carry both the score and the flags."""
    j = pinned(flagged, "trade_date")
    st = F.coalesce("is_st", F.lit(False))
    g = Window.partitionBy("trade_date", st)
    rn = F.row_number().over(g.orderBy(tie_key(F.col(score)).desc(), "symbol"))
    keep = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(g) * F.lit(st_keep)))
    reason = (
        F.when(F.coalesce("is_suspended", F.lit(False)), "suspended")
        .when(F.coalesce("is_limit_up", F.lit(False)), "limit_up")
        .when(F.col("amount").isNull(), "amount_missing")
        .when(F.col("amount") < min_amount, "amount_too_low")
        .when(F.coalesce("high_chase", F.lit(False)), "high_chase")
        .when(st & (rn > keep), "st_soft_filter")
    )
    return j.withColumn("reason", reason).withColumn("universe_pass", F.col("reason").isNull())


def top_k_weights(predictions: DataFrame, score: str, k: int, by: list[str] | None = None) -> DataFrame:
    """Equal weights of the k best per date."""
    keys = [*(by or []), "trade_date"]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(tie_key(F.col(score)).desc(), "symbol"))
    picked = predictions.where(F.col(score).isNotNull()).withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn")
    return picked.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def capped_weights(book: DataFrame, raw: str, cap: float, by: str = "trade_date") -> DataFrame:
    """Weights proportional to ``raw`` with a cap, the excess shared among the rest, in closed form.

    Sorted by size, the capped set is a prefix; the first k whose k-th share after removing the
    larger ones no longer exceeds the cap ends it. Running sums find k without any loop.
    """
    order = Window.partitionBy(by).orderBy(tie_key(F.col(raw)).desc(), "symbol")
    before = F.coalesce(F.sum(raw).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(raw).over(Window.partitionBy(by))
    pos = F.row_number().over(order) - 1
    work = book.withColumns({"_before": before, "_total": total, "_pos": pos})
    room = F.lit(1.0) - F.col("_pos") * F.lit(cap)
    share = F.col(raw) * room / (F.col("_total") - F.col("_before"))
    work = work.withColumn("_over", (room > 0) & (share > cap))
    k = F.sum(F.col("_over").cast("int")).over(Window.partitionBy(by))
    rest = F.sum(F.when(~F.col("_over"), F.col(raw))).over(Window.partitionBy(by))
    free = F.greatest(F.lit(1.0) - k * F.lit(cap), F.lit(0.0))
    return work.withColumn("weight", F.when(F.col("_over"), F.lit(cap)).otherwise(F.col(raw) * free / rest)).drop("_before", "_total", "_pos", "_over")


def hysteresis(predictions: DataFrame, score: str, entry: int, leave: int) -> DataFrame:
    """Held from entering the best ``entry`` ranks until falling past rank ``leave``."""
    rn = F.row_number().over(Window.partitionBy("trade_date").orderBy(tie_key(F.col(score)).desc(), "symbol"))
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    ranked = predictions.withColumn("rank", rn)
    signal = F.when(F.col("rank") <= entry, 1).when(F.col("rank") > leave, 0)
    return ranked.withColumn("held", F.coalesce(F.last(signal, ignorenulls=True).over(w), F.lit(0)) == 1)


def weight_turnover(weights: DataFrame) -> DataFrame:
    """Σ|Δw| per date against the previous rebalance date, absent names counting as 0."""
    dates = weights.select("trade_date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("trade_date")))
    now = weights.join(F.broadcast(dates), "trade_date").select("_i", "symbol", F.col("weight").alias("_w"))  # one row per session
    last = dates.agg(F.max("_i").alias("_last"))
    moved = now.select(F.col("_i"), "symbol", "_w").unionByName(
        now.select((F.col("_i") + 1).alias("_i"), "symbol", (-F.col("_w")).alias("_w"))
    )
    change = moved.groupBy("_i", "symbol").agg(F.sum("_w").alias("_d"))
    per = change.groupBy("_i").agg(F.sum(F.abs("_d")).alias("_t"))
    return dates.join(per, "_i").crossJoin(F.broadcast(last)).select(
        "trade_date", F.when(F.col("_i") == 1, 0.0).otherwise(F.col("_t")).alias("turnover")
    )


def trade_cost(value: Column, adv: Column, sell: Column, date: Column) -> dict[str, Column]:
    """Commission with a floor, dated stamp duty on sells, transfer fee and square-root impact."""
    duty = F.when(date >= F.lit(STAMP_HALVED).cast("date"), STAMP_NEW).otherwise(STAMP_OLD)
    size = F.abs(value)
    part = F.coalesce(F.greatest(ratio(size, adv), F.lit(0.0)), F.lit(0.0))
    return {
        "commission": F.when(size > 0, F.greatest(size * 0.00025, F.lit(5.0))).otherwise(0.0),
        "stamp_duty": F.when(sell, size * duty).otherwise(0.0),
        "transfer_fee": size * 0.00001,
        "impact": size * 0.001 * F.sqrt(part),
    }


def fifo_matches(fills: DataFrame, order: list[str]) -> DataFrame:
    """Match sells to the oldest buys per symbol as overlaps of cumulative quantity intervals.

    The k-th share bought meets the k-th share sold. Interval edges of both sides are stacked and
    swept: every piece between two neighbouring edges belongs to one buy and one sell, so there
    are at most buys + sells pieces and no pair join at all. A fill of nothing has no interval; left in, it
    would stand at the edge of the fill before it and take its place.
    """
    w = Window.partitionBy("symbol", "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edge = fills.where("quantity > 0").withColumn("_to", F.sum("quantity").over(w))
    lot = F.struct(F.col(order[0]).alias("at"), F.col("price").alias("price"))
    e = edge.select("symbol", "_to", F.when(F.col("side") == "buy", lot).alias("_b"), F.when(F.col("side") == "sell", lot).alias("_s"))
    cuts = e.groupBy("symbol", "_to").agg(F.max("_b").alias("_b"), F.max("_s").alias("_s"))
    o = Window.partitionBy("symbol").orderBy("_to")
    ahead = Window.partitionBy("symbol").orderBy(F.desc("_to")).rowsBetween(Window.unboundedPreceding, 0)  # backwards, one pass
    pieces = cuts.withColumns({
        "_from": F.coalesce(F.lag("_to").over(o), F.lit(0.0)),
        "_b": F.last("_b", ignorenulls=True).over(ahead), "_s": F.last("_s", ignorenulls=True).over(ahead),
    })
    return pieces.where("_b is not null and _s is not null").select(
        "symbol", F.col("_b.at").alias("bought_at"), F.col("_s.at").alias("sold_at"),
        (F.col("_to") - F.col("_from")).alias("quantity"), F.col("_b.price").alias("buy_price"), F.col("_s.price").alias("sell_price"),
        ((F.col("_s.price") - F.col("_b.price")) * (F.col("_to") - F.col("_from"))).alias("pnl"),
    )


def parent_tca(fills: DataFrame, parents: DataFrame) -> DataFrame:
    """Per parent order: completion, execution VWAP, arrival shortfall, VWAP slippage, opportunity cost."""
    f = fills.groupBy("parent_id").agg(F.sum("quantity").alias("filled"), F.sum(F.col("quantity") * F.col("price")).alias("notional"))
    j = parents.join(f, "parent_id", "left").fillna(0.0, ["filled", "notional"])
    vwap = ratio(F.col("notional"), F.col("filled"))
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return j.select(
        "parent_id", "side", (F.col("filled") / F.col("quantity")).alias("completion"), vwap.alias("execution_vwap"),
        (sign * (vwap - F.col("arrival_price")) / F.col("arrival_price") * 10000).alias("arrival_bps"),
        (sign * ratio(vwap - F.col("market_vwap"), F.col("market_vwap")) * 10000).alias("vwap_bps"),
        (sign * (F.col("terminal_price") - F.col("arrival_price")) * (F.col("quantity") - F.col("filled"))).alias("opportunity_cost"),
    )


def positions(fills: DataFrame, keys: list[str], order: list[str], initial_cash: float = 0.0) -> DataFrame:
    """Running shares and cash after every fill, as signed cumulative sums."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    return fills.withColumns({"shares": F.sum(q).over(w), "cash": F.lit(initial_cash) - F.sum(q * F.col("price")).over(w)})


def snapshot_differences(left: DataFrame, right: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """Two keyed snapshots compared field by field; only the differences are kept."""
    a = left.select(key, F.lit(1).alias("_a"), *[F.col(c).alias(f"_l_{c}") for c in tolerances])
    b = right.select(key, F.lit(1).alias("_b"), *[F.col(c).alias(f"_r_{c}") for c in tolerances])
    cells = []
    for c, tol in tolerances.items():
        x, y = F.col(f"_l_{c}").cast("double"), F.col(f"_r_{c}").cast("double")
        kind = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(F.abs(x - y) <= tol, None).otherwise("different")
        cells.append(F.struct(F.lit(c).alias("field"), x.alias("left_value"), y.alias("right_value"), kind.alias("kind")))
    return a.join(b, key, "full_outer").select(key, F.explode(F.array(*cells)).alias("d")).select(key, "d.*").where("kind is not null")


def weighted_exposure(weights: DataFrame, attributes: DataFrame, beta: str, sector: str) -> DataFrame:
    """Gross, net, beta exposure with its weighted coverage, and the largest sector share, per date."""
    j = weights.join(attributes, "symbol", "left")
    size = F.abs("weight")
    sectors = j.groupBy("trade_date", sector).agg(F.sum(size).alias("_s")).groupBy("trade_date").agg(F.max("_s").alias("largest_sector"))
    core = j.groupBy("trade_date").agg(
        F.sum(size).alias("gross"), F.sum("weight").alias("net"), F.sum(F.col("weight") * F.col(beta)).alias("beta_exposure"),
        ratio(F.sum(F.when(F.col(beta).isNotNull(), size)), F.sum(size)).alias("beta_coverage"),
    )
    return core.join(sectors, "trade_date")
