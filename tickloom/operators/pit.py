"""Point-in-time joins: nothing is read before it was available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import carry_last
from tickloom.sizes import broadcast_if_small


def decision_time(date: Column, clock: str = "15:00:00") -> Column:
    """The moment a trade date is decided on: the date plus the market-close clock."""
    h, m, s = (int(x) for x in clock.split(":"))
    return date.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(h), F.lit(m), F.lit(s))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    values: list[str] | None = None,
    keep_time: bool = False,
    bucket: str | None = None,
    order_ties: list[str] | None = None,
) -> DataFrame:
    """Left rows with the latest right row whose time is at or before theirs, per key; ties included.

    Both sides are stacked and the last right row is carried down by a window: one shuffle, no
    pair is ever formed, and all values travel as one struct so a matched row of NULLs stays a
    match. ``bucket`` (a ``date_trunc`` unit) also cuts each key by time and carries the last row
    of earlier buckets in, for keys whose history is too long for one task.
    """
    if right_time not in right.columns:
        raise ValueError(f"no availability column {right_time}: an observation date is no substitute")
    values = values if values is not None else [c for c in right.columns if c not in (*on, right_time)]
    ties = order_ties or values
    payload = F.struct(F.col(right_time).alias("_at"), *[F.col(v) for v in values])
    r = right.where(F.col(right_time).isNotNull()).select(
        *on, F.col(right_time).cast("timestamp").alias("_t"), F.lit(0).alias("_side"),
        F.struct(*[F.col(t) for t in ties]).alias("_tie"), payload.alias("_right"), F.lit(None).cast(_left_type(left)).alias("_left"),
    )
    left_row = F.struct(*[F.col(c) for c in left.columns])
    r_type = r.schema["_right"].dataType
    t_type = r.schema["_tie"].dataType
    lft = left.select(
        *on, F.col(left_time).cast("timestamp").alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(t_type).alias("_tie"), F.lit(None).cast(r_type).alias("_right"), left_row.alias("_left"),
    )
    both = r.unionByName(lft)
    if bucket is None:
        w = Window.partitionBy(*on).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
        done = both.withColumn("_match", F.last("_right", ignorenulls=True).over(w))
    else:
        done = carry_last(both, on, ["_t", "_side", "_tie"], F.date_trunc(bucket, "_t"), "_right", "_match")
    out = done.where("_side = 1").select("_left.*", *[F.col(f"_match.{v}").alias(v) for v in values], *(
        [F.col("_match._at").alias(right_time)] if keep_time else []))
    return out


def _left_type(left: DataFrame):
    return left.schema


def asof_suffixed(
    base: DataFrame, extra: DataFrame, on: list[str], left_time: str, right_time: str, suffix: str, flag: str | None = None
) -> DataFrame:
    """As-of join where clashing value columns get a suffix; ``flag`` marks rows with nothing joined."""
    values = [c for c in extra.columns if c not in (*on, right_time)]
    names = {v: f"{v}{suffix}" if v in base.columns else v for v in values}
    renamed = extra.select(*on, right_time, *[F.col(v).alias(names[v]) for v in values])
    out = asof_join(base, renamed, on, left_time, right_time)
    if flag:
        nothing = F.lit(True)
        for v in names.values():
            nothing = nothing & F.col(v).isNull()
        out = out.withColumn(flag, nothing.cast("int"))
    return out


def asof_market_series(base: DataFrame, series: DataFrame, left_time: str, right_time: str, prefix: str) -> DataFrame:
    """A market-wide series for every row: the as-of runs on distinct dates, then joins by date."""
    values = [c for c in series.columns if c != right_time]
    dates = base.select(left_time).distinct().withColumn("_one", F.lit(1))
    wide = series.select(F.lit(1).alias("_one"), right_time, *[F.col(v).alias(f"{prefix}{v}") for v in values])
    by_date = asof_join(dates, wide, ["_one"], left_time, right_time).drop("_one")
    return base.join(broadcast_if_small(by_date), left_time, "left")


def latest_visible(
    frame: DataFrame, as_of: Column, keys: list[str], available: str, order: list[Column]
) -> DataFrame:
    """The newest row per key among those visible at ``as_of``; ``order`` ranks newest first.

    ``max_by`` on the ordering struct would need descending fields reversed, so this uses one
    row_number; the filter runs first and the window group is one key's visible history.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = frame.where(F.col(available).isNotNull() & (F.col(available) <= as_of))
    return seen.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def next_session(dates: DataFrame, date: str, sessions: DataFrame, session: str, lag_days: int = 0, out: str = "session") -> DataFrame:
    """First trading session on or after date + lag (calendar days); NULL past the calendar's end.

    A calendar holds at most a few ten thousand days, so it is spread once into a day → session
    map, which makes the look-up an equi-join.
    """
    s = sessions.select(F.col(session).alias("_s")).distinct()
    w = Window.orderBy("_s")
    spans = s.select(F.coalesce(F.date_add(F.lag("_s").over(w), 1), F.date_sub("_s", 400)).alias("_from"), "_s")
    days = spans.select(F.explode(F.sequence("_from", "_s")).alias("_day"), F.col("_s").alias(out))
    target = F.date_add(F.col(date).cast("date"), lag_days)
    return dates.withColumn("_day", target).join(broadcast_if_small(days), "_day", "left").drop("_day")


def session_index(panel: DataFrame, date: str = "trade_date", out: str = "session") -> DataFrame:
    """Distinct dates numbered 1..N: the exchange clock. The window sees one row per session."""
    w = Window.orderBy(date)
    return panel.select(date).distinct().withColumn(out, F.row_number().over(w))


def in_intervals(
    panel: DataFrame, intervals: DataFrame, key: str, date: str, start: str, end: str, out: str
) -> DataFrame:
    """True where the date falls in any closed interval [start, end] of its key; open ends allowed.

    A sweep: interval edges are stacked under the panel rows and a running sum counts the open
    intervals, so overlapping or very many intervals never multiply rows.
    """
    cols = panel.columns
    row = F.struct(*[F.col(c) for c in cols])
    marks = panel.select(F.col(key).alias("_k"), F.col(date).alias("_d"), F.lit(1).alias("_o"), F.lit(0).alias("_v"), row.alias("_row"))
    none = F.lit(None).cast(marks.schema["_row"].dataType).alias("_row")
    opens = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_d"), F.lit(0).alias("_o"), F.lit(1).alias("_v"), none)
    shuts = intervals.where(F.col(end).isNotNull()).select(
        F.col(key).alias("_k"), F.col(end).alias("_d"), F.lit(2).alias("_o"), F.lit(-1).alias("_v"), none
    )
    w = Window.partitionBy("_k").orderBy("_d", "_o").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.unionByName(opens).unionByName(shuts).withColumn("_open", F.sum("_v").over(w))
    return swept.where("_o = 1").select("_row.*", (F.col("_open") > 0).alias(out))


def tri_state(flag: Column, known: Column) -> Column:
    """TRUE / FALSE / UNKNOWN as text; unknown never folds into false."""
    return F.when(~known, "UNKNOWN").when(F.coalesce(flag, F.lit(False)), "TRUE").otherwise("FALSE")


def eligibility(panel: DataFrame, masks: list[str]) -> DataFrame:
    """Combine tri-state masks: any TRUE blocks, else any UNKNOWN is unknown; unknown masks are named."""
    any_true, any_unknown = F.lit(False), F.lit(False)
    for m in masks:
        any_true = any_true | (F.col(m) == "TRUE")
        any_unknown = any_unknown | (F.col(m) == "UNKNOWN")
    names = F.array_join(
        F.array_compact(F.array(*[F.when(F.col(m) == "UNKNOWN", m.removeprefix("mask_")) for m in masks])), ","
    )
    return panel.withColumns({
        "eligible": ~any_true & ~any_unknown,
        "eligibility_status": F.when(any_true, "FALSE").when(any_unknown, "UNKNOWN").otherwise("TRUE"),
        "unknown_masks": names,
    })


def adjust_prices(
    panel: DataFrame, factors: DataFrame, method: str, prices: tuple[str, ...] = ("open", "high", "low", "close")
) -> DataFrame:
    """Scale prices by the step function in force: ``none``, ``hfq`` (as published) or ``qfq`` (÷ last)."""
    if method not in ("none", "hfq", "qfq"):
        raise ValueError(f"unknown adjustment {method}")
    if method == "none":
        return panel.withColumn("adjust_factor", F.lit(1.0))
    joined = asof_join(panel, factors, ["symbol"], "trade_date", "effective_date", ["hfq_factor"])
    scale = F.coalesce("hfq_factor", F.lit(1.0))
    if method == "qfq":
        w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        scale = scale / F.last(F.coalesce("hfq_factor", F.lit(1.0))).over(w)
    joined = joined.withColumn("adjust_factor", scale).drop("hfq_factor")
    return joined.withColumns({p: F.col(p) * F.col("adjust_factor") for p in prices})


def decayed_history(
    points: DataFrame,
    events: DataFrame,
    key: str,
    at: str,
    event_time: str,
    half_life_days: str,
    weights: dict[str, str],
    bucket_days: int = 32,
) -> DataFrame:
    """For each point, Σ value·0.5^(age / half-life) over ALL earlier events of its key.

    Pairing every point with every earlier event would be quadratic. The sum is linear, so it is
    carried instead: inside a bucket of days a running sum of values scaled to the bucket start
    (small exponents only); from bucket to bucket one number per half-life, folded over the short
    list of buckets. Exact, and no group is ever expanded.
    """
    day = 86400.0

    def days(c: str) -> Column:
        return F.unix_micros(F.col(c)) / F.lit(1e6 * day)

    e = events.select(
        key, F.col(half_life_days).cast("double").alias("_h"), days(event_time).alias("_t"),
        *[F.col(src).cast("double").alias(out) for out, src in weights.items()],
    ).withColumn("_b", F.floor(F.col("_t") / bucket_days).cast("long"))
    start = F.col("_b") * F.lit(float(bucket_days))
    # per bucket: what its events are worth at the bucket's end
    at_end = F.pow(F.lit(0.5), (start + bucket_days - F.col("_t")) / F.col("_h"))
    ends = e.groupBy(key, "_h", "_b").agg(*[F.sum(F.col(o) * at_end).alias(o) for o in weights])
    # fold: worth of all earlier buckets at the start of each bucket that is needed
    p = points.withColumn("_pt", days(at)).withColumn("_b", F.floor(F.col("_pt") / bucket_days).cast("long"))
    halves = e.select(key, "_h").distinct()
    wanted = p.select(key, "_b").distinct().join(halves, key)
    history = ends.groupBy(key, "_h").agg(F.sort_array(F.collect_list(F.struct("_b", *weights))).alias("_hist"))

    def carried(o: str) -> Column:
        return F.aggregate(
            F.filter("_hist", lambda s: s["_b"] < F.col("_b")), F.lit(0.0),
            lambda acc, s: acc + s[o] * F.pow(F.lit(0.5), (F.col("_b") - s["_b"] - 1) * F.lit(float(bucket_days)) / F.col("_h")),
        )

    carry = wanted.join(history, [key, "_h"]).select(key, "_h", "_b", *[carried(o).alias(f"_c_{o}") for o in weights])
    grown = F.pow(F.lit(2.0), (F.col("_t") - start) / F.col("_h"))
    inner = e.select(key, "_h", "_b", "_t", F.lit(0).alias("_side"), *[(F.col(o) * grown).alias(o) for o in weights])
    probes = p.select(key, F.col("_b"), F.col("_pt").alias("_t")).distinct().join(halves, key).select(
        key, "_h", "_b", "_t", F.lit(1).alias("_side"), *[F.lit(0.0).alias(o) for o in weights]
    )
    w = Window.partitionBy(key, "_h", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    stacked = inner.unionByName(probes).withColumns({o: F.sum(o).over(w) for o in weights}).where("_side = 1")
    shrink = F.pow(F.lit(0.5), (F.col("_t") - start) / F.col("_h"))
    worth = stacked.join(carry, [key, "_h", "_b"], "left").groupBy(key, "_t").agg(
        *[F.sum((F.col(o) + F.coalesce(F.col(f"_c_{o}"), F.lit(0.0))) * shrink).alias(o) for o in weights]
    )
    return p.drop("_b").withColumnRenamed("_pt", "_t").join(worth, [key, "_t"], "left").drop("_t").withColumns(
        {o: F.coalesce(F.col(o), F.lit(0.0)) for o in weights}
    )
