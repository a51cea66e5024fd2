"""Forward-looking labels. They are for training and evaluation, never for inference frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import flag, ratio
from tickloom.operators.cross import pct_rank
from tickloom.plans.arrays import Runs, codes_of, whole_groups
from tickloom.plans.factors import pinned


def _w():
    return Window.partitionBy("symbol").orderBy("trade_date")


def forward_returns(panel: DataFrame, horizons: list[int], price: str = "close") -> DataFrame:
    """close(t+h)/close(t) − 1 by the symbol's own rows."""
    return panel.withColumns({
        f"forward_return_{h}d": ratio(F.lead(price, h).over(_w()), F.col(price)) - 1 for h in horizons
    })


def label_set(panel: DataFrame, horizons: list[int], price: str = "close", blocked: Column | None = None) -> DataFrame:
    """Raw, excess (over the date's mean), percent-rank and tradable labels with their end dates."""
    w = _w()
    work = panel.where(F.col(price).isNotNull()).withColumn("_blocked", F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False))
    work = forward_returns(work, horizons, price).withColumns(
        {f"label_end_{h}d": F.lead("trade_date", h).over(w) for h in horizons}
        | {f"_shut_{h}": F.coalesce(F.lead("_blocked", h).over(w), F.lit(False)) for h in horizons}
    )
    extra = {}
    for h in horizons:
        y = F.col(f"forward_return_{h}d")
        extra[f"forward_excess_return_{h}d"] = y - F.avg(y).over(Window.partitionBy("trade_date"))
        extra[f"forward_rank_{h}d"] = pct_rank(y, "trade_date")
        if blocked is not None:
            extra[f"forward_tradable_return_{h}d"] = F.when(~F.col(f"_shut_{h}"), y)
    keep = F.coalesce(*[F.col(f"forward_return_{h}d") for h in horizons]).isNotNull()
    return work.withColumns(extra).where(keep).drop("_blocked", *[f"_shut_{h}" for h in horizons])


def excess_over_benchmark(panel: DataFrame, benchmark: DataFrame, horizons: list[int], ret: str = "benchmark_return") -> DataFrame:
    """Forward return minus the benchmark compounded over the next h sessions (one row per date)."""
    w = Window.orderBy("trade_date")
    cols = {}
    for h in horizons:
        f = w.rowsBetween(1, h)
        grown = F.aggregate(F.collect_list(1 + F.col(ret)).over(f), F.lit(1.0), lambda a, b: a * b) - 1
        cols[f"_b{h}"] = F.when(F.count(ret).over(f) == h, grown)
    by_date = benchmark.withColumns(cols).select("trade_date", *cols)
    out = forward_returns(panel, horizons).join(by_date, "trade_date", "left")
    return out.withColumns({
        f"forward_excess_{h}d": F.col(f"forward_return_{h}d") - F.col(f"_b{h}") for h in horizons
    }).drop(*cols)


def delayed_labels(panel: DataFrame, horizons: list[int], suspended: str, limit_up: str, st: str | None = None) -> DataFrame:
    """close(t+1+h)/close(t+1) − 1 with feasibility of the entry at t+1 and the first reason against it."""
    w = _w()
    entry = F.lead("close", 1).over(w)
    work = panel.withColumn("entry_close_t1", entry).withColumns({
        f"forward_return_{h}d": ratio(F.lead("close", 1 + h).over(w), F.col("entry_close_t1")) - 1 for h in horizons
    } | {
        "_s1": F.coalesce(F.lead(suspended, 1).over(w), F.lit(False)),
        "_u1": F.coalesce(F.lead(limit_up, 1).over(w), F.lit(False)),
    })
    reason = (
        F.when(F.coalesce(F.col(suspended), F.lit(False)), "suspended_at_t").when(F.col("_s1"), "suspended_at_t1")
    )
    if st:
        reason = reason.when(F.coalesce(F.col(st), F.lit(False)), "st_at_t")
    reason = reason.when(F.col("_u1"), "limit_up_at_t1").when(F.col("entry_close_t1").isNull(), "entry_price_missing")
    return work.withColumn("blocked_by", reason).withColumn("entry_feasible", F.col("blocked_by").isNull()).drop("_s1", "_u1")


def session_labels(panel: DataFrame, sessions: DataFrame, horizons: list[int], delay: int = 1, price: str = "close") -> DataFrame:
    """Returns on the exchange clock: entry at session t+d, exit at t+d+h, exact bars only.

    A missing bar gives a missing label, never the next bar. ``sessions`` numbers the exchange
    days; prices are found by equi-joins on (symbol, session).
    """
    s = sessions.select("trade_date", "session")
    numbered = panel.join(F.broadcast(s), "trade_date")  # one row per exchange day: at most tens of thousands
    prices = numbered.where(F.col(price) > 0).select("symbol", F.col("session").alias("_at"), F.col(price).alias("_p"))
    # one stacked probe per (row, offset), one join, one fold back
    offsets = [delay, *[delay + h for h in horizons]]
    probes = numbered.select("symbol", "trade_date", "session", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o"))
    hits = probes.withColumn("_at", F.col("session") + F.col("_o")).join(prices, ["symbol", "_at"])
    found = hits.groupBy("symbol", "trade_date").agg(*[F.max(F.when(F.col("_o") == o, F.col("_p"))).alias(f"_p{o}") for o in offsets])
    out = numbered.join(found, ["symbol", "trade_date"], "left")
    last = sessions.agg(F.max("session").alias("_last"))
    out = out.crossJoin(F.broadcast(last))  # one row
    return out.withColumns(
        {"entry_observed": F.col(f"_p{delay}").isNotNull()}
        | {f"executable_return_{h}d": ratio(F.col(f"_p{delay + h}"), F.col(f"_p{delay}")) - 1 for h in horizons}
        | {f"censored_{h}d": F.col("session") + delay + h > F.col("_last") for h in horizons}
    ).drop("_last", *[f"_p{o}" for o in offsets])


def log_and_risk_labels(panel: DataFrame, horizons: list[int], ret: str = "ret") -> DataFrame:
    """Future log return, volatility and worst drop from today's close within h rows."""
    w = _w()
    out = {}
    for h in horizons:
        f = w.rowsBetween(1, h)
        out[f"future_{h}d_log_return"] = F.ln(ratio(F.lead("close", h).over(w), F.col("close")))
        out[f"future_{h}d_volatility"] = F.when(F.count(ret).over(f) == h, F.stddev_samp(ret).over(f))
        out[f"future_{h}d_drawdown"] = F.when(F.count("close").over(f) == h, ratio(F.min("close").over(f), F.col("close")) - 1)
    return panel.withColumns(out)


def sector_neutral(panel: DataFrame, label: str, sector: str = "sector") -> DataFrame:
    w = Window.partitionBy("trade_date", sector)
    return panel.withColumn(f"{label}_sector_neutral", F.col(label) - F.avg(label).over(w))


def triple_barrier(panel: DataFrame, sigma: str, take: float = 2.0, stop: float = 2.0, days: int = 10, min_return: float = 0.0) -> DataFrame:
    """First touch of +take·σ or −stop·σ within the next rows, else the horizon; the sign is the label."""
    f = _w().rowsBetween(1, days)
    path = F.collect_list(F.struct(F.col("trade_date").alias("d"), F.ln("close").alias("p"))).over(f)
    work = panel.withColumn("_path", path).withColumn(
        "_ret", F.transform("_path", lambda s: F.struct(s["d"].alias("d"), (s["p"] - F.ln("close")).alias("r")))
    )
    s = F.col(sigma)
    hit = F.filter("_ret", lambda x: (x["r"] >= F.lit(take) * s) | (x["r"] <= F.lit(-stop) * s))
    usable = (F.size("_path") > 0) & s.isNotNull() & (s > 0)
    touch = F.when(usable & (F.size(hit) > 0), F.get(hit, F.lit(0)))
    end = F.when(usable, F.element_at("_ret", -1))
    work = work.withColumn("_touch", touch).withColumn("_end", end)
    ret = F.coalesce("_touch.r", "_end.r")
    barrier = F.when(F.col("_touch").isNotNull(), F.when(F.col("_touch.r") > 0, "pt").otherwise("sl")).otherwise("vt")
    out = work.withColumns({"t1": F.coalesce("_touch.d", "_end.d"), "barrier_return": ret, "barrier": barrier})
    quiet = (F.col("barrier") == "vt") & (F.abs("barrier_return") < min_return)
    return out.withColumn(
        "label", F.when(F.col("barrier_return").isNull() | quiet, 0).otherwise(F.signum("barrier_return")).cast("int")
    ).drop("_path", "_ret", "_touch", "_end")


def uniqueness_weights(events: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Mean of 1 / concurrency over each event's sessions, per symbol; an unfinished event takes its symbol's mean.

    Concurrency only changes where an event starts or has ended, so a symbol's events are swept over these edges; neither
    event × day pairs nor a symbol × session grid are formed. The calendar (one row per exchange day) goes to every task,
    one symbol's events meet in one.
    """
    days = np.sort(np.array([r[0] for r in sessions.select(F.unix_date(F.col("trade_date").cast("date"))).distinct().collect() if r[0] is not None], "float64"))
    staged = events.withColumns({"_from": F.unix_date(F.col(start).cast("date")), "_to": F.unix_date(F.col(end).cast("date"))})
    schema = T.StructType([*events.schema.fields, T.StructField("uniqueness", T.DoubleType())])
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "symbol"):
            codes = codes_of(table.column("symbol"))
            first, last = (table.column(c).to_pandas().to_numpy("float64", na_value=np.nan) for c in ("_from", "_to"))
            value = event_uniqueness(Runs(codes), codes >= 0, np.searchsorted(days, first, "left"), np.searchsorted(days, last, "right"), ~np.isnan(first) & ~np.isnan(last))
            yield from pa.Table.from_arrays([*[table.column(c) for c in names], pa.array(value, pa.float64(), from_pandas=True)], names=[*names, "uniqueness"]).to_batches()

    return pinned(staged, "symbol").sortWithinPartitions("symbol").mapInArrow(run, schema)


def event_uniqueness(runs: Runs, named: np.ndarray, begin: np.ndarray, stop: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Uniqueness of events that cover the sessions ``begin`` to ``stop - 1``, group by group."""
    out = np.full(runs.size, np.nan)
    usable = known & named & (stop > begin)
    for s, e in zip(runs.ends[:-1], runs.ends[1:]):
        at = s + np.flatnonzero(usable[s:e])
        if len(at) == 0:
            continue
        edges, place = np.unique(np.r_[begin[at], stop[at]], return_inverse=True)
        i, j = place[: len(at)], place[len(at) :]
        running = np.cumsum(np.bincount(i, minlength=len(edges)) - np.bincount(j, minlength=len(edges)))[:-1]
        share = np.r_[0.0, np.cumsum(np.where(running > 0, np.diff(edges) / np.maximum(running, 1), 0.0))]
        out[at] = (share[j] - share[i]) / (stop[at] - begin[at])
        out[s:e][np.isnan(out[s:e])] = out[at].mean()
    return out


def meta_label(signal: Column, label: Column, score: Column, threshold: float = 0.5) -> Column:
    """The primary signal picks the side, the secondary score decides whether to take it."""
    return F.signum(signal) * flag(F.coalesce(score, F.lit(0.0)) >= threshold) * F.abs(label)
