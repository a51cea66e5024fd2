"""Integrity checks, quarantine, reconciliation and audits as aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import count_if, ratio
from tickloom.operators.series import previous_value

PASS, WARN, FAIL, NOT_RUN = "PASS", "WARN", "FAIL", "NOT_RUN"

# Exchange session windows as (from minute, to minute, phase), end exclusive.
SESSION_WINDOWS = (
    (555, 565, "opening_auction"), (565, 570, "pre_open"), (570, 690, "morning"), (690, 780, "lunch"),
    (780, 897, "afternoon"), (897, 900, "closing_auction"),
)
AFTER_HOURS = (905, 930)
POST_CLOSE = (900, 930)
OUTSIDE_DAILY_BAR = ("lunch", "closed", "post_close", "after_hours", "pre_open")


def session_phase(minute: Column, star: Column | None = None) -> Column:
    """Minute of day → phase; the after-hours window exists for one board only."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, name in SESSION_WINDOWS:
        out = out.when((minute >= lo) & (minute < hi), name)
    if star is not None:
        out = out.when(star & (minute >= AFTER_HOURS[0]) & (minute < AFTER_HOURS[1]), "after_hours")
    return out.when((minute >= POST_CLOSE[0]) & (minute < POST_CLOSE[1]), "post_close").when(minute.isNotNull(), "closed")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def tag_duplicates(df: DataFrame, keys: list[str], out: str = "duplicate_key") -> DataFrame:
    """Mark every copy of a repeated key. Counts are partially aggregated; one key with a third of
    the rows never meets in one window, and the join back can be split by AQE."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*keys, F.lit(True).alias(out))
    return df.join(repeated, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def tag_integrity(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the comma-joined names of broken rules (duplicates included), '' if none."""
    tagged = tag_duplicates(df, keys)
    rules = {"duplicate_key": F.col("duplicate_key"), **rules}
    parts = F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()])
    return tagged.withColumn("violations", F.array_join(F.array_compact(parts), ",")).drop("duplicate_key")


def ohlcv_rules() -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad_price = F.lit(False)
    for x in (o, h, lo, c):
        bad_price = bad_price | x.isNull() | F.isnan(x) | (x <= 0)
    return {
        "bad_price": bad_price,
        "negative_flow": (F.col("volume") < 0) | (F.col("amount") < 0),
        "high_below_low": h < lo,
        "body_outside_range": (F.greatest(o, c) > h) | (F.least(o, c) < lo),
    }


def violation_report(tagged: DataFrame, names: list[str]) -> DataFrame:
    """One row per rule with its count, in one pass."""
    parts = F.split("violations", ",")
    counts = tagged.agg(*[count_if(F.array_contains(parts, n)).alias(n) for n in names])
    return counts.unpivot([], names, "rule", "rows")


def expected_key_gaps(panel: DataFrame, symbols: DataFrame, dates: DataFrame) -> DataFrame:
    """symbols × dates minus received keys; only the dates (a calendar) are broadcast."""
    return symbols.crossJoin(F.broadcast(dates)).join(panel.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")


def provider_changes(df: DataFrame, key: str, date: str, provider: str) -> DataFrame:
    """Dates where the provider of a key differs from its previous date."""
    w = Window.partitionBy(key).orderBy(date)
    return df.withColumn("previous", F.lag(provider).over(w)).where(
        F.col("previous").isNotNull() & (F.col("previous") != F.col(provider))
    )


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, float], lot_fields: tuple[str, ...] = ("volume",)) -> DataFrame:
    """Field-by-field outcome of a full outer compare, one row per key and field.

    Outcomes: MATCH, MISMATCH_UNIT (×100 either way), MISMATCH_ADJUSTMENT (all prices off by one
    ratio), MISMATCH_VALUE, MISSING_LEFT, MISSING_RIGHT.
    """
    a = left.select(*keys, F.lit(1).alias("_a"), *[F.col(f).alias(f"_l_{f}") for f in fields])
    b = right.select(*keys, F.lit(1).alias("_b"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    both = a.join(b, keys, "full_outer")
    out = {}
    for f, tol in fields.items():
        x, y = F.col(f"_l_{f}"), F.col(f"_r_{f}")
        o = F.when(F.col("_a").isNull() | x.isNull(), "MISSING_LEFT").when(F.col("_b").isNull() | y.isNull(), "MISSING_RIGHT")
        o = o.when(F.abs(y - x) <= tol * F.abs(x), "MATCH")
        if f in lot_fields:
            o = o.when((F.abs(ratio(y, x) - 100) < 1) | (F.abs(ratio(x, y) - 100) < 1), "MISMATCH_UNIT")
        out[f"_o_{f}"] = o.otherwise("MISMATCH_VALUE")
    both = both.withColumns(out)
    prices = [f for f in fields if f in ("open", "high", "low", "close")]
    quotients = F.array_compact(F.array(*[F.when(F.col(f"_o_{f}") == "MISMATCH_VALUE", ratio(F.col(f"_r_{f}"), F.col(f"_l_{f}"))) for f in prices]))
    both = both.withColumn("_q", quotients)
    same = (F.size("_q") >= 3) & ((F.array_max("_q") - F.array_min("_q")) / F.greatest(F.abs(F.array_max("_q")), F.lit(1e-12)) < 1e-3)
    cells = F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.col(f"_l_{f}").alias("left_value"), F.col(f"_r_{f}").alias("right_value"),
            (F.when(same & (F.col(f"_o_{f}") == "MISMATCH_VALUE"), "MISMATCH_ADJUSTMENT").otherwise(F.col(f"_o_{f}")) if f in prices else F.col(f"_o_{f}")).alias("outcome"),
        )
        for f in fields
    ])
    return both.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.*")


def fill_patches(reconciled: DataFrame) -> DataFrame:
    """Proposals: the primary side wins; only its missing values may be filled from the other."""
    decision = (
        F.when(F.col("outcome") == "MATCH", None)
        .when((F.col("outcome") == "MISSING_LEFT") & F.col("right_value").isNotNull(), "APPROVED_FILL")
        .otherwise("KEEP_PRIMARY")
    )
    return reconciled.withColumn("decision", decision).where("decision is not null")


def bars_from_ticks(ticks: DataFrame, ts: str, price: str, size: str, order: str) -> DataFrame:
    """Daily bars from trades inside exchange phases; other phases are excluded and counted."""
    phase = session_phase(minute_of_day(F.col(ts)))
    inside = ~phase.isin(*OUTSIDE_DAILY_BAR)
    t = ticks.select("symbol", F.to_date(ts).alias("trade_date"), inside.alias("_in"), F.col(order).alias("_o"), F.col(price).alias("_p"), F.col(size).alias("_s"))
    p = F.when(F.col("_in"), F.col("_p"))
    k = F.when(F.col("_in"), F.col("_o"))
    return t.groupBy("symbol", "trade_date").agg(
        count_if(F.col("_in")).alias("events"), F.min_by(p, k).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, k).alias("close"),
        F.sum(F.when(F.col("_in"), F.col("_s"))).alias("volume"), F.sum(F.when(F.col("_in"), F.col("_p") * F.col("_s"))).alias("amount"),
        count_if(~F.col("_in")).alias("excluded"),
    )


def event_checks(events: DataFrame, symbol: str, ts: str, sequence: str, price: str, size: str, classes: str, known: tuple[str, ...]) -> DataFrame:
    """All stream-integrity checks in one wide aggregate, then one verdict row per check.

    Neighbouring rows come from ``previous_value``, so a symbol with a third of all events is
    read in day-sized pieces.
    """
    work = previous_value(
        events.withColumn("_pair", F.struct(F.col(ts).alias("t"), F.col(sequence).alias("s"))), [symbol], [sequence],
        F.floor(F.col(sequence) / 65536), "_pair", "_prev",
    )
    back = F.unix_micros(F.col("_prev.t")) - F.unix_micros(ts)
    gap = F.col(sequence) - F.col("_prev.s") - 1
    phase = session_phase(minute_of_day(F.col(ts)))
    n = F.count(F.lit(1))
    repeated = events.groupBy(sequence).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c") - 1)), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("_distinct")
    )
    facts = work.agg(
        n.alias("_n"), count_if(back > 0).alias("regressions"), F.coalesce(F.max(F.when(back > 1_000_000, 1)), F.lit(0)).alias("_severe"),
        F.coalesce(F.sum(F.when(gap > 0, gap)), F.lit(0)).alias("gaps"), F.min(sequence).alias("_lo"), F.max(sequence).alias("_hi"),
        count_if(~F.coalesce(F.col(price) > 0, F.lit(False))).alias("bad_prices"), count_if(F.col(size) < 0).alias("bad_sizes"),
        count_if(phase.isin("lunch", "closed")).alias("outside"), count_if(phase == "post_close").alias("post"),
        count_if(~F.coalesce(F.col(classes).isin(*known), F.lit(False))).alias("unknown_class"), F.count_distinct(classes).alias("_classes"),
    ).crossJoin(F.broadcast(repeated))  # one row

    def verdict(name: str, count: Column, status: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), count.cast("long").alias("findings"), status.alias("status"))

    rows = F.array(
        verdict("timestamp_monotonic", F.col("regressions"), F.when(F.col("_severe") > 0, FAIL).when(F.col("regressions") > 0, WARN).otherwise(PASS)),
        verdict("duplicate_events", F.col("duplicates"), F.when(F.col("duplicates") > 0, FAIL).otherwise(PASS)),
        verdict("sequence_gaps", F.col("gaps"), F.when(F.col("gaps") > 0, WARN).otherwise(PASS)),
        verdict("manufactured_ids", F.when((F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1) & (F.col("_distinct") == F.col("_n")), F.col("_n")).otherwise(0),
                F.when((F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1) & (F.col("_distinct") == F.col("_n")), FAIL).otherwise(PASS)),
        verdict("price_sanity", F.col("bad_prices"), F.when(F.col("bad_prices") > 0, FAIL).otherwise(PASS)),
        verdict("volume_sanity", F.col("bad_sizes"), F.when(F.col("bad_sizes") > 0, FAIL).otherwise(PASS)),
        verdict("session_boundaries", F.col("outside") + F.col("post"), F.when(F.col("outside") > 0, FAIL).when(F.col("post") > 0, WARN).otherwise(PASS)),
        verdict("declared_semantics", F.col("unknown_class"), F.when(F.col("unknown_class") > 0, FAIL).when(F.col("_classes") > 1, WARN).otherwise(PASS)),
    )
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def usable(checks: DataFrame) -> DataFrame:
    """A table is usable only if nothing failed and nothing was skipped."""
    bad = count_if(F.col("status").isin(FAIL, NOT_RUN))
    return checks.agg(F.count(F.lit(1)).alias("checks"), bad.alias("blocking"), (bad == 0).alias("usable"))


def cumulative_regressions(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows where a running total falls inside its session."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous"))


def book_disorder(df: DataFrame, bids: str, asks: str) -> DataFrame:
    """Snapshots whose bids do not fall, asks do not rise, or that are crossed — array functions only."""
    b, a = F.col(bids), F.col(asks)
    fall = F.exists(F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), lambda x, y: y >= x), lambda v: v)
    rise = F.exists(F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: y <= x), lambda v: v)
    return df.withColumns({"bid_disorder": fall, "ask_disorder": rise, "crossed": F.get(b, F.lit(0)) >= F.get(a, F.lit(0))})


def gates(df: DataFrame, rules: dict[str, tuple[Column, str, float]]) -> DataFrame:
    """One aggregate, one row per gate: value, bound and PASS / FAIL / UNKNOWN (value missing)."""
    facts = df.agg(*[c.cast("double").alias(f"_{i}") for i, (c, _, _) in enumerate(rules.values())])
    cells = []
    for i, (name, (_, op, bound)) in enumerate(rules.items()):
        v = F.col(f"_{i}")
        ok = (v >= bound) if op == ">=" else (v <= bound)
        cells.append(F.struct(F.lit(name).alias("gate"), v.alias("value"), F.lit(float(bound)).alias("bound"),
                              F.when(v.isNull(), "UNKNOWN").when(ok, PASS).otherwise(FAIL).alias("status")))
    return facts.select(F.explode(F.array(*cells)).alias("g")).select("g.*")
