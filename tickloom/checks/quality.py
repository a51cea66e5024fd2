"""Integrity, reconciliation and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.checks.panels import PANEL_SQL, factor_panel, rk
from tickloom.checks.registry import query
from tickloom.functions.columns import count_if, tidy
from tickloom.operators import evaluate as E
from tickloom.operators import pit
from tickloom.operators import quality as Q
from tickloom.plans.inputs import BARS_SQL, TICKS_SQL, bars, table, ticks, tidy_sql

RAW_SQL = """raw AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS close, l_extendedprice / l_quantity * (1 + l_tax) AS high,
  l_extendedprice / l_quantity * (1 - l_discount) AS low, l_extendedprice / l_quantity * (1 + l_tax - l_discount) AS open, l_quantity - 2 AS volume, l_extendedprice AS amount, l_orderkey, l_linenumber FROM lineitem)"""
FLAGS_SQL = """tagged AS (SELECT symbol, trade_date, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY symbol, trade_date) > 1 AS duplicate_key, false AS bad_price, volume < 0 OR amount < 0 AS negative_flow,
  high < low AS high_below_low, greatest(open, close) > high OR least(open, close) < low AS body_outside_range FROM raw)"""
RULES = ["duplicate_key", "bad_price", "negative_flow", "high_below_low", "body_outside_range"]


def raw_rows(spark, root):
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), p.alias("close"), (p * (1 + F.col("l_tax"))).alias("high"),
        (p * (1 - F.col("l_discount"))).alias("low"), (p * (1 + F.col("l_tax") - F.col("l_discount"))).alias("open"), (F.col("l_quantity") - 2).alias("volume"),
        F.col("l_extendedprice").alias("amount"), "l_orderkey", "l_linenumber",
    )


@query("integrity_quarantine", f"""WITH {RAW_SQL}, {FLAGS_SQL}, v AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {r} THEN '{r}' END" for r in RULES)}) AS violations FROM tagged)
SELECT symbol, trade_date, l_orderkey, l_linenumber, violations FROM v WHERE violations <> ''""")
def integrity_quarantine(spark, root):
    tagged = Q.tag_integrity(raw_rows(spark, root), ["symbol", "trade_date"], Q.ohlcv_rules())
    return tagged.where("violations <> ''").select("symbol", "trade_date", "l_orderkey", "l_linenumber", "violations")


@query("integrity_report", f"""WITH {RAW_SQL}, {FLAGS_SQL} {' UNION ALL '.join(f"SELECT '{r}' AS rule, count(*) FILTER ({r}) AS rows FROM tagged" for r in RULES)}""")
def integrity_report(spark, root):
    return Q.violation_report(Q.tag_integrity(raw_rows(spark, root), ["symbol", "trade_date"], Q.ohlcv_rules()), RULES)


@query("expected_key_gaps", f"""WITH {BARS_SQL}, cal AS (SELECT DISTINCT trade_date FROM bars) SELECT s_suppkey AS symbol, trade_date FROM supplier CROSS JOIN cal
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s_suppkey AND b.trade_date = cal.trade_date)""")
def expected_key_gaps(spark, root):
    b = bars(spark, root).select("symbol", "trade_date")
    return Q.expected_key_gaps(b, table(spark, root, "supplier").select(F.col("s_suppkey").alias("symbol")), b.select("trade_date").distinct())


@query("session_gap_classes", f"""WITH {BARS_SQL}, cal AS (SELECT DISTINCT trade_date FROM bars), life AS (SELECT symbol, min(trade_date) AS a, max(trade_date) AS z FROM bars GROUP BY 1),
halts AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 30 AS e FROM orders WHERE o_orderpriority = '5-LOW')
SELECT gap, count(*) AS rows FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM halts h WHERE h.symbol = s_suppkey AND c.trade_date BETWEEN h.s AND h.e) THEN 'SUSPENDED'
  WHEN c.trade_date < l.a OR c.trade_date > l.z THEN 'PROVIDER_HISTORY_TRUNCATED' ELSE 'MISSING_UNEXPLAINED' END AS gap
  FROM supplier CROSS JOIN cal c LEFT JOIN life l ON l.symbol = s_suppkey WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s_suppkey AND b.trade_date = c.trade_date)) GROUP BY gap""")
def session_gap_classes(spark, root):
    b = bars(spark, root).select("symbol", "trade_date")
    life = b.groupBy("symbol").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z"))
    gaps = Q.expected_key_gaps(b, table(spark, root, "supplier").select(F.col("s_suppkey").alias("symbol")), b.select("trade_date").distinct())
    d = F.to_date("o_orderdate")
    halts = table(spark, root, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("symbol"), d.alias("s"), F.date_add(d, 30).alias("e"))
    g = pit.in_intervals(gaps, halts, "symbol", "trade_date", "s", "e", "halted").join(life, "symbol", "left")
    outside = (F.col("trade_date") < F.col("a")) | (F.col("trade_date") > F.col("z"))
    kind = F.when(F.col("halted"), "SUSPENDED").when(outside, "PROVIDER_HISTORY_TRUNCATED").otherwise("MISSING_UNEXPLAINED")
    return g.groupBy(kind.alias("gap")).agg(F.count(F.lit(1)).alias("rows"))


@query("provider_boundaries", """WITH d AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, min(l_linestatus) AS provider FROM lineitem GROUP BY ALL)
SELECT * FROM (SELECT *, lag(provider) OVER (PARTITION BY symbol ORDER BY trade_date) AS previous FROM d) WHERE previous <> provider""")
def provider_boundaries(spark, root):
    d = table(spark, root, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date")).agg(F.min("l_linestatus").alias("provider"))
    return Q.provider_changes(d, "symbol", "trade_date", "provider")


@query("coverage_by_symbol", f"""WITH {PANEL_SQL} SELECT symbol, count(*) AS rows, min(trade_date) AS first_date, max(trade_date) AS last_date, round(avg((mom IS NOT NULL)::INT), 6) AS factor_ratio,
  count(*) FILTER (mom IS NOT NULL AND fwd5 IS NOT NULL) AS pairs FROM panel GROUP BY symbol""")
def coverage_by_symbol(spark, root):
    p = factor_panel(spark, root)
    return p.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        F.round(F.avg(F.col("mom").isNotNull().cast("int")), 6).alias("factor_ratio"), count_if(F.col("mom").isNotNull() & F.col("fwd5").isNotNull()).alias("pairs"))


OTHER_SQL = f"""{BARS_SQL}, other AS (SELECT symbol, trade_date, close * k AS close, open * k AS open, high * k AS high, low * k AS low, CASE WHEN symbol % 7 = 1 THEN volume * 100 ELSE volume END AS volume
  FROM (SELECT *, CASE WHEN symbol % 5 = 2 THEN 1.5 ELSE 1.0 END AS k FROM bars) WHERE dayofmonth(trade_date) <> 13),
j AS (SELECT symbol, trade_date, b.symbol IS NULL AS no_l, o.symbol IS NULL AS no_r, symbol % 5 = 2 AS adj, symbol % 7 = 1 AS lot, b.close AS bc, o.close AS oc, b.volume AS bv, o.volume AS ov
  FROM (SELECT * FROM bars WHERE dayofmonth(trade_date) <> 20) b FULL OUTER JOIN other o USING (symbol, trade_date))"""


def reconciled(spark, root):
    b = bars(spark, root)
    k = F.when(F.col("symbol") % 5 == 2, 1.5).otherwise(1.0)
    other = b.where(F.dayofmonth("trade_date") != 13).withColumns({c: F.col(c) * k for c in ("open", "high", "low", "close")} | {"volume": F.when(F.col("symbol") % 7 == 1, F.col("volume") * 100).otherwise(F.col("volume"))})
    return Q.reconcile(b.where(F.dayofmonth("trade_date") != 20), other, ["symbol", "trade_date"], {"open": 1e-4, "high": 1e-4, "low": 1e-4, "close": 1e-4, "volume": 1e-6})


@query("panel_reconcile", f"""WITH {OTHER_SQL}, o AS (SELECT 'volume' AS field, CASE WHEN no_l THEN 'MISSING_LEFT' WHEN no_r THEN 'MISSING_RIGHT' WHEN lot THEN 'MISMATCH_UNIT' ELSE 'MATCH' END AS outcome FROM j
UNION ALL SELECT f, CASE WHEN no_l THEN 'MISSING_LEFT' WHEN no_r THEN 'MISSING_RIGHT' WHEN adj THEN 'MISMATCH_ADJUSTMENT' ELSE 'MATCH' END FROM j, (SELECT unnest(['open', 'high', 'low', 'close']) AS f))
SELECT field, outcome, count(*) AS rows FROM o GROUP BY ALL""")
def panel_reconcile(spark, root):
    return reconciled(spark, root).groupBy("field", "outcome").agg(F.count(F.lit(1)).alias("rows"))


@query("patch_proposals", f"""WITH {OTHER_SQL} SELECT symbol, trade_date, field, CASE WHEN no_l THEN 'APPROVED_FILL' ELSE 'KEEP_PRIMARY' END AS decision
FROM j, (SELECT unnest(['open', 'high', 'low', 'close', 'volume']) AS field) WHERE no_l OR no_r OR CASE WHEN field = 'volume' THEN lot ELSE adj END""")
def patch_proposals(spark, root):
    return Q.fill_patches(reconciled(spark, root)).select("symbol", "trade_date", "field", "decision")


PHASE_SQL = """CASE WHEN m >= 555 AND m < 565 THEN 'opening_auction' WHEN m >= 565 AND m < 570 THEN 'pre_open' WHEN m >= 570 AND m < 690 THEN 'morning' WHEN m >= 690 AND m < 780 THEN 'lunch'
 WHEN m >= 780 AND m < 897 THEN 'afternoon' WHEN m >= 897 AND m < 900 THEN 'closing_auction' WHEN m >= 900 AND m < 930 THEN 'post_close' ELSE 'closed' END"""
PHASED_SQL = f"{TICKS_SQL}, ph AS (SELECT *, {PHASE_SQL} AS phase FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM ticks))"


@query("session_phases", f"WITH {PHASED_SQL} SELECT phase, count(*) AS events FROM ph GROUP BY phase")
def session_phases(spark, root):
    return ticks(spark, root).groupBy(Q.session_phase(Q.minute_of_day(F.col("ts"))).alias("phase")).agg(F.count(F.lit(1)).alias("events"))


TICKBAR_SQL = f"""{PHASED_SQL}, i AS (SELECT *, CAST(ts AS DATE) AS trade_date, phase NOT IN ('lunch', 'closed', 'post_close', 'pre_open') AS ok FROM ph),
tb AS (SELECT symbol, trade_date, count(*) FILTER (ok) AS events, arg_min(price, event_id) FILTER (ok) AS open, max(price) FILTER (ok) AS high, min(price) FILTER (ok) AS low, arg_max(price, event_id) FILTER (ok) AS close,
 sum(size) FILTER (ok) AS volume, sum(price * size) FILTER (ok) AS amount, count(*) FILTER (NOT ok) AS excluded FROM i GROUP BY ALL)"""


@query("daily_bars_from_ticks", f"WITH {TICKBAR_SQL} SELECT symbol, trade_date, events, open, high, low, close, {tidy_sql('volume')} AS volume, {tidy_sql('amount')} AS amount, excluded FROM tb")
def daily_bars_from_ticks(spark, root):
    return Q.bars_from_ticks(ticks(spark, root), "ts", "price", "size", "event_id").withColumns({"volume": tidy(F.col("volume")), "amount": tidy(F.col("amount"))})


@query("tick_daily_reconcile", f"""WITH {TICKBAR_SQL}, d AS (SELECT symbol, CAST(ts AS DATE) AS trade_date, max(price) AS high, min(price) AS low, count(*) AS events FROM ticks GROUP BY ALL)
SELECT symbol, trade_date, CASE WHEN tb.events = 0 THEN 'NO_TICKS' WHEN abs(tb.high - d.high) <= 1e-4 * d.high AND abs(tb.low - d.low) <= 1e-4 * d.low THEN 'MATCH' WHEN tb.high <= d.high AND tb.low >= d.low THEN 'EXTREMES_NOT_SEEN' ELSE 'MISMATCH' END AS verdict
FROM d JOIN tb USING (symbol, trade_date)""")
def tick_daily_reconcile(spark, root):
    t = ticks(spark, root)
    d = t.groupBy("symbol", F.to_date("ts").alias("trade_date")).agg(F.max("price").alias("dh"), F.min("price").alias("dl"))
    j = d.join(Q.bars_from_ticks(t, "ts", "price", "size", "event_id"), ["symbol", "trade_date"])
    match = (F.abs(F.col("high") - F.col("dh")) <= 1e-4 * F.col("dh")) & (F.abs(F.col("low") - F.col("dl")) <= 1e-4 * F.col("dl"))
    inside = (F.col("high") <= F.col("dh")) & (F.col("low") >= F.col("dl"))
    return j.select("symbol", "trade_date", F.when(F.col("events") == 0, "NO_TICKS").when(match, "MATCH").when(inside, "EXTREMES_NOT_SEEN").otherwise("MISMATCH").alias("verdict"))


@query("event_integrity_checks", f"""WITH {PHASED_SQL}, l AS (SELECT *, epoch_us(lag(ts) OVER w) - epoch_us(ts) AS back, event_id - lag(event_id) OVER w - 1 AS gap FROM ph WINDOW w AS (PARTITION BY symbol ORDER BY event_id)),
f AS (SELECT count(*) AS n, count(*) FILTER (back > 0) AS reg, count(*) FILTER (back > 1000000) AS sev, coalesce(sum(gap) FILTER (gap > 0), 0) AS gaps, min(event_id) = 0 AND max(event_id) = count(*) - 1 AND count(DISTINCT event_id) = count(*) AS made,
 count(*) - count(DISTINCT event_id) AS dup, count(*) FILTER (NOT price > 0) AS bp, count(*) FILTER (size < 0) AS bs, count(*) FILTER (phase IN ('lunch', 'closed')) AS out, count(*) FILTER (phase = 'post_close') AS post, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'signup')) AS unk, count(DISTINCT event_type) AS cls FROM l)
SELECT c AS "check", v::BIGINT AS findings, s AS status FROM f, LATERAL (VALUES ('timestamp_monotonic', reg, CASE WHEN sev > 0 THEN 'FAIL' WHEN reg > 0 THEN 'WARN' ELSE 'PASS' END), ('duplicate_events', dup, CASE WHEN dup > 0 THEN 'FAIL' ELSE 'PASS' END),
 ('sequence_gaps', gaps, CASE WHEN gaps > 0 THEN 'WARN' ELSE 'PASS' END), ('manufactured_ids', CASE WHEN made THEN n ELSE 0 END, CASE WHEN made THEN 'FAIL' ELSE 'PASS' END), ('price_sanity', bp, CASE WHEN bp > 0 THEN 'FAIL' ELSE 'PASS' END),
 ('volume_sanity', bs, CASE WHEN bs > 0 THEN 'FAIL' ELSE 'PASS' END), ('session_boundaries', out + post, CASE WHEN out > 0 THEN 'FAIL' WHEN post > 0 THEN 'WARN' ELSE 'PASS' END), ('declared_semantics', unk, CASE WHEN unk > 0 THEN 'FAIL' WHEN cls > 1 THEN 'WARN' ELSE 'PASS' END)) t(c, v, s)""")
def event_integrity_checks(spark, root):
    return Q.event_checks(ticks(spark, root), "symbol", "ts", "event_id", "price", "size", "event_type", ("click", "view", "purchase", "signup"))


@query("cumulative_regressions", f"""WITH {TICKS_SQL}, c AS (SELECT symbol, CAST(ts AS DATE) AS d, ts, event_id, size, lag(size) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY event_id) AS previous FROM ticks)
SELECT symbol, event_id, size, previous FROM c WHERE size < previous""")
def cumulative_regressions(spark, root):
    t = ticks(spark, root).withColumn("d", F.to_date("ts"))
    return Q.cumulative_regressions(t, ["symbol", "d"], "event_id", "size").select("symbol", "event_id", "size", "previous")


@query("book_ordering", """WITH b AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: round(x::DOUBLE, 6)) AS bids, list_transform(embedding[6:10], lambda x: round(x::DOUBLE, 6)) AS asks FROM embeddings)
SELECT vec_id, bids[2] >= bids[1] OR bids[3] >= bids[2] OR bids[4] >= bids[3] OR bids[5] >= bids[4] AS bid_disorder, asks[2] <= asks[1] OR asks[3] <= asks[2] OR asks[4] <= asks[3] OR asks[5] <= asks[4] AS ask_disorder, bids[1] >= asks[1] AS crossed FROM b""")
def book_ordering(spark, root):
    e = table(spark, root, "embeddings")
    five = lambda i: F.transform(F.slice("embedding", i, 5), lambda x: F.round(x.cast("double"), 6))
    return Q.book_disorder(e.select("vec_id", five(1).alias("bids"), five(6).alias("asks")), "bids", "asks").drop("bids", "asks")


@query("receive_delay_percentiles", """WITH d AS (SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6 AS lag_days FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT round(quantile_cont(lag_days, 0.5), 6) AS p50, round(quantile_cont(lag_days, 0.95), 6) AS p95, round(quantile_cont(lag_days, 0.99), 6) AS p99, round(max(lag_days), 6) AS worst, count(*) FILTER (lag_days < 0) AS negative FROM d""")
def receive_delay_percentiles(spark, root):
    from tickloom.operators.quantiles import exact_quantiles

    j = table(spark, root, "lineitem").join(table(spark, root, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = j.select((F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).cast("double").alias("lag_days"))
    q = exact_quantiles(d, [], "lag_days", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    rest = d.agg(F.max("lag_days").alias("worst"), count_if(F.col("lag_days") < 0).alias("negative"))
    return q.select(*(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99"))).crossJoin(rest)  # one row each


@query("data_quality_gates", f"""WITH {PANEL_SQL}, f AS (SELECT count(*) AS r, count(DISTINCT symbol) AS s, count(DISTINCT trade_date) AS d, avg((mom IS NULL)::INT) AS nulls, sum((trade_date > DATE '2001-10-01')::INT) AS late FROM panel)
SELECT g AS gate, v::DOUBLE AS value, b::DOUBLE AS bound, CASE WHEN o = 1 AND v >= b OR o = 0 AND v <= b THEN 'PASS' ELSE 'FAIL' END AS status FROM f, LATERAL (VALUES ('min_rows', r, 1000, 1), ('min_symbols', s, 100, 1), ('min_dates', d, 3000, 1), ('null_ratio', round(nulls, 6), 0.2, 0), ('pit_violations', late, 0, 0)) t(g, v, b, o)""")
def data_quality_gates(spark, root):
    return Q.gates(factor_panel(spark, root), {
        "min_rows": (F.count(F.lit(1)), ">=", 1000), "min_symbols": (F.count_distinct("symbol"), ">=", 100), "min_dates": (F.count_distinct("trade_date"), ">=", 3000),
        "null_ratio": (F.round(F.avg(F.col("mom").isNull().cast("int")), 6), "<=", 0.2), "pit_violations": (F.sum((F.col("trade_date") > F.lit("2001-10-01").cast("date")).cast("int")), "<=", 0),
    })


@query("label_alignment_audit", f"""WITH {BARS_SQL}, l AS (SELECT symbol, trade_date, trade_date + CAST(symbol % 3 AS INT) AS available, lead(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS entry FROM bars)
SELECT count(*) AS rows, count(*) FILTER (entry IS NULL) AS not_auditable, count(*) FILTER (available > entry) AS violations FROM l""")
def label_alignment_audit(spark, root):
    """A row must be available by the opening of its own label window; rows without one are not auditable."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    l = bars(spark, root).select(F.date_add("trade_date", (F.col("symbol") % 3).cast("int")).alias("available"), F.lead("trade_date").over(w).alias("entry"))
    return l.agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("entry").isNull()).alias("not_auditable"), count_if(F.col("available") > F.col("entry")).alias("violations"))


@query("survivorship_audit", f"""WITH {BARS_SQL}, m AS (SELECT s_suppkey AS symbol, CASE WHEN s_acctbal < 0 THEN 'delisted' WHEN s_acctbal < 1000 THEN 'unknown' ELSE 'listed' END AS status FROM supplier)
SELECT status, count(DISTINCT m.symbol) AS symbols, count(b.symbol) AS rows FROM m LEFT JOIN bars b ON b.symbol = m.symbol GROUP BY status""")
def survivorship_audit(spark, root):
    status = F.when(F.col("s_acctbal") < 0, "delisted").when(F.col("s_acctbal") < 1000, "unknown").otherwise("listed")
    m = table(spark, root, "supplier").select(F.col("s_suppkey").alias("symbol"), status.alias("status"))
    per = bars(spark, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return m.join(per, "symbol", "left").groupBy("status").agg(F.count_distinct("symbol").alias("symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query("adverse_regime_ic", f"""WITH {PANEL_SQL}, d AS (SELECT trade_date, round(avg(fwd5), 10) AS m FROM panel GROUP BY 1), c AS (SELECT quantile_cont(m, 0.25) AS q FROM d),
bad AS (SELECT trade_date FROM d, c WHERE m <= q), k AS (SELECT trade_date, {rk('mom', 'trade_date')} AS a, {rk('fwd5', 'trade_date')} AS b FROM panel SEMI JOIN bad USING (trade_date) WHERE mom IS NOT NULL AND fwd5 IS NOT NULL),
i AS (SELECT trade_date, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS ic FROM k GROUP BY 1)
SELECT count(*) AS dates, {tidy_sql("avg(ic)")} AS mean_ic FROM i WHERE ic IS NOT NULL""")
def adverse_regime_ic(spark, root):
    p = factor_panel(spark, root)
    d = p.groupBy("trade_date").agg(F.round(F.avg("fwd5"), 10).alias("m"))
    cut = d.agg(F.percentile("m", F.lit(0.25)).alias("q"))  # one value per session
    bad = d.crossJoin(F.broadcast(cut)).where("m <= q").select("trade_date")
    ic = E.ic_by_date(p.join(bad, "trade_date", "left_semi"), "mom", "fwd5").where("ic is not null")
    return ic.agg(F.count(F.lit(1)).alias("dates"), tidy(F.avg("ic")).alias("mean_ic"))


@query("daily_health", f"""WITH {PANEL_SQL}, d AS (SELECT trade_date, count(*) AS rows, avg((mom IS NULL)::INT) AS nulls FROM panel GROUP BY 1)
SELECT trade_date, rows, round(nulls, 6) AS null_ratio, rows < 0.5 * avg(rows) OVER (ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS thin, nulls > 0.1 AS sparse FROM d""")
def daily_health(spark, root):
    w = Window.orderBy("trade_date").rowsBetween(-20, -1)  # one row per session
    d = factor_panel(spark, root).groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.col("mom").isNull().cast("int")), 6).alias("null_ratio"))
    return d.select("trade_date", "rows", "null_ratio", (F.col("rows") < 0.5 * F.avg("rows").over(w)).alias("thin"), (F.col("null_ratio") > 0.1).alias("sparse"))


@query("target_liveness", f"""WITH {PANEL_SQL}, t AS (SELECT trade_date, sum(abs(w)) AS gross, count(*) FILTER (abs(w) > 1e-9) AS live FROM (SELECT trade_date, CASE WHEN vlm > 0.95 AND dayofmonth(trade_date) > 3 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS w FROM panel) GROUP BY 1),
p AS (SELECT trade_date, count(mom) AS predictions FROM panel WHERE year(trade_date) < 2001 GROUP BY 1)
SELECT trade_date, round(coalesce(gross, 0)::DOUBLE, 6) + 0.0 AS gross, coalesce(live, 0) AS live, coalesce(predictions, 0) AS predictions, CASE WHEN coalesce(live, 0) > 0 THEN NULL WHEN coalesce(predictions, 0) = 0 THEN 'no_predictions' ELSE 'all_weights_zero' END AS reason FROM t FULL OUTER JOIN p USING (trade_date)""")
def target_liveness(spark, root):
    from tickloom.operators.portfolio import target_liveness as op

    p = factor_panel(spark, root)
    weights = p.select("symbol", "trade_date", F.when((F.col("vlm") > 0.95) & (F.dayofmonth("trade_date") > 3), 0.05).otherwise(0.0).alias("weight"))
    return op(weights, p.where(F.year("trade_date") < 2001), "mom")


@query("universe_drift", """SELECT coalesce(a.k, b.k) AS symbol, CASE WHEN a.k IS NULL THEN 'only_bars' WHEN b.k IS NULL THEN 'only_master' ELSE 'both' END AS presence FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') b ON a.k = b.k""")
def universe_drift(spark, root):
    a = table(spark, root, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("symbol"), F.lit(1).alias("a"))
    b = table(spark, root, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("symbol")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "symbol", "full_outer").select("symbol", F.when(F.col("a").isNull(), "only_bars").when(F.col("b").isNull(), "only_master").otherwise("both").alias("presence"))


@query("adjustment_forensics", f"""WITH {BARS_SQL}, ex AS (SELECT DISTINCT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS trade_date FROM orders), r AS (SELECT symbol, trade_date, open / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS gap FROM bars)
SELECT symbol, count(*) AS ex_dates, count(*) FILTER (gap < -0.03) AS gapped, CASE WHEN count(*) FILTER (gap < -0.03) * 2 >= count(*) THEN 'RAW' ELSE 'ADJUSTED_OR_MIXED' END AS verdict FROM r SEMI JOIN ex USING (symbol, trade_date) WHERE gap IS NOT NULL GROUP BY symbol""")
def adjustment_forensics(spark, root):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    ex = table(spark, root, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("trade_date"))
    r = bars(spark, root).select("symbol", "trade_date", (F.col("open") / F.lag("close").over(w) - 1).alias("gap")).where("gap is not null")
    g = r.join(ex, ["symbol", "trade_date"], "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("ex_dates"), count_if(F.col("gap") < -0.03).alias("gapped"))
    return g.withColumn("verdict", F.when(F.col("gapped") * 2 >= F.col("ex_dates"), "RAW").otherwise("ADJUSTED_OR_MIXED"))
