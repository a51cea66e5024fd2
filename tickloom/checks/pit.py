"""Point-in-time joins, identities and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.checks.registry import query
from tickloom.functions.columns import tidy
from tickloom.functions.symbols import board_of, canonical_symbol, code_of, exchange_of
from tickloom.operators import islands, pit
from tickloom.plans.inputs import (
    BARS_SQL, SECTORS_SQL, STATEMENTS_SQL, TICKS_SQL, bars, listing_code, sectors, statements, table, ticks, tidy_sql,
)

ASOF_SQL = "ASOF LEFT JOIN statements s ON b.symbol = s.symbol AND b.trade_date + INTERVAL 15 HOUR >= s.available_at"


@query("asof_statements", f"""WITH {BARS_SQL}, {STATEMENTS_SQL}
SELECT b.symbol, b.trade_date, b.close, s.revenue, s.orders, s.report_period
FROM bars b {ASOF_SQL}""")
def asof_statements(spark, root):
    left = bars(spark, root).select("symbol", "trade_date", "close").withColumn("decided_at", pit.decision_time(F.col("trade_date")))
    right = statements(spark, root).select("symbol", "available_at", "revenue", "orders", "report_period")
    return pit.asof_join(left, right, ["symbol"], "decided_at", "available_at").drop("decided_at")


@query("asof_bucketed_ticks", f"""WITH {TICKS_SQL},
buys AS (SELECT symbol, ts AS bought_at, price AS buy_price, event_id AS buy_id FROM ticks WHERE event_type = 'purchase')
SELECT t.symbol, t.event_id, t.ts, b.buy_price, b.buy_id, b.bought_at
FROM ticks t ASOF LEFT JOIN buys b ON t.symbol = b.symbol AND t.ts >= b.bought_at""")
def asof_bucketed_ticks(spark, root):
    """Ticks of one user are unbounded, so the as-of also cuts by day and carries across days."""
    t = ticks(spark, root)
    buys = t.where("event_type = 'purchase'").select(
        "symbol", F.col("ts").alias("bought_at"), F.col("price").alias("buy_price"), F.col("event_id").alias("buy_id")
    )
    left = t.select("symbol", "event_id", "ts")
    return pit.asof_join(left, buys, ["symbol"], "ts", "bought_at", keep_time=True, bucket="day", order_ties=["buy_id"])


@query("asof_suffix_and_missing_flag", f"""WITH {BARS_SQL}, {STATEMENTS_SQL}
SELECT b.symbol, b.trade_date, b.volume AS orders, s.revenue, s.orders AS orders_fund,
       CAST(s.symbol IS NULL AS INT) AS missing_fund
FROM bars b {ASOF_SQL.replace(" + INTERVAL 15 HOUR", "")}""")
def asof_suffix(spark, root):
    base = bars(spark, root).select("symbol", "trade_date", F.col("volume").alias("orders"))
    extra = statements(spark, root).select("symbol", "available_at", "revenue", "orders")
    return pit.asof_suffixed(base, extra, ["symbol"], "trade_date", "available_at", "_fund", "missing_fund")


@query("asof_market_series", f"""WITH {BARS_SQL},
macro AS (SELECT CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS available_at,
  round(sum(o_totalprice), 2) AS turnover, count(*) AS orders FROM orders GROUP BY 1)
SELECT b.symbol, b.trade_date, m.turnover AS macro_turnover, m.orders AS macro_orders
FROM bars b ASOF LEFT JOIN macro m ON b.trade_date >= m.available_at""")
def asof_market(spark, root):
    month = F.trunc(F.to_date("o_orderdate"), "month")
    macro = table(spark, root, "orders").groupBy(F.date_add(F.add_months(month, 1), 14).alias("available_at")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("turnover"), F.count(F.lit(1)).alias("orders")
    )
    return pit.asof_market_series(bars(spark, root).select("symbol", "trade_date"), macro, "trade_date", "available_at", "macro_")


@query("latest_visible_statement", f"""WITH {STATEMENTS_SQL}
SELECT symbol, report_period, revenue, available_at FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) AS rn FROM statements
  WHERE available_at <= TIMESTAMP '1998-06-30 15:00:00') WHERE rn = 1""")
def latest_visible_statement(spark, root):
    as_of = F.lit("1998-06-30 15:00:00").cast("timestamp")
    rows = pit.latest_visible(statements(spark, root), as_of, ["symbol"], "available_at", [F.desc("report_period")])
    return rows.select("symbol", "report_period", "revenue", "available_at")


@query("visible_only", f"""WITH {STATEMENTS_SQL}
SELECT symbol, report_period, available_at FROM statements WHERE available_at <= TIMESTAMP '1997-01-15 00:00:00'""")
def visible_only(spark, root):
    s = statements(spark, root).select("symbol", "report_period", "available_at")
    return s.where(F.col("available_at").isNotNull() & (F.col("available_at") <= F.lit("1997-01-15").cast("timestamp")))


def _quarter_sums(spark, root, cond, name):
    end = F.date_sub(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 3), 1)
    return table(spark, root, "orders").where(cond).groupBy(F.col("o_custkey").alias("symbol"), end.alias("report_period")).agg(
        F.round(F.sum("o_totalprice"), 2).alias(name), F.count(F.lit(1)).alias("rows")
    )


@query("statement_full_outer_merge", """WITH q AS (SELECT o_custkey AS symbol,
  CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_period, o_totalprice, o_orderstatus FROM orders),
a AS (SELECT symbol, report_period, round(sum(o_totalprice), 2) AS income, count(*) AS rows FROM q WHERE o_orderstatus = 'F' GROUP BY ALL),
b AS (SELECT symbol, report_period, round(sum(o_totalprice), 2) AS backlog, count(*) AS rows FROM q WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT symbol, report_period, a.income, b.backlog, coalesce(a.rows, b.rows) AS rows,
  CASE WHEN b.symbol IS NULL THEN 'left_only' WHEN a.symbol IS NULL THEN 'right_only' ELSE 'both' END AS presence
FROM a FULL OUTER JOIN b USING (symbol, report_period)""")
def statement_full_outer_merge(spark, root):
    from tickloom.operators.fundamentals import merge_statements

    a = _quarter_sums(spark, root, "o_orderstatus = 'F'", "income")
    b = _quarter_sums(spark, root, "o_orderstatus = 'O'", "backlog")
    return merge_statements(a, b, ["symbol", "report_period"], coalesce=["rows"], presence="presence")


@query("next_trading_session", f"""WITH {BARS_SQL}, {STATEMENTS_SQL}, cal AS (SELECT DISTINCT trade_date AS session FROM bars),
t AS (SELECT symbol, report_period, CAST(available_at AS DATE) + 1 AS target FROM statements)
SELECT t.symbol, t.report_period, c.session FROM t ASOF LEFT JOIN cal c ON t.target <= c.session""")
def next_trading_session(spark, root):
    s = statements(spark, root).select("symbol", "report_period", "available_at")
    return pit.next_session(s, "available_at", bars(spark, root), "trade_date", 1).drop("available_at")


@query("event_decay_daily", f"""WITH {TICKS_SQL},
e AS (SELECT symbol, ts, price / 100 - 1 AS sentiment, size / (size + 50) AS confidence,
  CASE event_type WHEN 'purchase' THEN 10.0 WHEN 'error' THEN 2.0 ELSE 5.0 END AS half_life FROM ticks),
p AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS trade_date FROM ticks),
j AS (SELECT p.symbol, p.trade_date, e.sentiment, e.confidence,
  pow(0.5, (epoch_us(p.trade_date + INTERVAL 15 HOUR) - epoch_us(e.ts)) / 86400e6 / e.half_life) * e.confidence AS w
  FROM p LEFT JOIN e ON e.symbol = p.symbol AND e.ts <= p.trade_date + INTERVAL 15 HOUR)
SELECT symbol, trade_date, {tidy_sql("coalesce(sum(w * sentiment), 0.0) / greatest(coalesce(sum(w), 0.0), 1e-12)")} AS event_sentiment,
  {tidy_sql("coalesce(sum(w), 0.0)")} AS event_weight FROM j GROUP BY ALL""")
def event_decay_daily(spark, root):
    half = F.when(F.col("event_type") == "purchase", 10.0).when(F.col("event_type") == "error", 2.0).otherwise(5.0)
    t = ticks(spark, root)
    conf = F.col("size") / (F.col("size") + 50)
    events = t.select(
        "symbol", "ts", half.alias("half_life"), conf.alias("w"), (conf * (F.col("price") / 100 - 1)).alias("ws")
    )
    points = t.select("symbol", F.to_date("ts").alias("trade_date")).distinct().withColumn("at", pit.decision_time(F.col("trade_date")))
    out = pit.decayed_history(points, events, "symbol", "at", "ts", "half_life", {"weight": "w", "weighted": "ws"})
    return out.select(
        "symbol", "trade_date",
        tidy(F.col("weighted") / F.greatest("weight", F.lit(1e-12))).alias("event_sentiment"), tidy(F.col("weight")).alias("event_weight"),
    )


@query("universe_snapshot_members", f"""WITH {BARS_SQL},
snaps AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS snap, arg_max(o_orderstatus <> 'P', o_orderkey) AS is_member FROM orders GROUP BY ALL)
SELECT b.symbol, b.trade_date FROM bars b ASOF LEFT JOIN snaps s ON b.symbol = s.symbol AND b.trade_date >= s.snap
WHERE coalesce(s.is_member, false)""")
def universe_snapshot_members(spark, root):
    snaps = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("snap")).agg(
        F.max_by(F.col("o_orderstatus") != "P", "o_orderkey").alias("is_member")
    )
    joined = pit.asof_join(bars(spark, root).select("symbol", "trade_date"), snaps, ["symbol"], "trade_date", "snap")
    return joined.where(F.coalesce("is_member", F.lit(False))).select("symbol", "trade_date")


SUSPENSION_SQL = BARS_SQL + """,
day_flags AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, min(l_returnflag = 'R') AS halted FROM lineitem GROUP BY ALL),
turns AS (SELECT *, CASE WHEN halted IS DISTINCT FROM lag(halted) OVER w THEN 1 ELSE 0 END AS turn FROM day_flags WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
numbered AS (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY trade_date) AS run FROM turns),
suspensions AS (SELECT symbol, min(trade_date) AS effective_start, max(trade_date) AS effective_end, count(*) AS run_rows FROM numbered WHERE halted GROUP BY symbol, run)"""


def suspensions(spark, root):
    days = table(spark, root, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.min(F.col("l_returnflag") == "R").alias("halted")
    )
    return islands.runs_where(days, ["symbol"], "trade_date", F.col("halted")).select(
        "symbol", F.col("run_start").alias("effective_start"), F.col("run_end").alias("effective_end"), "run_rows"
    )


@query("interval_runs", f"WITH {SUSPENSION_SQL} SELECT * FROM suspensions")
def interval_runs(spark, root):
    return suspensions(spark, root)


@query("eligibility_masks", f"""WITH {SUSPENSION_SQL},
m AS (SELECT b.symbol, b.trade_date,
  CASE WHEN EXISTS (SELECT 1 FROM suspensions s WHERE s.symbol = b.symbol AND b.trade_date BETWEEN s.effective_start AND s.effective_end) THEN 'TRUE' ELSE 'FALSE' END AS mask_is_suspended,
  CASE WHEN s_acctbal < 500 THEN 'UNKNOWN' WHEN b.trade_date < DATE '1995-01-01' + CAST(round(s_acctbal / 20) AS INT) THEN 'TRUE' ELSE 'FALSE' END AS mask_pre_listing,
  CASE WHEN row_number() OVER (PARTITION BY b.symbol ORDER BY b.trade_date) - 1 < 60 THEN 'TRUE' ELSE 'FALSE' END AS mask_seasoning
  FROM bars b JOIN supplier ON s_suppkey = b.symbol)
SELECT *, mask_is_suspended <> 'TRUE' AND mask_pre_listing = 'FALSE' AND mask_seasoning <> 'TRUE' AS eligible,
  CASE WHEN 'TRUE' IN (mask_is_suspended, mask_pre_listing, mask_seasoning) THEN 'FALSE' WHEN mask_pre_listing = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'TRUE' END AS eligibility_status,
  CASE WHEN mask_pre_listing = 'UNKNOWN' THEN 'pre_listing' ELSE '' END AS unknown_masks FROM m""")
def eligibility_masks(spark, root):
    from pyspark.sql import Window

    panel = bars(spark, root).select("symbol", "trade_date")
    panel = pit.in_intervals(panel, suspensions(spark, root), "symbol", "trade_date", "effective_start", "effective_end", "halted")
    master = table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("symbol"),
        F.when(F.col("s_acctbal") >= 500, F.date_add(F.lit("1995-01-01").cast("date"), F.round(F.col("s_acctbal") / 20).cast("int"))).alias("listing_date"),
    )
    joined = panel.join(master, "symbol")
    seen = F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date")) - 1
    masks = joined.select(
        "symbol", "trade_date",
        pit.tri_state(F.col("halted"), F.lit(True)).alias("mask_is_suspended"),
        pit.tri_state(F.col("trade_date") < F.col("listing_date"), F.col("listing_date").isNotNull()).alias("mask_pre_listing"),
        pit.tri_state(seen < 60, F.lit(True)).alias("mask_seasoning"),
    )
    return pit.eligibility(masks, ["mask_is_suspended", "mask_pre_listing", "mask_seasoning"])


@query("membership_by_effective_dates", f"""WITH {BARS_SQL},
spans AS (SELECT s_suppkey AS symbol, DATE '1995-01-01' + CAST(floor(abs(s_acctbal) / 10) AS INT) AS effective_from,
  CASE WHEN s_acctbal > 2000 THEN DATE '1995-01-01' + CAST(floor(abs(s_acctbal) / 10) AS INT) + 900 END AS effective_to FROM supplier)
SELECT b.symbol, b.trade_date FROM bars b WHERE EXISTS (SELECT 1 FROM spans s WHERE s.symbol = b.symbol
  AND b.trade_date >= s.effective_from AND (s.effective_to IS NULL OR b.trade_date <= s.effective_to))""")
def membership(spark, root):
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.floor(F.abs("s_acctbal") / 10).cast("int"))
    spans = table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("symbol"), start.alias("effective_from"), F.when(F.col("s_acctbal") > 2000, F.date_add(start, 900)).alias("effective_to")
    )
    panel = bars(spark, root).select("symbol", "trade_date")
    return pit.in_intervals(panel, spans, "symbol", "trade_date", "effective_from", "effective_to", "member").where("member").drop("member")


@query("overlapping_intervals", """WITH spans AS (SELECT DISTINCT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS effective_from, CAST(o_orderdate AS DATE) + 60 AS effective_to FROM orders)
SELECT symbol, effective_from, effective_to FROM (SELECT *, max(effective_to) OVER (PARTITION BY symbol ORDER BY effective_from, effective_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)
WHERE reach >= effective_from""")
def overlapping_intervals(spark, root):
    d = F.to_date("o_orderdate")
    spans = table(spark, root, "orders").select(F.col("o_custkey").alias("symbol"), d.alias("effective_from"), F.date_add(d, 60).alias("effective_to")).distinct()
    return islands.overlapping(spans, "symbol", "effective_from", "effective_to")


@query("observed_families", f"""WITH {BARS_SQL}
SELECT b.symbol, b.trade_date, EXISTS (SELECT 1 FROM orders WHERE o_custkey = b.symbol AND CAST(o_orderdate AS DATE) = b.trade_date) AS has_orders,
  EXISTS (SELECT 1 FROM events WHERE user_id = b.symbol AND CAST(ts AS DATE) = b.trade_date) AS has_ticks FROM bars b""")
def observed_families(spark, root):
    panel = bars(spark, root).select("symbol", "trade_date")
    for name, seen in (
        ("has_orders", table(spark, root, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("trade_date"))),
        ("has_ticks", table(spark, root, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"))),
    ):
        panel = panel.join(seen.distinct().withColumn(name, F.lit(True)), ["symbol", "trade_date"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return panel


for _method, _scale in (("hfq", "coalesce(hfq, 1.0)"), ("qfq", "coalesce(hfq, 1.0) / last_value(coalesce(hfq, 1.0)) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")):

    @query(f"adjusted_prices_{_method}", f"""WITH {BARS_SQL},
acts AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS effective_date, 1.0 + count(*)::DOUBLE / 10 AS hfq FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
j AS (SELECT b.*, a.hfq FROM bars b ASOF LEFT JOIN acts a ON a.symbol = b.symbol AND b.trade_date >= a.effective_date),
k AS (SELECT *, {_scale} AS f FROM j)
SELECT symbol, trade_date, {tidy_sql("open * f")} AS open, {tidy_sql("close * f")} AS close, {tidy_sql("f")} AS adjust_factor, volume FROM k""")
    def adjusted(spark, root, method=_method):
        acts = table(spark, root, "orders").where("o_orderpriority = '1-URGENT'").groupBy(
            F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("effective_date")
        ).agg((1.0 + F.count(F.lit(1)) / 10).alias("hfq_factor"))
        out = pit.adjust_prices(bars(spark, root), acts, method)
        return out.select("symbol", "trade_date", tidy(out.open).alias("open"), tidy(out.close).alias("close"), tidy(out.adjust_factor).alias("adjust_factor"), "volume")


@query("symbol_identity", """WITH c AS (SELECT s_suppkey AS supplier, s_suppkey % 4 AS b,
  CASE s_suppkey % 4 WHEN 0 THEN '60' WHEN 1 THEN '00' WHEN 2 THEN '30' ELSE '68' END || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS code FROM supplier)
SELECT supplier, code,
  CASE WHEN left(code, 3) IN ('688', '689') THEN 'star' WHEN left(code, 1) = '6' THEN 'sh_main' WHEN left(code, 3) IN ('300', '301', '302') THEN 'chinext'
       WHEN left(code, 3) IN ('000', '001', '002', '003', '004') THEN 'sz_main' ELSE 'other' END AS board,
  CASE WHEN left(code, 1) = '6' THEN 'SH' ELSE 'SZ' END AS exchange,
  CASE WHEN supplier % 3 = 0 AND left(code, 1) <> '6' THEN NULL ELSE code || CASE WHEN left(code, 1) = '6' THEN '.SH' ELSE '.SZ' END END AS symbol
FROM c""")
def symbol_identity(spark, root):
    s = table(spark, root, "supplier").select(F.col("s_suppkey").alias("supplier"), listing_code(F.col("s_suppkey")).alias("c"))
    spelled = F.when(F.col("supplier") % 3 == 0, F.concat(F.lit("sh"), "c")).otherwise(F.col("c"))
    code = code_of(spelled)
    return s.select("supplier", code.alias("code"), board_of(code).alias("board"), exchange_of(code).alias("exchange"), canonical_symbol(spelled).alias("symbol"))


@query("sector_map_build", """WITH src AS (SELECT s_suppkey AS symbol, 'register' AS source, 1 AS priority, n_name AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0
  UNION ALL SELECT s_suppkey, 'board', 2, 'board_' || s_suppkey % 4 FROM supplier WHERE s_suppkey % 5 <> 0),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority) AS rn FROM src) WHERE rn = 1)
SELECT s_suppkey AS symbol, coalesce(p.source, 'missing') AS source, coalesce(p.sector, 'missing') AS sector FROM supplier LEFT JOIN picked p ON p.symbol = s_suppkey""")
def sector_map_build(spark, root):
    from tickloom.operators.sectors import pick_by_priority

    reg = sectors(spark, root).where("balance > 0").select("symbol", F.lit("register").alias("source"), F.lit(1).alias("priority"), "sector")
    sup = table(spark, root, "supplier").select(F.col("s_suppkey").alias("symbol"))
    board = sup.where("symbol % 5 <> 0").select("symbol", F.lit("board").alias("source"), F.lit(2).alias("priority"), F.concat(F.lit("board_"), F.col("symbol") % 4).alias("sector"))
    return pick_by_priority(reg.unionByName(board), sup, "symbol", ["priority"], ["source", "sector"], missing="missing")


@query("sector_map_report", f"""WITH {SECTORS_SQL}
SELECT sector, count(*) AS members, round(count(*)::DOUBLE / (SELECT count(*) FROM sectors), 6) AS share, count(*) > 1 AND count(DISTINCT concept) > 1 AS conflicting FROM sectors GROUP BY sector""")
def sector_map_report(spark, root):
    from tickloom.operators.sectors import sector_report

    return sector_report(sectors(spark, root), "sector", "concept")


@query("st_intervals_from_names", """WITH names AS (SELECT conv_id AS symbol, turn, text LIKE '%que%' AS st FROM conversations),
nx AS (SELECT *, lead(turn) OVER (PARTITION BY symbol ORDER BY turn) AS until, CASE WHEN st IS DISTINCT FROM lag(st) OVER (PARTITION BY symbol ORDER BY turn) THEN 1 ELSE 0 END AS turned FROM names),
g AS (SELECT *, sum(turned) OVER (PARTITION BY symbol ORDER BY turn) AS run FROM nx)
SELECT symbol, min(turn) AS start_turn, CASE WHEN bool_or(until IS NULL) THEN NULL ELSE max(until) END AS end_turn FROM g WHERE st GROUP BY symbol, run""")
def st_intervals(spark, root):
    """Dated name history → half-open spans in which the name carries the marker."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("turn")
    names = table(spark, root, "conversations").select(F.col("conv_id").alias("symbol"), "turn", F.col("text").contains("que").alias("st"))
    nx = names.withColumn("until", F.lead("turn").over(w)).withColumn("turned", (~F.col("st").eqNullSafe(F.lag("st").over(w))).cast("int"))
    return nx.withColumn("run", F.sum("turned").over(w)).where("st").groupBy("symbol", "run").agg(
        F.min("turn").alias("start_turn"), F.when(~F.bool_or(F.col("until").isNull()), F.max("until")).alias("end_turn")
    ).drop("run")
