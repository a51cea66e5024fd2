"""Labels, evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.checks.panels import PANEL_SQL, factor_panel, rk
from tickloom.checks.normal_sql import normal_sql
from tickloom.checks.registry import query
from tickloom.functions.columns import rounded, rounded_mean, tidy
from tickloom.operators import evaluate as E
from tickloom.operators import frontier as FR
from tickloom.operators import labels as LB
from tickloom.operators import pit
from tickloom.operators import stats as ST
from tickloom.operators.cross import pct_rank
from tickloom.operators.quantiles import exact_quantiles
from tickloom.session import cut_lineage
from tickloom.plans.factors import pinned
from tickloom.plans.inputs import BARS_SQL, SECTORS_SQL, bars, sectors, tidy_sql

W = "OVER (PARTITION BY symbol ORDER BY trade_date)"


def t(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


@query("label_set", f"""WITH {BARS_SQL},
f AS (SELECT symbol, trade_date, lead(close, 5) {W} / close - 1 AS y, lead(trade_date, 5) {W} AS label_end_5d,
  coalesce(lead(volume >= 60, 5) {W}, false) AS shut FROM bars)
SELECT symbol, trade_date, label_end_5d, {tidy_sql("y")} AS forward_return_5d, {tidy_sql("y - avg(y) OVER (PARTITION BY trade_date)")} AS forward_excess_return_5d,
  {tidy_sql(f"(CASE WHEN y IS NOT NULL THEN {rk('y', 'trade_date')} / count(y) OVER (PARTITION BY trade_date) END)")} AS forward_rank_5d,
  CASE WHEN NOT shut THEN {tidy_sql("y")} END AS forward_tradable_return_5d
FROM f QUALIFY y IS NOT NULL""")
def label_set(spark, root):
    out = LB.label_set(bars(spark, root), [5], blocked=F.col("volume") >= 60)
    names = ["forward_return_5d", "forward_excess_return_5d", "forward_rank_5d", "forward_tradable_return_5d"]
    return t(out, *names).select("symbol", "trade_date", "label_end_5d", *names)


@query("label_excess_benchmark", f"""WITH {BARS_SQL},
r AS (SELECT symbol, trade_date, close / lag(close) {W} - 1 AS ret, lead(close, 3) {W} / close - 1 AS fwd FROM bars),
b AS (SELECT trade_date, avg(ret) AS m FROM r GROUP BY trade_date),
c AS (SELECT trade_date, CASE WHEN count(m) OVER f = 3 THEN product(1 + m) OVER f - 1 END AS bench FROM b WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT symbol, trade_date, {tidy_sql("fwd - bench")} AS forward_excess_3d FROM r LEFT JOIN c USING (trade_date)""")
def label_excess_benchmark(spark, root):
    b = bars(spark, root)
    w = Window.partitionBy("symbol").orderBy("trade_date")
    market = b.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).groupBy("trade_date").agg(F.avg("r").alias("benchmark_return"))
    return t(LB.excess_over_benchmark(b, market, [3]), "forward_excess_3d").select("symbol", "trade_date", "forward_excess_3d")


@query("label_delayed_executable", f"""WITH {BARS_SQL},
f AS (SELECT symbol, trade_date, close, volume <= 2 AS halted, coalesce(close > lag(close) {W} * 1.05, false) AS sealed FROM bars),
g AS (SELECT *, lead(close) {W} AS entry, lead(close, 6) {W} / lead(close) {W} - 1 AS y, coalesce(lead(halted) {W}, false) AS h1, coalesce(lead(sealed) {W}, false) AS u1 FROM f)
SELECT symbol, trade_date, {tidy_sql("y")} AS forward_return_5d,
  CASE WHEN halted THEN 'suspended_at_t' WHEN h1 THEN 'suspended_at_t1' WHEN u1 THEN 'limit_up_at_t1' WHEN entry IS NULL THEN 'entry_price_missing' END AS blocked_by,
  NOT (halted OR h1 OR u1 OR entry IS NULL) AS entry_feasible FROM g""")
def label_delayed_executable(spark, root):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    flags = bars(spark, root).withColumns({
        "halted": F.col("volume") <= 2, "sealed": F.coalesce(F.col("close") > F.lag("close").over(w) * 1.05, F.lit(False)),
    })
    out = LB.delayed_labels(flags, [5], "halted", "sealed")
    return t(out, "forward_return_5d").select("symbol", "trade_date", "forward_return_5d", "blocked_by", "entry_feasible")


@query("label_session_clock", f"""WITH {BARS_SQL},
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session FROM (SELECT DISTINCT trade_date FROM bars)),
n AS (SELECT b.symbol, b.trade_date, b.close, c.session FROM bars b JOIN cal c USING (trade_date))
SELECT n.symbol, n.trade_date, CAST(n.session AS INT) AS session, e.close IS NOT NULL AS entry_observed, {tidy_sql("x.close / e.close - 1")} AS executable_return_3d,
  n.session + 4 > (SELECT max(session) FROM cal) AS censored_3d
FROM n LEFT JOIN n e ON e.symbol = n.symbol AND e.session = n.session + 1 LEFT JOIN n x ON x.symbol = n.symbol AND x.session = n.session + 4""")
def label_session_clock(spark, root):
    b = bars(spark, root).select("symbol", "trade_date", "close")
    out = LB.session_labels(b, pit.session_index(b), [3])
    return t(out, "executable_return_3d").select("symbol", "trade_date", "session", "entry_observed", "executable_return_3d", "censored_3d")


@query("label_log_and_risk", f"""WITH {BARS_SQL},
r AS (SELECT symbol, trade_date, close, close / lag(close) {W} - 1 AS ret FROM bars)
SELECT symbol, trade_date, {tidy_sql(f"ln(lead(close, 5) {W} / close)")} AS future_5d_log_return,
  CASE WHEN count(ret) OVER f = 5 THEN {tidy_sql("stddev_samp(ret) OVER f")} END AS future_5d_volatility,
  CASE WHEN count(close) OVER f = 5 THEN {tidy_sql("min(close) OVER f / close - 1")} END AS future_5d_drawdown
FROM r WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def label_log_and_risk(spark, root):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    b = bars(spark, root).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    names = ["future_5d_log_return", "future_5d_volatility", "future_5d_drawdown"]
    return t(LB.log_and_risk_labels(b, [5]), *names).select("symbol", "trade_date", *names)


@query("label_sector_neutral", f"""WITH {PANEL_SQL}, {SECTORS_SQL}
SELECT symbol, trade_date, {tidy_sql("fwd5 - avg(fwd5) OVER (PARTITION BY trade_date, sector)")} AS fwd5_sector_neutral FROM panel JOIN sectors USING (symbol)""")
def label_sector_neutral(spark, root):
    joined = factor_panel(spark, root).join(sectors(spark, root).select("symbol", "sector"), "symbol")
    return t(LB.sector_neutral(joined, "fwd5"), "fwd5_sector_neutral").select("symbol", "trade_date", "fwd5_sector_neutral")


@query("label_triple_barrier", f"""WITH {BARS_SQL},
r AS (SELECT symbol, trade_date, ln(close) AS p, row_number() {W} AS i, ln(close) - lag(ln(close)) {W} AS lr FROM bars),
s AS (SELECT *, CASE WHEN count(lr) OVER f = 20 THEN round(stddev_samp(lr) OVER f, 8) END AS sigma FROM r WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
j AS (SELECT a.symbol, a.trade_date, b.trade_date AS d, b.i - a.i AS k, b.p - a.p AS r, a.sigma FROM s a JOIN s b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 10 WHERE a.sigma > 0),
h AS (SELECT symbol, trade_date, min(k) FILTER (r >= 1.5 * sigma OR r <= -1.5 * sigma) AS hit, max(k) AS last FROM j GROUP BY ALL),
o AS (SELECT h.symbol, h.trade_date, j.d AS t1, j.r, CASE WHEN h.hit IS NULL THEN 'vt' WHEN j.r > 0 THEN 'pt' ELSE 'sl' END AS barrier FROM h JOIN j ON j.symbol = h.symbol AND j.trade_date = h.trade_date AND j.k = coalesce(h.hit, h.last))
SELECT s.symbol, s.trade_date, o.t1, {tidy_sql("o.r")} AS barrier_return, coalesce(o.barrier, 'vt') AS barrier, coalesce(CAST(sign(o.r) AS INT), 0) AS label FROM s LEFT JOIN o USING (symbol, trade_date)""")
def label_triple_barrier(spark, root):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    f = w.rowsBetween(-19, 0)
    b = bars(spark, root).select("symbol", "trade_date", "close").withColumn("lr", F.ln("close") - F.lag(F.ln("close")).over(w))
    b = b.withColumn("sigma", F.when(F.count("lr").over(f) == 20, F.round(F.stddev_samp("lr").over(f), 8)))
    out = LB.triple_barrier(b, "sigma", 1.5, 1.5, 10)
    return t(out, "barrier_return").select("symbol", "trade_date", "t1", "barrier_return", "barrier", "label")


@query("label_uniqueness_weights", f"""WITH {BARS_SQL},
cal AS (SELECT DISTINCT trade_date AS d FROM bars),
e AS (SELECT symbol, trade_date AS t0, lead(trade_date, 4) {W} AS t1 FROM bars),
c AS (SELECT e.symbol, cal.d, count(*) AS open FROM e JOIN cal ON cal.d BETWEEN e.t0 AND e.t1 GROUP BY ALL)
SELECT symbol, t0, t1, {tidy_sql("coalesce(u, avg(u) OVER (PARTITION BY symbol))")} AS uniqueness FROM (SELECT e.symbol, e.t0, e.t1, avg(1.0::DOUBLE / c.open) AS u FROM e LEFT JOIN c ON c.symbol = e.symbol AND c.d BETWEEN e.t0 AND e.t1 GROUP BY ALL)""")
def label_uniqueness_weights(spark, root):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    b = bars(spark, root).select("symbol", "trade_date")
    events = pinned(b, "symbol").select("symbol", F.col("trade_date").alias("t0"), F.lead("trade_date", 4).over(w).alias("t1"))
    return t(LB.uniqueness_weights(events, b.select("trade_date").distinct(), "t0", "t1"), "uniqueness").select("symbol", "t0", "t1", "uniqueness")


@query("label_meta", f"""WITH {PANEL_SQL}
SELECT symbol, trade_date, {tidy_sql("sign(mom) * (CASE WHEN coalesce(vlm, 0) >= 0.5 THEN 1.0 ELSE 0.0 END) * abs(fwd5)")} AS meta FROM panel""")
def label_meta(spark, root):
    p = factor_panel(spark, root)
    return p.select("symbol", "trade_date", tidy(LB.meta_label(F.col("mom"), F.col("fwd5"), F.col("vlm"))).alias("meta"))


@query("label_setups", f"""WITH {BARS_SQL},
r AS (SELECT *, close / lag(close) {W} - 1 AS ret, lead(close, 5) {W} / close - 1 AS fwd,
  max(high) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past_high,
  min(low) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past_low FROM bars)
SELECT symbol, trade_date, coalesce(close <= past_low * 1.02, false) AS low_buy, coalesce(close > past_high, false) AS breakout,
  CASE WHEN close <= past_low * 1.02 THEN {tidy_sql("fwd")} END AS low_buy_label, CASE WHEN close > past_high THEN {tidy_sql("fwd")} END AS breakout_label,
  CASE WHEN ret >= 0.05 THEN {tidy_sql("-fwd")} END AS limit_risk_label FROM r""")
def label_setups(spark, root):
    """Setup flags and their labels: the forward return on setup days, sign flipped for the risk setup."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    past = w.rowsBetween(-20, -1)
    b = bars(spark, root).withColumns({
        "ret": F.col("close") / F.lag("close").over(w) - 1, "fwd": F.lead("close", 5).over(w) / F.col("close") - 1,
        "hi": F.max("high").over(past), "lo": F.min("low").over(past),
    })
    low, brk, risk = F.coalesce(F.col("close") <= F.col("lo") * 1.02, F.lit(False)), F.coalesce(F.col("close") > F.col("hi"), F.lit(False)), F.col("ret") >= 0.05
    return b.select(
        "symbol", "trade_date", low.alias("low_buy"), brk.alias("breakout"), F.when(low, tidy(F.col("fwd"))).alias("low_buy_label"),
        F.when(brk, tidy(F.col("fwd"))).alias("breakout_label"), F.when(risk, tidy(-F.col("fwd"))).alias("limit_risk_label"),
    )


# -- evaluation ----------------------------------------------------------------------------

PAIRS = "k AS (SELECT trade_date, factor_name, x, y FROM long WHERE x IS NOT NULL AND y IS NOT NULL)"
LONG_SQL = f"""{PANEL_SQL},
long AS (SELECT symbol, trade_date, factor_name, x, fwd5 AS y FROM (SELECT symbol, trade_date, fwd5, mom, vlm, gap FROM panel) UNPIVOT INCLUDE NULLS (x FOR factor_name IN (mom, vlm, gap))), {PAIRS},
z AS (SELECT trade_date, factor_name, x, y, {rk('x', 'factor_name, trade_date')} AS a, {rk('y', 'factor_name, trade_date')} AS b FROM k),
ic AS (SELECT factor_name, trade_date, count(*) AS n,
  CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS ric, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pic FROM z GROUP BY ALL)"""
FACTORS = ["mom", "vlm", "gap"]
NW_SQL = """nw_n AS (SELECT factor_name, count(ric) AS n, avg(ric) AS m FROM ic WHERE ric IS NOT NULL GROUP BY 1),
nw_l AS (SELECT *, greatest(1, least(greatest(greatest(1, floor(4 * pow(n / 100.0, 2.0 / 9.0))), 4), n - 1)) AS lag FROM nw_n),
nw_c AS (SELECT i.factor_name, row_number() OVER (PARTITION BY i.factor_name ORDER BY trade_date) AS r, ric - m AS c FROM ic i JOIN nw_n USING (factor_name) WHERE ric IS NOT NULL),
nw_g AS (SELECT a.factor_name, b.r - a.r AS k, sum(a.c * b.c) AS g FROM nw_c a JOIN nw_c b ON a.factor_name = b.factor_name AND b.r - a.r BETWEEN 0 AND 60 GROUP BY ALL),
nw AS (SELECT l.factor_name, any_value(l.m) / sqrt(greatest(sum(CASE WHEN k = 0 THEN g / n WHEN k <= lag THEN 2 * (1 - k / (lag + 1.0)) * g / n ELSE 0 END), 1e-12) / any_value(n)) AS t_stat
  FROM nw_l l JOIN nw_g g USING (factor_name) GROUP BY l.factor_name)"""


def long_ic(spark, root, method="spearman"):
    p = factor_panel(spark, root).select("symbol", "trade_date", "fwd5", *FACTORS)
    return E.ic_by_date(E.long_factors(p, FACTORS, ["symbol", "trade_date", "fwd5"]), "factor_value", "fwd5", by=["factor_name"], method=method)


@query("ic_by_date", f"WITH {LONG_SQL} SELECT factor_name, trade_date, n AS pairs, {tidy_sql('pic')} AS ic FROM ic")
def ic_by_date(spark, root):
    return t(long_ic(spark, root, "pearson"), "ic")


@query("ic_summary_hac", f"""WITH {LONG_SQL}, {NW_SQL}
SELECT factor_name, {tidy_sql("avg(ric)")} AS mean_ic, {tidy_sql("stddev_samp(ric)")} AS std_ic, {tidy_sql("avg(ric) / stddev_samp(ric)")} AS icir,
  {tidy_sql("avg(CASE WHEN ric > 1e-12 THEN 1.0 WHEN ric IS NOT NULL THEN 0.0 END)")} AS positive_ratio, {tidy_sql("any_value(t_stat)")} AS t_stat
FROM ic JOIN nw USING (factor_name) GROUP BY factor_name""")
def ic_summary_hac(spark, root):
    return t(E.ic_summary(long_ic(spark, root), ["factor_name"], horizon=5), "mean_ic", "std_ic", "icir", "positive_ratio", "t_stat")


@query("ic_decay_curve", f"""WITH {BARS_SQL},
r AS (SELECT symbol, trade_date, close / lag(close) {W} - 1 AS x, lead(close, 1) {W} / close - 1 AS h1, lead(close, 5) {W} / close - 1 AS h5, lead(close, 20) {W} / close - 1 AS h20 FROM bars),
l AS (SELECT trade_date, horizon, x, y FROM r UNPIVOT (y FOR horizon IN (h1, h5, h20)) WHERE x IS NOT NULL),
z AS (SELECT trade_date, horizon, {rk('x', 'horizon, trade_date')} AS a, {rk('y', 'horizon, trade_date')} AS b FROM l),
i AS (SELECT horizon, trade_date, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS ic FROM z GROUP BY ALL)
SELECT horizon, {tidy_sql("avg(ic)")} AS mean_ic FROM i GROUP BY horizon""")
def ic_decay_curve(spark, root):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    b = bars(spark, root)
    r = b.select("symbol", "trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("x"), *[
        (F.lead("close", h).over(w) / F.col("close") - 1).alias(f"h{h}") for h in (1, 5, 20)])
    long = r.unpivot(["symbol", "trade_date", "x"], ["h1", "h5", "h20"], "horizon", "y")
    return E.ic_by_date(long, "x", "y", by=["horizon"]).groupBy("horizon").agg(tidy(F.avg("ic")).alias("mean_ic"))


Q_SQL = """q AS (SELECT *, CASE WHEN x IS NOT NULL AND n >= 5 AND lo < hi THEN least(greatest(CAST(ceil(rn * 5.0 / n) AS INT), 1), 5) END AS quantile FROM (
  SELECT *, count(x) OVER g AS n, min(round_even(x * 1e10, 0)) OVER g AS lo, max(round_even(x * 1e10, 0)) OVER g AS hi,
    row_number() OVER (PARTITION BY factor_name, trade_date ORDER BY round_even(x * 1e10, 0) NULLS LAST, symbol) AS rn FROM long WINDOW g AS (PARTITION BY factor_name, trade_date)))"""


@query("quantile_group_returns", f"""WITH {LONG_SQL}, {Q_SQL}
SELECT trade_date, {', '.join(tidy_sql(f"avg(y) FILTER (quantile = {i})") + f" AS q{i}" for i in range(1, 6))},
  {tidy_sql("avg(y) FILTER (quantile = 5) - avg(y) FILTER (quantile = 1)")} AS long_short FROM q WHERE factor_name = 'mom' AND quantile IS NOT NULL GROUP BY trade_date""")
def quantile_group_returns(spark, root):
    return t(E.quantile_returns(factor_panel(spark, root), "mom", "fwd5"), "q1", "q2", "q3", "q4", "q5", "long_short")


TURN_SQL = """days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM panel)),
top AS (SELECT factor_name, i, symbol FROM q JOIN days USING (trade_date) WHERE quantile = 5),
kept AS (SELECT a.factor_name, a.i, count(*) AS now, count(b.symbol) AS kept FROM top a LEFT JOIN top b ON b.factor_name = a.factor_name AND b.symbol = a.symbol AND b.i = a.i - 1 GROUP BY ALL),
turn AS (SELECT n.factor_name, d.trade_date, CASE WHEN d.i = 1 OR k.now IS NULL THEN 0.0 ELSE 1.0 - k.kept / k.now END AS turnover
  FROM (SELECT DISTINCT factor_name FROM long) n CROSS JOIN days d LEFT JOIN kept k ON k.factor_name = n.factor_name AND k.i = d.i)"""


@query("top_quantile_turnover", f"WITH {LONG_SQL}, {Q_SQL}, {TURN_SQL} SELECT trade_date, {tidy_sql('turnover')} AS turnover FROM turn WHERE factor_name = 'mom'")
def top_quantile_turnover(spark, root):
    p = factor_panel(spark, root)
    p = p.withColumn("q", E.quantile_labels(F.col("mom"), 5, "trade_date"))
    return t(E.top_turnover(p, F.col("q"), 5), "turnover")


@query("factor_summary_table", f"""WITH {LONG_SQL}, {NW_SQL}, {Q_SQL}, {TURN_SQL},
cells AS (SELECT factor_name, trade_date, quantile, avg(y) AS r FROM q WHERE quantile IS NOT NULL GROUP BY ALL),
means AS (SELECT factor_name, quantile, avg(r) AS m FROM cells GROUP BY ALL HAVING avg(r) IS NOT NULL),
mono AS (SELECT factor_name, corr(a, b) AS monotonicity FROM (SELECT factor_name, {rk('quantile', 'factor_name')} AS a, {rk('m', 'factor_name')} AS b FROM means) GROUP BY 1),
tn AS (SELECT factor_name, avg(turnover) AS turnover FROM turn GROUP BY 1)
SELECT factor_name, {tidy_sql("avg(pic)")} AS ic, {tidy_sql("avg(pic) / stddev_samp(pic)")} AS icir, {tidy_sql("avg(ric)")} AS rank_ic, {tidy_sql("avg(ric) / stddev_samp(ric)")} AS rank_icir,
  {tidy_sql("avg(CASE WHEN ric > 1e-12 THEN 1.0 WHEN ric IS NOT NULL THEN 0.0 END)")} AS positive_ratio, {tidy_sql("any_value(t_stat)")} AS t_stat,
  {tidy_sql("any_value(monotonicity)")} AS monotonicity, {tidy_sql("any_value(tn.turnover)")} AS turnover
FROM ic JOIN nw USING (factor_name) JOIN mono USING (factor_name) JOIN tn USING (factor_name) GROUP BY factor_name""")
def factor_summary_table(spark, root):
    out = E.factor_summary(factor_panel(spark, root), FACTORS, "fwd5", horizon=5)
    return t(out, "ic", "icir", "rank_ic", "rank_icir", "positive_ratio", "t_stat", "monotonicity", "turnover")


@query("capacity_proxy", f"""WITH {PANEL_SQL}, r AS (SELECT mom AS x, amount AS a FROM panel WHERE mom IS NOT NULL AND amount IS NOT NULL), c AS (SELECT quantile_cont(x, 0.8) AS cut FROM r)
SELECT {tidy_sql("avg(a)")} AS average_amount, {tidy_sql("avg(a) FILTER (x >= cut)")} AS top_amount, {tidy_sql("avg(a) FILTER (x >= cut) * 0.05")} AS capacity FROM r, c""")
def capacity_proxy(spark, root):
    return t(E.capacity(factor_panel(spark, root), "mom"), "average_amount", "top_amount", "capacity")


@query("exact_split_quantiles", f"""WITH {BARS_SQL} SELECT symbol, {', '.join(tidy_sql(f"quantile_cont(amount, {q})") + f" AS {n}" for n, q in (("q05", 0.05), ("q50", 0.5), ("q99", 0.99)))} FROM bars GROUP BY symbol""")
def exact_split_quantiles(spark, root):
    return t(exact_quantiles(bars(spark, root), ["symbol"], "amount", {"q05": 0.05, "q50": 0.5, "q99": 0.99}), "q05", "q50", "q99")


@query("factor_correlation_pairs", f"""WITH {PANEL_SQL}, r AS (SELECT {', '.join(f"CASE WHEN {c} IS NOT NULL THEN ({rk(c + ' ', 'trade_date, ' + c + ' IS NULL')}) / count({c}) OVER (PARTITION BY trade_date) END AS {c}" for c in FACTORS)} FROM panel)
{" UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, {tidy_sql(f'corr({a}, {b})')} AS corr FROM r" for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:])}""")
def factor_correlation_pairs(spark, root):
    return t(E.correlation_pairs(factor_panel(spark, root), FACTORS, "spearman"), "corr")


@query("factor_screening", f"""WITH {LONG_SQL}
SELECT factor_name, {tidy_sql("avg(ric)")} AS mean_ic, concat_ws(',', CASE WHEN coalesce(NOT avg(ric) >= 0.0, true) THEN 'mean_ic' END, CASE WHEN coalesce(NOT avg(CASE WHEN ric > 1e-12 THEN 1.0 WHEN ric IS NOT NULL THEN 0.0 END) >= 0.5, true) THEN 'positive_ratio' END) AS failed FROM ic GROUP BY factor_name""")
def factor_screening(spark, root):
    s = E.ic_summary(long_ic(spark, root), ["factor_name"])
    return t(E.screen(s, {"mean_ic": (">=", 0.0), "positive_ratio": (">=", 0.5)}), "mean_ic").select("factor_name", "mean_ic", "failed")


NAMES = [*FACTORS, "ret"]


@query("correlation_clusters", f"""WITH RECURSIVE {PANEL_SQL}, r AS (SELECT {', '.join(f"CASE WHEN {c} IS NOT NULL THEN ({rk(c + ' ', 'trade_date, ' + c + ' IS NULL')}) / count({c}) OVER (PARTITION BY trade_date) END AS {c}" for c in NAMES)} FROM panel),
e AS ({" UNION ALL ".join(f"SELECT '{a}' AS l, '{b}' AS r, corr({a}, {b}) AS c FROM r" for a in NAMES for b in NAMES if a != b)}),
reach AS (SELECT unnest({NAMES}) AS factor, unnest({NAMES}) AS other UNION SELECT factor, e.r FROM reach JOIN e ON e.l = other WHERE abs(c) >= 0.3)
SELECT factor, min(other) AS cluster FROM reach GROUP BY factor""")
def correlation_clusters(spark, root):
    pairs = E.correlation_pairs(factor_panel(spark, root), NAMES, "spearman")
    return E.correlation_clusters(pairs, NAMES, 0.3)


@query("stratified_ic", f"""WITH {PANEL_SQL}, {SECTORS_SQL},
s AS (SELECT p.*, concept, CASE WHEN vlm <= 0.5 THEN 'low' WHEN vlm > 0.5 THEN 'high' END AS liquidity FROM panel p JOIN sectors USING (symbol)),
l AS (SELECT trade_date, mom, fwd5, axis, bucket FROM s UNPIVOT (bucket FOR axis IN (concept, liquidity)) WHERE mom IS NOT NULL AND fwd5 IS NOT NULL),
z AS (SELECT axis, bucket, trade_date, {rk('mom', 'axis, bucket, trade_date')} AS a, {rk('fwd5', 'axis, bucket, trade_date')} AS b FROM l),
i AS (SELECT axis, bucket, trade_date, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS ic FROM z GROUP BY ALL)
SELECT axis, bucket, count(*) AS dates, {tidy_sql("avg(ic)")} AS mean_ic, {tidy_sql("CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) END")} AS icir FROM i WHERE ic IS NOT NULL GROUP BY ALL""")
def stratified_ic(spark, root):
    p = factor_panel(spark, root).join(sectors(spark, root).select("symbol", "concept"), "symbol")
    p = p.withColumn("liquidity", F.when(F.col("vlm") <= 0.5, "low").when(F.col("vlm") > 0.5, "high"))
    return t(E.stratified_ic(p, "mom", "fwd5", ["concept", "liquidity"]), "mean_ic", "icir")


BOOK_SQL = f"""{PANEL_SQL},
grid AS (SELECT unnest([0.0, 0.5, 1.0]) AS lam),
sc AS (SELECT g.lam, p.symbol, p.trade_date, p.fwd5, coalesce(p.vlm, 0) + g.lam * 100 * p.gap AS score FROM panel p CROSS JOIN grid g WHERE p.fwd5 IS NOT NULL AND p.gap IS NOT NULL),
rn AS (SELECT *, row_number() OVER (PARTITION BY lam, trade_date ORDER BY round_even(score * 1e10, 0) DESC, symbol) AS rn FROM sc),
book AS (SELECT lam, trade_date, avg(fwd5) FILTER (rn <= 5) AS top_return, avg(fwd5) AS universe_return FROM rn GROUP BY ALL)"""


def books(spark, root):
    """Daily top-5 books for a grid of blend weights: the grid is a three-row side, one job for all."""
    grid = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "lam double")
    p = factor_panel(spark, root).where("gap is not null").crossJoin(F.broadcast(grid))
    p = p.withColumn("score", F.coalesce("vlm", F.lit(0)) + F.col("lam") * 100 * F.col("gap"))
    return E.top_k_excess(p, "score", "fwd5", 5, by=["lam"])


@query("top_k_weight_grid", f"WITH {BOOK_SQL} SELECT lam::DOUBLE AS lam, {tidy_sql('avg(top_return - universe_return)')} AS excess, {tidy_sql('avg(top_return)')} AS top_return FROM book GROUP BY lam")
def top_k_weight_grid(spark, root):
    return books(spark, root).groupBy("lam").agg(tidy(F.avg("excess")).alias("excess"), tidy(F.avg("top_return")).alias("top_return"))


def book_returns(spark, root):
    b = books(spark, root)
    return b.select("lam", "trade_date", F.round(F.col("top_return") / 5, 8).alias("ret"), F.round(F.col("universe_return") / 5, 8).alias("market"))


RET_SQL = BOOK_SQL + ", rets AS (SELECT lam::DOUBLE AS lam, trade_date, round(top_return / 5, 8) AS ret, round(universe_return / 5, 8) AS market FROM book)"


@query("return_statistics", f"""WITH {RET_SQL}
SELECT lam, count(*) AS n, {tidy_sql("sqrt(252) * avg(ret) / stddev_samp(ret)")} AS sharpe, {tidy_sql("sqrt(252) * avg(ret) / stddev_samp(ret) FILTER (ret < 0)")} AS sortino,
 {tidy_sql("avg((ret > 0)::INT)")} AS hit_ratio, {tidy_sql("sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0)")} AS profit_factor, {tidy_sql("stddev_samp(ret) * sqrt(252)")} AS volatility FROM rets WHERE ret IS NOT NULL GROUP BY lam""")
def return_statistics(spark, root):
    return t(ST.return_stats(book_returns(spark, root), ["lam"]), "sharpe", "sortino", "hit_ratio", "profit_factor", "volatility")


@query("drawdown_calmar", f"""WITH {RET_SQL},
n AS (SELECT lam, trade_date, exp(sum(ln(1 + coalesce(ret, 0))) OVER w) AS nav FROM rets WINDOW w AS (PARTITION BY lam ORDER BY trade_date)),
d AS (SELECT *, nav / max(nav) OVER (PARTITION BY lam ORDER BY trade_date) - 1 AS dd FROM n),
g AS (SELECT lam, min(dd) AS mdd, pow(arg_max(nav, trade_date) / arg_min(nav, trade_date), 252.0 / count(*)) - 1 AS cagr FROM d GROUP BY lam)
SELECT lam, {tidy_sql("mdd")} AS max_drawdown, {tidy_sql("cagr")} AS cagr, {tidy_sql("cagr / abs(mdd)")} AS calmar FROM g""")
def drawdown_calmar(spark, root):
    return t(ST.drawdown_stats(ST.nav(book_returns(spark, root), ["lam"], "trade_date"), ["lam"], "trade_date"), "max_drawdown", "cagr", "calmar")


@query("value_at_risk", f"""WITH {RET_SQL}, q AS (SELECT lam, quantile_cont(ret, 0.05) AS q, avg(ret) AS m, stddev_samp(ret) AS s FROM rets GROUP BY lam)
SELECT lam, {tidy_sql("-any_value(q)")} AS var, {tidy_sql("-avg(ret) FILTER (ret <= q)")} AS cvar, {tidy_sql("-(any_value(m) - 1.6448536269514729 * any_value(s))")} AS normal_var FROM rets JOIN q USING (lam) GROUP BY lam""")
def value_at_risk(spark, root):
    return t(ST.value_at_risk(book_returns(spark, root), ["lam"]), "var", "cvar", "normal_var")


@query("probabilistic_sharpe", f"""WITH RECURSIVE {RET_SQL}, m AS (SELECT lam, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, coalesce(skewness(ret), 0) AS skew, coalesce(kurtosis(ret), 0) AS kurt FROM rets WHERE ret IS NOT NULL GROUP BY lam),
s AS (SELECT *, mean / sd AS sr, sqrt(n - 1) / sqrt(greatest(1 - skew * mean / sd + (kurt + 2) / 4 * pow(mean / sd, 2), 1e-12)) AS f FROM m),
g AS (SELECT var_samp(sr) AS v, count(*) AS k FROM s WHERE sd > 0),
i AS (SELECT unnest([1 - 1 / k, 1 - 1 / (k * exp(1))]) AS p, unnest([1, 2]) AS which, -10::DOUBLE AS low, 10::DOUBLE AS high, 0 AS step FROM g
UNION ALL SELECT p, which, CASE WHEN below THEN x ELSE low END, CASE WHEN below THEN high ELSE x END, step + 1 FROM (SELECT *, {normal_sql('x')} < p AS below FROM (SELECT *, (low + high) / 2 AS x FROM i WHERE step < 70))),
b AS (SELECT CASE WHEN max(k) >= 2 AND max(v) > 0 THEN sqrt(max(v)) * sum(CASE which WHEN 1 THEN 1 - 0.5772156649015329 ELSE 0.5772156649015329 END * (low + high) / 2) END AS best FROM i, g WHERE step = 70),
z AS (SELECT *, sr * f AS z0, (sr - best) * f AS z1 FROM s, b)
SELECT lam, n, {tidy_sql('sr')} AS sr, {tidy_sql('skew')} AS skew, {tidy_sql('kurt')} AS kurt, {tidy_sql(f"CASE WHEN n < 4 THEN NULL WHEN sd <= 1e-12 THEN (mean > 0)::INT::DOUBLE ELSE {normal_sql('z0')} END")} AS psr, {tidy_sql(f"CASE WHEN n >= 4 AND best IS NOT NULL THEN {normal_sql('z1')} END")} AS dsr FROM z""")
def probabilistic_sharpe(spark, root):
    out = ST.deflated_sharpe(cut_lineage(book_returns(spark, root)), ["lam"])
    return t(out, "sr", "skew", "kurt", "psr", "dsr").select("lam", "n", "sr", "skew", "kurt", "psr", "dsr")


@query("capm_beta_capture", f"""WITH {RET_SQL}
SELECT lam, {tidy_sql("regr_slope(ret, market)")} AS beta, {tidy_sql("pow(1 + regr_intercept(ret, market), 252) - 1")} AS alpha, {tidy_sql("pow(corr(ret, market), 2)")} AS r2,
 {tidy_sql("(exp(sum(ln(1 + ret)) FILTER (market > 0)) - 1) / (exp(sum(ln(1 + market)) FILTER (market > 0)) - 1)")} AS up_capture,
 {tidy_sql("(exp(sum(ln(1 + ret)) FILTER (market < 0)) - 1) / (exp(sum(ln(1 + market)) FILTER (market < 0)) - 1)")} AS down_capture FROM rets WHERE ret IS NOT NULL AND market IS NOT NULL GROUP BY lam""")
def capm_beta_capture(spark, root):
    return t(ST.capm(book_returns(spark, root), ["lam"]), "beta", "alpha", "r2", "up_capture", "down_capture")


@query("overfitting_probability", f"""WITH {RET_SQL}, i AS (SELECT lam, ret, row_number() OVER (PARTITION BY lam ORDER BY trade_date) - 1 AS i, count(*) OVER (PARTITION BY lam) // 8 AS size FROM rets),
c AS (SELECT lam, i // size AS chunk, avg(ret) AS m FROM i WHERE i // size < 8 GROUP BY ALL),
s AS (SELECT mask, lam, avg(m) FILTER ((mask >> chunk) & 1 = 1) AS inside, avg(m) FILTER ((mask >> chunk) & 1 = 0) AS outside FROM c, (SELECT unnest(range(256)) AS mask) WHERE bit_count(mask) = 4 GROUP BY ALL),
r AS (SELECT mask, inside, count(*) OVER (PARTITION BY mask) AS k, rank() OVER (PARTITION BY mask ORDER BY outside) + (count(*) OVER (PARTITION BY mask, outside) - 1) / 2 AS place FROM s),
b AS (SELECT least(greatest((place - 1) / (k - 1), 1 / (k + 1)), 1 - 1 / (k + 1)) AS share FROM r QUALIFY row_number() OVER (PARTITION BY mask ORDER BY round(inside, 12) DESC, place) = 1)
SELECT count(*) AS splits, avg((share < 0.5)::INT) AS pbo FROM b""")
def overfitting_probability(spark, root):
    return ST.overfitting_probability(book_returns(spark, root), "lam", "trade_date", "ret", 8)


def _unit_sql(what: str) -> str:
    return f"(('0x' || substr(md5('7:' || b || ':' || i || ':{what}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


@query("superior_ability_bootstrap", f"""WITH {RET_SQL}, k AS (SELECT lam, trade_date, ret - market AS x FROM rets WHERE ret IS NOT NULL AND market IS NOT NULL),
cal AS MATERIALIZED (SELECT trade_date, m, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT trade_date, avg(x) AS m, count(DISTINCT lam) AS c FROM k GROUP BY trade_date) WHERE c = (SELECT count(DISTINCT lam) FROM k)),
d AS MATERIALIZED (SELECT lam, i, x, n FROM k JOIN cal USING (trade_date)),
mo AS (SELECT avg(m) AS mean, var_pop(m) AS v, any_value(n) AS n FROM cal),
au AS (SELECT a.i - b.i AS k, sum((a.m - mean) * (b.m - mean)) / any_value(mo.n) / any_value(v) AS r, any_value(mo.n) AS n, any_value(v) AS v FROM cal a, mo, cal b WHERE a.i > b.i AND a.i - b.i <= least(mo.n - 1, floor(8.0 * pow(mo.n / 100.0, 1.0 / 3.0)) + 1) GROUP BY 1),
sig AS (SELECT * FROM au WHERE k < coalesce((SELECT min(k) FROM au WHERE abs(r) < 2.0 * sqrt(log10(n) / n)), 100000)),
gs AS (SELECT coalesce(sum(2.0 * k * r), 0)::DOUBLE AS g, (SELECT v FROM mo) + coalesce(sum(2.0 * r), 0)::DOUBLE AS s FROM sig),
bl AS (SELECT CASE WHEN n < 8 OR v <= 1e-15 OR s <= 1e-15 THEN 1 ELSE greatest(1, least(n // 2, round_even(pow(2 * g * g / (s * s), 1.0 / 3.0) * pow(n, 1.0 / 3.0), 0)::BIGINT)) END AS block FROM gs, mo),
mu AS (SELECT lam, avg(x) AS mu, any_value(n) AS n, greatest(1, least(greatest(1, floor(4.0 * pow(any_value(n) / 100.0, 2.0 / 9.0))), any_value(n) - 1)) AS lag FROM d GROUP BY lam),
ga AS (SELECT a.lam, a.i - b.i AS k, sum((a.x - mu) * (b.x - mu)) / any_value(mu.n) AS g, any_value(lag) AS lag, any_value(mu.n) AS n FROM d a JOIN mu USING (lam) JOIN d b ON b.lam = a.lam AND b.i <= a.i AND a.i - b.i <= lag GROUP BY 1, 2),
om AS (SELECT lam, sqrt(greatest(sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lag + 1)) * g END), 1e-12) / any_value(n)) AS w FROM ga GROUP BY lam),
st AS MATERIALIZED (SELECT lam, w, mu, mu AS upper, CASE WHEN mu >= -w * sqrt(greatest(2 * ln(ln(n)), 0)) THEN mu ELSE 0 END AS cons, greatest(mu, 0) AS lower FROM mu JOIN om USING (lam)),
pl AS (SELECT b, i, n, CASE WHEN i = 0 OR {_unit_sql('new')} < 1.0::DOUBLE / block THEN floor({_unit_sql('start')} * n)::BIGINT END AS s FROM range(200) r(b), cal, bl),
dr AS (SELECT b, (last_value(s IGNORE NULLS) OVER w + i - last_value(CASE WHEN s IS NOT NULL THEN i END IGNORE NULLS) OVER w) % n AS i FROM pl WINDOW w AS (PARTITION BY b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bm AS (SELECT b, lam, avg(x) AS m FROM dr JOIN d USING (i) GROUP BY ALL),
z AS (SELECT b, greatest(max((m - lower) / w), 0) AS zl, greatest(max((m - cons) / w), 0) AS zc, greatest(max((m - upper) / w), 0) AS zu FROM bm JOIN st USING (lam) GROUP BY b),
ob AS (SELECT greatest(max(mu / w), 0) AS t, arg_max(lam, mu / w) AS best FROM st)
SELECT round(t, 3) + 0.0 AS test_statistic, best AS best_candidate, CAST(block AS INT) AS block_length, avg((zl >= t - 1e-9)::INT) AS p_lower, avg((zc >= t - 1e-9)::INT) AS p_consistent, avg((zu >= t - 1e-9)::INT) AS p_upper FROM z, ob, bl GROUP BY ALL""")
def superior_ability_bootstrap(spark, root):
    # several branches read the daily returns (one row per session and book): cut the long plan once
    r = cut_lineage(book_returns(spark, root)).withColumn("excess", F.col("ret") - F.col("market"))
    return ST.superior_ability(r, "lam", "trade_date", "excess", 200).withColumn("test_statistic", F.round("test_statistic", 3) + 0.0)


@query("covariance_shrunk", f"""WITH {RET_SQL}
SELECT l AS left, r AS right, {tidy_sql("c * CASE WHEN l = r THEN 1 ELSE 0.9 END")} AS cov FROM (SELECT a.lam AS l, b.lam AS r, covar_samp(a.ret * 1000, b.ret * 1000) AS c FROM rets a JOIN rets b USING (trade_date) WHERE a.lam <= b.lam GROUP BY a.lam, b.lam)""")
def covariance_shrunk(spark, root):
    r = book_returns(spark, root).withColumn("ret", F.col("ret") * 1000)
    return t(ST.covariance_pairs(r, "lam", "trade_date", "ret", shrink=0.1), "cov")


@query("covariance_ewma", f"""WITH {RET_SQL},
ages AS (SELECT trade_date, pow(1 - 2.0 / 61, row_number() OVER (ORDER BY trade_date DESC) - 1) AS w FROM (SELECT DISTINCT trade_date FROM rets)),
c AS (SELECT lam, trade_date, ret * 1000 - avg(ret * 1000) OVER (PARTITION BY lam) AS x, w / (SELECT sum(w) FROM ages) AS w FROM rets JOIN ages USING (trade_date))
SELECT a.lam AS left, b.lam AS right, {tidy_sql("sum(a.w * a.x * b.x)")} AS cov FROM c a JOIN c b USING (trade_date) WHERE a.lam <= b.lam GROUP BY ALL""")
def covariance_ewma(spark, root):
    r = book_returns(spark, root).withColumn("ret", F.col("ret") * 1000)
    return t(ST.covariance_pairs(r, "lam", "trade_date", "ret", span=60), "cov")


@query("covariance_ledoit_wolf", f"""WITH {RET_SQL}, o AS (SELECT lam, trade_date, ret FROM rets WHERE ret IS NOT NULL AND trade_date IN (SELECT trade_date FROM rets WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT lam) FROM rets))),
c AS (SELECT lam, trade_date, ret - avg(ret) OVER (PARTITION BY lam) AS x FROM o),
m AS (SELECT a.lam AS i, b.lam AS j, count(*) AS n, avg(a.x * b.x) AS s, avg(pow(a.x * b.x, 2)) AS q, avg(pow(a.x, 3) * b.x) AS c3, avg(a.x * a.x) AS vi, avg(b.x * b.x) AS vj FROM c a JOIN c b USING (trade_date) GROUP BY ALL),
r AS (SELECT avg(s / sqrt(vi * vj)) AS r FROM m WHERE i <> j), g AS (SELECT *, CASE WHEN i = j THEN vi ELSE r * sqrt(vi * vj) END AS t, q - s * s AS phi FROM m, r),
d AS (SELECT greatest(0, least(1, (sum(phi) - sum(CASE WHEN i = j THEN phi ELSE r * sqrt(vj / vi) * (c3 - vi * s) END)) / sum(pow(t - s, 2)) / max(n))) AS k FROM g)
SELECT i AS "left", j AS "right", {tidy_sql("k * t + (1 - k) * s")} AS cov, {tidy_sql("k")} AS shrinkage FROM g, d""")
def covariance_ledoit_wolf(spark, root):
    return t(ST.ledoit_wolf(cut_lineage(book_returns(spark, root)), "lam", "trade_date", "ret"), "cov", "shrinkage")


@query("pareto_front", f"""WITH {RET_SQL}, c AS (SELECT symbol, round(avg(ret), 8) AS gain, round(stddev_samp(ret), 8) AS risk FROM panel WHERE ret IS NOT NULL GROUP BY symbol)
SELECT symbol, gain, risk FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.symbol <> a.symbol AND b.gain >= a.gain AND b.risk <= a.risk AND (b.gain > a.gain OR b.risk < a.risk))""")
def pareto_front(spark, root):
    c = factor_panel(spark, root).where("ret is not null").groupBy("symbol").agg(F.round(F.avg("ret"), 8).alias("gain"), F.round(F.stddev_samp("ret"), 8).alias("risk"))
    return FR.pareto_front(c, {"gain": 1, "risk": -1})


OBJ_SQL = PANEL_SQL + ", c AS (SELECT symbol, round(avg(ret), 4) AS gain, round(stddev_samp(ret), 3) AS risk, round(avg(volume) / 10, 0) AS size, count(ret) AS seen FROM panel GROUP BY symbol)"


def objective_table(spark, root):
    return factor_panel(spark, root).groupBy("symbol").agg(
        rounded_mean(F.col("ret"), 4).alias("gain"), rounded(F.stddev_samp("ret"), 3).alias("risk"), F.round(F.avg("volume") / 10, 0).alias("size"), F.count("ret").alias("seen"))


@query("pareto_three_objectives", f"""WITH {OBJ_SQL}
SELECT symbol, gain, risk, size FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.gain >= a.gain AND b.risk <= a.risk AND b.size >= a.size AND (b.gain > a.gain OR b.risk < a.risk OR b.size > a.size))""")
def pareto_three_objectives(spark, root):
    """Rounded objectives, so that rows tie."""
    return FR.pareto_front(objective_table(spark, root), {"gain": 1, "risk": -1, "size": 1}).select("symbol", "gain", "risk", "size")


_SCALED = {c: f"(coalesce({c}, 0) - min(coalesce({c}, 0)) OVER ()) / CASE WHEN max(coalesce({c}, 0)) OVER () - min(coalesce({c}, 0)) OVER () < 1e-12 THEN 1 ELSE max(coalesce({c}, 0)) OVER () - min(coalesce({c}, 0)) OVER () END" for c in ("gain", "risk", "size")}


@query("preference_rank", f"""WITH {OBJ_SQL},
u AS (SELECT symbol, least(greatest({_SCALED['gain']}, 0), 1) * 0.5::DOUBLE AS cg, least(greatest(1 - {_SCALED['risk']}, 0), 1) * 0.375::DOUBLE AS cr, least(greatest({_SCALED['size']}, 0), 1) * 0.125::DOUBLE AS cs FROM c WHERE seen > 0),
s AS (SELECT *, round(least(cg + cr + cs, 1), 6) AS preference_score FROM u)
SELECT symbol, preference_score, CAST(dense_rank() OVER (ORDER BY preference_score DESC) AS INT) AS preference_rank, round(cg, 6) AS contribution_gain, round(cr, 6) AS contribution_risk, round(cs, 6) AS contribution_size FROM s""")
def preference_rank(spark, root):
    out = FR.preference_rank(objective_table(spark, root), {"gain": 1, "risk": -1, "size": 1}, {"gain": 4, "risk": 3, "size": 1}, "seen")
    return out.select("symbol", "preference_score", "preference_rank", "contribution_gain", "contribution_risk", "contribution_size")


@query("fold_robustness", f"""WITH {RET_SQL}, f AS (SELECT lam, year(trade_date) AS y, avg(ret - market) AS e, sqrt(252) * avg(ret) / stddev_samp(ret) AS s FROM rets GROUP BY ALL)
SELECT lam, {tidy_sql("0.6 * avg((e > 0)::INT) + 0.4 * abs(avg(e)) / (abs(avg(e)) + stddev_samp(e))")} AS fold_consistency, {tidy_sql("1 / (1 + exp(-min(s)))")} AS regime_consistency FROM f GROUP BY lam""")
def fold_robustness(spark, root):
    r = book_returns(spark, root).groupBy("lam", F.year("trade_date").alias("fold")).agg(
        F.avg(F.col("ret") - F.col("market")).alias("excess"), (F.sqrt(F.lit(252.0)) * F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"))
    return t(ST.fold_robustness(r, "lam", "excess", "sharpe"), "fold_consistency", "regime_consistency")


@query("walk_forward_folds", f"""WITH {BARS_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS s, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM bars)),
plan AS (SELECT k AS fold, n - (4 - k) * 60 + 1 AS v0 FROM (SELECT DISTINCT n FROM cal), generate_series(0, 3) g(k))
SELECT CAST(fold AS INT) AS fold, 'valid' AS role, trade_date FROM cal JOIN plan ON s BETWEEN v0 AND v0 + 59 UNION ALL SELECT CAST(fold AS INT), 'train', trade_date FROM cal JOIN plan ON s BETWEEN 1 AND v0 - 1 - 10""")
def walk_forward_folds(spark, root):
    sessions = pit.session_index(bars(spark, root))
    n = sessions.count()  # exchange days: a calendar, not data
    return E.tag_folds(sessions, E.walk_forward_folds(n, 4, 60, 250, 5, 5))


@query("purged_folds", f"""WITH {BARS_SQL}, s AS (SELECT symbol, trade_date AS t0, lead(trade_date, 5) {W} AS t1 FROM bars),
n AS (SELECT *, row_number() OVER (ORDER BY t0, t1, symbol) - 1 AS i, count(*) OVER () AS n FROM s WHERE t1 IS NOT NULL),
f AS (SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS own FROM n),
p AS (SELECT own AS fold, min(t0) AS a, max(t1) AS b, max(i) AS last FROM f GROUP BY own)
SELECT CAST(p.fold AS INT) AS fold, CASE WHEN own = p.fold THEN 'test' WHEN t1 >= a AND t0 <= b THEN 'purged' WHEN i > last AND i <= last + ceil(n * 0.01) THEN 'embargo' ELSE 'train' END AS role, count(*) AS samples FROM f CROSS JOIN p GROUP BY ALL""")
def purged_folds(spark, root):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    s = bars(spark, root).select("symbol", F.col("trade_date").alias("t0"), F.lead("trade_date", 5).over(w).alias("t1")).where("t1 is not null")
    return E.purged_folds(s, "t0", "t1").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("samples"))


@query("conformal_intervals", f"""WITH {PANEL_SQL}, {SECTORS_SQL}, j AS (SELECT p.*, concept, round(vlm / 100, 8) AS pred FROM panel p JOIN sectors USING (symbol)),
r AS (SELECT concept, abs(fwd5 - pred) AS e, row_number() OVER (PARTITION BY concept ORDER BY abs(fwd5 - pred)) AS k, count(*) OVER (PARTITION BY concept) AS n FROM j WHERE fwd5 IS NOT NULL AND trade_date < DATE '1998-01-01'),
q AS (SELECT concept, e FROM r WHERE k = least(greatest(ceil((n + 1) * 0.9), 1), n))
SELECT symbol, trade_date, {tidy_sql("pred - e")} AS lower, {tidy_sql("pred + e")} AS upper FROM j LEFT JOIN q USING (concept) WHERE trade_date >= DATE '1998-01-01'""")
def conformal_intervals(spark, root):
    j = factor_panel(spark, root).join(sectors(spark, root).select("symbol", "concept"), "symbol").withColumn("pred", F.round(F.col("vlm") / 100, 8))
    cut = F.lit("1998-01-01").cast("date")
    out = ST.conformal(j.where(F.col("trade_date") >= cut), j.where(F.col("trade_date") < cut), "pred", "fwd5", ["concept"])
    return t(out, "lower", "upper").select("symbol", "trade_date", "lower", "upper")


@query("cross_section_factor_returns", f"""WITH {PANEL_SQL}, s AS (SELECT trade_date, sum(vlm * vlm) AS a, sum(vlm * gap) AS b, sum(gap * gap) AS c, sum(vlm * fwd1) AS p, sum(gap * fwd1) AS q FROM panel
  WHERE vlm IS NOT NULL AND gap IS NOT NULL AND fwd1 IS NOT NULL GROUP BY trade_date)
SELECT trade_date, {tidy_sql("(p * c - q * b) / (a * c - b * b)")} AS b_vlm, {tidy_sql("(a * q - b * p) / (a * c - b * b)")} AS b_gap FROM s WHERE a * c - b * b > 1e-9""")
def cross_section_factor_returns(spark, root):
    p = factor_panel(spark, root)
    det = p.where("vlm is not null and gap is not null and fwd1 is not null").groupBy("trade_date").agg(
        (F.sum(F.col("vlm") ** 2) * F.sum(F.col("gap") ** 2) - F.sum(F.col("vlm") * F.col("gap")) ** 2).alias("d")).where("d > 1e-9")
    out = ST.cross_section_ols(p, "fwd1", ["vlm", "gap"], "trade_date").join(det.select("trade_date"), "trade_date", "left_semi")
    return t(out, "b_vlm", "b_gap")


@query("coverage_population", f"""WITH {PANEL_SQL} SELECT trade_date, count(*) AS pairs, count(*) >= 20 AS usable FROM panel WHERE mom IS NOT NULL AND fwd5 IS NOT NULL GROUP BY trade_date""")
def coverage_population(spark, root):
    p = factor_panel(spark, root).where("mom is not null and fwd5 is not null")
    return p.groupBy("trade_date").agg(F.count(F.lit(1)).alias("pairs"), (F.count(F.lit(1)) >= 20).alias("usable"))


@query("rolling_icir_weights", f"""WITH {LONG_SQL},
r AS (SELECT factor_name, trade_date, CASE WHEN count(ric) OVER f >= 12 AND stddev_samp(ric) OVER f > 0 THEN avg(ric) OVER f / stddev_samp(ric) OVER f END AS v,
  row_number() OVER (PARTITION BY factor_name ORDER BY trade_date DESC) AS rn FROM ic WINDOW f AS (PARTITION BY factor_name ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
p AS (SELECT factor_name, greatest(coalesce(v, 0), 0) AS raw FROM r WHERE rn = 1)
SELECT factor_name, {tidy_sql("0.75 * CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 1.0 / count(*) OVER () END + 0.25 / count(*) OVER ()")} AS weight FROM p""")
def rolling_icir_weights(spark, root):
    w = Window.partitionBy("factor_name").orderBy("trade_date").rowsBetween(-59, 0)
    ic = long_ic(spark, root)
    sd = F.stddev_samp("ic").over(w)
    v = ic.withColumn("v", F.when((F.count("ic").over(w) >= 12) & (sd > 0), F.avg("ic").over(w) / sd))
    last = v.groupBy("factor_name").agg(F.max_by("v", "trade_date").alias("v"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return last.select("factor_name", tidy(0.75 * E.normalised(F.col("v")) + 0.25 / n).alias("weight"))


@query("composite_score", f"""WITH {PANEL_SQL}, z AS (SELECT symbol, trade_date, {', '.join(f"CASE WHEN stddev_pop({c}) OVER g > 1e-12 THEN ({c} - avg({c}) OVER g) / stddev_pop({c}) OVER g END AS {c}" for c in FACTORS)} FROM panel WINDOW g AS (PARTITION BY trade_date))
SELECT symbol, trade_date, {tidy_sql("0.5 * coalesce(mom, 0) + 0.3 * coalesce(vlm, 0) + 0.2 * coalesce(gap, 0)")} AS composite FROM z""")
def composite_score(spark, root):
    from tickloom.operators.cross import group_zscore

    p = factor_panel(spark, root)
    z = p.select("symbol", "trade_date", *[group_zscore(F.col(c), "trade_date").alias(c) for c in FACTORS])
    return z.select("symbol", "trade_date", tidy(sum((F.lit(w) * F.coalesce(c, F.lit(0)) for c, w in zip(FACTORS, (0.5, 0.3, 0.2))), F.lit(0.0))).alias("composite"))


@query("regime_conditional_excess", f"""WITH {RET_SQL}, m AS (SELECT *, CASE WHEN market > 0 THEN 'bull' ELSE 'bear' END AS regime FROM rets WHERE ret IS NOT NULL)
SELECT lam, coalesce(regime, 'ALL') AS regime, count(*) AS days, {tidy_sql("avg(ret - market) * 252")} AS excess FROM m GROUP BY GROUPING SETS ((lam, regime), (lam))""")
def regime_conditional_excess(spark, root):
    r = book_returns(spark, root).where("ret is not null").withColumn("regime", F.when(F.col("market") > 0, "bull").otherwise("bear"))
    g = r.groupingSets([["lam", "regime"], ["lam"]], "lam", "regime").agg(F.count(F.lit(1)).alias("days"), tidy(F.avg(F.col("ret") - F.col("market")) * 252).alias("excess"))
    return g.withColumn("regime", F.coalesce("regime", F.lit("ALL")))


@query("lifecycle_replay", f"""WITH {LONG_SQL}, m AS (SELECT factor_name, date_trunc('month', trade_date)::DATE AS month, avg(ric) AS ic FROM ic GROUP BY ALL),
f AS (SELECT *, coalesce(ic < -1e-12, true) AS bad, row_number() OVER (PARTITION BY factor_name ORDER BY month) AS i FROM m),
g AS (SELECT *, i - coalesce(max(CASE WHEN NOT bad THEN i END) OVER (PARTITION BY factor_name ORDER BY month), 0) AS streak FROM f),
h AS (SELECT *, max(streak) OVER (PARTITION BY factor_name ORDER BY month) AS worst FROM g)
SELECT factor_name, month, CAST(streak AS INT) AS degradations, CASE WHEN worst >= 3 THEN 'retired' WHEN bad THEN 'degraded' ELSE 'active' END AS stage FROM h""")
def lifecycle_replay(spark, root):
    """State per factor from ordered observations: retired for good after three bad months in a row."""
    ic = long_ic(spark, root).groupBy("factor_name", F.trunc("trade_date", "month").alias("month")).agg(F.avg("ic").alias("ic"))
    w = Window.partitionBy("factor_name").orderBy("month")
    bad = F.coalesce(F.col("ic") < -1e-12, F.lit(True))
    f = ic.withColumns({"bad": bad, "i": F.row_number().over(w)})
    f = f.withColumn("degradations", F.col("i") - F.coalesce(F.max(F.when(~F.col("bad"), F.col("i"))).over(w), F.lit(0)))
    worst = F.max("degradations").over(w)
    return f.select("factor_name", "month", "degradations", F.when(worst >= 3, "retired").when(F.col("bad"), "degraded").otherwise("active").alias("stage"))


@query("capacity_curve", f"""WITH {PANEL_SQL}, d AS (SELECT trade_date, avg(fwd1) AS alpha, avg(amount) AS adv FROM panel GROUP BY 1), g AS (SELECT unnest([1e4, 1e6, 1e8]) AS aum)
SELECT aum::DOUBLE AS aum, {tidy_sql("avg(alpha) * 252")} AS gross_annual, {tidy_sql("avg(0.001 * sqrt(aum * abs(alpha) / adv)) * 252")} AS impact_annual FROM d CROSS JOIN g GROUP BY aum""")
def capacity_curve(spark, root):
    grid = spark.createDataFrame([(1e4,), (1e6,), (1e8,)], "aum double")
    d = factor_panel(spark, root).groupBy("trade_date").agg(F.avg("fwd1").alias("alpha"), F.avg("amount").alias("adv"))
    return d.crossJoin(F.broadcast(grid)).groupBy("aum").agg(
        tidy(F.avg("alpha") * 252).alias("gross_annual"), tidy(F.avg(0.001 * F.sqrt(F.col("aum") * F.abs("alpha") / F.col("adv"))) * 252).alias("impact_annual"))


@query("inverse_variance_model_weights", f"""WITH {LONG_SQL}, m AS (SELECT factor_name, greatest(avg(ric), 0) / greatest(var_samp(ric), 1e-12) AS raw FROM ic GROUP BY 1)
SELECT factor_name, {tidy_sql("CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 1.0 / count(*) OVER () END")} AS weight FROM m""")
def inverse_variance_model_weights(spark, root):
    m = long_ic(spark, root).groupBy("factor_name").agg((F.greatest(F.avg("ic"), F.lit(0.0)) / F.greatest(F.var_samp("ic"), F.lit(1e-12))).alias("raw"))
    return m.select("factor_name", tidy(E.normalised(F.col("raw"))).alias("weight"))
