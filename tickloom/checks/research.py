"""Sectors, flows, evidence, text and fundamentals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.checks.panels import PANEL_SQL, factor_panel
from tickloom.checks.normal_sql import normal_sql
from tickloom.checks.registry import query
from tickloom.functions.columns import tidy
from tickloom.operators import evidence as EV
from tickloom.operators import flows as FL
from tickloom.operators import fundamentals as FU
from tickloom.operators import pit
from tickloom.operators import sectors as SE
from tickloom.plans.inputs import BARS_SQL, SECTORS_SQL, STATEMENTS_SQL, bars, sectors, statements, table, tidy_sql

W = "OVER (PARTITION BY symbol ORDER BY trade_date)"


def t(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def cells(*names):
    return ", ".join(f"{tidy_sql(n)} AS {n}" for n in names)


def with_sector(spark, root):
    """Bars by region: with 25 nations a few names each, the coarse label keeps five members a day."""
    return bars(spark, root).join(sectors(spark, root).select("symbol", F.col("concept").alias("sector")), "symbol")


SB_SQL = f"{BARS_SQL}, {SECTORS_SQL}, sb AS (SELECT b.*, s.concept AS sector FROM bars b JOIN sectors s USING (symbol))"


def full(x, n, least, fn="avg", part="symbol"):
    fr = f"OVER (PARTITION BY {part} ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {fr} >= {least} THEN {fn}({x}) {fr} END"


SP_SQL = f"""{SB_SQL}, m AS (SELECT *, close / lag(close) {W} - 1 AS ret, greatest(coalesce(lag(amount) {W}, 0), 0) AS al, (close > {full('close', 20, 20)})::INT AS a20, (close > {full('close', 60, 60)})::INT AS a60, (close >= 0.999 * {full('close', 60, 60, 'max')})::INT AS hi FROM sb),
sp AS (SELECT trade_date, sector, avg(ret) AS ret_eqw, CASE WHEN sum(al) > 0 THEN sum(ret * al) / sum(al) ELSE avg(ret) END AS ret_amtw, sum(amount) AS amount, count(*) AS n_members, avg((ret > 0)::INT) AS breadth_up, avg(a20) AS breadth_ma20, avg(a60) AS breadth_ma60, avg(hi) AS breadth_high60
 FROM m WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)"""


@query("sector_daily_panel", f"WITH {SP_SQL} SELECT trade_date, sector, n_members, {cells('ret_eqw', 'ret_amtw', 'amount', 'breadth_up', 'breadth_ma20', 'breadth_ma60', 'breadth_high60')} FROM sp")
def sector_daily_panel(spark, root):
    return t(SE.sector_panel(with_sector(spark, root), 3), "ret_eqw", "ret_amtw", "amount", "breadth_up", "breadth_ma20", "breadth_ma60", "breadth_high60")


@query("sector_signals", f"""WITH {SP_SQL}, e AS (SELECT *, ln(1 + greatest(ret_eqw, -0.99)) AS lr, ret_eqw - avg(ret_eqw) OVER (PARTITION BY trade_date) AS ex FROM sp),
s AS (SELECT *, exp({full('lr', 20, 10, 'sum', 'sector')}) - 1 AS mom_20, {full('ret_eqw', 20, 10, 'stddev_samp', 'sector')} AS vol_20, {full('ex', 20, 10, 'sum', 'sector')} AS rs_20, exp({full('lr', 60, 30, 'sum', 'sector')}) - 1 AS mom_60, {full('ret_eqw', 60, 30, 'stddev_samp', 'sector')} AS vol_60,
 {full('ex', 60, 30, 'sum', 'sector')} AS rs_60, 1 + coalesce(exp({full('lr', 252, 20, 'sum', 'sector')}) - 1, 0) AS nav, ({full('amount', 5, 3, 'avg', 'sector')}) / (({full('amount', 20, 10, 'avg', 'sector')}) + 1e-9) - 1 AS amt_accel FROM e),
d AS (SELECT *, nav / max(nav) OVER (PARTITION BY sector ORDER BY trade_date) - 1 AS drawdown, mom_60 / (vol_60 * sqrt(60) + 1e-9) AS rmom_60 FROM s) SELECT trade_date, sector, {cells('mom_20', 'vol_20', 'rs_20', 'mom_60', 'vol_60', 'rs_60', 'amt_accel', 'drawdown', 'rmom_60')} FROM d""")
def sector_signals(spark, root):
    cols = ["mom_20", "vol_20", "rs_20", "mom_60", "vol_60", "rs_60", "amt_accel", "drawdown", "rmom_60"]
    return t(SE.sector_signals(SE.sector_panel(with_sector(spark, root), 3)), *cols).select("trade_date", "sector", *cols)


ROT_SQL = f"""{SB_SQL}, m AS (SELECT *, close / lag(close) {W} - 1 AS r, (close - open) / nullif(open, 0) * amount AS f FROM sb),
d AS (SELECT trade_date, sector, avg(r) AS ret, sum(r) AS rs, count(r) AS rn, sum(amount) AS amt, sum(f) AS flow, avg((coalesce(r, 0) > 0)::INT) AS sector_breadth, sum((coalesce(r, 0) >= 0.03)::INT)::BIGINT AS sector_limit_up_count, avg((coalesce(r, 0) >= 0.03)::INT) AS sector_limit_up_ratio FROM m GROUP BY ALL),
e AS (SELECT *, ret - CASE WHEN sum(rn) OVER g > 0 THEN sum(rs) OVER g / sum(rn) OVER g END AS rel, amt / nullif(sum(amt) OVER g, 0) AS sector_turnover_share, flow / nullif(sum(abs(flow)) OVER g, 0) AS sector_money_flow_share FROM d WINDOW g AS (PARTITION BY trade_date)),
rot AS (SELECT *, {full('ret', 20, 20, 'avg', 'sector')} AS sector_return_strength, {full('rel', 20, 20, 'avg', 'sector')} AS sector_relative_strength, amt / nullif({full('amt', 20, 20, 'avg', 'sector')}, 0) AS sector_volume_expansion FROM e)"""


@query("sector_rotation_inputs", f"WITH {ROT_SQL} SELECT trade_date, sector, sector_limit_up_count, {cells(*SE.ROTATION)} FROM rot")
def sector_rotation_inputs(spark, root):
    return t(SE.rotation_inputs(with_sector(spark, root)), *SE.ROTATION)


@query("sector_rotation_score", f"""WITH {ROT_SQL}, r9 AS (SELECT trade_date, sector, {', '.join(f'round({c}, 9) AS {c}' for c in SE.ROTATION)} FROM rot), z AS (SELECT trade_date, sector, {', '.join(f"CASE WHEN stddev_pop({c}) OVER g > 1e-12 THEN ({c} - avg({c}) OVER g) / stddev_pop({c}) OVER g END AS {c}" for c in SE.ROTATION)} FROM r9 WINDOW g AS (PARTITION BY trade_date))
SELECT trade_date, sector, round(({' + '.join(f'coalesce({c}, 0)' for c in SE.ROTATION)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in SE.ROTATION)}, 0), 4) + 0.0 AS rotation_score FROM z""")
def sector_rotation_score(spark, root):
    i = SE.rotation_inputs(with_sector(spark, root))
    i = i.withColumns({c: F.round(c, 9) for c in SE.ROTATION})
    return SE.rotation_score(i).select("trade_date", "sector", (F.round("rotation_score", 4) + F.lit(0.0)).alias("rotation_score"))


@query("sector_heat", f"""WITH {SB_SQL}, m AS (SELECT *, close / lag(close, 5) {W} - 1 AS r5, close / lag(close, 20) {W} - 1 AS r20, close / lag(close, 60) {W} - 1 AS r60, close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS h FROM sb WHERE trade_date <= DATE '2000-06-30'),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1), d AS (SELECT sector, median(r5) AS ret_5d, median(r20) AS ret_20d, median(r60) AS ret_60d, median(h) AS pct_from_high, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT *, CASE WHEN stddev_samp(ret_60d) OVER () > 1e-12 THEN (ret_60d - avg(ret_60d) OVER ()) / stddev_samp(ret_60d) OVER () ELSE 0 END + CASE WHEN stddev_samp(pct_from_high) OVER () > 1e-12 THEN (pct_from_high - avg(pct_from_high) OVER ()) / stddev_samp(pct_from_high) OVER () ELSE 0 END AS heat, ret_5d - ret_20d / 4 AS accel FROM d),
c AS (SELECT quantile_cont(heat, 0.66) AS hi, quantile_cont(heat, 0.33) AS lo FROM e), f AS (SELECT *, -0.6 * (CASE WHEN stddev_samp(heat) OVER () > 1e-12 THEN (heat - avg(heat) OVER ()) / stddev_samp(heat) OVER () ELSE 0 END) + 0.4 * (CASE WHEN stddev_samp(accel) OVER () > 1e-12 THEN (accel - avg(accel) OVER ()) / stddev_samp(accel) OVER () ELSE 0 END) AS rotation_score, CASE WHEN heat > hi THEN 'high' WHEN heat < lo THEN 'low' ELSE 'middle' END AS regime_tag FROM e, c)
SELECT sector, n, {cells('ret_5d', 'ret_20d', 'ret_60d', 'pct_from_high', 'heat', 'accel', 'rotation_score')}, regime_tag, CASE WHEN regime_tag = 'low' AND accel > 0 THEN 'low_turning_in' WHEN regime_tag = 'high' AND accel < 0 THEN 'high_fading_out' ELSE 'watch' END AS rotation_tag FROM f""")
def sector_heat(spark, root):
    return t(SE.sector_heat(with_sector(spark, root), "2000-06-30"), "ret_5d", "ret_20d", "ret_60d", "pct_from_high", "heat", "accel", "rotation_score")


@query("sector_tier_pool", f"""WITH {PANEL_SQL}, {SECTORS_SQL}, i AS (SELECT sector, round(corr(mom, fwd5), 8) AS ic FROM panel JOIN sectors USING (symbol) WHERE mom IS NOT NULL AND fwd5 IS NOT NULL GROUP BY sector),
p AS (SELECT *, (rank() OVER (ORDER BY ic) + (count(*) OVER (PARTITION BY ic) - 1) / 2.0) / count(*) OVER () AS p FROM i), c AS (SELECT sector, ic, CASE WHEN p >= 0.7 AND ic > 0 THEN 'core' WHEN p <= 0.3 OR ic <= 0 THEN 'avoid' ELSE 'satellite' END AS tier FROM p)
SELECT sector, {tidy_sql('ic')} AS ic, tier, CASE tier WHEN 'core' THEN 1.0 WHEN 'satellite' THEN 0.5 ELSE 0.0 END::DOUBLE AS tier_weight FROM c""")
def sector_tier_pool(spark, root):
    from tickloom.operators.evaluate import pearson

    p = factor_panel(spark, root).join(sectors(spark, root).select("symbol", "sector"), "symbol").where("mom is not null and fwd5 is not null")
    return t(SE.tier_pool(p.groupBy("sector").agg(F.round(pearson("mom", "fwd5"), 8).alias("ic")), "ic"), "ic")


@query("decision_axis_blend", f"""WITH {SP_SQL}, u AS (SELECT trade_date, sector, {', '.join(f"({c} - min({c}) OVER g) / nullif(max({c}) OVER g - min({c}) OVER g, 0) AS {c}" for c in ('ret_eqw', 'amount', 'breadth_ma60'))} FROM (SELECT trade_date, sector, round(ret_eqw, 9) AS ret_eqw, round(amount, 4) AS amount, round(breadth_ma60, 9) AS breadth_ma60 FROM sp) WINDOW g AS (PARTITION BY trade_date))
SELECT trade_date, sector, {tidy_sql("(0.5 * coalesce(ret_eqw, 0) + 0.3 * coalesce(amount, 0) + 0.2 * coalesce(breadth_ma60, 0)) / nullif(0.5 * (ret_eqw IS NOT NULL)::INT + 0.3 * (amount IS NOT NULL)::INT + 0.2 * (breadth_ma60 IS NOT NULL)::INT, 0)")} AS axis_score,
 {tidy_sql("0.5 * (ret_eqw IS NOT NULL)::INT + 0.3 * (amount IS NOT NULL)::INT + 0.2 * (breadth_ma60 IS NOT NULL)::INT")} AS confidence FROM u""")
def decision_axis_blend(spark, root):
    p = SE.sector_panel(with_sector(spark, root), 3).select("trade_date", "sector", F.round("ret_eqw", 9).alias("ret_eqw"), F.round("amount", 4).alias("amount"), F.round("breadth_ma60", 9).alias("breadth_ma60"))
    return t(SE.blend_axes(p, {"ret_eqw": 0.5, "amount": 0.3, "breadth_ma60": 0.2}, "trade_date"), "axis_score", "confidence").select("trade_date", "sector", "axis_score", "confidence")


# -- flows ---------------------------------------------------------------------------------

FLOW_SQL = f"""{BARS_SQL}, raw_flow AS (SELECT trade_date, symbol, 'main_money_flow' AS source, (close - open) * volume AS net FROM bars UNION ALL SELECT trade_date, symbol, 'margin_financing', amount - lag(amount) {W} FROM bars),
fl AS (SELECT trade_date, symbol, source, net, greatest(net, 0) AS buy, greatest(-net, 0) AS sell FROM raw_flow),
ff AS (SELECT *, (net - avg(net) OVER w) / nullif(stddev_samp(net) OVER w, 0) AS z, count(net) OVER w >= 5 AS ok, net - lag(net) OVER o AS flow_acceleration, avg(sign(net)) OVER w AS pers, -(net - lag(net, 20) OVER o) AS flow_reversal, abs(net) / nullif(sum(abs(net)) OVER (PARTITION BY trade_date, source), 0) AS flow_concentration, (buy - sell) / nullif(buy + sell, 0) AS institution_retail_imbalance
 FROM fl WINDOW o AS (PARTITION BY source, symbol ORDER BY trade_date), w AS (PARTITION BY source, symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
feat AS (SELECT *, CASE WHEN ok THEN z END AS flow_zscore, CASE WHEN ok THEN pers END AS flow_persistence, CASE WHEN ok THEN z END * flow_concentration AS large_order_pressure FROM ff)"""


def flow_frame(spark, root):
    b = bars(spark, root)
    main = FL.normalise_flow(b.withColumn("v", (F.col("close") - F.col("open")) * F.col("volume")), "main_money_flow", "v")
    return FL.flow_features(main.unionByName(FL.normalise_flow(b, "margin_financing", "amount")))


@query("flow_features", f"WITH {FLOW_SQL} SELECT trade_date, symbol, source, {cells('flow_zscore', 'flow_acceleration', 'flow_persistence', 'flow_reversal', 'flow_concentration', 'institution_retail_imbalance', 'large_order_pressure')} FROM feat")
def flow_features(spark, root):
    cols = ["flow_zscore", "flow_acceleration", "flow_persistence", "flow_reversal", "flow_concentration", "institution_retail_imbalance", "large_order_pressure"]
    return t(flow_frame(spark, root), *cols).select("trade_date", "symbol", "source", *cols)


@query("flow_signals", f"""WITH {FLOW_SQL}, l AS (SELECT *, coalesce(flow_zscore, 0) AS zz, coalesce(large_order_pressure, 0) AS pp FROM feat QUALIFY row_number() OVER (PARTITION BY source, symbol ORDER BY trade_date DESC) = 1)
SELECT source, symbol, trade_date, {tidy_sql("tanh(0.6 * zz + 4 * pp)")} AS score, {tidy_sql("least(abs(tanh(0.6 * zz + 4 * pp)), 1)")} AS confidence, CASE source WHEN 'main_money_flow' THEN 0.6 ELSE 0.65 END::DOUBLE AS evidence_quality FROM l WHERE abs(zz) >= 1 OR abs(pp) >= 0.05""")
def flow_signals(spark, root):
    return t(FL.flow_signals(flow_frame(spark, root)), "score", "confidence")


# -- evidence and text ---------------------------------------------------------------------

TIERS = [(1, "src1", "official", 0.95), (2, "src2", "major", 0.8), (3, "src", "minor", 0.6)]


@query("source_credibility", """WITH tiers(rank, keyword, tier, weight) AS (VALUES (1, 'src1', 'official', 0.95::DOUBLE), (2, 'src2', 'major', 0.8::DOUBLE), (3, 'src', 'minor', 0.6::DOUBLE))
SELECT doc_id, source, (SELECT arg_min(tier, rank) FROM tiers WHERE contains(source, keyword)) AS source_tier, (SELECT arg_min(weight, rank) FROM tiers WHERE contains(source, keyword)) AS credibility FROM documents""")
def source_credibility(spark, root):
    tiers = spark.createDataFrame(TIERS, "rank int, keyword string, tier string, weight double")
    return EV.credibility(table(spark, root, "documents").select("doc_id", "source"), "source", tiers)


@query("news_cross_validation", """WITH d AS (SELECT lang, source, text, TIMESTAMP '2024-01-01 09:00:00' + to_minutes(doc_id * 7) AS seen, CAST(substr(source, 4) AS INT) AS rank, source IN ('src1', 'src2') AS p, contains(text, 'not') AS r, contains(text, '?') AS m FROM documents)
SELECT lang, count(*) AS rows, count(DISTINCT source) AS confirming_sources, sum(p::INT)::BIGINT AS primary_confirmations, sum(r::INT)::BIGINT AS contradictions, count(*) - count(DISTINCT text) AS reposts, min((hour(seen) >= 15)::INT) = 1 AS after_close_only, round(avg(m::INT), 9) AS rumour_share, arg_min(source, rank) AS best_source, min(seen) AS first_seen, max(seen) AS last_seen FROM d GROUP BY lang""")
def news_cross_validation(spark, root):
    d = table(spark, root, "documents").select(
        "lang", "source", "text", F.timestamp_micros(F.lit(1704099600000000) + F.col("doc_id") * 7 * 60 * 1000000).alias("at"), F.expr("substring(source, 4)").cast("int").alias("rank"))
    out = EV.cross_validate(d, ["lang"], "source", "text", "at", "rank", F.col("source").isin("src1", "src2"), F.col("text").contains("not"), F.col("text").contains("?"))
    return out.withColumn("rumour_share", F.round("rumour_share", 9))


THEMES = {"energy": ["the", "then"], "water": ["eau", "agua"], "iron": ["eisen", "und"]}


@query("theme_tags", """WITH d AS (SELECT doc_id, lower(text) AS x FROM documents) SELECT doc_id, list_filter([CASE WHEN contains(x, 'the') OR contains(x, 'then') THEN 'energy' END, CASE WHEN contains(x, 'eau') OR contains(x, 'agua') THEN 'water' END, CASE WHEN contains(x, 'eisen') OR contains(x, 'und') THEN 'iron' END], lambda v: v IS NOT NULL) AS themes FROM d""")
def theme_tags(spark, root):
    return EV.tag_themes(table(spark, root, "documents"), "text", THEMES).select("doc_id", "themes")


@query("theme_mentions", """WITH d AS (SELECT doc_id, source, lower(text) AS x FROM documents), l AS (SELECT unnest(list_filter([CASE WHEN contains(x, 'the') OR contains(x, 'then') THEN 'energy' END, CASE WHEN contains(x, 'eau') OR contains(x, 'agua') THEN 'water' END, CASE WHEN contains(x, 'eisen') OR contains(x, 'und') THEN 'iron' END], lambda v: v IS NOT NULL)) AS theme, source FROM d)
SELECT theme, count(*) AS documents, count(DISTINCT source) AS sources FROM l GROUP BY theme""")
def theme_mentions(spark, root):
    d = EV.tag_themes(table(spark, root, "documents"), "text", THEMES).select("source", F.explode("themes").alias("theme"))
    return d.groupBy("theme").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))


@query("evidence_ids", """SELECT doc_id, sha256(concat_ws(chr(10), source, lang, CAST(doc_id AS VARCHAR))) AS evidence_id, sha256(text) AS raw_hash FROM documents""")
def evidence_ids(spark, root):
    return table(spark, root, "documents").select("doc_id", EV.stable_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("evidence_id"), F.sha2("text", 256).alias("raw_hash"))


@query("evidence_upsert", """WITH b AS (SELECT doc_id % 97 AS k, doc_id AS version, source FROM documents) SELECT k, version, source FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC) = 1""")
def evidence_upsert(spark, root):
    b = table(spark, root, "documents").select((F.col("doc_id") % 97).alias("k"), F.col("doc_id").alias("version"), "source")
    early = b.where(F.col("source") < "src5")
    return EV.upsert(early, b.where(F.col("source") >= "src5"), ["k"], "version")


LAG_SQL = f"""{SP_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session FROM (SELECT DISTINCT trade_date FROM bars)), r AS (SELECT trade_date, sector, ret_eqw - avg(ret_eqw) OVER (PARTITION BY trade_date) AS excess FROM sp),
ev AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'other' END AS theme, r_name AS sector, CAST(o_orderdate AS DATE) AS d, 1 + o_orderkey % 5 AS w FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
h AS (SELECT ev.theme, k.lag, ev.w, r.excess FROM ev JOIN cal c ON c.trade_date = ev.d CROSS JOIN (SELECT unnest([1, 2, 3]) AS lag) k JOIN cal c2 ON c2.session = c.session + k.lag JOIN r ON r.trade_date = c2.trade_date AND r.sector = ev.sector WHERE excess IS NOT NULL),
curve AS (SELECT theme, CAST(lag AS INT) AS lag, count(*) AS events, sum(w * excess) / sum(w) * count(*) / (count(*) + 5) AS shrunk_excess FROM h GROUP BY theme, lag)"""


def policy_curve(spark, root):
    theme = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("other")
    places = table(spark, root, "nation").join(table(spark, root, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    buyers = table(spark, root, "customer").join(places, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    ev = table(spark, root, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        theme.alias("theme"), F.col("r_name").alias("sector"), F.to_date("o_orderdate").alias("event_date"), (1 + F.col("o_orderkey") % 5).cast("double").alias("strength"))
    p = SE.sector_panel(with_sector(spark, root), 3)
    r = p.select("trade_date", "sector", (F.col("ret_eqw") - F.avg("ret_eqw").over(Window.partitionBy("trade_date"))).alias("excess"))
    return EV.lag_curve(ev, r, pit.session_index(bars(spark, root)), 3)


@query("policy_lag_curve", f"WITH {LAG_SQL} SELECT theme, lag, events, {tidy_sql('shrunk_excess')} AS shrunk_excess FROM curve")
def policy_lag_curve(spark, root):
    return t(policy_curve(spark, root), "shrunk_excess")


@query("policy_peak_lag", f"WITH {LAG_SQL} SELECT theme, lag AS peak_lag FROM curve QUALIFY row_number() OVER (PARTITION BY theme ORDER BY round(abs(shrunk_excess), 12) DESC, lag) = 1")
def policy_peak_lag(spark, root):
    return EV.peak_lag(policy_curve(spark, root))


@query("evidence_posterior", f"""WITH e AS (SELECT source AS scope_value, lang AS independence_key, least(greatest(n_chars / 5000.0, 0), 1)::DOUBLE AS s, 0.5 + (doc_id % 5) / 10.0 AS rel, TIMESTAMP '2024-01-01 09:00:00' + to_hours(doc_id % 900) AS seen FROM documents),
c AS (SELECT scope_value, independence_key, max(s * rel * pow(0.5, datediff('day', CAST(seen AS DATE), DATE '2024-02-01') / 20.0)) AS c FROM e WHERE seen <= TIMESTAMP '2024-02-01 00:00:00' GROUP BY ALL)
SELECT 'source' AS scope, scope_value, count(*) AS independent_keys, {tidy_sql("1 / (1 + exp(-(ln(0.1 / 0.9) + 2.5 * sum(c))))")} AS posterior, count(*) >= 2 AS usable FROM c GROUP BY scope_value""")
def evidence_posterior(spark, root):
    e = table(spark, root, "documents").select(
        F.lit("source").alias("scope"), F.col("source").alias("scope_value"), F.col("lang").alias("independence_key"), (F.col("n_chars") / 5000.0).alias("strength"),
        (0.5 + (F.col("doc_id") % 5) / 10.0).alias("reliability"), F.timestamp_micros(F.lit(1704099600000000) + (F.col("doc_id") % 900) * 3600 * 1000000).alias("available_at"))
    return t(EV.posterior(e, F.lit("2024-02-01").cast("timestamp")), "posterior")


@query("capital_flow_thesis", f"""WITH e AS (SELECT 'source' AS kind, source AS value, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END * (0.5 + doc_id % 4 / 4.0) * (n_chars % 100) / 100.0 * greatest((doc_id % 10) / 10.0, 0.05) AS s, (doc_id % 10) / 10.0 AS conf FROM documents),
g AS (SELECT kind, value, sum(s) AS score, sum(abs(s)) AS m, coalesce(sum(s) FILTER (s > 0), 0) AS p, count(*) FILTER (s > 0) AS np, count(*) FILTER (s < 0) AS nn, avg(conf) AS conf FROM e GROUP BY ALL)
SELECT kind, value, {tidy_sql('score')} AS score, CASE WHEN score >= 0 THEN np ELSE nn END AS support, {tidy_sql('CASE WHEN score >= 0 THEN m - p ELSE p END / nullif(m, 0)')} AS contradiction, {tidy_sql('conf')} AS confidence, CASE WHEN conf < 0.3 THEN 'rejected' ELSE 'active' END AS status FROM g WHERE CASE WHEN score >= 0 THEN np ELSE nn END >= 2""")
def capital_flow_thesis(spark, root):
    e = table(spark, root, "documents").select(
        F.lit("source").alias("kind"), F.col("source").alias("value"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(1).alias("direction"), (0.5 + (F.col("doc_id") % 4) / 4.0).alias("prior"),
        ((F.col("n_chars") % 100) / 100.0).alias("strength"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), "doc_id")
    return t(EV.thesis(e, order="doc_id"), "score", "contradiction", "confidence")


@query("canonical_urls", """WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: coalesce(string_split(x, '=')[2], '') <> '' AND lower(string_split(x, '=')[1]) NOT IN ('spm', 'from', 'source', 'share', 'share_token', 'fbclid', 'gclid') AND NOT starts_with(lower(x), 'utm_'))) AS kept FROM p)
SELECT page_id, lower(s) || '://' || lower(h) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k""")
def canonical_urls(spark, root):
    return table(spark, root, "pages").select("page_id", EV.canonical_url(F.col("url")).alias("canonical"))


@query("page_documents", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS links,
 trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_documents(spark, root):
    return EV.page_fields(table(spark, root, "pages")).select("page_id", "title", F.size("links").cast("long").alias("links"), "text")


@query("announcement_classes", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'the|then') THEN 'order' WHEN regexp_matches(lower(text), 'que|eau') THEN 'buyback' WHEN regexp_matches(lower(text), 'und') THEN 'litigation' ELSE 'other' END AS class FROM conversations""")
def announcement_classes(spark, root):
    x = F.lower("text")
    return table(spark, root, "conversations").select("conv_id", "turn", F.when(x.rlike("the|then"), "order").when(x.rlike("que|eau"), "buyback").when(x.rlike("und"), "litigation").otherwise("other").alias("class"))


# -- fundamentals --------------------------------------------------------------------------

FW = "OVER (PARTITION BY symbol ORDER BY report_period)"
GROW = ["revenue_ttm", "revenue_change", "revenue_qoq", "revenue_yoy"]


@query("statement_growth", f"""WITH {STATEMENTS_SQL}, g AS (SELECT symbol, report_period, CASE WHEN count(revenue) OVER f = 4 THEN sum(revenue) OVER f END AS revenue_ttm, revenue - lag(revenue) {FW} AS revenue_change, (revenue - lag(revenue) {FW}) / nullif(abs(lag(revenue) {FW}), 0) AS revenue_qoq, (revenue - lag(revenue, 4) {FW}) / nullif(abs(lag(revenue, 4) {FW}), 0) AS revenue_yoy
 FROM statements WINDOW f AS (PARTITION BY symbol ORDER BY report_period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT symbol, report_period, {cells(*GROW)} FROM g""")
def statement_growth(spark, root):
    return t(FU.report_growth(statements(spark, root), ["revenue"]), *GROW).select("symbol", "report_period", *GROW)


METRICS = ["gross_margin", "roe", "roic", "debt_to_asset", "cash_to_income", "net_margin", "asset_turnover", "leverage", "dupont_roe"]
MET_SQL = f"""{STATEMENTS_SQL}, met AS (SELECT *, (revenue - cost) / nullif(revenue, 0) AS gross_margin, (revenue - cost) / nullif(assets - debt, 0) AS roe, (revenue - cost) * 0.75 / nullif(assets - debt + debt, 0) AS roic, debt / nullif(assets, 0) AS debt_to_asset, cash / nullif(revenue - cost, 0) AS cash_to_income, (revenue - cost) / nullif(revenue, 0) AS net_margin, revenue / nullif(assets, 0) AS asset_turnover, assets / nullif(assets - debt, 0) AS leverage,
 (revenue - cost) / nullif(revenue, 0) * (revenue / nullif(assets, 0)) * (assets / nullif(assets - debt, 0)) AS dupont_roe FROM statements)"""


@query("statement_metrics", f"WITH {MET_SQL} SELECT symbol, report_period, {cells(*METRICS)} FROM met")
def statement_metrics(spark, root):
    return t(FU.key_metrics(statements(spark, root)), *METRICS).select("symbol", "report_period", *METRICS)


def _report_columns():
    """Statement columns under the names the scores ask for."""
    rev, cost, cash, assets, debt, n = (F.col(c).cast("double") for c in ("revenue", "cost", "cash", "assets", "debt", "orders"))
    return {
        "net_income": rev - cost, "operating_cash_flow": cash, "roa": F.try_divide(rev - cost, assets), "leverage": F.try_divide(debt, assets), "current_ratio": F.try_divide(cash, debt), "shares": n,
        "gross_margin": F.try_divide(rev - cost, rev), "asset_turnover": F.try_divide(rev, assets), "receivables": rev - cash, "revenue": rev, "sales": rev, "cogs": cost, "inventory": debt,
        "total_assets": assets, "current_assets": cash / 4, "ppe": debt / 2, "depreciation": n, "sga": cost / 2, "capex": debt - cash, "short_term_debt": debt, "cash": cash,
    }


@query("piotroski_score", f"""WITH {STATEMENTS_SQL}, p AS (SELECT symbol, report_period, revenue - cost AS inc, cash, (revenue - cost) / nullif(assets, 0) AS roa, debt / nullif(assets, 0) AS lev, cash / nullif(debt, 0) AS cur, orders, (revenue - cost) / nullif(revenue, 0) AS gm, revenue / nullif(assets, 0) AS turn FROM statements),
s AS (SELECT symbol, report_period, {' + '.join(f'coalesce({c}, false)::INT' for c in ('inc > 0', 'cash > 0', f'roa > lag(roa) {FW}', 'cash > inc', f'lev < lag(lev) {FW}', f'cur > lag(cur) {FW}', f'orders <= lag(orders) {FW}', f'gm > lag(gm) {FW}', f'turn > lag(turn) {FW}'))} AS f_score FROM p)
SELECT symbol, report_period, f_score, {tidy_sql('f_score / 9.0 * 100')} AS f_score_100 FROM s""")
def piotroski_score(spark, root):
    return t(FU.piotroski(statements(spark, root), _report_columns()), "f_score_100").select("symbol", "report_period", "f_score", "f_score_100")


@query("beneish_m_score", f"""WITH {STATEMENTS_SQL}, b AS (SELECT symbol, report_period, revenue, assets, (revenue - cash) / nullif(revenue, 0) AS recv, (revenue - cost) / nullif(revenue, 0) AS gm, 1 - (cash / 4 + debt / 2) / nullif(assets, 0) AS soft, orders / nullif(orders + debt / 2, 0) AS wear, cost / 2 / nullif(revenue, 0) AS sga, debt / nullif(assets, 0) AS lev, (revenue - cost - cash) / nullif(assets, 0) AS tata FROM statements),
m AS (SELECT symbol, report_period, CASE WHEN revenue > 0 AND lag(revenue) {FW} > 0 AND assets > 0 AND lag(assets) {FW} > 0 THEN -4.84 + 0.92 * (recv / nullif(lag(recv) {FW}, 0)) + 0.528 * (lag(gm) {FW} / nullif(gm, 0)) + 0.404 * (soft / nullif(lag(soft) {FW}, 0)) + 0.892 * (revenue / nullif(lag(revenue) {FW}, 0)) + 0.115 * (lag(wear) {FW} / nullif(wear, 0)) - 0.172 * (sga / nullif(lag(sga) {FW}, 0)) + 4.679 * tata - 0.327 * (lev / nullif(lag(lev) {FW}, 0)) END AS m_score FROM b)
SELECT symbol, report_period, {cells('m_score')}, {tidy_sql("CASE WHEN m_score IS NULL THEN 50.0 WHEN m_score >= -1.78 THEN least(99.0, 70.0 + (m_score + 1.78) * 20.0) ELSE greatest(1.0, 50.0 + (m_score + 1.78) * 20.0) END")} AS fraud_percentile FROM m""")
def beneish_m_score(spark, root):
    m = FU.beneish_m(statements(spark, root), _report_columns())
    return t(m.withColumn("fraud_percentile", FU.fraud_percentile(F.col("m_score"))), "m_score", "fraud_percentile").select("symbol", "report_period", "m_score", "fraud_percentile")


@query("altman_z", f"""WITH {STATEMENTS_SQL} SELECT symbol, report_period, {tidy_sql("1.2 * (cash - debt) / assets + 1.4 * cash / assets + 3.3 * (revenue - cost) / assets + 0.6 * (assets - debt) / nullif(debt, 0) + revenue / assets")} AS z FROM statements""")
def altman(spark, root):
    s = statements(spark, root)
    z = FU.altman_z(F.col("cash") - F.col("debt"), F.col("cash"), F.col("revenue") - F.col("cost"), F.col("assets") - F.col("debt"), F.col("debt"), F.col("revenue"), F.col("assets"))
    return s.select("symbol", "report_period", tidy(z).alias("z"))


def _all_rank(c):
    tie = f"round_even({c} * 1e10, 0)"
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {tie} NULLS LAST) + (count(*) OVER (PARTITION BY {tie}) - 1) / 2.0) / count({c}) OVER () END"


@query("forensic_ratios", f"""WITH {STATEMENTS_SQL}, g AS (SELECT symbol, report_period, ((revenue - cash) / nullif(lag(revenue - cash) {FW}, 0) - 1) - (revenue / nullif(lag(revenue) {FW}, 0) - 1) AS receivable_gap, (debt / nullif(lag(debt) {FW}, 0) - 1) - (cost / nullif(lag(cost) {FW}, 0) - 1) AS inventory_gap,
 (revenue - cost - cash) / nullif(assets, 0) AS accrual_ratio, -(cash / nullif(revenue - cost, 0)) AS cfo_shortfall, abs(debt - cash) / nullif(cash, 0) AS capex_pressure, 0.0::DOUBLE / nullif(assets, 0) AS goodwill_risk, debt / nullif(cash, 0) AS debt_pressure, NULL::DOUBLE AS related_party_risk FROM statements),
r AS (SELECT *, {', '.join(f'{_all_rank(c)} AS p_{i}' for i, c in enumerate(FU.FORENSIC))} FROM g)
SELECT symbol, report_period, {cells(*FU.FORENSIC)}, round(list_avg([{', '.join(f'p_{i}' for i in range(8))}]), 4) + 0.0 AS fraud_risk_composite FROM r""")
def forensic_ratios(spark, root):
    out = t(FU.forensic(statements(spark, root), _report_columns()), *FU.FORENSIC)
    return out.select("symbol", "report_period", *FU.FORENSIC, (F.round("fraud_risk_composite", 4) + F.lit(0.0)).alias("fraud_risk_composite"))


def metrics_by_segment(spark, root):
    m = FU.key_metrics(statements(spark, root))
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("bucket"))
    return m.join(c, "symbol").select("symbol", "report_period", "bucket", F.round("roe", 9).alias("roe"), F.round("debt_to_asset", 9).alias("debt_to_asset"))


SEG_SQL = f"{MET_SQL}, seg AS (SELECT symbol, report_period, c_mktsegment AS bucket, round(roe, 9) AS roe, round(debt_to_asset, 9) AS debt_to_asset FROM met JOIN customer ON c_custkey = symbol)"


def _pr(c):
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY report_period, bucket ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY report_period, bucket, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY report_period, bucket) END"


@query("bucket_fundamental_rank", f"""WITH {SEG_SQL}, r AS (SELECT symbol, report_period, {_pr('roe')} AS a, 1 - {_pr('debt_to_asset')} AS b FROM seg)
SELECT symbol, report_period, {tidy_sql('a')} AS roe_rank, {tidy_sql('b')} AS debt_to_asset_rank, {tidy_sql('(0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0)) / nullif(0.6 * (a IS NOT NULL)::INT + 0.4 * (b IS NOT NULL)::INT, 0)')} AS composite FROM r""")
def bucket_fundamental_rank(spark, root):
    out = FU.bucket_rank(metrics_by_segment(spark, root), {"roe": (0.6, 1), "debt_to_asset": (0.4, -1)}, ["report_period", "bucket"])
    return t(out, "roe_rank", "debt_to_asset_rank", "composite").select("symbol", "report_period", "roe_rank", "debt_to_asset_rank", "composite")


@query("normal_fundamental_axes", f"""WITH {SEG_SQL}, q AS (SELECT report_period, bucket, quantile_cont(roe, 0.01) AS al, quantile_cont(roe, 0.99) AS ah, quantile_cont(debt_to_asset, 0.01) AS bl, quantile_cont(debt_to_asset, 0.99) AS bh FROM seg GROUP BY ALL),
k AS (SELECT symbol, report_period, bucket, CASE WHEN roe IS NOT NULL THEN least(greatest(roe, al), ah) END AS a, CASE WHEN debt_to_asset IS NOT NULL THEN least(greatest(debt_to_asset, bl), bh) END AS b FROM seg JOIN q USING (report_period, bucket)),
z AS (SELECT symbol, report_period, CASE WHEN stddev_pop(a) OVER w > 1e-12 THEN (a - avg(a) OVER w) / stddev_pop(a) OVER w END AS za, CASE WHEN stddev_pop(b) OVER w > 1e-12 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w END AS zb FROM k WINDOW w AS (PARTITION BY report_period, bucket)),
p AS (SELECT symbol, report_period, CASE WHEN za IS NOT NULL THEN {normal_sql('za')} END AS a, CASE WHEN zb IS NOT NULL THEN 1 - ({normal_sql('zb')}) END AS b FROM z)
SELECT symbol, report_period, round((0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0)) / nullif(0.6 * (a IS NOT NULL)::INT + 0.4 * (b IS NOT NULL)::INT, 0), 6) AS composite FROM p""")
def normal_fundamental_axes(spark, root):
    out = FU.normal_axes(metrics_by_segment(spark, root), {"roe": (0.6, 1), "debt_to_asset": (0.4, -1)}, ["report_period", "bucket"])
    return out.select("symbol", "report_period", F.round("composite", 6).alias("composite"))


@query("dcf_and_peg", f"""WITH {STATEMENTS_SQL}, x AS (SELECT symbol, report_period, cash AS c, 0.05::DOUBLE AS g, 0.1::DOUBLE AS d, assets / nullif(revenue - cost, 0) AS pe, (revenue - lag(revenue, 4) {FW}) / nullif(abs(lag(revenue, 4) {FW}), 0) AS gr FROM statements),
v AS (SELECT *, CASE WHEN pe > 0 AND gr > 0 THEN pe / (gr * 100) END AS peg FROM x)
SELECT symbol, report_period, {tidy_sql("list_sum(list_transform([1, 2, 3, 4, 5], lambda k: c * pow(1 + g, k) / pow(1 + d, k))) + c * pow(1 + g, 5) * 1.02 / (d - 0.02) / pow(1 + d, 5)")} AS value, {tidy_sql('peg')} AS peg, CASE WHEN peg IS NULL THEN 'not_meaningful' WHEN peg < 1 THEN 'cheap' WHEN peg < 2 THEN 'fair' ELSE 'expensive' END AS band FROM v""")
def dcf_and_peg(spark, root):
    s = FU.report_growth(statements(spark, root), ["revenue"])
    pe = F.try_divide(F.col("assets"), F.col("revenue") - F.col("cost"))
    value, band = FU.peg(pe, F.col("revenue_yoy"))
    return s.select("symbol", "report_period", tidy(FU.dcf_value(F.col("cash"), F.lit(0.05), F.lit(0.1))).alias("value"), tidy(value).alias("peg"), band.alias("band"))


@query("reverse_dcf", f"""WITH RECURSIVE {STATEMENTS_SQL}, b AS (SELECT symbol, report_period, cash AS c, assets * 10 AS price, 0 AS step, -0.5::DOUBLE AS low, 1.0::DOUBLE AS high FROM statements
UNION ALL SELECT symbol, report_period, c, price, step + 1, CASE WHEN cheap THEN g ELSE low END, CASE WHEN cheap THEN high ELSE g END
FROM (SELECT *, list_sum(list_transform([1, 2, 3, 4, 5], lambda k: c * pow(1 + g, k) / pow(1.1, k))) + c * pow(1 + g, 5) * 1.02 / 0.08 / pow(1.1, 5) < price AS cheap FROM (SELECT *, (low + high) / 2 AS g FROM b WHERE step < 60)))
SELECT symbol, report_period, CASE WHEN c > 0 THEN round((low + high) / 2, 6) END AS implied_growth FROM b WHERE step = 60""")
def reverse_dcf(spark, root):
    s = statements(spark, root)
    return s.select("symbol", "report_period", F.round(FU.reverse_dcf(F.col("assets") * 10, F.col("cash"), F.lit(0.1)), 6).alias("implied_growth"))


@query("orthogonalise_by_date", f"""WITH {PANEL_SQL}, s AS (SELECT trade_date, regr_slope(mom, vlm) AS b, regr_intercept(mom, vlm) AS a, count(*) AS n FROM panel WHERE mom IS NOT NULL AND vlm IS NOT NULL GROUP BY 1)
SELECT symbol, trade_date, CASE WHEN n > 2 AND mom IS NOT NULL AND vlm IS NOT NULL THEN {tidy_sql('mom - a - b * vlm')} END AS residual FROM panel LEFT JOIN s USING (trade_date)""")
def orthogonalise_by_date(spark, root):
    from tickloom.operators.cross import ols_residual

    return t(ols_residual(factor_panel(spark, root), "mom", "vlm", ["trade_date"]), "residual").select("symbol", "trade_date", "residual")


@query("winsorise_mad", f"""WITH {PANEL_SQL}, m AS (SELECT trade_date, median(gap) AS med FROM panel GROUP BY 1), d AS (SELECT trade_date, median(abs(gap - med)) AS mad FROM panel JOIN m USING (trade_date) GROUP BY 1)
SELECT symbol, trade_date, {tidy_sql("CASE WHEN gap IS NULL OR mad <= 1e-12 THEN gap ELSE least(greatest(gap, med - 1.4826 * 2 * mad), med + 1.4826 * 2 * mad) END")} AS gap FROM panel JOIN m USING (trade_date) JOIN d USING (trade_date)""")
def winsorise_mad(spark, root):
    from tickloom.operators.cross import winsorise_mad as op

    return t(op(factor_panel(spark, root).select("symbol", "trade_date", "gap"), ["gap"], ["trade_date"], 2.0), "gap")


@query("winsorise_and_robust_z", f"""WITH {PANEL_SQL}, q AS (SELECT trade_date, quantile_cont(gap, 0.05) AS lo, quantile_cont(gap, 0.95) AS hi FROM panel GROUP BY 1), c AS (SELECT symbol, trade_date, least(greatest(gap, lo), hi) AS gap FROM panel JOIN q USING (trade_date)), m AS (SELECT trade_date, median(gap) AS med FROM c GROUP BY 1), d AS (SELECT trade_date, median(abs(gap - med)) AS mad FROM c JOIN m USING (trade_date) GROUP BY 1)
SELECT symbol, trade_date, {tidy_sql("gap")} AS gap, {tidy_sql("(gap - med) / (1.4826 * mad + 1e-12)")} AS gap_rz FROM c JOIN m USING (trade_date) JOIN d USING (trade_date)""")
def winsorise_and_robust_z(spark, root):
    from tickloom.operators.cross import robust_zscore, winsorise_quantile

    c = winsorise_quantile(factor_panel(spark, root).select("symbol", "trade_date", "gap"), ["gap"], ["trade_date"], 0.05, 0.95)
    z = robust_zscore(c, ["gap"], ["trade_date"])
    return t(z, "gap", "gap_rz")


@query("fill_by_sector_median", f"""WITH {PANEL_SQL}, {SECTORS_SQL}, j AS (SELECT p.symbol, trade_date, sector, CASE WHEN p.symbol % 4 = 1 THEN NULL ELSE gap END AS x FROM panel p JOIN sectors USING (symbol)), a AS (SELECT trade_date, sector, median(x) AS m FROM j GROUP BY ALL), b AS (SELECT trade_date, median(x) AS m FROM j GROUP BY ALL)
SELECT j.symbol, j.trade_date, {tidy_sql('coalesce(x, a.m, b.m)')} AS x FROM j LEFT JOIN a USING (trade_date, sector) LEFT JOIN b USING (trade_date)""")
def fill_by_sector_median(spark, root):
    from tickloom.operators.cross import fill_group_median

    j = factor_panel(spark, root).join(sectors(spark, root).select("symbol", "sector"), "symbol").select("symbol", "trade_date", "sector", F.when(F.col("symbol") % 4 != 1, F.col("gap")).alias("x"))
    return t(fill_group_median(j, ["x"], ["trade_date", "sector"], ["trade_date"]), "x").select("symbol", "trade_date", "x")
