"""Factor applicability by slice; concepts, revenue purity and themes by pattern matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.checks.panels import PANEL_SQL, factor_panel, rk
from tickloom.checks.registry import query
from tickloom.functions.columns import tidy
from tickloom.operators import applicability as AP
from tickloom.operators import matching as MA
from tickloom.plans.inputs import SECTORS_SQL, sectors, table, tidy_sql
from tickloom.session import cut_lineage, stored
from tickloom.sizes import broadcast_if_small


def t(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def cells(*names):
    return ", ".join(f"{tidy_sql(n)} AS {n}" for n in names)


# -- applicability -------------------------------------------------------------------------

FACTORS, LABELS, SLICES = ["mom", "gap"], {1: "fwd1", 5: "fwd5"}, ["concept", "sector"]
_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS factor_name, {h} AS horizon, '{s}' AS slice, {v} AS value, trade_date, symbol, {f} AS x, {y} AS y FROM pan WHERE {f} IS NOT NULL AND {y} IS NOT NULL"
    for f in FACTORS for h, y in LABELS.items() for s, v in (("global", "'all'"), *((c, c) for c in SLICES))
)
_DAY, _KEY = "factor_name, horizon, slice, value, trade_date", "factor_name, horizon, slice, value"
SLICE_SQL = f"""WITH {PANEL_SQL}, {SECTORS_SQL}, pan AS MATERIALIZED (SELECT panel.*, sector, concept FROM panel JOIN sectors USING (symbol)), lg AS MATERIALIZED ({_LONG}),
r AS (SELECT *, {rk('x', _DAY)} AS rx, {rk('y', _DAY)} AS ry FROM lg),
ic AS (SELECT {_DAY}, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM r GROUP BY ALL),
q AS (SELECT {_DAY}, quantile_cont(x, 0.2) AS q2, quantile_cont(x, 0.8) AS q8 FROM lg GROUP BY ALL),
hit AS (SELECT {_DAY}, avg(y) FILTER (x >= q8) > avg(y) FILTER (x <= q2) AS hit FROM lg JOIN q USING ({_DAY}) GROUP BY ALL),
d AS (SELECT {_KEY}, avg(ic) FILTER (n >= 3) AS m, stddev_samp(ic) FILTER (n >= 3) AS sd, avg(hit::INT) FILTER (n >= 3) AS h, count(*) AS dates FROM ic JOIN hit USING ({_DAY}) GROUP BY ALL),
c AS (SELECT {_KEY}, least(greatest(avg(abs((rank() OVER w + (count(*) OVER (PARTITION BY {_KEY}, x) - 1) / 2.0) / count(*) OVER (PARTITION BY {_KEY}) - 0.5)) * 2, 0), 1) AS crowding_score FROM lg GROUP BY ALL WINDOW w AS (PARTITION BY {_KEY} ORDER BY x)),
sl AS MATERIALIZED (SELECT {_KEY}, samples, symbols, dates, coalesce(m, 0) AS rank_ic, coalesce(CASE WHEN sd > 1e-12 THEN m / sd END, 0) AS rank_icir, coalesce(h, 0) AS hit_rate, crowding_score
 FROM (SELECT {_KEY}, count(*) AS samples, count(DISTINCT symbol) AS symbols FROM lg GROUP BY ALL) JOIN d USING ({_KEY}) JOIN c USING ({_KEY}) WHERE samples >= 6 AND symbols >= 3)"""
SLICE_SQL = SLICE_SQL.replace(
    f"c AS (SELECT {_KEY}, least(greatest(avg(abs((rank() OVER w", f"cr AS (SELECT {_KEY}, abs((rank() OVER w"
).replace("- 0.5)) * 2, 0), 1) AS crowding_score FROM lg GROUP BY ALL WINDOW w", "- 0.5) AS p FROM lg WINDOW w").replace(
    "ORDER BY x)),\nsl AS", f"ORDER BY x)),\nc AS (SELECT {_KEY}, least(greatest(avg(p) * 2, 0), 1) AS crowding_score FROM cr GROUP BY ALL),\nsl AS"
)
METRICS = ["rank_ic", "rank_icir", "hit_rate", "crowding_score"]


def slice_panel(spark, root):
    names = broadcast_if_small(sectors(spark, root).select("symbol", "sector", "concept"))
    return stored(factor_panel(spark, root).join(names, "symbol").select("symbol", "trade_date", *SLICES, *FACTORS, *LABELS.values()), "slices")


@query("factor_slices", f"{SLICE_SQL} SELECT {_KEY}, samples, symbols, dates, {cells(*METRICS)} FROM sl")
def factor_slices(spark, root):
    return t(AP.panel_metrics(slice_panel(spark, root), FACTORS, LABELS, SLICES), *METRICS)


@query("factor_applicability", f"""{SLICE_SQL}, ok AS (SELECT *, rank_icir >= 0.01 AND hit_rate >= 0.48 AND crowding_score <= 0.75 AS ok FROM sl),
li AS (SELECT factor_name, horizon, coalesce(list(value ORDER BY value) FILTER (ok AND slice = 'concept'), []) AS applicable_concept, coalesce(list(value ORDER BY value) FILTER (ok AND slice = 'sector'), []) AS applicable_sector, bool_or(ok AND slice <> 'global') AS any_slice FROM ok GROUP BY ALL)
SELECT factor_name, horizon, samples, symbols, dates, applicable_concept, applicable_sector, CASE WHEN samples < 120 OR symbols < 3 OR dates < 8 THEN 'insufficient_sample' WHEN crowding_score > 0.75 THEN 'crowded' WHEN rank_icir < -0.05 OR hit_rate < 0.45 THEN 'invalidated'
 WHEN any_slice AND rank_icir >= 0.01 AND hit_rate >= 0.48 THEN 'production' WHEN rank_icir >= 0 THEN 'validation' ELSE 'decaying' END AS stage FROM sl JOIN li USING (factor_name, horizon) WHERE slice = 'global'""")
def factor_applicability(spark, root):
    out = AP.applicability(slice_panel(spark, root), FACTORS, LABELS, SLICES, min_icir=0.01, min_hit=0.48)
    return out.select("factor_name", "horizon", "samples", "symbols", "dates", "applicable_concept", "applicable_sector", "stage")


# -- concepts and themes -------------------------------------------------------------------

BOARD_SQL = """WITH p AS (SELECT p_type AS industry, split_part(p_name, ' ', 2) AS chain, split_part(p_name, ' ', 1) AS leaf, p_name AS board, p_size FROM part), tx AS (SELECT * FROM p WHERE p_size <= 3), ex AS (SELECT DISTINCT board FROM p WHERE p_size = 50),
b AS (SELECT board, NOT EXISTS (SELECT 1 FROM ex WHERE ex.board = x.board) AS is_concept, coalesce((SELECT list_sort(list_distinct(list(industry || '/' || chain || '/' || leaf))) FROM tx WHERE tx.board = x.board), []) AS leaves FROM (SELECT DISTINCT board FROM p) x)"""


def boards(spark, root):
    """Part names stand for boards, small parts for the taxonomy, the largest for boards that are no concepts."""
    words = F.split("p_name", " ")
    p = table(spark, root, "part").select(F.col("p_type").alias("industry"), words[1].alias("chain"), words[0].alias("leaf"), F.col("p_name").alias("board"), "p_size")
    return MA.board_leaves(p, p.where("p_size <= 3"), p.where("p_size = 50"))


@query("concept_leaves", f"{BOARD_SQL} SELECT board, is_concept, leaves FROM b")
def concept_leaves(spark, root):
    return boards(spark, root)


@query("taxonomy_coverage", f"{BOARD_SQL} SELECT count(*) AS live_boards, count(*) FILTER (NOT is_concept) AS excluded_noise, count(*) FILTER (is_concept) AS concept_boards, count(*) FILTER (is_concept AND len(leaves) > 0) AS mapped_to_taxonomy FROM b")
def taxonomy_coverage(spark, root):
    return MA.taxonomy_coverage(boards(spark, root))


KEYWORDS = [("fasteners", "bolt"), ("fasteners", "screw"), ("motion", "gear"), ("motion", "ring"), ("motion", "hot gear"), ("red goods", "red "), ("gadgets", "widget"), ("gadgets", "gizmo")]
VIEWS = ["R", "A"]


def segments(spark, root):
    """Revenue of a name by quarter, return flag (the view) and part (the segment), as shares of its quarter and view."""
    rows = table(spark, root, "lineitem").join(table(spark, root, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    by = rows.groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("view"), F.to_date(F.trunc(F.to_date("l_shipdate"), "quarter")).alias("period"), F.col("p_name").alias("segment")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return by.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("symbol", "view", "period")) * F.when(F.col("symbol") % 2 == 0, 100.0).otherwise(1.0)).drop("v")


@query("revenue_purity", f"""WITH s AS (SELECT symbol, view, period, segment, v / sum(v) OVER (PARTITION BY symbol, view, period) * CASE WHEN symbol % 2 = 0 THEN 100 ELSE 1 END AS share FROM (SELECT l_suppkey AS symbol, l_returnflag AS view, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, p_name AS segment, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)),
v AS (SELECT * FROM s QUALIFY CASE view WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END = min(CASE view WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) OVER (PARTITION BY symbol)),
l AS (SELECT * FROM v QUALIFY period = max(period) OVER (PARTITION BY symbol)), z AS (SELECT *, share / CASE WHEN max(share) OVER (PARTITION BY symbol) > 1.5 THEN 100 ELSE 1 END AS x FROM l),
k AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{p}')" for c, p in KEYWORDS)}) k(concept, pattern)),
e AS (SELECT symbol, concept, least(sum(x), 1) AS e, max(period) AS verified FROM (SELECT z.*, c.concept FROM z JOIN (SELECT DISTINCT concept FROM k) c ON EXISTS (SELECT 1 FROM k WHERE k.concept = c.concept AND contains(z.segment, k.pattern))) GROUP BY symbol, concept)
SELECT symbol, concept, round(e, 3) AS exposure, CASE WHEN e >= 0.3 THEN 'high' WHEN e >= 0.1 THEN 'medium' WHEN e > 0 THEN 'low' ELSE 'none' END AS confidence, verified FROM e""")
def revenue_purity(spark, root):
    return MA.revenue_purity(segments(spark, root), spark.createDataFrame(KEYWORDS, "concept string, pattern string"), VIEWS)


THEME_WORDS = [("energy", "the"), ("energy", "then"), ("water", "eau"), ("water", "agua"), ("iron", "eisen"), ("iron", "und"), ("rare", "é"), ("rare", "ü")]
EVIDENCE_SQL = f"""WITH w AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in THEME_WORDS)}) w(theme, pattern)),
ev AS (SELECT DISTINCT theme, doc_id, (n_chars % 100) / 100.0 AS magnitude, 0.3 + (doc_id % 7) / 10.0 AS confidence, source IN ('src1', 'src2', 'src3') AS official, 20 + doc_id % 90 AS horizon_days, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 1 END AS direction FROM documents JOIN w ON contains(lower(text), pattern))"""


def evidence(spark, root):
    d = table(spark, root, "documents").select(
        F.lower("text").alias("body"), "doc_id", ((F.col("n_chars") % 100) / 100.0).alias("magnitude"), (0.3 + (F.col("doc_id") % 7) / 10.0).alias("confidence"), F.col("source").isin("src1", "src2", "src3").alias("official"),
        (20 + F.col("doc_id") % 90).alias("horizon_days"), F.when(F.col("doc_id") % 5 == 0, -1).otherwise(1).alias("direction"))
    return MA.tagged(d, "body", spark.createDataFrame(THEME_WORDS, "theme string, pattern string"), ["theme"]).drop("body")


@query("theme_evidence", f"{EVIDENCE_SQL} SELECT theme, doc_id FROM ev")
def theme_evidence(spark, root):
    """Every theme of every whole document, by one automaton over all words."""
    return evidence(spark, root).select("theme", "doc_id")


@query("theme_profiles", f"""{EVIDENCE_SQL}, mk AS (SELECT theme, avg(doc_id % 10) / 10.0 AS market_strength, avg(doc_id % 3) / 2.0 AS industry_fundamental_strength, max(doc_id % 4) / 4.0 AS bubble_risk FROM ev WHERE theme <> 'rare' GROUP BY theme),
f AS (SELECT theme, coalesce(avg(magnitude * confidence) FILTER (official), 0)::DOUBLE AS p, CAST(least(126, max(horizon_days)) AS INT) AS horizon_days, least(1, avg(confidence) + 0.05 * count(*))::DOUBLE AS theme_confidence, count(*) FILTER (direction >= 0) AS supporting, count(*) FILTER (direction < 0) AS opposing FROM ev GROUP BY theme),
j AS (SELECT f.*, coalesce(market_strength, 0.35)::DOUBLE AS m, coalesce(industry_fundamental_strength, 0.3)::DOUBLE AS fu, coalesce(bubble_risk, 0.2)::DOUBLE AS b FROM f LEFT JOIN mk USING (theme)),
s AS (SELECT *, greatest(0, least(1, 0.28 * greatest(0, least(1, p)) + 0.2 * least(1, m) + 0.24 * least(1, fu) + 0.18 * 0.3 + 0.1 * 0.3 - 0.1 * least(1, b)))::DOUBLE AS strength, CASE WHEN fu >= 0.75 AND p >= 0.45 THEN 'earnings_realization' WHEN fu >= 0.55 THEN 'fundamental_validation' WHEN p >= 0.6 AND m >= 0.35 THEN 'narrative_formation' ELSE 'policy_seed' END AS lifecycle_stage FROM j)
SELECT theme, {tidy_sql('strength')} AS theme_strength, {tidy_sql('p')} AS policy_strength, lifecycle_stage, horizon_days, {tidy_sql('theme_confidence')} AS theme_confidence, supporting, opposing,
 DATE '2024-03-01' + CAST(greatest(1, floor(horizon_days * CASE lifecycle_stage WHEN 'earnings_realization' THEN 0.7 WHEN 'fundamental_validation' THEN 0.8 WHEN 'narrative_formation' THEN 0.8 ELSE 1 END + 1e-9)) AS INT) AS expiry_date,
 CASE WHEN fu < 0.55 THEN ['order_disclosure', 'revenue_exposure', 'capacity_release'] ELSE [] END AS required_follow_up FROM s""")
def theme_profiles(spark, root):
    e = cut_lineage(evidence(spark, root))
    market = e.where("theme <> 'rare'").groupBy("theme").agg((F.avg(F.col("doc_id") % 10) / 10.0).alias("market_strength"), (F.avg(F.col("doc_id") % 3) / 2.0).alias("industry_fundamental_strength"), (F.max(F.col("doc_id") % 4) / 4.0).alias("bubble_risk"))
    out = MA.theme_profiles(e, market, F.lit("2024-03-01"))
    return t(out, "theme_strength", "policy_strength", "theme_confidence").select("theme", "theme_strength", "policy_strength", "lifecycle_stage", "horizon_days", "theme_confidence", "supporting", "opposing", "expiry_date", "required_follow_up")
