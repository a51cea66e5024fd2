"""Technical indicators and factor preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.checks.libraries import factor_query
from tickloom.checks.panels import PANEL_SQL, factor_panel
from tickloom.checks.registry import query
from tickloom.functions.columns import tidy
from tickloom.operators import preprocess as P
from tickloom.plans import technical as T
from tickloom.plans.inputs import BARS_SQL, SECTORS_SQL, bars, sectors, tidy_sql
from tickloom.session import cut_lineage

factor_query("technical_oscillators", T.oscillators())
factor_query("technical_advanced", T.advanced())
factor_query("technical_daily", T.daily())


@query("benchmark_returns", f"""WITH {BARS_SQL}, m AS (SELECT trade_date, avg(close) AS level FROM bars GROUP BY 1), r AS (SELECT trade_date, level / lag(level) OVER (ORDER BY trade_date) - 1 AS r FROM m)
SELECT symbol, trade_date, round(r, 6) + 0.0 AS benchmark_ret_1d FROM bars JOIN r USING (trade_date)""")
def benchmark_returns(spark, root):
    b = bars(spark, root)
    index = b.groupBy("trade_date").agg(F.avg("close").alias("close"))
    return T.with_benchmark(b, index).select("symbol", "trade_date", (F.round("benchmark_ret_1d", 6) + F.lit(0.0)).alias("benchmark_ret_1d"))


SP_SQL = f"{PANEL_SQL}, {SECTORS_SQL}, sp AS (SELECT p.symbol, p.trade_date, s.concept AS sector, p.mom, p.vlm, p.gap FROM panel p JOIN sectors s USING (symbol))"


def sector_panel(spark, root):
    names = sectors(spark, root).select("symbol", F.col("concept").alias("sector"))
    # the regressions read their input once per pass; the panel is built once
    return cut_lineage(factor_panel(spark, root).select("symbol", "trade_date", "mom", "vlm", "gap").join(names, "symbol"))


@query("neutralise_exposures", f"""WITH {SP_SQL}, cats AS (SELECT trade_date, count(DISTINCT sector) AS cats FROM sp GROUP BY 1), k AS (SELECT * FROM sp WHERE mom IS NOT NULL AND vlm IS NOT NULL AND gap IS NOT NULL),
c AS (SELECT symbol, trade_date, mom - avg(mom) OVER g AS y, vlm - avg(vlm) OVER g AS a, gap - avg(gap) OVER g AS b, vlm, gap FROM k WINDOW g AS (PARTITION BY trade_date, sector)),
s AS (SELECT trade_date, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb, sum(vlm * vlm) AS ra, sum(gap * gap) AS rb FROM c GROUP BY 1),
e AS (SELECT *, aa > aa * 1e-8 AND aa > ra * 1e-20 AS oka FROM s), e2 AS (SELECT *, CASE WHEN oka THEN bb - ab / aa * ab ELSE bb END AS p, CASE WHEN oka THEN yb - ab / aa * ay ELSE yb END AS q FROM e),
b2 AS (SELECT *, CASE WHEN p > bb * 1e-8 AND bb > rb * 1e-20 THEN q / p ELSE 0.0 END AS w2 FROM e2), b1 AS (SELECT *, CASE WHEN oka THEN (ay - ab * w2) / aa ELSE 0.0 END AS w1 FROM b2)
SELECT sp.symbol, sp.trade_date, {tidy_sql("CASE WHEN n > cats + 2 THEN y - w1 * a - w2 * b END")} AS neutral FROM sp LEFT JOIN c ON c.symbol = sp.symbol AND c.trade_date = sp.trade_date LEFT JOIN b1 ON b1.trade_date = sp.trade_date LEFT JOIN cats ON cats.trade_date = sp.trade_date""")
def neutralise_exposures(spark, root):
    out = P.neutralise(sector_panel(spark, root), "mom", ["vlm", "gap"], ["trade_date"], "sector", "neutral")
    return out.select("symbol", "trade_date", tidy(F.col("neutral")).alias("neutral"))


@query("orthogonal_factors", f"""WITH {SP_SQL}, k AS (SELECT symbol, trade_date, mom, vlm, mom - avg(mom) OVER g AS a, vlm - avg(vlm) OVER g AS b, count(*) OVER g AS n FROM sp WHERE mom IS NOT NULL AND vlm IS NOT NULL WINDOW g AS (PARTITION BY trade_date)),
s AS (SELECT trade_date, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(mom * mom) AS ra, sum(vlm * vlm) AS rb FROM k WHERE n >= 2 GROUP BY 1), e AS (SELECT *, CASE WHEN aa > aa * 1e-8 AND aa > ra * 1e-20 THEN sqrt(aa) END AS r0 FROM s),
f AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN bb - ab / aa * ab ELSE bb END AS p FROM e), h AS (SELECT *, CASE WHEN p > bb * 1e-8 AND bb > rb * 1e-20 THEN sqrt(p) END AS r1 FROM f),
q AS (SELECT symbol, k.trade_date, a / r0 AS x, (b - coalesce(a / r0 * (ab / r0), 0)) / r1 AS y FROM k JOIN h USING (trade_date))
SELECT sp.symbol, sp.trade_date, {tidy_sql('x')} AS mom_orth, {tidy_sql('y')} AS vlm_orth FROM sp LEFT JOIN q ON q.symbol = sp.symbol AND q.trade_date = sp.trade_date""")
def orthogonal_factors(spark, root):
    out = P.orthogonalise(sector_panel(spark, root), ["mom", "vlm"], ["trade_date"])
    return out.select("symbol", "trade_date", tidy(F.col("mom_orth")).alias("mom_orth"), tidy(F.col("vlm_orth")).alias("vlm_orth"))
