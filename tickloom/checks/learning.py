"""Calibration, walk-forward linear models and meta labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.checks.panels import PANEL_SQL, factor_panel, rk
from tickloom.checks.registry import query
from tickloom.functions.columns import tidy
from tickloom.operators import calibration as CA
from tickloom.operators import combinatorial as CP
from tickloom.operators import learning as LE
from tickloom.plans.inputs import tidy_sql
from tickloom.session import cut_lineage

SPLIT = "1999-01-01"


def t(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def known_rank(x, keys="trade_date"):
    return f"CASE WHEN {x} IS NOT NULL THEN {rk(x, keys)} / count({x}) OVER (PARTITION BY {keys}) END"


_BUCKET = " + ".join(f"(r >= {k / 10!r}::DOUBLE)::INT" for k in range(1, 10))


@query("isotonic_calibration", f"""WITH {PANEL_SQL},
tr AS MATERIALIZED (SELECT *, {_BUCKET} AS bucket FROM (SELECT fwd1, {rk('mom', 'trade_date')} / count(*) OVER (PARTITION BY trade_date) AS r, (fwd1 - avg(fwd1) OVER (PARTITION BY trade_date) > 1e-12)::INT AS beat FROM panel WHERE mom IS NOT NULL AND fwd1 IS NOT NULL AND trade_date < DATE '{SPLIT}')),
u AS (SELECT r AS x, sum(beat) AS sy, count(*) AS n FROM tr GROUP BY r),
o AS MATERIALIZED (SELECT x, sy, n, row_number() OVER (ORDER BY x) AS i, sum(sy) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM u),
means AS MATERIALIZED (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.sy)::DOUBLE / (b.cn - a.cn + a.n) AS m FROM o a JOIN o b ON b.i >= a.i),
cuts AS (SELECT l.i FROM (SELECT b AS i, max(m) AS v FROM means GROUP BY b) l JOIN (SELECT a - 1 AS i, min(m) AS v FROM means GROUP BY a) h USING (i) WHERE l.v <= h.v),
bl AS (SELECT sum(x * n) / sum(n) AS x0, sum(sy)::DOUBLE / sum(n) AS y0 FROM (SELECT o.*, (SELECT count(*) FROM cuts WHERE cuts.i < o.i) AS g FROM o) GROUP BY g),
lines AS MATERIALIZED (SELECT x0, y0, lead(x0) OVER (ORDER BY x0) AS x1, lead(y0) OVER (ORDER BY x0) AS y1 FROM bl),
centre AS (SELECT bucket, avg(fwd1) AS c FROM tr GROUP BY bucket),
gap AS (SELECT tr.bucket, abs(fwd1 - c) AS g FROM tr JOIN centre USING (bucket)),
wide AS (SELECT bucket, CASE WHEN count(*) >= 5 THEN quantile_cont(g, 0.9) END AS w FROM gap GROUP BY bucket),
tab AS (SELECT k.bucket, coalesce(c, (SELECT avg(fwd1) FROM tr)) AS c, coalesce(w, (SELECT quantile_cont(g, 0.9) FROM gap)) AS w FROM (SELECT unnest(range(10)) AS bucket) k LEFT JOIN centre USING (bucket) LEFT JOIN wide USING (bucket)),
ap AS (SELECT *, {_BUCKET} AS bucket FROM (SELECT symbol, trade_date, coalesce({known_rank('mom')}, 0.5) AS r FROM panel WHERE trade_date >= DATE '{SPLIT}')),
met AS (SELECT ap.symbol, ap.trade_date, ap.r, ap.bucket, l.x0, l.y0, l.x1, l.y1 FROM ap ASOF LEFT JOIN lines l ON ap.r >= l.x0)
SELECT symbol, trade_date, {tidy_sql('r')} AS calib_rank, {tidy_sql("coalesce(y0 + CASE WHEN x1 > x0 THEN (y1 - y0) * (r - x0) / (x1 - x0) ELSE 0 END, (SELECT arg_min(y0, x0) FROM lines))")} AS p_beat, {tidy_sql('c')} AS expected_forward_return, {tidy_sql('w')} AS conformal_width
FROM met JOIN tab USING (bucket)""")
def isotonic_calibration(spark, root):
    p = cut_lineage(factor_panel(spark, root).select("symbol", "trade_date", "mom", "fwd1"))
    split = F.lit(SPLIT).cast("date")
    out = CA.calibrated(p.where(F.col("trade_date") < split), p.where(F.col("trade_date") >= split), "mom", "fwd1")
    names = ["calib_rank", "p_beat", "expected_forward_return", "conformal_width"]
    return t(out.select("symbol", "trade_date", *names), *names)


#: (fold, train from, train to, valid from, valid to) by session number, five sessions apart.
FOLDS = [(k, 1, 600 + 200 * k, 606 + 200 * k, 805 + 200 * k) for k in range(4)]
FOLD_SQL = "folds AS (SELECT * FROM (VALUES " + ", ".join(map(str, FOLDS)) + ") v(fold, a, z, lo, hi))"
CAL_SQL = "cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session FROM (SELECT DISTINCT trade_date FROM panel))"


@query("walk_forward_linear", f"""WITH {PANEL_SQL}, {CAL_SQL}, {FOLD_SQL},
d AS MATERIALIZED (SELECT symbol, trade_date, session, coalesce({known_rank('mom')}, 0.5) AS x1, coalesce({known_rank('gap')}, 0.5) AS x2, {known_rank('fwd5')} AS y FROM panel JOIN cal USING (trade_date)),
m AS (SELECT fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, regr_sxx(x1, x1) + 1 AS s11, regr_sxx(x2, x2) + 1 AS s22, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS s1, regr_sxy(y, x2) AS s2 FROM d JOIN folds ON session BETWEEN a AND z WHERE y IS NOT NULL GROUP BY fold),
w AS (SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS w2 FROM m)
SELECT symbol, trade_date, CAST(fold AS INT) AS fold, {tidy_sql('my + w1 * (x1 - m1) + w2 * (x2 - m2)')} AS prediction FROM d JOIN folds ON session BETWEEN lo AND hi JOIN w USING (fold)""")
def walk_forward_linear(spark, root):
    p = cut_lineage(factor_panel(spark, root).select("symbol", "trade_date", "mom", "gap", "fwd5"))
    return t(LE.walk_forward_linear(p, ["mom", "gap"], "fwd5", FOLDS), "prediction")


@query("walk_forward_elastic", f"""WITH RECURSIVE {PANEL_SQL}, {CAL_SQL}, {FOLD_SQL},
d AS MATERIALIZED (SELECT symbol, trade_date, session, coalesce({known_rank('mom')}, 0.5) AS x1, coalesce({known_rank('gap')}, 0.5) AS x2, {known_rank('fwd5')} AS y FROM panel JOIN cal USING (trade_date)),
m AS MATERIALIZED (SELECT fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(y, x1) AS s1, covar_pop(y, x2) AS s2 FROM d JOIN folds ON session BETWEEN a AND z WHERE y IS NOT NULL GROUP BY fold),
it AS (SELECT fold, 0 AS k, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM m
 UNION ALL SELECT fold, k + 1, n1, sign(s2 - s12 * n1) * greatest(abs(s2 - s12 * n1) - 0.0005::DOUBLE, 0) / (s22 + 0.0005::DOUBLE) FROM (SELECT it.fold, k, s2, s12, s22, sign(s1 - s12 * w2) * greatest(abs(s1 - s12 * w2) - 0.0005::DOUBLE, 0) / (s11 + 0.0005::DOUBLE) AS n1 FROM it JOIN m USING (fold) WHERE k < 60)),
w AS (SELECT m.*, it.w1, it.w2 FROM m JOIN it USING (fold) WHERE k = 60)
SELECT symbol, trade_date, CAST(fold AS INT) AS fold, {tidy_sql('my + w1 * (x1 - m1) + w2 * (x2 - m2)')} AS prediction FROM d JOIN folds ON session BETWEEN lo AND hi JOIN w USING (fold)""")
def walk_forward_elastic(spark, root):
    p = cut_lineage(factor_panel(spark, root).select("symbol", "trade_date", "mom", "gap", "fwd5"))
    return t(LE.walk_forward_linear(p, ["mom", "gap"], "fwd5", FOLDS, alpha=0.001, l1_ratio=0.5), "prediction")


def _newton(before: str, after: str) -> str:
    """One Newton step of the balanced logistic fit with two features, for every fold."""
    x = ("1", "z1", "z2")
    sums = [f"sum(w * (p - y) * {x[i]}) / any_value(n) + {'0' if i == 0 else f'any_value(b{i}) / any_value(n)'} AS g{i}" for i in range(3)]
    sums += [f"sum(w * p * (1 - p) * {x[i]} * {x[j]}) / any_value(n) + {'1.0 / any_value(n)' if i == j > 0 else '0'} AS h{i}{j}" for i in range(3) for j in range(i, 3)]
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    d0 = "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2))"
    d1 = "(h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02))"
    d2 = "(h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02))"
    return f"""{after} AS MATERIALIZED (SELECT fold, b0 - {d0} / {det} AS b0, b1 - {d1} / {det} AS b1, b2 - {d2} / {det} AS b2 FROM (
 SELECT fold, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {', '.join(sums)} FROM (SELECT tr.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS p FROM tr JOIN {before} USING (fold)) GROUP BY fold))"""


META = 8
META_SQL = f"""WITH {PANEL_SQL}, {CAL_SQL}, {FOLD_SQL},
d AS MATERIALIZED (SELECT symbol, trade_date, session, mom, gap, (fwd1 > 0)::INT AS y FROM panel JOIN cal USING (trade_date)),
st AS (SELECT fold, avg(mom) AS m1, coalesce(nullif(stddev_pop(mom), 0), 1) AS s1, avg(gap) AS m2, coalesce(nullif(stddev_pop(gap), 0), 1) AS s2, count(*) AS n, sum(y) AS ones FROM d JOIN folds ON session BETWEEN a AND z WHERE y IS NOT NULL GROUP BY fold),
tr AS MATERIALIZED (SELECT fold, y, n, coalesce((mom - m1) / s1, 0) AS z1, coalesce((gap - m2) / s2, 0) AS z2, CASE WHEN y = 1 THEN n / (2.0 * ones) ELSE n / (2.0 * (n - ones)) END AS w FROM d JOIN folds ON session BETWEEN a AND z JOIN st USING (fold) WHERE y IS NOT NULL),
k0 AS (SELECT fold, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM folds),
{', '.join(_newton(f'k{i}', f'k{i + 1}') for i in range(META))},
pr AS (SELECT symbol, trade_date, fold, 1 / (1 + exp(-(b0 + b1 * coalesce((mom - m1) / s1, 0) + b2 * coalesce((gap - m2) / s2, 0)))) AS p FROM d JOIN folds ON session BETWEEN lo AND hi JOIN st USING (fold) JOIN k{META} USING (fold))"""


@query("meta_label_filter", f"""{META_SQL}
SELECT symbol, trade_date, CAST(fold AS INT) AS fold, round(p, 3) + 0.0 AS p_success, round(CASE WHEN p >= 0.5 THEN (p - 0.5) / 0.5 ELSE 0 END, 3) + 0.0 AS size FROM pr""")
def meta_label_filter(spark, root):
    p = cut_lineage(factor_panel(spark, root).select("symbol", "trade_date", "mom", "gap", (F.col("fwd1") > 0).cast("int").alias("success")))
    out = LE.meta_label_filter(p, ["mom", "gap"], "success", FOLDS)
    return out.select("symbol", "trade_date", "fold", (F.round("p_success", 3) + 0.0).alias("p_success"), (F.round("size", 3) + 0.0).alias("size"))


@query("meta_label_sizes", f"""WITH {PANEL_SQL}, p AS (SELECT symbol, trade_date, 1 / (1 + exp(-(0.1 + 2.5 * mom - 4.0 * gap)))::DOUBLE AS p FROM panel)
SELECT symbol, trade_date, {tidy_sql('p')} AS p_success, {tidy_sql('CASE WHEN p >= 0.48 THEN least(greatest((p - 0.48::DOUBLE) / 0.52::DOUBLE, 0), 1) ELSE 0 END')} AS size FROM p""")
def meta_label_sizes(spark, root):
    """The filter's decision for given weights."""
    p = factor_panel(spark, root).select("symbol", "trade_date", (1 / (1 + F.exp(-(0.1 + 2.5 * F.col("mom") - 4.0 * F.col("gap"))))).alias("p_success"))
    return t(p.withColumn("size", LE.size_of_bet(F.col("p_success"), 0.48)), "p_success", "size")


# -- combinatorial folds -------------------------------------------------------------------

CPCV_SQL = f"""WITH {PANEL_SQL},
sa AS (SELECT trade_date, m, lead(trade_date, 5) OVER (ORDER BY trade_date) AS until, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT trade_date, round(avg(fwd5), 8) AS m FROM panel WHERE fwd5 IS NOT NULL GROUP BY trade_date)),
g AS MATERIALIZED (SELECT *, ((i + 1) * 6 - 1) // n AS grp FROM sa),
pairs AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS split FROM range(6) x(a), range(6) y(b) WHERE a < b),
tests AS (SELECT split, unnest([a, b]) AS grp FROM pairs),
plan AS (SELECT split, grp, row_number() OVER (PARTITION BY grp ORDER BY split) - 1 AS path FROM tests),
span AS (SELECT split, min(trade_date) AS t0, max(until) AS t1 FROM plan JOIN g USING (grp) GROUP BY split),
lasts AS (SELECT split, max(i) AS z FROM plan JOIN g USING (grp) GROUP BY split, grp),
tag AS MATERIALIZED (SELECT s.split, g.trade_date, g.m, g.grp, plan.path, CASE WHEN plan.path IS NOT NULL THEN 'test' WHEN g.until >= s.t0 AND g.trade_date <= s.t1 THEN 'purged' WHEN EXISTS (SELECT 1 FROM lasts WHERE lasts.split = s.split AND g.i > z AND g.i <= z + ceil(g.n * 0.01)) THEN 'embargo' ELSE 'train' END AS role
 FROM g CROSS JOIN span s LEFT JOIN plan ON plan.split = s.split AND plan.grp = g.grp)"""


def cpcv_samples(spark, root):
    """Mean five-session return per session; its label ends five sessions later."""
    p = factor_panel(spark, root).where("fwd5 is not null").groupBy("trade_date").agg(F.round(F.avg("fwd5"), 8).alias("m"))
    return cut_lineage(p.withColumn("until", F.lead("trade_date", 5).over(Window.orderBy("trade_date"))))  # one row per session


@query("cpcv_folds", f"{CPCV_SQL} SELECT CAST(split AS INT) AS split, trade_date, CAST(grp AS INT) AS \"group\", role, CAST(path AS INT) AS path FROM tag")
def cpcv_folds(spark, root):
    return CP.combinatorial_folds(cpcv_samples(spark, root), "trade_date", "until").select("split", "trade_date", "group", "role", "path")


@query("cpcv_paths", f"""{CPCV_SQL}, side AS (SELECT split, sign(coalesce(avg(m) FILTER (role = 'train'), 0)) AS side FROM tag GROUP BY split)
SELECT CAST(path AS INT) AS path, count(*) AS sessions, {tidy_sql('avg(side * m)')} AS mean_return, {tidy_sql('CASE WHEN stddev_samp(side * m) > 0 THEN sqrt(252) * avg(side * m) / stddev_samp(side * m) END')} AS sharpe FROM tag JOIN side USING (split) WHERE role = 'test' GROUP BY path""")
def cpcv_paths(spark, root):
    r = CP.path_returns(CP.combinatorial_folds(cpcv_samples(spark, root), "trade_date", "until"), "trade_date", "m")
    sd = F.stddev_samp("m")
    return t(r.groupBy("path").agg(F.count(F.lit(1)).alias("sessions"), F.avg("m").alias("mean_return"), F.when(sd > 0, F.sqrt(F.lit(252.0)) * F.avg("m") / sd).alias("sharpe")), "mean_return", "sharpe")
