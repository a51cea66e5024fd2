"""Style factors, return attribution and high-frequency day factors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.checks.panels import rk
from tickloom.checks.registry import query
from tickloom.functions.columns import tidy
from tickloom.operators import attribution as AT
from tickloom.operators import highfreq as HF
from tickloom.plans.inputs import BARS_SQL, SECTORS_SQL, TICKS_SQL, bars, sectors, ticks, tidy_sql
from tickloom.session import cut_lineage

W = "OVER (PARTITION BY symbol ORDER BY trade_date)"
LEAST, LOOKBACK, SKIP = 6, 40, 5


def t(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def cells(*names):
    return ", ".join(f"{tidy_sql(n)} AS {n}" for n in names)


def style_panel(spark, root):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    s = sectors(spark, root).select("symbol", "concept", "balance")
    wide = bars(spark, root).join(s, "symbol").withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    return wide.select("symbol", "trade_date", "concept", "ret", (F.col("balance") / F.col("close")).alias("book"), (F.col("close") * (F.col("symbol") % 13 + 1)).alias("equity"))


def _spread(name: str, column: str, sign: int) -> str:
    return f"""{name}_k AS (SELECT trade_date, ret, {column} AS x FROM lagged WHERE {column} IS NOT NULL AND ret IS NOT NULL),
{name}_p AS (SELECT *, {rk('x', 'trade_date')} / count(*) OVER (PARTITION BY trade_date) AS p FROM {name}_k QUALIFY count(*) OVER (PARTITION BY trade_date) >= {LEAST}),
{name}_d AS (SELECT trade_date, {sign} * (avg(ret) FILTER (p >= 0.7::DOUBLE) - avg(ret) FILTER (p <= 0.3::DOUBLE)) AS {name} FROM {name}_p GROUP BY trade_date)"""


STYLE_SQL = f"""{BARS_SQL}, {SECTORS_SQL},
pan AS MATERIALIZED (SELECT symbol, trade_date, concept, close / lag(close) {W} - 1 AS ret, balance / close AS book, close * (symbol % 13 + 1) AS equity FROM bars JOIN sectors USING (symbol)),
mom AS (SELECT *, CASE WHEN row_number() {W} > {LOOKBACK} THEN exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND {SKIP} PRECEDING)) - 1 END AS um FROM pan),
lagged AS MATERIALIZED (SELECT symbol, trade_date, ret, lag(equity) {W} AS equity, lag(book) {W} AS book, lag(um) {W} AS um FROM mom),
{_spread('smb', 'equity', -1)}, {_spread('hml', 'book', 1)}, {_spread('umd', 'um', 1)},
style AS MATERIALIZED (SELECT trade_date, mkt, smb, hml, umd FROM (SELECT trade_date, avg(ret) AS mkt FROM pan GROUP BY trade_date) LEFT JOIN smb_d USING (trade_date) LEFT JOIN hml_d USING (trade_date) LEFT JOIN umd_d USING (trade_date))"""


def styles(spark, root):
    return AT.style_factors(style_panel(spark, root), book="book", equity="equity", lookback=LOOKBACK, skip=SKIP, least=LEAST)


@query("style_factor_returns", f"WITH {STYLE_SQL} SELECT trade_date, {cells('mkt', 'smb', 'hml', 'umd')} FROM style")
def style_factor_returns(spark, root):
    return t(styles(spark, root)[0], "mkt", "smb", "hml", "umd")


def solve_sql(source: str, keys: str, k: int, out: str) -> str:
    """CTEs that solve a symmetric k × k system by elimination: x{i}_{j} (i <= j) and y{i} of ``source`` → b{i} of ``out``."""
    steps, name = [], source
    for i in range(k):
        cols = [f"x{a}_{b} - x{i}_{a} / x{i}_{i} * x{i}_{b} AS x{a}_{b}" if a > i else f"x{a}_{b}" for a in range(k) for b in range(a, k)]
        cols += [f"y{a} - x{i}_{a} / x{i}_{i} * y{i} AS y{a}" if a > i else f"y{a}" for a in range(k)]
        steps.append(f"{out}_e{i} AS (SELECT {keys}, {', '.join(cols)} FROM {name})")
        name = f"{out}_e{i}"
    for i in reversed(range(k)):
        rest = "".join(f" - x{i}_{j} * b{j}" for j in range(i + 1, k))
        steps.append(f"{out}_s{i} AS (SELECT *, (y{i}{rest}) / x{i}_{i} AS b{i} FROM {name})")
        name = f"{out}_s{i}"
    return ", ".join(steps) + f", {out} AS (SELECT {keys}, {', '.join(f'b{i}' for i in range(k))} FROM {name})"


def _model(name: str, factors: tuple[str, ...]) -> str:
    k, x = len(factors) + 1, ("1", *factors)
    sums = [f"sum({x[i]} * {x[j]})::DOUBLE AS x{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum({x[i]} * ret) AS y{i}" for i in range(k)]
    known = " AND ".join(f"{f} IS NOT NULL" for f in factors)
    fitted = " - ".join(["ret", *(f"b{i + 1} * {f}" for i, f in enumerate(factors))])
    betas = ", ".join(f"b{factors.index(f) + 1} AS beta_{f}" if f in factors else f"NULL::DOUBLE AS beta_{f}" for f in ("mkt", "smb", "hml", "umd"))
    lag = "greatest(1, least(greatest(1, floor(4.0 * pow(n / 100.0, 2.0 / 9.0))), n - 1))"
    return f"""{name}_r AS (SELECT * FROM strat JOIN style USING (trade_date) WHERE ret IS NOT NULL AND {known}),
{name}_m AS (SELECT concept, {', '.join(sums)} FROM {name}_r GROUP BY concept), {solve_sql(f'{name}_m', 'concept', k, f'{name}_b')},
{name}_e AS MATERIALIZED (SELECT concept, trade_date, ret, b0, {fitted} AS e, row_number() OVER (PARTITION BY concept ORDER BY trade_date) AS i FROM {name}_r JOIN {name}_b USING (concept)),
{name}_s AS (SELECT concept, count(*) AS n, avg(e) AS mean, sum((e - b0) ** 2) AS res, var_pop(ret) * count(*) AS tot FROM {name}_e GROUP BY concept),
{name}_g AS (SELECT a.concept, a.i - b.i AS k, sum((a.e - s.mean) * (b.e - s.mean)) / any_value(s.n) AS g, any_value({lag}) AS lag FROM {name}_e a JOIN {name}_s s USING (concept) JOIN {name}_e b ON b.concept = a.concept AND b.i <= a.i AND a.i - b.i <= 12 GROUP BY 1, 2),
{name}_t AS (SELECT concept, sum(CASE WHEN k = 0 THEN g WHEN k <= lag THEN 2 * (1 - k / (lag + 1)) * g ELSE 0 END) AS v FROM {name}_g GROUP BY concept),
{name} AS (SELECT c.concept, '{name}' AS model, CASE WHEN n >= 20 THEN 'measured' ELSE 'unavailable' END AS status, CASE WHEN n >= 20 THEN '' ELSE 'insufficient_overlap' END AS missing, n >= 20 AS ok, CASE WHEN n >= 20 AND b0 > -1 THEN pow(1 + b0, 244) - 1 END AS alpha_annual,
 CASE WHEN n >= 20 THEN mean / sqrt(greatest(v, 1e-12) / n) END AS alpha_t, {', '.join(f'CASE WHEN n >= 20 THEN beta_{f} END AS beta_{f}' for f in ('mkt', 'smb', 'hml', 'umd'))}, CASE WHEN n >= 20 THEN 1 - res / tot END AS r_squared, CASE WHEN n >= 20 THEN n END AS n
 FROM (SELECT DISTINCT concept FROM strat) c LEFT JOIN (SELECT *, {betas} FROM {name}_b) USING (concept) LEFT JOIN {name}_s USING (concept) LEFT JOIN {name}_t USING (concept))"""


NAMES = ["alpha_annual", "alpha_t", "beta_mkt", "beta_smb", "beta_hml", "beta_umd", "r_squared"]


@query("style_attribution", f"""WITH {STYLE_SQL}, strat AS MATERIALIZED (SELECT concept, trade_date, avg(ret) AS ret FROM pan GROUP BY ALL HAVING avg(ret) IS NOT NULL),
{_model('capm', ('mkt',))}, {_model('ff3', ('mkt', 'smb', 'hml'))}, {_model('carhart4', ('mkt', 'smb', 'hml', 'umd'))},
every AS (SELECT *, 0 AS step FROM capm UNION ALL SELECT *, 1 FROM ff3 UNION ALL SELECT *, 2 FROM carhart4),
marked AS (SELECT *, coalesce(step = max(step) FILTER (ok) OVER (PARTITION BY concept), false) AS strictest FROM every)
SELECT concept, model, status, missing, n, strictest, bool_or(coalesce(strictest AND alpha_annual > 0 AND alpha_t >= 2, false)) OVER (PARTITION BY concept) AS survives, {cells(*NAMES)} FROM marked""")
def style_attribution(spark, root):
    p = cut_lineage(style_panel(spark, root))
    factors, status = AT.style_factors(p, book="book", equity="equity", lookback=LOOKBACK, skip=SKIP, least=LEAST)
    returns = cut_lineage(p.groupBy("concept", "trade_date").agg(F.avg("ret").alias("ret")).where("ret IS NOT NULL"))
    out = AT.attribution(returns, cut_lineage(factors), status, "concept")
    return t(out, *NAMES).select("concept", "model", "status", "missing", "n", "strictest", "survives", *NAMES)


@query("style_attribution_without_book", f"""WITH {STYLE_SQL}, strat AS MATERIALIZED (SELECT concept, trade_date, avg(ret) AS ret FROM pan GROUP BY ALL HAVING avg(ret) IS NOT NULL), {_model('capm', ('mkt',))}
SELECT concept, model, status, missing, {cells('alpha_t', 'beta_mkt')} FROM (SELECT concept, model, status, missing, alpha_t, beta_mkt FROM capm
 UNION ALL SELECT DISTINCT concept, m, 'unavailable', 'hml', NULL::DOUBLE, NULL::DOUBLE FROM strat, (SELECT unnest(['ff3', 'carhart4']) AS m))""")
def style_attribution_without_book(spark, root):
    """Without a book column the value factor is unavailable, and so are the models that need it."""
    p = cut_lineage(style_panel(spark, root))
    factors, status = AT.style_factors(p, equity="equity", lookback=LOOKBACK, skip=SKIP, least=LEAST)
    returns = cut_lineage(p.groupBy("concept", "trade_date").agg(F.avg("ret").alias("ret")).where("ret IS NOT NULL"))
    out = AT.attribution(returns, cut_lineage(factors), status, "concept")
    return t(out, "alpha_t", "beta_mkt").select("concept", "model", "status", "missing", "alpha_t", "beta_mkt")


# -- high-frequency day factors ------------------------------------------------------------

MINUTES = 30


def minute_bars(spark, root):
    """Half-hour bars of each event type, all day round."""
    e, key = ticks(spark, root), F.struct("ts", "event_id")
    at = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / (60 * MINUTES)) * (60 * MINUTES))
    b = e.groupBy(F.col("event_type").alias("symbol"), at.alias("bar_time")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.round(F.sum("size"), 4).alias("volume"), F.round(F.sum(F.col("price") * F.col("size")), 4).alias("amount"),
    )
    return b.withColumn("trade_date", F.to_date("bar_time"))


MINUTE_SQL = f"""{TICKS_SQL}, mb AS MATERIALIZED (SELECT *, CAST(bar_time AS DATE) AS trade_date FROM (SELECT event_type AS symbol, time_bucket(INTERVAL {MINUTES} MINUTE, ts, TIMESTAMP '2000-01-01') AS bar_time, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close,
 round(sum(size), 4) AS volume, round(sum(price * size), 4) AS amount FROM ticks GROUP BY ALL))"""
SHAPES = ["top_volume_bar_return", "intraday_skew", "intraday_kurtosis", "amihud_1min", "crowding_fft_ratio", "opening_flow_ratio", "closing_flow_ratio"]


@query("intraday_shape", f"""WITH {MINUTE_SQL},
b AS MATERIALIZED (SELECT *, coalesce(close / lag(close) OVER d - 1, close / open - 1) AS r, row_number() OVER d - 1 AS t, count(*) OVER (PARTITION BY symbol, trade_date) AS n FROM mb WINDOW d AS (PARTITION BY symbol, trade_date ORDER BY bar_time)),
f AS (SELECT b.symbol, b.trade_date, k.k, sum((volume - m) * cos(2 * pi() * k.k * t / n)) ** 2 + sum((volume - m) * sin(2 * pi() * k.k * t / n)) ** 2 AS p FROM b JOIN (SELECT symbol, trade_date, avg(volume) AS m FROM b GROUP BY ALL) USING (symbol, trade_date) JOIN (SELECT unnest(range(1, 400)) AS k) k ON k.k <= n // 2 GROUP BY ALL),
s AS (SELECT symbol, trade_date, sum(p) FILTER (k <= 2) / sum(p) AS ratio, sum(p) AS power FROM f GROUP BY ALL),
g AS (SELECT symbol, trade_date, any_value(n) AS n, arg_max(close / open - 1, (volume, -t)) AS top_volume_bar_return, skewness(r) AS sk, kurtosis(r) AS ku, avg(abs(r) / (amount / 1e6)) FILTER (amount <> 0) AS amihud_1min, sum(volume) AS vol,
 sum(amount) FILTER (t < 10) / sum(amount) AS opening_flow_ratio, sum(amount) FILTER (t >= n - 10) / sum(amount) AS closing_flow_ratio, count(DISTINCT r) > 1 AS varied FROM b GROUP BY ALL)
SELECT symbol, trade_date, {cells(*SHAPES)} FROM (SELECT g.*, CASE WHEN n > 2 AND varied THEN sk END AS intraday_skew, CASE WHEN n > 3 AND varied THEN ku END AS intraday_kurtosis, CASE WHEN n >= 8 AND vol > 0 THEN CASE WHEN power <= 0 THEN 0 ELSE ratio END END AS crowding_fft_ratio FROM g LEFT JOIN s USING (symbol, trade_date))""")
def intraday_shape(spark, root):
    """Against a plain discrete Fourier sum over every frequency."""
    return t(HF.intraday_shape(minute_bars(spark, root), edge=10), *SHAPES).select("symbol", "trade_date", *SHAPES)


WD = "OVER (PARTITION BY symbol ORDER BY trade_date"
F8 = f"{WD} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
MICRO = list(HF.DAILY)


def _corr(x: str, y: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"CASE WHEN count({a}) {F8} = 8 AND min({a}) {F8} < max({a}) {F8} AND min({b}) {F8} < max({b}) {F8} THEN covar_pop({a}, {b}) {F8} / (stddev_pop({a}) {F8} * stddev_pop({b}) {F8}) END"


@query("daily_microstructure", f"""WITH {MINUTE_SQL},
d AS (SELECT symbol, trade_date, arg_min(open, bar_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_time) AS close, sum(volume) AS volume, sum(amount) AS amount FROM mb GROUP BY ALL),
a AS (SELECT *, lag(close) {WD}) AS pc, CASE WHEN volume <= 0 THEN close ELSE amount / volume END AS vwap, CASE WHEN count(*) {F8} = 8 THEN avg(amount) {F8} END AS am, CASE WHEN count(*) {F8} = 8 THEN sum(volume) {F8} END AS vs, volume / lag(volume) {WD}) - 1 AS dv FROM d),
c AS MATERIALIZED (SELECT *, close / pc - 1 AS r, lag(dv) {WD}) AS ldv FROM a)
SELECT symbol, trade_date, round(daily_amihud, 3) + 0.0 AS daily_amihud, {cells(*(m for m in MICRO if m != 'daily_amihud'))} FROM (SELECT symbol, trade_date, close / vwap - 1 AS last_30min_return, abs(r) / (amount / 1e8) AS daily_amihud, {_corr('r', 'dv')} AS close_volume_corr, {_corr('r', 'ldv')} AS lead_lag_price_volume_corr, volume / vs AS turnover_concentration,
 CASE WHEN stddev_pop(amount) OVER (PARTITION BY trade_date) > 1e-12 THEN (amount - avg(amount) OVER (PARTITION BY trade_date)) / stddev_pop(amount) OVER (PARTITION BY trade_date) END AS amount_zscore,
 (close - open) / nullif(high - low, 0) * (amount / am) AS money_flow_strength, (open / pc - 1) * (amount / am) AS opening_flow_ratio, (close / vwap - 1) * (amount / am) AS closing_flow_ratio FROM c)""")
def daily_microstructure(spark, root):
    out = HF.daily_microstructure(HF.daily_bars(minute_bars(spark, root)), 8)
    rest = [m for m in MICRO if m != "daily_amihud"]
    return t(out, *rest).withColumn("daily_amihud", F.round("daily_amihud", 3) + 0.0).select("symbol", "trade_date", *MICRO)
