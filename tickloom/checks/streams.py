"""Streams, stores and contracts."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.checks.books import SESSION_SQL
from tickloom.checks.panels import PANEL_SQL, factor_panel
from tickloom.checks.registry import query
from tickloom.functions.columns import tidy
from tickloom.operators import pit
from tickloom.plans.inputs import BARS_SQL, PREDICTIONS_SQL, TICKS_SQL, bars, predictions, table, ticks, tidy_sql
from tickloom.session import shared_folder
from tickloom.sources import journal as JO
from tickloom.sources import tables as TB
from tickloom.streaming import events as ST
from tickloom.streaming import ledger as LG


def t(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def scratch(spark) -> str:
    """A new folder for one run below the shared folder, which a cluster has to name."""
    return f"{shared_folder(spark)}/run-{os.urandom(8).hex()}"


def tick_stream(spark, root):
    """The events table as a stream; the pattern names that one table, as a stream takes no plain file path."""
    raw = ST.file_stream(spark, f"{root}/events.parque[t]", schemas.EVENTS)
    return raw.select(
        F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type",
        F.round(F.lit(100.0) + F.col("value") / 10.0, 4).alias("price"), F.col("value").alias("size"),
    )


@query("stream_session_bars", f"WITH {SESSION_SQL} SELECT symbol, bar_end, open, high, low, close, {tidy_sql('volume')} AS volume, {tidy_sql('amount')} AS amount FROM bar WHERE bar_end <= (SELECT max(bar_end) FROM bar) - INTERVAL 1 HOUR")
def stream_session_bars(spark, root):
    """The bar operator on a stream: append mode emits the bars the watermark has passed."""
    folder = scratch(spark)
    stream = ST.stream_bars(tick_stream(spark, root), 30, "ts", "price", "size", "1 hour")
    ST.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return t(spark.read.parquet(f"{folder}/out"), "volume", "amount")


@query("stream_unique_events", "SELECT event_id, user_id AS symbol, event_type FROM events")
def stream_unique_events(spark, root):
    folder = scratch(spark)
    stream = ST.unique_events(tick_stream(spark, root), "ts", "1 day").select("event_id", "symbol", "event_type")
    ST.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query("stream_total_order", "SELECT event_id, user_id AS symbol FROM events")
def stream_total_order(spark, root):
    folder = scratch(spark)
    stream = tick_stream(spark, root).select("event_id", "symbol", "ts")
    ST.ordered_sink(stream, f"{folder}/out", f"{folder}/late", f"{folder}/checkpoint", time="ts", order=["ts", "event_id"])
    return spark.read.parquet(f"{folder}/out").select("event_id", "symbol")


@query("sliding_windows", f"""WITH {TICKS_SQL}, w AS (SELECT event_type, to_timestamp(0)::TIMESTAMP + to_seconds((epoch_us(ts) // 1200000000 - k) * 1200) AS window_start, ts, price FROM ticks, (SELECT unnest([0, 1, 2]) AS k))
SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS events, {tidy_sql('avg(price)')} AS mean, arg_max(price, ts) AS last FROM w GROUP BY ALL""")
def sliding_windows(spark, root):
    return t(ST.sliding_stats(ticks(spark, root), "ts", "price", "1 hour", "20 minutes", ["event_type"]), "mean")


@query("frontier_visibility", f"WITH {TICKS_SQL} SELECT event_id FROM ticks WHERE ts + to_minutes(event_id % 600) <= TIMESTAMP '2024-01-15 12:00:00'")
def frontier_visibility(spark, root):
    e = ticks(spark, root).withColumn("available_at", F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 600) * 60_000_000))
    return ST.visible_at(e, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("event_id")


DIGEST_SQL = f"""WITH {TICKS_SQL}, h0 AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, event_id::VARCHAR AS h FROM ticks),
h1 AS (SELECT i // 512 AS i, sha256(string_agg(h, ',' ORDER BY h0.i)) AS h FROM h0 GROUP BY h0.i // 512)""" + "".join(
    f", h{n} AS (SELECT i // 512 AS i, CASE WHEN (SELECT count(*) FROM h{n - 1}) > 1 THEN sha256(string_agg(h, ',' ORDER BY h{n - 1}.i)) ELSE min(h) END AS h FROM h{n - 1} GROUP BY h{n - 1}.i // 512)" for n in range(2, 7)
) + " SELECT h AS digest FROM h6"


@query("ordered_digest", DIGEST_SQL)
def ordered_digest(spark, root):
    return ST.ordered_digest(ticks(spark, root), ["ts", "event_id"], "event_id", F.date_trunc("hour", F.col("ts")), chunk=512)


LEGAL = [("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("purchase", "click")]


@query("transition_audit", f"""WITH {TICKS_SQL}, p AS (SELECT event_id, symbol, event_type, lag(event_type) OVER (PARTITION BY symbol ORDER BY event_id) AS previous FROM ticks)
SELECT event_id, symbol, previous, event_type, previous IS NULL OR (previous || '>' || event_type) IN ({', '.join(f"'{a}>{b}'" for a, b in LEGAL)}) AS legal FROM p""")
def transition_audit(spark, root):
    out = ST.transition_audit(ticks(spark, root), "symbol", "event_id", "event_type", LEGAL, F.floor(F.col("event_id") / 4096))
    return out.select("event_id", "symbol", "previous", "event_type", "legal")


#: Deliveries of the events: most at once, then a second delivery with events held back and events sent again.
ARRIVALS_SQL = f"WITH {TICKS_SQL}, a AS (SELECT *, 1 AS arrival FROM ticks WHERE event_id % 10 <> 3 UNION ALL SELECT *, 2 AS arrival FROM ticks WHERE event_id % 10 IN (3, 7))"
STATES_SQL = f"""{ARRIVALS_SQL}, top AS (SELECT symbol, max((ts, event_id)) AS f FROM a WHERE arrival = 1 GROUP BY symbol),
m AS (SELECT a.*, CASE WHEN arrival = 2 AND event_id % 10 = 7 THEN 'duplicate' WHEN arrival = 2 AND (ts, event_id) < f THEN 'late' ELSE 'ok' END AS verdict FROM a LEFT JOIN top USING (symbol)),
p AS (SELECT *, lag(event_type) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS previous FROM m WHERE verdict = 'ok'),
i AS (SELECT symbol, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS admitted, count(*) FILTER (previous IS NOT NULL AND (previous || '>' || event_type) NOT IN ({', '.join(f"'{a}>{b}'" for a, b in LEGAL)})) AS illegal FROM p GROUP BY symbol)
SELECT symbol, i.event_id, state, admitted, illegal, count(*) FILTER (verdict = 'duplicate') AS duplicates, count(*) FILTER (verdict = 'late') AS late FROM i JOIN m USING (symbol) GROUP BY ALL"""
STATE_COLUMNS = ["event_id", "state", "admitted", "illegal", "duplicates", "late"]


def deliveries(spark, root):
    e = ticks(spark, root).select("event_id", "symbol", "ts", "event_type")
    k = F.col("event_id") % 10
    return e.where(k != 3).withColumn("arrival", F.lit(1)).unionAll(e.where(k.isin(3, 7)).withColumn("arrival", F.lit(2)))


@query("stream_key_states", STATES_SQL)
def stream_key_states(spark, root):
    """Both deliveries through the stateful stream, which is stopped between them and resumed from its checkpoint."""
    folder, schema = scratch(spark), "event_id long, symbol long, ts timestamp, event_type string"
    for arrival in (1, 2):
        deliveries(spark, root).where(F.col("arrival") == arrival).drop("arrival").write.parquet(f"{folder}/in/arrival={arrival}")
        stream = ST.file_stream(spark, f"{folder}/in/*", schema)
        LG.run_ledger(stream, f"{folder}/out", f"{folder}/checkpoint", key="symbol", time="ts", ident="event_id", state="event_type", legal=LEGAL, keep=90 * 86400.0)
    return LG.current_states(spark.read.parquet(f"{folder}/out")).select(F.col("key").alias("symbol"), *STATE_COLUMNS)


@query("replayed_key_states", STATES_SQL)
def replayed_key_states(spark, root):
    out = LG.replay_states(deliveries(spark, root), "symbol", "ts", "event_id", "event_type", "arrival", LEGAL, F.date_trunc("day", F.col("ts")))
    return out.select(F.col("key").alias("symbol"), *STATE_COLUMNS)


@query("stream_refused_events", f"""{ARRIVALS_SQL}, top AS (SELECT symbol, max((ts, event_id)) AS f FROM a WHERE arrival = 1 GROUP BY symbol)
SELECT symbol, event_id, CASE WHEN event_id % 10 = 7 THEN 'duplicate' ELSE 'late' END AS kind FROM a LEFT JOIN top USING (symbol) WHERE arrival = 2 AND (event_id % 10 = 7 OR (ts, event_id) < f)""")
def stream_refused_events(spark, root):
    """The ledger's side output: every redelivered and every late event by name."""
    folder, schema = scratch(spark), "event_id long, symbol long, ts timestamp, event_type string"
    for arrival in (1, 2):
        deliveries(spark, root).where(F.col("arrival") == arrival).drop("arrival").write.parquet(f"{folder}/in/arrival={arrival}")
        stream = ST.file_stream(spark, f"{folder}/in/*", schema)
        LG.run_ledger(stream, f"{folder}/out", f"{folder}/checkpoint", key="symbol", time="ts", ident="event_id", state="event_type", legal=LEGAL, keep=90 * 86400.0)
    return spark.read.parquet(f"{folder}/out").where("kind <> 'state'").select(F.col("key").alias("symbol"), "event_id", "kind")


@query("same_bar_ambiguity", f"""WITH {BARS_SQL}, h AS (SELECT symbol, low <= open * 0.97 AS s, high >= open * 1.03 AS g FROM bars)
SELECT CASE WHEN s AND g THEN 'stop' WHEN s THEN 'stop' WHEN g THEN 'target' ELSE 'none' END AS outcome, count(*) AS bars, count(*) FILTER (s AND g) AS ambiguous FROM h GROUP BY 1""")
def same_bar_ambiguity(spark, root):
    s, g = F.col("low") <= F.col("open") * 0.97, F.col("high") >= F.col("open") * 1.03
    b = bars(spark, root).select(ST.resolve_ambiguity(s, g, "pessimistic").alias("outcome"), (s & g).cast("long").alias("a"))
    return b.groupBy("outcome").agg(F.count(F.lit(1)).alias("bars"), F.sum("a").alias("ambiguous"))


@query("forward_log_settlement", f"""WITH {PREDICTIONS_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session FROM (SELECT DISTINCT trade_date FROM predictions)),
g AS (SELECT a.symbol, c.session, b.close / a.close - 1 AS g FROM predictions a JOIN cal c ON c.trade_date = a.trade_date JOIN cal d ON d.session = c.session + 5 JOIN predictions b ON b.symbol = a.symbol AND b.trade_date = d.trade_date),
l AS (SELECT symbol, trade_date FROM predictions WHERE score >= 0.9), r AS (SELECT l.trade_date, c.session, avg(g.g) AS pool FROM l JOIN cal c USING (trade_date) JOIN g ON g.symbol = l.symbol AND g.session = c.session GROUP BY ALL), m AS (SELECT session, avg(g) AS universe FROM g GROUP BY 1)
SELECT 'main' AS book, trade_date, {tidy_sql('pool')} AS pool, {tidy_sql('universe')} AS universe, {tidy_sql('pool - universe')} AS excess FROM r JOIN m USING (session)""")
def forward_log_settlement(spark, root):
    p = predictions(spark, root)
    log = p.where("score >= 0.9").select("symbol", "trade_date", F.lit("main").alias("book"))
    return t(ST.settle_forward(log, p.select("symbol", "trade_date", "close"), pit.session_index(p), 5, ["book"]), "pool", "universe", "excess")


# -- stores and contracts ------------------------------------------------------------------


@query("dataset_manifest", f"""WITH {PANEL_SQL} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) FILTER (mom IS NULL) AS null_mom, count(*) FILTER (fwd5 IS NULL) AS null_fwd5 FROM panel""")
def dataset_manifest(spark, root):
    return TB.manifest(factor_panel(spark, root), ["mom", "fwd5"])


@query("one_provider_per_symbol", """SELECT l_suppkey AS symbol, l_linestatus AS provider, count(*) AS rows FROM lineitem l JOIN (SELECT l_suppkey AS k, min(CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus = 'F' ELSE l_linestatus = 'O' END::INT) AS best FROM lineitem GROUP BY 1) b ON b.k = l.l_suppkey
WHERE CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus = 'F' ELSE l_linestatus = 'O' END::INT = best GROUP BY ALL""")
def one_provider_per_symbol(spark, root):
    rank = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus") == "F").otherwise(F.col("l_linestatus") == "O").cast("int")
    rows = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_linestatus").alias("provider"), rank.alias("rank"))
    return TB.first_provider(rows, "symbol", "rank").groupBy("symbol", "provider").agg(F.count(F.lit(1)).alias("rows"))


@query("daily_append", f"""WITH {BARS_SQL}, old AS (SELECT symbol, trade_date, close FROM bars WHERE trade_date < DATE '2000-01-01'), new AS (SELECT symbol, trade_date, close + 1 AS close FROM bars WHERE trade_date >= DATE '1999-12-01')
SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.trade_date, o.trade_date) AS trade_date, coalesce(n.close, o.close) AS close FROM old o FULL OUTER JOIN new n USING (symbol, trade_date)""")
def daily_append(spark, root):
    b = bars(spark, root).select("symbol", "trade_date", "close")
    old, new = b.where("trade_date < '2000-01-01'"), b.where("trade_date >= '1999-12-01'").withColumn("close", F.col("close") + 1)
    return TB.keep_last(old, new, ["symbol", "trade_date"])


@query("append_only_new", f"WITH {BARS_SQL} SELECT symbol, trade_date FROM bars WHERE trade_date >= DATE '2000-01-01'")
def append_only_new(spark, root):
    b = bars(spark, root).select("symbol", "trade_date")
    return TB.append_new(b.where("trade_date < '2000-01-01'"), b.where("trade_date >= '1999-12-01'"), ["symbol", "trade_date"])


@query("wide_macro_series", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS available_at, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O, max(o_totalprice) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def wide_macro_series(spark, root):
    o = table(spark, root, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("available_at"), "o_orderstatus", "o_totalprice")
    return TB.wide_series(o, "available_at", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query("ingest_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 99 AS ingest_sequence FROM events")
def ingest_sequence(spark, root):
    e = ticks(spark, root).select("event_id", "ts")
    return TB.ingest_sequence(e, ["ts", "event_id"], F.date_trunc("day", F.col("ts")), 100).select("event_id", "ingest_sequence")


@query("journal_decisions", """WITH d AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL), s AS (SELECT symbol, day, CASE WHEN symbol % 3 = 0 THEN n + 1 ELSE n END AS n FROM d WHERE symbol % 4 <> 0)
SELECT d.symbol, d.day, CASE WHEN s.symbol IS NULL THEN 'NEW' WHEN s.n = d.n THEN 'DEDUPLICATED' ELSE 'CONFLICT' END AS decision FROM d LEFT JOIN s USING (symbol, day)""")
def journal_decisions(spark, root):
    e = ticks(spark, root).withColumn("day", F.to_date("ts")).select("symbol", "day", "event_id", "size")
    incoming = TB.content_hash(e, ["symbol", "day"])
    stored = incoming.where("symbol % 4 <> 0").select("symbol", "day", F.when(F.col("symbol") % 3 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))
    return TB.journal_decisions(stored, incoming.drop("content_hash").join(incoming.select("symbol", "day", F.col("content_hash").alias("h")), ["symbol", "day"]), ["symbol", "day"], F.col("h")).select("symbol", "day", "decision")


JOURNAL = "event_id long, size double, symbol long, day date"
JOURNAL_KEYS = ["day", "symbol"]
#: Two deliveries: all days but the last with symbols 0 to 39; then all days again, where every third symbol's sizes changed.
JOURNAL_SQL = """WITH e AS (SELECT event_id, value AS size, user_id % 40 AS symbol, CAST(ts AS DATE) AS day FROM events),
one AS (SELECT * FROM e WHERE day < (SELECT max(day) FROM e)), two AS (SELECT event_id, CASE WHEN symbol % 3 = 0 THEN size + 1 ELSE size END AS size, symbol, day FROM e)"""


def journal(spark, root, supersede):
    """Both deliveries appended to a new journal; the second delivery's receipts."""
    folder = scratch(spark)
    e = ticks(spark, root).select("event_id", "size", (F.col("symbol") % 40).alias("symbol"), F.to_date("ts").alias("day"))
    last = e.agg(F.max("day")).first()[0]
    JO.append_journal(e.where(F.col("day") < F.lit(last)), folder, JOURNAL_KEYS)
    changed = e.withColumn("size", F.when(F.col("symbol") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return folder, JO.append_journal(changed, folder, JOURNAL_KEYS, supersede)


@query("journal_append", f"""{JOURNAL_SQL} SELECT day, symbol, count(*) AS rows, CASE WHEN NOT EXISTS (SELECT 1 FROM one WHERE one.day = two.day AND one.symbol = two.symbol) THEN 'NEW' WHEN symbol % 3 = 0 THEN 'CONFLICT' ELSE 'DEDUPLICATED' END AS decision FROM two GROUP BY ALL""")
def journal_append(spark, root):
    return journal(spark, root, False)[1].select("day", "symbol", "rows", "decision")


@query("journal_read", f"""{JOURNAL_SQL} SELECT event_id, size, symbol, day FROM two WHERE symbol IN (3, 4, 5) AND dayofmonth(day) % 2 = 0""")
def journal_read(spark, root):
    """After the second delivery superseded the first: the rows of named symbols and days, pruned by the join."""
    folder, _ = journal(spark, root, True)
    wanted = JO.inventory(spark, folder, JOURNAL, JOURNAL_KEYS).where("symbol IN (3, 4, 5) AND dayofmonth(day) % 2 = 0").select("day", "symbol")
    return JO.read_journal(spark, folder, JOURNAL, JOURNAL_KEYS, wanted)


@query("journal_inventory", f"""{JOURNAL_SQL}, n AS (SELECT day, symbol, count(*) AS rows FROM two GROUP BY ALL)
SELECT day, symbol, rows, CASE WHEN symbol % 3 = 0 AND EXISTS (SELECT 1 FROM one WHERE one.day = n.day AND one.symbol = n.symbol) THEN 2 ELSE 1 END AS versions FROM n""")
def journal_inventory(spark, root):
    return JO.inventory(spark, journal(spark, root, True)[0], JOURNAL, JOURNAL_KEYS).select("day", "symbol", "rows", "versions")


@query("static_export", f"WITH {PANEL_SQL} SELECT symbol, trade_date, mom, vlm, fwd5 FROM panel")
def static_export(spark, root):
    return TB.static_export(factor_panel(spark, root), ["mom", "vlm"], ["fwd5"]).select("symbol", "trade_date", "features.mom", "features.vlm", "labels.fwd5")


@query("contract_check", f"""WITH {BARS_SQL}, f AS (SELECT round(avg((amount > 5000)::INT), 6) AS a FROM bars) SELECT c AS "column", p AS present, v AS null_share, o AS ok FROM f, LATERAL (VALUES ('symbol', true, 0.0::DOUBLE, true), ('trade_date', true, 0.0, true), ('open', true, 0.0, true), ('high', true, 0.0, true), ('low', true, 0.0, true), ('close', true, 0.0, true), ('volume', true, 0.0, true), ('amount', true, a, true)) x(c, p, v, o)""")
def contract_check(spark, root):
    b = bars(spark, root).withColumn("amount", F.when(F.col("amount") <= 5000, F.col("amount")))
    return schemas.check_contract(b, schemas.DAILY)


@query("feature_pinning", f"WITH {PANEL_SQL} SELECT symbol, trade_date, mom, NULL::DOUBLE AS absent FROM panel")
def feature_pinning(spark, root):
    return schemas.pin_features(factor_panel(spark, root), ["symbol", "trade_date"], ["mom", "absent"])


@query("long_factor_table", f"WITH {PANEL_SQL} SELECT symbol, trade_date, factor_name, factor_value FROM (SELECT symbol, trade_date, mom, vlm FROM panel) UNPIVOT INCLUDE NULLS (factor_value FOR factor_name IN (mom, vlm))")
def long_factor_table(spark, root):
    from tickloom.plans.factors import to_long

    return to_long(factor_panel(spark, root), ["symbol", "trade_date"], ["mom", "vlm"])


@query("saved_formula", f"WITH {BARS_SQL} SELECT symbol, trade_date, {tidy_sql('close / nullif(lag(close, 3) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1')} AS f FROM bars")
def saved_formula(spark, root):
    from tickloom.plans.factors import evaluate
    from tickloom.plans.registry import from_definition

    tree = from_definition({"op": "sub", "args": [{"op": "div", "args": ["close", {"op": "delay", "args": ["close"], "params": [3]}]}, 1]})
    return t(evaluate(bars(spark, root), {"f": tree}), "f")


@query("rolling_user_function", f"""WITH {BARS_SQL} SELECT symbol, trade_date, CASE WHEN count(close) OVER w = 5 THEN {tidy_sql("list_sort(list(close) OVER w)[3]")} END AS mid FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_user_function(spark, root):
    from tickloom.plans.registry import rolling_apply

    w = Window.partitionBy("symbol").orderBy("trade_date")
    out = bars(spark, root).withColumn("mid", rolling_apply(F.col("close"), w, 5, lambda v: sorted(v)[2]))
    return t(out, "mid").select("symbol", "trade_date", "mid")
