"""Panels derived from the relational tables: daily bars, statements, ticks, predictions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.sizes import Layout

_SESSIONS_BOUND = 20_000  # trading days a daily calendar can hold; far above any real one


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def bars(spark: SparkSession, root: str) -> DataFrame:
    """One row per (supplier, ship date): trades folded into open/high/low/close, volume, amount.

    The whole fold is a partially aggregated group-by, so a supplier with a third of all lines
    leaves the scan as at most one row per day and task. First and last trades are picked by one
    bigint key, which keeps the aggregate hash-based.
    """
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    price = F.lit(100.0) + F.floor(F.col("l_extendedprice") / q) / 10000.0
    cents = F.pmod(rounded(F.col("l_extendedprice") * 100, 0).cast("long"), F.lit(1 << 20))
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * F.lit(1 << 20) + cents
    rows = table(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("trade_date"),
        key.alias("k"),
        price.alias("p"),
        rounded(price * (1 - d / 2), 8).alias("o"),
        rounded(price * (1 + t / 2), 8).alias("c"),
        rounded(price * (1 + t), 8).alias("h"),
        rounded(price * (1 - d), 8).alias("l"),
        q.alias("q"),
    )
    return rows.groupBy("symbol", "trade_date").agg(
        F.min_by("o", "k").alias("open"),
        F.max("h").alias("high"),
        F.min("l").alias("low"),
        F.max_by("c", "k").alias("close"),
        F.sum("q").alias("volume"),
        rounded(F.sum(F.col("q") * F.col("p")), 4).alias("amount"),
    )


def bars_layout(spark: SparkSession, root: str) -> Layout:
    """Window layout for ``bars``: dates are as wide as the supplier table, a footer count away."""
    return Layout.bounded(symbols=_supplier_count(spark, root), sessions=_SESSIONS_BOUND)


@lru_cache(maxsize=32)
def _supplier_count(spark: SparkSession, root: str) -> int:
    return table(spark, root, "supplier").count()


def sectors(spark: SparkSession, root: str) -> DataFrame:
    """symbol → sector (nation), concept (region); as long as the supplier table."""
    s, n, r = (table(spark, root, x) for x in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("symbol"),
            F.col("n_name").alias("sector"),
            F.col("r_name").alias("concept"),
            F.col("s_acctbal").alias("balance"),
        )
    )


def listing_code(symbol: Column) -> Column:
    """A six-digit listing code with a board prefix, spread evenly over four boards."""
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("60", "00", "30", "68")]), (symbol % 4 + 1).cast("int"))
    digits = symbol.cast("string")
    return F.concat(prefix, F.lpad(digits, 4, "0"))


def statements(spark: SparkSession, root: str) -> DataFrame:
    """Orders folded to quarterly reports that become visible 30 days after the quarter ends."""
    q = F.trunc(F.to_date("o_orderdate"), "quarter")
    end = F.date_sub(F.add_months(q, 3), 1)
    return (
        table(spark, root, "orders")
        .select(F.col("o_custkey").alias("symbol"), end.alias("report_period"), "o_totalprice", "o_orderstatus", "o_orderpriority")
        .groupBy("symbol", "report_period")
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("revenue"),
            F.count(F.lit(1)).alias("orders"),
            F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("cash"),
            F.round(F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_totalprice")).otherwise(0.0)), 2).alias("cost"),
            F.round(F.max("o_totalprice"), 2).alias("assets"),
            F.round(F.min("o_totalprice"), 2).alias("debt"),
        )
        .withColumn("available_at", F.date_add("report_period", 30).cast("timestamp"))
    )


def ticks(spark: SparkSession, root: str) -> DataFrame:
    """Events as trades: user = symbol, value = size; the id is the published sequence."""
    return table(spark, root, "events").select(
        F.col("user_id").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "event_type",
        F.round(F.lit(100.0) + F.col("value") / 10.0, 4).alias("price"),
        F.col("value").alias("size"),
    )


def bar_score() -> Column:
    """A deterministic score of a bar, with known ties."""
    day = F.datediff(F.col("trade_date"), F.lit("1995-01-01").cast("date"))
    return ((F.col("symbol") * 37 + day * 11) % 101).cast("double") / 100.0


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """A deterministic score with known ties for every bar."""
    return bars(spark, root).select(
        "symbol",
        "trade_date",
        bar_score().alias("score"),
        "close",
        "amount",
    )


# -- the same panels in SQL, for the cross-engine check ------------------------------------

BARS_SQL = """
trades AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         (l_orderkey * 8 + l_linenumber) * 1048576 + CAST(round(l_extendedprice * 100) AS BIGINT) % 1048576 AS k,
         100.0::DOUBLE + floor(l_extendedprice / l_quantity) / 10000.0::DOUBLE AS p, l_quantity AS q, l_discount AS d, l_tax AS t
  FROM lineitem),
bars AS (
  SELECT symbol, trade_date,
         arg_min(round(p * (1 - d / 2), 8), k) AS open, max(round(p * (1 + t), 8)) AS high,
         min(round(p * (1 - d), 8)) AS low, arg_max(round(p * (1 + t / 2), 8), k) AS close,
         sum(q) AS volume, round(sum(q * p), 4) AS amount
  FROM trades GROUP BY symbol, trade_date)"""

SECTORS_SQL = """
sectors AS (
  SELECT s_suppkey AS symbol, n_name AS sector, r_name AS concept, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

STATEMENTS_SQL = """
statements AS (
  SELECT o_custkey AS symbol,
         CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_period,
         round(sum(o_totalprice), 2) AS revenue, count(*) AS orders,
         round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END), 2) AS cash,
         round(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE 0.0 END), 2) AS cost,
         round(max(o_totalprice), 2) AS assets, round(min(o_totalprice), 2) AS debt,
         CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY + INTERVAL 30 DAY AS TIMESTAMP) AS available_at
  FROM orders GROUP BY ALL)"""

TICKS_SQL = """
ticks AS (
  SELECT user_id AS symbol, ts, event_id, event_type, round(100.0::DOUBLE + value / 10.0::DOUBLE, 4) AS price, value AS size FROM events)"""

PREDICTIONS_SQL = BARS_SQL + """,
predictions AS (
  SELECT symbol, trade_date,
         CAST((symbol * 37 + datediff('day', DATE '1995-01-01', trade_date) * 11) % 101 AS DOUBLE) / 100.0 AS score, close, amount
  FROM bars)"""


def tidy_sql(x: str) -> str:
    """SQL twin of ``columns.tidy``."""
    x = f"(({x}) * 1.00000000001::DOUBLE)"
    return (
        f"CASE WHEN abs({x}) < 100 THEN round(({x})::DOUBLE, 6) + 0.0 "
        f"WHEN abs({x}) < 1000000 THEN round(({x})::DOUBLE, 2) + 0.0 ELSE round(({x})::DOUBLE, -3) + 0.0 END"
    )
