"""Books on odd inputs, against what the plain definition gives."""

import duckdb

import __spark_entry__ as entry
from tests.conftest import ROOT
from tickloom.operators import portfolio as P
from tools.compare import rows


def test_fill_of_nothing_takes_no_place(spark):
    rows = [("a", 1, "buy", 5.0, 10.0), ("a", 2, "sell", 3.0, 11.0), ("a", 3, "sell", 0.0, 99.0), ("a", 4, "buy", 0.0, 1.0), ("a", 5, "sell", 2.0, 12.0)]
    fills = spark.createDataFrame(rows, "symbol string, event_id long, side string, quantity double, price double")
    got = sorted(tuple(r) for r in P.fifo_matches(fills, ["event_id"]).select("bought_at", "sold_at", "quantity", "pnl").collect())
    assert got == [(1, 2, 3.0, 3.0), (1, 5, 2.0, 4.0)]


def test_guard_with_a_day_of_empty_trades(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * from '{ROOT}/events.parquet' union all by name select * replace (event_id + 10000000 as event_id, user_id + 500000 as user_id, 0.0::double as value) from '{ROOT}/events.parquet' where event_id < 3) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = entry.queries()["microstructure_guard"](spark, str(tmp_path))
    rel = con.execute(entry.oracle_sql()["microstructure_guard"])
    want = rows([d[0] for d in rel.description], rel.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
