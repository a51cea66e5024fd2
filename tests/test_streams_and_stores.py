"""Streams give what the batch operators give; stores do not depend on layout."""

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators.intraday import session_bars
from tickloom.operators.pit import asof_join
from tickloom.plans.inputs import bars, ticks
from tickloom.sources import tables as TB
from tickloom.streaming import events as ST


def arriving(spark, root, folder, parts):
    e = ticks(spark, root).select("event_id", "symbol", "ts", "price", "size")
    for i, cond in enumerate(parts):
        e.where(cond).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    return "event_id long, symbol long, ts timestamp, price double, size double"


def test_stream_bars_equal_batch_bars(spark, root, tmp_path):
    schema = arriving(spark, root, tmp_path, ["ts < '2024-01-10'", "ts >= '2024-01-10'"])
    stream = ST.file_stream(spark, f"{tmp_path}/in/*", schema, max_files=1)
    ST.run_available(ST.stream_bars(stream, 60, "ts", "price", "size", "2 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = session_bars(ticks(spark, root), 60, "ts", "price", "size").drop("last_seen")
    end = batch.agg(F.max("bar_end")).first()[0]
    want = batch.where(F.col("bar_end") <= F.lit(end) - F.expr("INTERVAL 2 DAYS"))
    cols = ["symbol", "bar_end", "open", "high", "low", "close"]
    assert got.count() == want.count() > 0
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0


def test_ordered_sink_separates_late_rows_and_resumes(spark, root, tmp_path):
    schema = arriving(spark, root, tmp_path, ["event_id % 10 <> 3"])
    run = lambda: ST.ordered_sink(ST.file_stream(spark, f"{tmp_path}/in/*", schema), f"{tmp_path}/out", f"{tmp_path}/late", f"{tmp_path}/cp", "ts", ["ts", "event_id"])
    run()
    before = spark.read.parquet(f"{tmp_path}/out").count()
    late = ticks(spark, root).select("event_id", "symbol", "ts", "price", "size").where("event_id % 10 = 3")
    late.coalesce(1).write.parquet(f"{tmp_path}/in/part=9")
    run()  # resumes from its checkpoint: earlier rows are not emitted again
    total = ticks(spark, root).count()
    on_time, refused = spark.read.parquet(f"{tmp_path}/out").count(), spark.read.parquet(f"{tmp_path}/late").count()
    assert on_time + refused == total and refused > 0 and on_time >= before


def test_duplicates_are_dropped(spark, root, tmp_path):
    schema = arriving(spark, root, tmp_path, ["event_id < 400", "event_id < 200"])
    stream = ST.file_stream(spark, f"{tmp_path}/in/*", schema)
    ST.run_available(ST.unique_events(stream, "ts", "60 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == ticks(spark, root).where("event_id < 400").count()


def test_digest_ignores_arrival_order(spark, root):
    t = ticks(spark, root)
    hour = F.date_trunc("hour", F.col("ts"))
    digest = lambda df: ST.ordered_digest(df, ["ts", "event_id"], "event_id", hour, chunk=100).first().digest
    first = digest(t)
    assert first == digest(t.repartition(7).orderBy(F.rand(1)))
    assert first != digest(t.where("event_id <> 5"))


def test_content_hash_ignores_row_and_column_order(spark, root):
    b = bars(spark, root)
    a = TB.content_hash(b, ["symbol"])
    c = TB.content_hash(b.select(*reversed(b.columns)).orderBy(F.rand(2)), ["symbol"])
    assert a.exceptAll(c).count() == 0
    d = TB.content_hash(b.withColumn("close", F.col("close") + 0.01), ["symbol"])
    assert a.select("content_hash").intersect(d.select("content_hash")).count() == 0


@pytest.mark.parametrize("suffix", ["parquet", "csv", "json", "orc"])
def test_table_suffixes(spark, root, tmp_path, suffix):
    b = bars(spark, root)
    path = f"{tmp_path}/panel.{suffix}"
    TB.write_table(b, path)
    back = TB.read_table(spark, path, None if suffix in ("parquet", "orc") else b.schema)
    assert back.select(b.columns).exceptAll(b).count() == 0


def test_partitioned_write_prunes(spark, root, tmp_path):
    b = bars(spark, root).withColumn("year", F.year("trade_date"))
    TB.write_table(b, f"{tmp_path}/panel", ["year"])
    back = TB.read_table(spark, f"{tmp_path}/panel").where("year = 1998")
    assert back.count() == b.where("year = 1998").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_unknown_suffix_and_unsafe_features(spark, root):
    with pytest.raises(ValueError):
        TB.read_table(spark, "/tmp/x.xlsx")
    with pytest.raises(ValueError):
        TB.static_export(bars(spark, root), ["forward_return_5d"], ["close"])


def test_asof_needs_availability(spark, root):
    b = bars(spark, root)
    with pytest.raises(ValueError):
        asof_join(b, b.select("symbol", "close"), ["symbol"], "trade_date", "available_at")


def test_asof_keeps_matched_null_rows(spark):
    left = spark.createDataFrame([(1, "2024-01-05"), (1, "2024-01-01"), (2, "2024-01-05")], "symbol int, d string").selectExpr("symbol", "to_date(d) as trade_date")
    right = spark.createDataFrame([(1, "2024-01-02", 5.0), (1, "2024-01-05", None)], "symbol int, d string, v double").selectExpr("symbol", "to_date(d) as at", "v")
    for bucket in (None, "day"):
        rows = asof_join(left, right, ["symbol"], "trade_date", "at", keep_time=True, bucket=bucket).collect()
        got = {(r.symbol, str(r.trade_date)): (r.v, r["at"] and str(r["at"])[:10]) for r in rows}
        assert got == {(1, "2024-01-05"): (None, "2024-01-05"), (1, "2024-01-01"): (None, None), (2, "2024-01-05"): (None, None)}


def test_contract_names_missing_columns(spark, root):
    b = bars(spark, root).drop("open")
    assert schemas.missing_columns(b, schemas.DAILY) == ["open"]
    bad = [r.column for r in schemas.check_contract(b, schemas.DAILY).collect() if not r.ok]
    assert bad == ["open"]
    assert schemas.feature_drift(b, ["open", "close"], ["symbol", "trade_date"])["missing"] == ["open"]
