"""Stages hand on packed columns: every value comes back to the last bit, and a row costs far less than its doubles."""

import numpy as np
import pyarrow as pa

from tickloom.functions import factor as f
from tickloom.functions.factor import col, walk
from tickloom.plans import arrays as A
from tickloom.plans import blocks as B
from tickloom.plans.factors import _carried, evaluate


def test_values_come_back_to_the_last_bit():
    rng, n = np.random.default_rng(5), 6000
    gaps = lambda x: pa.array(np.where(rng.random(n) < 0.1, np.nan, x), from_pandas=True)
    table = pa.table({
        "symbol": pa.array(np.repeat(np.arange(n // 40), 40)), "trade_date": pa.array(np.tile(np.arange(40), n // 40).astype("int32")).cast(pa.date32()),
        "rank": rng.integers(1, 2000, n) / 2.0 / 997, "six": gaps(np.round(rng.normal(size=n), 6)), "eight": np.round(100 + rng.random(n), 8), "whole": np.floor(rng.random(n) * 50) - 20, "any": gaps(rng.normal(size=n)),
        "zero": np.where(rng.random(n) < 0.5, -0.0, 0.0), "nan": np.where(rng.random(n) < 0.1, np.nan, 1.5), "both": pa.array([1.0, None, float("nan")] * (n // 3)), "huge": np.full(n, 1e300), "inf": np.full(n, -np.inf),
        "none": pa.nulls(n, pa.float64()), "text": pa.array(["a", None, "b"] * (n // 3)), "int": pa.array([3, None] * (n // 2), pa.int64()),
    })
    cut = [table.slice(i, 700) for i in range(0, n, 700)]
    batches = list(B.packed(iter(cut), "trade_date", 7, 1500))
    together = pa.Table.from_batches(batches).sort_by("_portion").combine_chunks().to_batches(max_chunksize=4)
    parts = list(B.portions_read(iter(together), table.schema, ["trade_date", "symbol"], 1))
    days = [set(p.column("trade_date").to_pylist()) for p in parts]
    assert sum(map(len, days)) == 40 and len(parts) > 1  # a date is never cut
    got = pa.concat_tables(parts).sort_by([("symbol", "ascending"), ("trade_date", "ascending")])
    assert got.schema.equals(table.schema)
    for name in table.column_names:
        a, b = table.column(name), got.column(name)
        assert a.is_null().equals(b.is_null()), name
        if pa.types.is_float64(a.type):
            assert (a.fill_null(7.0).to_numpy().view("int64") == b.fill_null(7.0).to_numpy().view("int64")).all(), name
        else:
            assert a.equals(b), name


def test_ranks_stand_as_whole_numbers_beside_their_count():
    rng, dates, wide = np.random.default_rng(2), 30, 701
    x, y = (np.where(rng.random(dates * wide) < share, np.nan, rng.integers(0, top, dates * wide)) for share, top in ((0.1, 300), (0.2, 10**6)))
    day = np.repeat(np.arange(dates), wide)
    rank = lambda v: pa.array(np.concatenate([A.ranked(v[day == d], A.Runs(np.zeros(wide, int))) for d in range(dates)]), from_pandas=True)
    odd = pa.array(np.where(rng.random(dates * wide) < 0.1, np.nan, rng.random(dates * wide)), from_pandas=True)  # no rank: plain bits
    table = pa.table({"symbol": np.tile(np.arange(wide), dates), "day": day, "x": rank(x), "again": rank(x * 2), "y": rank(y), "full": rank(rng.random(dates * wide)), "odd": odd})
    size = {}
    for shares in ((), ("x", "again", "y", "full", "odd")):
        batches = list(B.packed(iter([table]), "symbol", 5, shares=shares, within="day"))
        got = pa.concat_tables(B.portions_read(iter(batches), table.schema, ["symbol", "day"], 1)).sort_by([("day", "ascending"), ("symbol", "ascending")])
        assert got.equals(table.select(got.column_names).combine_chunks())
        size[shares] = sum(b.nbytes for b in batches)
    assert min(size.values()) == list(size.values())[1] < 0.7 * list(size.values())[0]


def test_text_keys_meet_whatever_the_task():
    one, two = pa.chunked_array([["a", "b", None]]), pa.chunked_array([[None, "c"], ["b", "a"]])
    p, q = B.portions_of(one, 64).tolist(), B.portions_of(two, 64).tolist()
    assert (p[0], p[1], p[2]) == (q[3], q[2], q[0])


C, V = col("close"), col("volume")
TREES = {
    "early": f.rank(C) * f.rank(f.mean(V, 5)) + f.rank(f.delta(C, 3)),
    "flag": f.truth((f.delta(C, 1) > 0.0) & (f.rank(V) > 0.5)),
    "deep": f.rank(f.corr(f.rank(C), f.rank(V), 4)),
    "deeper": f.mean(f.rank(f.std(f.rank(C - f.delay(C, 2)), 5)), 3),
}


def test_complete_factors_and_trees_move_as_one_column():
    done = {n.key for n in walk(TREES.values()) if n.kind == "series" and all(x.kind != "cross" for x in walk([n]))}
    done |= {n.key for n in walk(TREES.values()) if n.kind == "cross" and all(x.kind != "cross" for x in walk(n.args))}
    later = [n for n in walk(TREES.values()) if n.kind != "row" and n.key not in done]
    cols, trees, ends = _carried([a for n in later for a in n.args], TREES, done, ["close", "volume"])
    assert ends == ["early", "flag"] and cols == []
    assert {n.op for n in trees.values()} == {"rank"} and len(trees) == 3


def test_a_row_costs_few_bytes(spark):
    """Rows of plain doubles took 188 bytes for these exchanges."""
    rng, symbols, days = np.random.default_rng(11), 150, 300
    import pandas as pd

    pdf = pd.DataFrame({"symbol": np.repeat(np.arange(symbols), days), "day": np.tile(np.arange(days), symbols), "close": np.round(100 + rng.random(symbols * days), 4), "volume": rng.integers(1, 50, symbols * days).astype(float)})
    panel = spark.createDataFrame(pdf).selectExpr("symbol", "date_add(date'2024-01-01', cast(day as int)) AS trade_date", "close", "volume")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    evaluate(panel, TREES, tidied=True).write.format("noop").mode("overwrite").save()
    assert 0 < written() - before < 130 * symbols * days
