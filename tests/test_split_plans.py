"""Plans for groups too large for one task give the results of the plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import factor as f
from tickloom.functions.factor import col
from tickloom.operators import cross as X
from tickloom.operators import series as S
from tickloom.operators.quantiles import exact_quantiles
from tickloom.plans.alpha101 import alphas
from tickloom.plans.factors import Layout, evaluate
from tickloom.plans.inputs import bars, ticks


def same(a, b, keys, cols, tol=1e-9):
    j = a.alias("a").join(b.alias("b"), keys, "full_outer")
    bad = F.lit(False)
    for c in cols:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        bad = bad | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol, F.lit(False))
    assert j.where(bad).count() == 0
    assert a.count() == b.count()


@pytest.mark.parametrize("layout", [Layout(split_dates=True, rank_buckets=4), Layout(split_series=True, chunk_rows=16), Layout(split_series=True, split_dates=True, chunk_rows=64, rank_buckets=3)])
def test_factor_stages_split(spark, root, layout):
    panel = bars(spark, root).cache()
    C, V = col("close"), col("volume")
    trees = {
        "a": f.rank(f.ts_rank(C, 7)), "b": f.zscore(f.mean(V, 5)), "c": f.corr(f.rank(V), f.rank(C), 6), "d": f.scale(f.delta(C, 3)),
        "e": f.demean(f.decay(C, 4)), **alphas([5, 16]),
    }
    same(evaluate(panel, trees), evaluate(panel, trees, layout), ["symbol", "trade_date"], list(trees))


def test_hot_series_is_numbered_exactly(spark, root):
    t = ticks(spark, root).withColumn("hot", F.lit(1))
    got = S.number_rows(t, ["hot"], ["ts", "event_id"], F.date_trunc("day", F.col("ts")))
    want = t.withColumn("want", F.row_number().over(Window.partitionBy("hot").orderBy("ts", "event_id")) - 1)
    assert got.join(want.select("event_id", "want"), "event_id").where("_row <> want").count() == 0


def test_previous_and_carried_values(spark, root):
    t = ticks(spark, root).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("price")))
    w = Window.partitionBy("symbol").orderBy("event_id")
    bucket = F.floor(F.col("event_id") / 37)
    got = S.previous_value(t, ["symbol"], ["event_id"], bucket, "price", "prev")
    got = S.carry_last(got, ["symbol"], ["event_id"], bucket, "v", "seen")
    want = t.select("event_id", F.lag("price").over(w).alias("prev"), F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))
    same(got.select("event_id", "prev", "seen"), want, ["event_id"], ["prev", "seen"])


def test_exact_quantiles_with_heavy_ties(spark, root):
    t = ticks(spark, root).withColumn("x", F.when(F.col("event_id") % 3 == 0, 5.0).otherwise(F.round("size", 0)))
    got = exact_quantiles(t, ["event_type"], "x", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, buckets=8)
    want = t.groupBy("event_type").agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))])
    same(got, want, ["event_type"], ["q10", "q50", "q90"])


def test_layout_is_measured(spark, root):
    panel = bars(spark, root)
    assert Layout.measured(panel, limit=10).split_series and Layout.measured(panel, limit=2).split_dates
    assert not Layout.measured(panel).split_series


def test_split_rank_does_not_gather_the_rows_of_a_shared_value(spark):
    """Ranks stay those of the plain window with a value on most rows, and its rows are joined by broadcast."""
    t = spark.range(3000).selectExpr("id", "id % 2 AS g", "CASE WHEN id % 5 > 0 THEN 0.0 ELSE id * 37 % 101 END AS x", "CASE WHEN id % 11 > 0 THEN id % 7 END AS y")
    columns = {"rx": F.col("x"), "ry": F.col("y")}
    for key in (["g"], []):
        got = X.split_rank(t, columns, key, ["id"], buckets=8, hot_rows=500)
        want = t.select("*", *[X.pct_rank(c, *key or [F.lit(1)]).alias(n) for n, c in columns.items()])
        said = lambda df: [(r.id, *(None if v is None else round(v, 12) for v in (r.rx, r.ry))) for r in df.orderBy("id").collect()]
        assert said(got) == said(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "percentile_approx" not in plan and "BroadcastHashJoin" in plan
