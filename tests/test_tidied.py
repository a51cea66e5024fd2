"""Factors are rounded in the last stage's arrays, with the values of ``columns.tidy``."""

import math

import numpy as np
from pyspark.sql import functions as F

from tickloom.checks import QUERIES
from tickloom.functions import factor as f
from tickloom.functions.columns import rounded, tidy
from tickloom.plans.arrays import tidy_values
from tickloom.plans.factors import Layout, evaluate


def by_hand(x):
    """The SQL's rule: half away from zero on the scaled double."""
    x = x * 1.00000000001
    half = lambda y: y if abs(y) >= 2**52 else math.copysign(math.floor(abs(y)) + (abs(y) - math.floor(abs(y)) >= 0.5), y)
    if abs(x) < 100:
        return half(x * 1e6) / 1e6 + 0.0
    return (half(x * 100.0) / 100.0 if abs(x) < 1e6 else half(x / 1000.0) * 1000.0) + 0.0


def test_tidy_is_one_rule_everywhere(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, 0.4999999, -2.5e-6, 0.1234565, 99.9999999999, -99.99999995, 100.005, 999999.995, 1e6, -1500.0, 2.5e9, 1e15 + 500, 4.6e18, -3e22, 1e300]
    values += (rng.normal(size=300) * 10.0 ** rng.integers(-7, 12, 300)).tolist()
    want = [by_hand(x) for x in values]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select(tidy(F.col("x"))).collect()]
    assert got == want and tidy_values(np.array(values)).tolist() == want
    assert all(math.copysign(1, v) == 1 for v in got if v == 0)


def test_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-0.25,), (2.5,)], "x double").coalesce(1)
    got = [tuple(r) for r in df.select(tidy(df.x), rounded(df.x, 0), rounded(df.x, 1)).collect()]
    assert got[0] == (None, None, None) and all(math.isnan(v) for v in got[1]) and got[2] == (math.inf,) * 3
    assert got[3] == (-0.25, 0.0, -0.3) and got[4] == (2.5, 3.0, 2.5)


def test_both_plans_round_alike(spark, root):
    from tickloom.plans.inputs import bars

    p = bars(spark, root).where("symbol <= 6").cache()
    trees = {"m": f.mean(f.returns(f.col("close")), 5), "v": f.total(f.col("amount"), 5), "r": f.rank(f.col("volume"))}
    rows = lambda lay: sorted(map(tuple, evaluate(p, trees, lay, tidied=True).collect()))
    assert repr(rows(None)) == repr(rows(Layout(split_series=True, split_dates=True, chunk_rows=50, rank_buckets=3)))


def test_no_projection_rounds_the_factors(spark, root):
    """Eighteen rounded columns made one generated method that the JVM never compiled, by decimal text at that."""
    plan = QUERIES["factors_default18"](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and plan.lstrip().startswith("MapInArrow")
