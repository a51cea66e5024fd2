"""A mean that is an exact half is rounded as one, whatever its rows' order."""

from pyspark.sql import functions as F

from tickloom.functions.columns import rounded, rounded_mean


def test_exact_halves_and_missing_values(spark):
    half = [0.000549, -0.000251, 0.001203, 0.000333, -0.000084]  # 1,750 millionths over five rows: 0.00035
    rows = [("up", v) for v in half] + [("down", -v) for v in half] + [("none", None), ("some", None), ("some", 0.00012), ("zero", 0.00002), ("zero", -0.00002)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "k string, x double").repartition(parts)
        got = {r["k"]: r["m"] for r in df.groupBy("k").agg(rounded_mean(F.col("x"), 4).alias("m")).collect()}
        assert got == {"up": 0.0004, "down": -0.0004, "none": None, "some": 0.0001, "zero": 0.0}
        assert str(got["zero"]) == "0.0"


def test_float_sums_would_decide_some_halves_by_their_order(spark):
    rows = [(k, i, v) for k, seed in enumerate(range(40)) for i, v in enumerate(halves(seed))]
    df = spark.createDataFrame(rows, "k int, i int, x double").coalesce(1)
    plain, exact = rounded(F.avg("x"), 4), rounded_mean(F.col("x"), 4)
    got = df.groupBy("k").agg(plain.alias("plain"), exact.alias("exact")).collect()
    assert all(r["exact"] == 0.0124 for r in got)
    assert any(r["plain"] == 0.0123 for r in got)


def halves(seed: int, n: int = 60) -> list[float]:
    """n returns of six decimals whose mean is just 0.01235."""
    import random

    draw = random.Random(seed)
    whole = [draw.randint(-80_000, 90_000) for _ in range(n - 1)]
    return [w / 1e6 for w in [*whole, 12_350 * n - sum(whole)]]
