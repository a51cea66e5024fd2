"""Combinatorial purged cross-validation: every choice of test groups, and the back-test paths they make."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.series import number_rows


def split_plan(spark: SparkSession, groups: int, tested: int) -> DataFrame:
    """(split, group, path): the test groups of every split. The j-th split that tests a group belongs to path j, so
    each path tests every group once."""
    rows, used = [], dict.fromkeys(range(groups), 0)
    for split, chosen in enumerate(combinations(range(groups), tested)):
        for g in chosen:
            rows.append((split, g, used[g]))
            used[g] += 1
    return spark.createDataFrame(rows, "split int, group int, path int")


def combinatorial_folds(samples: DataFrame, start: str, end: str, groups: int = 6, tested: int = 2, embargo: float = 0.01, tie: tuple[str, ...] = ()) -> DataFrame:
    """Every (split, sample) with role train, test, purged or embargo, the sample's group, and its path where tested.

    Samples are numbered by start, end and ``tie`` and cut into equal contiguous groups. A training sample whose label
    span meets the span from the first start to the last end of the split's test samples is purged, and the
    ``embargo`` share of all samples that follows a test group is left out. An unknown end never meets a span. Spans
    are one row per split, so tagging is a join with C(groups, tested) rows.
    """
    spark = samples.sparkSession
    one = samples.withColumn("_g", F.lit(1))
    numbered = number_rows(one, ["_g"], [start, end, *tie], F.col(start), "_i").drop("_g")
    size = samples.agg(F.count(F.lit(1)).alias("_n"))
    numbered = numbered.join(F.broadcast(size)).withColumn("group", F.floor(((F.col("_i") + 1) * groups - 1) / F.col("_n")).cast("int"))
    plan = split_plan(spark, groups, tested)
    ends = numbered.groupBy("group").agg(F.min(start).alias("_t0"), F.max(end).alias("_t1"), F.max("_i").alias("_last"), F.max("_n").alias("_all"))
    of_split = plan.join(F.broadcast(ends), "group")  # one row per group of each split
    spans = of_split.groupBy("split").agg(
        F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1"), F.collect_list(F.struct("group", "path")).alias("_tests"), F.collect_list("_last").alias("_lasts"),
        F.ceil(F.max("_all") * F.lit(float(embargo))).alias("_reach"),
    )
    both = numbered.join(F.broadcast(spans))  # C(groups, tested) rows
    mine = F.filter("_tests", lambda t: t["group"] == F.col("group"))
    after = F.exists("_lasts", lambda z: (F.col("_i") > z) & (F.col("_i") <= z + F.col("_reach")))
    role = F.when(F.size(mine) > 0, "test").when((F.col(end) >= F.col("_t0")) & (F.col(start) <= F.col("_t1")), "purged").when(after, "embargo").otherwise("train")
    return both.select(*samples.columns, "split", "group", role.alias("role"), F.when(F.size(mine) > 0, mine[0]["path"]).alias("path"))


def path_returns(tagged: DataFrame, date: str, ret: str) -> DataFrame:
    """(path, date, group, split, side, ret): every back-test path put together from the splits that test its groups.

    The bet of a split is the sign of its mean training return; a split without training samples bets nothing.
    """
    trained = tagged.groupBy("split").agg(F.signum(F.coalesce(F.avg(F.when(F.col("role") == "train", F.col(ret))), F.lit(0.0))).alias("side"))
    tests = tagged.where("role = 'test'").join(F.broadcast(trained), "split")  # one row per split
    return tests.select("path", date, "group", "split", "side", (F.col("side") * F.col(ret)).alias(ret))
