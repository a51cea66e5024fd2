"""Monotone calibration of scores: isotonic regression pooled in range partitions, and its lookup."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.cross import pct_rank
from tickloom.operators.quantiles import exact_quantiles
from tickloom.session import stored

#: Blocks that one task may pool at the end; while there are more, neighbours are pooled side by side.
ONE_TASK = 100_000
_BLOCKS = "part int, pos long, sx double, sy double, n double"


def pool(sx: np.ndarray, sy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent blocks in order of x, given as sums, joined until their means do not fall."""
    out: list[list[float]] = []
    for x, y, w in zip(sx.tolist(), sy.tolist(), n.tolist(), strict=True):
        while out and out[-1][1] * w > y * out[-1][2]:
            px, py, pw = out.pop()
            x, y, w = x + px, y + py, w + pw
        out.append([x, y, w])
    found = np.array(out, dtype=float).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _pooled_part(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "pos"])
    sx, sy, n = pool(*(rows[c].to_numpy() for c in ("sx", "sy", "n")))
    return pd.DataFrame({"part": np.int32(rows["deal"].iloc[0]), "pos": np.arange(len(n)), "sx": sx, "sy": sy, "n": n})


def _edges(blocks: DataFrame) -> DataFrame:
    """One row per part: its size, its border means, its first block. As many rows as there are range partitions."""
    first, last = F.min_by(F.struct("sx", "sy", "n"), "pos"), F.max_by(F.struct("sx", "sy", "n"), "pos")
    return blocks.groupBy("part").agg(F.count(F.lit(1)).alias("held"), first.alias("first"), last.alias("last"))


def isotonic_blocks(points: DataFrame, x: str, y: str, partitions: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(part, pos, x, y, n): the blocks of the non-decreasing least-squares fit of y on x, in order of (part, pos).

    Equal x are folded first. Every range of x pools its own values; then ranges are cut in halves and pooled with
    their neighbours' halves, so a border lies inside a range in the next round, until no border falls. A fit that is
    monotone already ends after one round. Ranges of at most ``one_task`` blocks go to a neighbour whole, so they grow
    fewer; once no more blocks than that are left, one task pools them all. Pooling is exact in any order. Rows with a null or NaN are left out. A block's x is the mean of its x values.
    """
    known = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x = x AND y = y AND NOT isnan(x) AND NOT isnan(y)")
    tied = known.groupBy("x").agg(F.sum("y").alias("sy"), F.count(F.lit(1)).cast("double").alias("n"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0)] * 3
        for batch in batches:
            held = pool(*(np.concatenate([a, b]) for a, b in zip(held, (batch["x"] * batch["n"], batch["sy"], batch["n"]), strict=True)))
        yield pd.DataFrame({"sx": held[0], "sy": held[1], "n": held[2]})

    ranges = tied.repartitionByRange(partitions, "x") if partitions else tied.repartitionByRange("x")
    first = ranges.sortWithinPartitions("x").mapInPandas(own, "sx double, sy double, n double")
    blocks = stored(first.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "sx", "sy", "n"), "isotonic")
    for turn in count():
        edges = _edges(blocks).withColumn("before", F.lag("last").over(Window.orderBy("part")))
        seen = edges.agg(F.sum("held").alias("held"), F.max((F.col("before.sy") * F.col("first.n") > F.col("first.sy") * F.col("before.n")).cast("int")).alias("falls")).first()
        if not seen["falls"]:
            return blocks.select("part", "pos", (F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y"), "n")
        dense = edges.select("part", "held", (F.row_number().over(Window.orderBy("part")) - 1).alias("rank"))
        low = blocks.groupBy("part").agg(F.min("pos").alias("low"))
        second = F.when(F.col("held") <= one_task, F.pmod(F.col("rank") + turn, F.lit(2))).otherwise((2 * (F.col("pos") - F.col("low")) >= F.col("held")).cast("int"))
        half = F.floor((2 * F.col("rank") + second + 1) / 2)
        placed = blocks.join(F.broadcast(dense), "part").join(F.broadcast(low), "part")  # one row per range each
        dealt = placed.withColumn("deal", (F.lit(0) if seen["held"] <= one_task else half).cast("int"))
        pooled = dealt.select("deal", "part", "pos", "sx", "sy", "n").groupBy("deal").applyInPandas(_pooled_part, _BLOCKS)
        blocks = stored(pooled, "isotonic")


def isotonic_lookup(df: DataFrame, x: str, blocks: DataFrame, out: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``out``: the fit at x, on straight lines between the blocks' x and flat beyond them. Null x → null.

    Distinct values of x and the lines meet in ``buckets`` ranges of x; a line that crosses ranges stands in each. An
    empty fit says one half.
    """
    edges = _edges(blocks.select("part", "pos", F.col("x").alias("sx"), F.col("y").alias("sy"), "n"))
    after = edges.select("part", F.lead("first").over(Window.orderBy("part")).alias("next"))  # one row per range of x
    own = F.lead(F.struct("x", "y")).over(Window.partitionBy("part").orderBy("pos"))
    lines = blocks.withColumn("own", own).join(F.broadcast(after), "part").select(
        F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce("own.x", "next.sx").alias("x1"), F.coalesce("own.y", "next.sy").alias("y1")
    )
    floor = edges.agg(F.min_by("first", "part").alias("f")).first()["f"]  # the first block
    asked = df.select(F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL").distinct()
    cuts = asked.agg(F.percentile_approx("_x", [k / buckets for k in range(1, buckets)]).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))

    def bucket(v: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= v)) if cuts else F.lit(0)

    spread = lines.withColumn("_b", F.explode(F.sequence(bucket(F.col("x0")), F.when(F.col("x1").isNull(), F.lit(len(cuts))).otherwise(bucket(F.col("x1"))))))
    both = asked.select(bucket(F.col("_x")).alias("_b"), F.col("_x").alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("_l")).unionAll(
        spread.select("_b", F.col("x0").alias("_at"), F.lit(0).alias("_k"), F.struct("x0", "y0", "x1", "y1").alias("_l"))
    )
    w = Window.partitionBy("_b").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_l", F.last("_l", ignorenulls=True).over(w)).where("_k = 1")
    line = F.col("_l.y0") + F.when(F.col("_l.x1") > F.col("_l.x0"), (F.col("_l.y1") - F.col("_l.y0")) * (F.col("_at") - F.col("_l.x0")) / (F.col("_l.x1") - F.col("_l.x0"))).otherwise(0.0)
    first = F.lit(floor["sy"] if floor else 0.5)
    told = met.select(F.col("_at").alias("_x"), F.coalesce(line, first).alias(out))
    return df.join(told, F.col(x).cast("double") == F.col("_x"), "left").drop("_x")


def calibrated(train: DataFrame, apply: DataFrame, score: str, label: str, alpha: float = 0.1, buckets: int = 10, partitions: int | None = None) -> DataFrame:
    """``apply`` with calib_rank, p_beat, expected_forward_return and a conformal band, learned from ``train`` alone.

    The score's percent rank of its date (one half where the score is missing) is mapped to the share of names that
    beat their date's mean label. Ten rank buckets give the expected label, and the ``1 - alpha`` quantile of the
    absolute residuals of a bucket its width; a bucket with under five residuals takes the width of all.
    """
    d = train.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_rank", pct_rank(F.col(score), "trade_date"))
    d = d.withColumn("_beat", (F.col(label) - F.avg(label).over(Window.partitionBy("trade_date")) > 1e-12).cast("double"))  # rounding beats nobody
    d = stored(d.select("_rank", "_beat", F.col(label).alias("_y")), "calibration")

    def bucket(r: Column) -> Column:
        return sum(((r >= k / buckets).cast("int") for k in range(1, buckets)), F.lit(0))

    d = d.withColumn("_bucket", bucket(F.col("_rank")))
    centre = d.groupBy("_bucket").agg(F.avg("_y").alias("_centre"))
    spread = d.join(F.broadcast(centre), "_bucket").withColumn("_gap", F.abs(F.col("_y") - F.col("_centre")))
    whole = exact_quantiles(spread, [], "_gap", {"_all_width": 1 - alpha})
    widths = exact_quantiles(spread, ["_bucket"], "_gap", {"_width": 1 - alpha}).join(spread.groupBy("_bucket").agg(F.count("_gap").alias("_n")), "_bucket")
    every = d.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_bucket"))
    totals = d.agg(F.avg("_y").alias("_mean")).join(F.broadcast(whole))  # one row each
    table = every.join(centre, "_bucket", "left").join(widths, "_bucket", "left").join(F.broadcast(totals)).select(
        "_bucket", F.coalesce("_centre", "_mean").alias("expected_forward_return"), F.coalesce(F.when(F.col("_n") >= 5, F.col("_width")), F.col("_all_width")).alias("conformal_width")
    )
    table = table.withColumn("uncertainty", F.least(F.greatest(F.col("conformal_width") / F.greatest(F.max("conformal_width").over(Window.partitionBy()), F.lit(1e-12)), F.lit(0.0)), F.lit(1.0)))
    ranked = apply.withColumn("calib_rank", F.coalesce(pct_rank(F.col(score), "trade_date"), F.lit(0.5)))
    clipped = isotonic_blocks(d, "_rank", "_beat", partitions).withColumn("y", F.least(F.greatest("y", F.lit(0.0)), F.lit(1.0)))
    mapped = isotonic_lookup(ranked, "calib_rank", clipped, "p_beat").withColumn("_bucket", bucket(F.col("calib_rank")))
    banded = mapped.join(F.broadcast(table), "_bucket").drop("_bucket")  # one row per bucket
    return banded.withColumns({
        "conformal_lower": F.col("expected_forward_return") - F.col("conformal_width"), "conformal_upper": F.col("expected_forward_return") + F.col("conformal_width"),
    })
