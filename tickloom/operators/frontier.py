"""Non-dominated candidates by partition skylines merged in rounds, and a preference ranking of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.session import stored

#: Points that one task compares with one another.
BLOCK = 20_000
#: Skylines that meet in one merge.
FAN = 8


def skyline(points: np.ndarray) -> np.ndarray:
    """Which of the distinct ``points`` (larger is better everywhere) no other one dominates.

    Points come in order of falling sums, so a point can only be dominated by one before it, and only kept ones need
    to be looked at.
    """
    order = np.lexsort((*points.T, -points.sum(axis=1)))
    kept = np.zeros((0, points.shape[1]))
    keep = np.zeros(len(points), dtype=bool)
    for chunk in np.array_split(order, max(1, len(order) // 256)):
        rest = chunk[~beaten(points[chunk], kept)] if len(kept) else chunk
        rest = rest[~beaten(points[rest], points[rest])]
        keep[rest] = True
        kept = np.concatenate([kept, points[rest]])
    return keep


def beaten(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points are dominated by one of ``others``."""
    out = np.zeros(len(points), dtype=bool)
    for low in range(0, len(others), 1024):
        part = others[low : low + 1024]
        at_least = (part[None, :, :] >= points[:, None, :]).all(axis=2)
        out |= (at_least & (part[None, :, :] > points[:, None, :]).any(axis=2)).any(axis=1)
    return out


def _of_group(columns: list[str]):
    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[skyline(rows[columns].to_numpy(dtype=float))]

    return keep


def _of_partition(columns: list[str]):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch])
            held = both[skyline(both[columns].to_numpy(dtype=float))]
        if held is not None:
            yield held

    return keep


def pareto_front(candidates: DataFrame, objectives: dict[str, int], key: str | None = None) -> DataFrame:
    """Rows no other row dominates: none is at least as good in every objective and better in one.

    An objective's direction is +1 (more is better) or -1. Equal rows stay together; a row with an unknown objective
    cannot be compared and stays. Every partition drops what its own rows dominate; then skylines meet ``FAN`` at a
    time. Once few partitions are left, or the front itself is large, blocks of at most about ``BLOCK`` points are
    compared two by two, so no task holds the whole front.
    """
    names = list(objectives)
    signed = candidates.select(*[(F.col(c).cast("double") * d).alias(f"_o{i}") for i, (c, d) in enumerate(objectives.items())])
    columns = signed.columns
    known = signed.dropna().distinct()
    schema = ", ".join(f"{c} double" for c in columns)
    front = stored(known.mapInPandas(_of_partition(columns), schema).withColumn("_p", F.spark_partition_id()), "front")
    while True:
        seen = front.agg(F.count_distinct("_p").alias("parts"), F.count(F.lit(1)).alias("points")).first()
        if seen["parts"] <= 1 or seen["points"] > BLOCK:
            break
        merged = front.withColumn("_p", F.floor(F.col("_p") / FAN).cast("int")).groupBy("_p").applyInPandas(_of_group(columns), f"{schema}, _p int")
        front = stored(merged, "front")
    if seen["parts"] > 1:
        front = apart(front.drop("_p"), columns, -(-seen["points"] // BLOCK))
    key_of = [F.col(f"_o{i}").eqNullSafe(F.col(c).cast("double") * d) for i, (c, d) in enumerate(objectives.items())]
    met = key_of[0]
    for cond in key_of[1:]:
        met = met & cond
    told = candidates.join(front.select(*columns), met, "left_semi")
    unknown = candidates.where(F.greatest(*[F.col(c).isNull().cast("int") for c in names], F.lit(0)) == 1)
    return told.unionAll(unknown)


def apart(front: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """A large front: every block meets every other in a task of two blocks; points dominated anywhere go."""
    schema = ", ".join(f"{c} double" for c in columns)
    own = front.withColumn("_b", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))
    dealt = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"_x": F.least("_b", "_with"), "_y": F.greatest("_b", "_with")})

    def dominated(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.loc[~skyline(rows[columns].to_numpy(dtype=float)), columns]

    gone = dealt.groupBy("_x", "_y").applyInPandas(dominated, schema).distinct()
    return front.join(gone, columns, "left_anti")


def preference_rank(candidates: DataFrame, objectives: dict[str, int], weights: dict[str, float], observations: str | None = None) -> DataFrame:
    """``candidates`` with preference_score, a contribution per objective and a rank, best first.

    Each objective is scaled to [0, 1] over all candidates, turned so that more is better, and weighed; weights are
    cut at 0 and add up to 1 (even if none is positive). A constant objective scales to 0. Unknown objectives count
    as 0 before scaling. Candidates without observations are left out. The rank is dense: equal scores share it.
    """
    usable = candidates.where(F.col(observations) > 0) if observations else candidates
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in objectives}
    total = sum(max(0.0, w) for w in weights.values())
    share = {c: max(0.0, weights.get(c, 0.0)) / total if total > 0 else 1.0 / len(objectives) for c in objectives}
    ends = usable.agg(*[e for c in objectives for e in (F.min(value[c]).alias(f"_lo_{c}"), F.max(value[c]).alias(f"_hi_{c}"))])  # one row
    wide = usable.join(F.broadcast(ends))

    def unit(c: str, d: int) -> Column:
        spread = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        u = (value[c] - F.col(f"_lo_{c}")) / F.when(spread < 1e-12, 1.0).otherwise(spread)
        return F.least(F.greatest(u if d > 0 else 1.0 - u, F.lit(0.0)), F.lit(1.0))

    parts = {f"contribution_{c}": unit(c, d) * share[c] for c, d in objectives.items()}
    scored = wide.withColumns(parts).withColumn("preference_score", rounded(F.least(sum((F.col(p) for p in parts), F.lit(0.0)), F.lit(1.0)), 6))
    scores = scored.groupBy("preference_score").agg(F.count(F.lit(1)).alias("_n"))
    ranks = scores.select("preference_score", F.row_number().over(Window.orderBy(F.desc("preference_score"))).alias("preference_rank"))  # at most a million and one scores
    out = scored.join(ranks, "preference_score")
    return out.select(*candidates.columns, "preference_score", "preference_rank", *[rounded(F.col(p), 6).alias(p) for p in parts])
