"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); a component's name is its smallest id.

    Every id points to a smaller one or itself. A round lets the pointer of each id take the least pointer among its
    neighbours, hands that to what it pointed to, and then shortens the path by following pointers once; the number
    of rounds grows with the logarithm of a component's width. Both directions are aggregated with partial sums,
    so an id with very many links is no hot task.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    state = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "graph-state")
    while True:
        edges = both.join(state.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("component").alias("offer"))
        own = state.select("id", F.col("component").alias("offer"))
        met = edges.union(own).groupBy("id").agg(F.min("offer").alias("offer"))
        hooked = met.join(state, "id").select(F.col("component").alias("id"), "offer")
        best = met.union(hooked).groupBy("id").agg(F.min("offer").alias("offer"))
        jump = best.select(F.col("id").alias("offer"), F.col("offer").alias("further"))
        following = stored(best.join(jump, "offer", "left").select("id", F.least("offer", "further").alias("component")), "graph-state")
        changed = following.join(state, ["id", "component"], "left_anti").isEmpty()
        state = following
        if changed:
            return state
