"""Many patterns in one pass over texts, and what concepts, revenue shares and themes make of the matches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns that one automaton holds; a larger list is matched in several passes of this size.
PATTERNS = 50_000


def matched(df: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern", out: str = "matched", at_once: int = PATTERNS) -> DataFrame:
    """``df`` with the sorted distinct patterns that stand anywhere in ``text``; null text: null, none found: empty.

    Patterns are sorted and cut into lists of at most ``at_once``. An Aho-Corasick automaton of a list reads each text
    once, whatever the number of patterns in it. The automaton is built from the list in each task, so only the list,
    whose size is bounded, is sent. Null and empty patterns match nothing. Matching is exact and by characters.
    """
    known = patterns.select(F.col(pattern).cast("string").alias("p")).where("p <> ''").distinct()
    total = known.count()
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema], T.StructField(out, T.ArrayType(T.StringType()), True)])
    lists = [[r.p for r in known.where(F.pmod(F.xxhash64("p"), F.lit(-(-total // at_once))) == k).collect()] for k in range(-(-total // at_once))]  # about at_once strings each

    def pass_over(found: list[str], last: str | None, name: str):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in found:
                automaton.add_word(p, p)
            automaton.make_automaton()
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                before = batch.column(batch.schema.get_field_index(last)).to_pylist() if last else [None] * len(texts)
                hits = [None if t is None else sorted({p for _, p in automaton.iter(t)} | set(b or ())) for t, b in zip(texts, before, strict=True)]
                keep = [i for i, n in enumerate(batch.schema.names) if n != last]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(hits, pa.list_(pa.string()))], names=[*[batch.schema.names[i] for i in keep], name])

        return task

    if not lists:
        return df.withColumn(out, F.when(F.col(text).isNotNull(), F.array().cast("array<string>")))
    done = df.mapInArrow(pass_over(lists[0], None, out), schema)
    for more in lists[1:]:
        done = done.mapInArrow(pass_over(more, out, out), schema)
    return done


def tagged(df: DataFrame, text: str, patterns: DataFrame, tags: list[str], pattern: str = "pattern") -> DataFrame:
    """One row per row of ``df`` and tag of a matched pattern: ``df``'s columns and the tags. A tag met by several
    patterns stands once. Rows without a match have none."""
    hits = matched(df, text, patterns, pattern, "_hit").withColumn("_hit", F.explode("_hit"))
    return hits.join(patterns.select(F.col(pattern).alias("_hit"), *tags), "_hit").drop("_hit").distinct()


# -- concepts ------------------------------------------------------------------------------


def board_leaves(boards: DataFrame, taxonomy: DataFrame, excluded: DataFrame, board: str = "board") -> DataFrame:
    """One row per board: whether it is a concept (not excluded), and its leaves as 'industry/chain/leaf' in order.

    ``taxonomy`` has (industry, chain, leaf, board); a board may belong to several leaves, and to none.
    """
    path = F.concat_ws("/", "industry", "chain", "leaf")
    leaves = taxonomy.groupBy(F.col("board").alias(board)).agg(F.sort_array(F.collect_set(path)).alias("leaves"))
    noise = excluded.select(F.col("board").alias(board)).distinct().withColumn("_noise", F.lit(True))
    met = boards.select(board).distinct().join(leaves, board, "left").join(noise, board, "left")
    return met.select(board, F.col("_noise").isNull().alias("is_concept"), F.coalesce("leaves", F.array().cast("array<string>")).alias("leaves"))


def taxonomy_coverage(mapped: DataFrame) -> DataFrame:
    """One row: boards, excluded ones, concepts, and how many concepts have a leaf."""
    concept, held = F.col("is_concept"), F.size("leaves") > 0
    return mapped.agg(
        F.count(F.lit(1)).alias("live_boards"), F.count_if(~concept).alias("excluded_noise"), F.count_if(concept).alias("concept_boards"), F.count_if(concept & held).alias("mapped_to_taxonomy"),
    )


def revenue_purity(segments: DataFrame, keywords: DataFrame, views: list[str], symbol: str = "symbol", as_of: Column | None = None) -> DataFrame:
    """(symbol, concept, exposure, confidence, verified): the share of a company's revenue in segments that a concept's
    keywords name.

    ``segments`` has (symbol, view, period, segment, share), ``keywords`` (concept, pattern). Of each company one view
    counts, the first of ``views`` that it has (all rows if none), and its last period only. Shares above 1.5 are
    percentages. Negative shares count as 0 and the sum is cut at 1. Every company meets every concept whose keyword
    stands in one of its segments; a company without such a segment has no row for the concept.
    """
    order = F.coalesce(*[F.when(F.col("view") == v, F.lit(i)) for i, v in enumerate(views)], F.lit(len(views)))
    ranked = segments.withColumn("_v", order)
    best = ranked.groupBy(symbol).agg(F.min("_v").alias("_best"))
    chosen = ranked.join(best, symbol).where("_v = _best")
    chosen = chosen.join(chosen.groupBy(symbol).agg(F.max("period").alias("_last")), symbol).where("period = _last")
    scale = chosen.groupBy(symbol).agg(F.when(F.max("share") > 1.5, 100.0).otherwise(1.0).alias("_scale"))
    rows = chosen.join(scale, symbol).select(symbol, "period", "segment", F.monotonically_increasing_id().alias("_row"), (F.greatest(F.col("share"), F.lit(0.0)) / F.col("_scale")).alias("_share"))
    hits = tagged(rows, "segment", keywords, ["concept"])
    summed = hits.groupBy(symbol, "concept").agg(F.least(F.sum("_share"), F.lit(1.0)).alias("_e"), F.max("period").alias("verified"))
    e = F.round("_e", 3)
    confidence = F.when(F.col("_e") >= 0.30, "high").when(F.col("_e") >= 0.10, "medium").when(F.col("_e") > 0, "low").otherwise("none")
    return summed.select(symbol, "concept", e.alias("exposure"), confidence.alias("confidence"), F.coalesce("verified", as_of) if as_of is not None else F.col("verified"))


# -- themes --------------------------------------------------------------------------------

#: Weights of a theme's strength, and what market metrics count where they are unknown.
STRENGTH = {"policy_strength": 0.28, "market_strength": 0.20, "industry_fundamental_strength": 0.24, "capital_flow_strength": 0.18, "news_sentiment_strength": 0.10}
UNKNOWN = {
    "market_strength": 0.35, "industry_fundamental_strength": 0.30, "capital_flow_strength": 0.30, "news_sentiment_strength": 0.30, "bubble_risk": 0.20, "crowding_score": 0.25,
    "invalidation_score": 0.0, "trend_decay_score": 0.0,
}
#: The share of its horizon after which a theme of each stage is looked at again.
EXPIRY = {
    "policy_seed": 1.0, "narrative_formation": 0.8, "capital_inflow": 0.6, "fundamental_validation": 0.8, "earnings_realization": 0.7, "valuation_bubble": 0.3, "divergence": 0.3, "decay": 0.2, "invalidated": 0.0,
}


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def lifecycle_stage() -> Column:
    """Stage of a theme from its strengths and risks; the first rule that holds decides."""
    policy, market, fundamental, flow = (unit(F.col(c)) for c in ("policy_strength", "market_strength", "industry_fundamental_strength", "capital_flow_strength"))
    bubble, crowding, invalid, decay = (unit(F.col(c)) for c in ("bubble_risk", "crowding_score", "invalidation_score", "trend_decay_score"))
    rules = {
        "invalidated": invalid >= 0.80, "decay": (decay >= 0.70) & (market < 0.45), "valuation_bubble": (bubble >= 0.75) & (crowding >= 0.65) & (market >= 0.60),
        "divergence": (crowding >= 0.70) & (fundamental >= 0.50) & (market < 0.65), "earnings_realization": (fundamental >= 0.75) & (policy >= 0.45), "fundamental_validation": fundamental >= 0.55,
        "capital_inflow": (flow >= 0.60) & (market >= 0.55), "narrative_formation": (policy >= 0.60) & (market >= 0.35),
    }
    return F.coalesce(*[F.when(cond, stage) for stage, cond in rules.items()], F.lit("policy_seed"))


def theme_profiles(evidence: DataFrame, market: DataFrame, as_of: Column) -> DataFrame:
    """One row per theme of the evidence: strengths, stage, horizon, confidence, expiry date and evidence counts.

    ``evidence`` has (theme, magnitude, confidence, official, horizon_days, direction); ``market`` has (theme) and any
    of the market metrics, unknown ones count as the fixed values above. Policy strength is the mean of magnitude
    times confidence over official evidence. Evidence without a theme is left out.
    """
    official = F.when(F.col("official"), F.col("magnitude") * F.col("confidence"))
    folded = evidence.where("theme IS NOT NULL AND theme <> ''").groupBy("theme").agg(
        F.coalesce(F.avg(official), F.lit(0.0)).alias("policy_strength"), F.least(F.lit(126), F.max("horizon_days")).cast("int").alias("horizon_days"),
        F.least(F.lit(1.0), F.avg("confidence") + 0.05 * F.count(F.lit(1))).alias("theme_confidence"), F.count_if(F.col("direction") >= 0).alias("supporting"), F.count_if(F.col("direction") < 0).alias("opposing"),
    )
    told = folded.join(market, "theme", "left")
    told = told.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in market.columns else F.lit(v) for c, v in UNKNOWN.items()})
    strength = sum((unit(F.col(c)) * w for c, w in STRENGTH.items()), F.lit(0.0)) - 0.20 * unit(F.col("invalidation_score")) - 0.10 * unit(F.col("bubble_risk"))
    told = told.withColumns({"theme_strength": unit(strength), "lifecycle_stage": lifecycle_stage()})
    share = F.coalesce(*[F.when(F.col("lifecycle_stage") == s, F.lit(v)) for s, v in EXPIRY.items()])
    days = F.greatest(F.lit(1), F.floor(F.col("horizon_days") * share + 1e-9).cast("int"))
    follow = F.when(F.col("industry_fundamental_strength") < 0.55, F.array(F.lit("order_disclosure"), F.lit("revenue_exposure"), F.lit("capacity_release"))).otherwise(F.array().cast("array<string>"))
    return told.withColumns({
        "expiry_date": F.date_add(as_of.cast("date"), days),
        "required_follow_up": F.when(F.col("lifecycle_stage") == "valuation_bubble", F.concat(follow, F.array(F.lit("valuation_percentile")))).otherwise(follow),
    }).select("theme", "theme_strength", "policy_strength", *[c for c in STRENGTH if c != "policy_strength"], "lifecycle_stage", "horizon_days", "theme_confidence", "supporting", "opposing", "expiry_date", "required_follow_up")
