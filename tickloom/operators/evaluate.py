"""Factor evaluation: information coefficients, quantiles, turnover, summaries, selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.functions.columns import clean, ratio
from tickloom.operators.cross import mean_rank, pct_rank
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.series import number_rows, tie_key
from tickloom.plans.arrays import BATCH_ROWS, codes_of, pack_task
from tickloom.plans.arrays import tie_key as tie_values
from tickloom.plans.blocks import PORTIONS, portions_read
from tickloom.plans.blocks import SCHEMA as BLOCKS
from tickloom.session import stored
from tickloom.sizes import GROUP_ROWS, largest_group


def pearson(x: str, y: str) -> Column:
    """Aggregate correlation, NULL when a side is constant (``corr`` raises there under ANSI)."""
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def ic_by_date(
    panel: DataFrame, factor: str, label: str, date: str = "trade_date", method: str = "spearman", by: list[str] | None = None
) -> DataFrame:
    """Correlation of factor and label over one date's finite pairs; under 3 pairs or a constant side → NULL."""
    keys = [*(by or []), date]
    pairs = panel.select(*keys, clean(F.col(factor)).alias("_x"), clean(F.col(label)).alias("_y"))
    pairs = pairs.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    if method == "spearman":
        pairs = pairs.select(*keys, mean_rank(F.col("_x"), *keys).alias("_x"), mean_rank(F.col("_y"), *keys).alias("_y"))
    n = F.count(F.lit(1))
    return pairs.groupBy(*keys).agg(n.alias("pairs"), F.when(n >= 3, pearson("_x", "_y")).alias("ic"))


def long_factors(panel: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """(keep..., factor_name, factor_value): all factors then share one grouped job."""
    return panel.unpivot(keep, factors, "factor_name", "factor_value")


def newey_west(series: DataFrame, by: list[str], order: str, value: str, horizon: int | None = None) -> DataFrame:
    """Bartlett HAC t-statistic of the mean of each series; lag = max(automatic, horizon − 1).

    One series has one value per session, so its array is bounded by the calendar.
    """
    rows = series.where(F.col(value).isNotNull())
    packed = rows.groupBy(*by).agg(  # mean and count come from the aggregate, so no lambda recomputes them
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("_s"),
        F.avg(value).alias("mean"), F.count(F.lit(1)).cast("int").alias("n"),
    )
    n = F.col("n")
    auto = F.greatest(F.lit(1), F.floor(4.0 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int"))
    lag = F.greatest(auto, F.lit((horizon or 1) - 1))
    lag = F.greatest(F.lit(1), F.least(lag, n - 1))
    work = packed.where("n >= 2").withColumn("_lag", lag)
    work = work.withColumn("_c", F.transform("_s", lambda s: s["v"] - F.col("mean")))

    def gamma(k: Column) -> Column:
        a = F.slice("_c", k + 1, F.col("n") - k)
        b = F.slice("_c", F.lit(1), F.col("n") - k)
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) / F.col("n")

    g0 = F.aggregate("_c", F.lit(0.0), lambda s, v: s + v * v) / F.col("n")
    var = F.aggregate(
        F.sequence(F.lit(1), F.col("_lag")), g0, lambda s, k: s + 2.0 * (1.0 - k / (F.col("_lag") + 1.0)) * gamma(k)
    )
    return work.withColumn("_var", F.greatest(var, F.lit(1e-12))).select(
        *by, "n", "mean", (F.col("mean") / F.sqrt(F.col("_var") / F.col("n"))).alias("t_stat")
    )


def ic_summary(ic: DataFrame, by: list[str], date: str = "trade_date", horizon: int | None = None) -> DataFrame:
    """Mean, deviation, information ratio, share positive and HAC t of each IC series."""
    known = ic.where(F.col("ic").isNotNull())
    sd = F.stddev_samp("ic")
    stats = known.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"), sd.alias("std_ic"),
        F.when(sd > 1e-12, F.avg("ic") / sd).alias("icir"),
        F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive_ratio"),
    )
    return stats.join(newey_west(known, by, date, "ic", horizon).select(*by, "t_stat"), by, "left")


def quantile_labels(x: Column, q: int, *keys: str, tie: str = "symbol") -> Column:
    """ceil(first-rank share · q) within the group; too few or constant values → NULL."""
    k = tie_key(x)
    w = Window.partitionBy(*keys).orderBy(k.asc_nulls_last(), tie)
    g = Window.partitionBy(*keys)
    n = F.count(x).over(g)
    ok = x.isNotNull() & (n >= q) & (F.min(k).over(g) < F.max(k).over(g))
    bucket = F.ceil(F.row_number().over(w) * F.lit(q) / n).cast("int")
    return F.when(ok, F.least(F.greatest(bucket, F.lit(1)), F.lit(q)))


def quantile_returns(panel: DataFrame, factor: str, label: str, q: int = 5, date: str = "trade_date") -> DataFrame:
    """Mean label per date and quantile, and top minus bottom."""
    tagged = panel.withColumn("quantile", quantile_labels(F.col(factor), q, date))
    cells = {f"q{i}": F.avg(F.when(F.col("quantile") == i, F.col(label))) for i in range(1, q + 1)}
    out = tagged.where(F.col("quantile").isNotNull()).groupBy(date).agg(*[c.alias(n) for n, c in cells.items()])
    return out.withColumn("long_short", F.col(f"q{q}") - F.col("q1"))


def top_turnover(panel: DataFrame, quantile: Column, top: int, date: str = "trade_date", symbol: str = "symbol") -> DataFrame:
    """1 − kept/current of the top group between consecutive dates; the first date is 0.

    Membership of the previous *date* (not the symbol's previous row) is an equi-join on the
    date index; only the top group travels.
    """
    dates = panel.select(date).distinct()
    numbered = dates.withColumn("_i", F.row_number().over(Window.orderBy(date)))
    top_rows = panel.where(quantile == top).select(date, symbol).join(F.broadcast(numbered), date)  # one row per session
    before = top_rows.select((F.col("_i") + 1).alias("_i"), symbol, F.lit(1).alias("_was"))
    counts = top_rows.join(before, ["_i", symbol], "left").groupBy("_i").agg(
        F.count(F.lit(1)).alias("_now"), F.count("_was").alias("_kept")
    )
    value = F.when((F.col("_i") == 1) | F.col("_now").isNull(), 0.0).otherwise(1.0 - F.col("_kept") / F.col("_now"))
    return numbered.join(counts, "_i", "left").select(date, value.alias("turnover"))


def capacity(panel: DataFrame, factor: str, amount: str = "amount", share: float = 0.05, q: float = 0.8) -> DataFrame:
    """Mean amount of the rows at or above the factor's global quantile, times a participation share."""
    rows = panel.select(clean(F.col(factor)).alias("x"), clean(F.col(amount)).alias("a")).where("x is not null and a is not null")
    rows = stored(rows, "capacity")  # read twice, and its panel is the dear part
    cut = exact_quantiles(rows, [], "x", {"cut": q})
    top = F.avg(F.when(F.col("x") >= F.col("cut"), F.col("a")))
    return rows.crossJoin(F.broadcast(cut)).agg(  # the cut is one row
        F.avg("a").alias("average_amount"), top.alias("top_amount"), (top * share).alias("capacity")
    )


def monotonicity(groups: DataFrame, by: list[str], index: str, value: str) -> DataFrame:
    """Spearman correlation of quantile number and mean return, per factor."""
    means = groups.groupBy(*by, index).agg(F.avg(value).alias("_m")).where("_m is not null")
    ranked = means.select(*by, mean_rank(F.col(index), *by).alias("_x"), mean_rank(F.col("_m"), *by).alias("_y"))
    return ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 2, pearson("_x", "_y")).alias("monotonicity"))


def correlation_pairs(panel: DataFrame, factors: list[str], method: str = "pearson", date: str = "trade_date") -> DataFrame:
    """Pairwise correlations as rows (left, right, corr); Spearman ranks inside each date.

    All pairs are one partially aggregated pass over the panel: K·(K−1)/2 sets of five sums.
    """
    if method == "spearman":
        panel = panel.select(date, *[pct_rank(F.col(f), date).alias(f) for f in factors])
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    masked = panel.select(*[
        F.when(F.col(p).isNotNull() & F.col(o).isNotNull(), F.col(p)).alias(f"_{side}{i}")
        for i, (a, b) in enumerate(pairs) for side, p, o in (("x", a, b), ("y", b, a))
    ])
    stats = masked.agg(*[pearson(f"_x{i}", f"_y{i}").alias(f"_c{i}") for i in range(len(pairs))])
    rows = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return stats.select(F.explode(rows).alias("r")).select("r.left", "r.right", "r.corr")


def correlation_clusters(pairs: DataFrame, factors: list[str], threshold: float = 0.85) -> DataFrame:
    """Connected components of |corr| ≥ threshold: the smallest reachable name labels each factor.

    The graph has one node per factor name, so a few rounds of label joins settle it; K rounds
    are always enough and the pair table never grows.
    """
    spark = pairs.sparkSession
    edges = pairs.where(F.abs("corr") >= threshold).select("left", "right")
    both = edges.unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right")))
    labels = spark.createDataFrame([(f, f) for f in factors], "factor string, cluster string")
    rounds = max(1, (len(factors) - 1).bit_length() + 1) if len(factors) > 2 else 1
    reach = both.unionByName(spark.createDataFrame([(f, f) for f in factors], "left string, right string")).distinct()
    for _ in range(rounds):  # doubling: paths of length 2^k after k rounds
        step = reach.select(F.col("left").alias("_l"), F.col("right").alias("left")).join(reach, "left")
        reach = step.select(F.col("_l").alias("left"), "right").distinct()
    return labels.select("factor").join(
        reach.groupBy(F.col("left").alias("factor")).agg(F.min("right").alias("cluster")), "factor"
    )


def folded_days(panel: DataFrame, factors: list[str], label: str, q: int) -> DataFrame:
    """Whole dates folded once for all factors: (factor_name, trade_date, kind, quantile, value, ranked, symbol).

    ``ic`` rows hold the plain and the rank correlation, ``cell`` rows a quantile's mean label, ``top`` rows the symbols
    of the highest quantile. The panel moves once, in packed columns; as long rows it moved and was sorted once a statistic.
    """
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    portions = n * max(1, -(-PORTIONS // n))
    wide = panel.select("symbol", "trade_date", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([label, *factors])])
    dealt = wide.mapInArrow(pack_task("trade_date", portions), BLOCKS).repartitionById(n, F.col("_portion") % n).sortWithinPartitions("_portion")
    schema = f"factor_name string, trade_date {wide.schema['trade_date'].dataType.simpleString()}, kind string, quantile int, value double, ranked double, symbol {wide.schema['symbol'].dataType.simpleString()}"
    return dealt.mapInArrow(_day_statistics(to_arrow_schema(wide.schema), factors, label, q), schema)


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isinf(x), np.nan, x)


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) < 3 or x.min() == x.max() or y.min() == y.max():
        return np.nan
    dx, dy = x - x.mean(), y - y.mean()
    spread = np.sqrt((dx * dx).mean()) * np.sqrt((dy * dy).mean())
    return float((dx * dy).mean() / spread) if spread else np.nan


def _average_ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(tie_values(x)).rank().to_numpy()


def _day_quantiles(x: np.ndarray, q: int) -> np.ndarray:
    """``quantile_labels`` of one date whose rows are sorted by symbol; 0 where there is none. NaN is unknown."""
    key = tie_values(x)
    at = np.argsort(key, kind="stable")[: int(np.count_nonzero(~np.isnan(x)))]
    out = np.zeros(len(x), "int32")
    if len(at) >= q and key[at[0]] < key[at[-1]]:
        out[at] = np.clip(np.ceil(np.arange(1, len(at) + 1) * q / len(at)), 1, q)
    return out


def _day_statistics(schema: pa.Schema, factors: list[str], label: str, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in portions_read(batches, schema, ["trade_date", "symbol"], BATCH_ROWS):
            codes = codes_of(table.column("trade_date"))
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            numbers = {c: table.column(c).to_pandas().to_numpy(dtype="float64", na_value=np.nan) for c in dict.fromkeys([label, *factors])}
            days, symbols = table.column("trade_date"), table.column("symbol")
            for name in factors:
                where, kinds, cells, values, ranked, holders = [], [], [], [], [], []
                for a, b in zip(first, np.r_[first[1:], len(codes)]):
                    x, y = numbers[name][a:b], numbers[label][a:b]
                    pairs = ~np.isnan(_finite(x)) & ~np.isnan(_finite(y))
                    tags = _day_quantiles(x, q)
                    with np.errstate(all="ignore"):
                        ics = _correlation(x[pairs], y[pairs]), _correlation(_average_ranks(x[pairs]), _average_ranks(y[pairs]))
                    known = (tags > 0) & ~np.isnan(y)
                    sums, counts = np.bincount(tags[known], y[known], q + 1), np.bincount(tags[known], minlength=q + 1)
                    held = np.flatnonzero(np.bincount(tags, minlength=q + 1)[1:]) + 1
                    top = np.flatnonzero(tags == q)
                    where += [a] * (1 + len(held)) + (a + top).tolist()
                    kinds += ["ic"] + ["cell"] * len(held) + ["top"] * len(top)
                    cells += [None, *held.tolist()] + [q] * len(top)
                    values += [ics[0], *(sums[k] / counts[k] if counts[k] else np.nan for k in held)] + [np.nan] * len(top)
                    ranked += [ics[1]] + [np.nan] * (len(held) + len(top))
                    holders += [None] * (1 + len(held)) + (a + top).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(where), pa.string()), pa.concat_arrays(days.take(pa.array(where, pa.int64())).chunks), pa.array(kinds, pa.string()), pa.array(cells, pa.int32()),
                    pa.array(np.array(values, "float64"), from_pandas=True), pa.array(np.array(ranked, "float64"), from_pandas=True), pa.concat_arrays(symbols.take(pa.array(holders, pa.int64())).chunks),
                ], names=["factor_name", "trade_date", "kind", "quantile", "value", "ranked", "symbol"])

    return run


def factor_summary(panel: DataFrame, factors: list[str], label: str, amount: str = "amount", q: int = 5, horizon: int = 1) -> DataFrame:
    """One row per factor: IC, rank IC, ratios, monotonicity, top turnover. Factors are rows, not loops.

    Dates of at most ``GROUP_ROWS`` rows are folded in one pass, and what comes of it is stored: each of the statistics
    would compute it anew. Of wider ones the panel is stored, and moves once a statistic.
    """
    by = ["factor_name"]
    panel = stored(panel.select("symbol", "trade_date", label, *factors), "summary")
    if largest_group(panel, "trade_date") <= GROUP_ROWS:
        days = stored(folded_days(panel, factors, label, q), "days")
        ics = days.where("kind = 'ic'")
        plain, ranks = ics.select(*by, "trade_date", F.col("value").alias("ic")), ics.select(*by, "trade_date", F.col("ranked").alias("ic"))
        cells = days.where("kind = 'cell'").select(*by, "trade_date", "quantile", F.col("value").alias("r"))
        tagged = days.where("kind <> 'cell'").select(*by, "trade_date", "symbol", "quantile")
    else:
        long = long_factors(panel, factors, ["symbol", "trade_date", label])
        plain, ranks = (ic_by_date(long, "factor_value", label, by=by, method=m) for m in ("pearson", "spearman"))
        tagged = long.withColumn("quantile", quantile_labels(F.col("factor_value"), q, "factor_name", "trade_date"))
        cells = tagged.where("quantile is not null").groupBy("factor_name", "trade_date", "quantile").agg(F.avg(label).alias("r"))
    rank_ic, plain = ic_summary(ranks, by, horizon=horizon), ic_summary(plain, by, horizon=horizon)
    mono = monotonicity(cells, by, "quantile", "r")
    turn = grouped_turnover(tagged, q).groupBy("factor_name").agg(F.avg("turnover").alias("turnover"))
    return (
        plain.select("factor_name", F.col("mean_ic").alias("ic"), "icir")
        .join(rank_ic.select("factor_name", F.col("mean_ic").alias("rank_ic"), F.col("icir").alias("rank_icir"), "positive_ratio", "t_stat"), by)
        .join(mono, by, "left")
        .join(turn, by, "left")
    )


def grouped_turnover(tagged: DataFrame, top: int, by: str = "factor_name") -> DataFrame:
    """``top_turnover`` for many factors at once."""
    dates = tagged.select("trade_date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("trade_date")))
    names = tagged.select(by).distinct()
    top_rows = tagged.where(F.col("quantile") == top).select(by, "trade_date", "symbol").join(F.broadcast(dates), "trade_date")
    before = top_rows.select(by, (F.col("_i") + 1).alias("_i"), "symbol", F.lit(1).alias("_was"))
    counts = top_rows.join(before, [by, "_i", "symbol"], "left").groupBy(by, "_i").agg(
        F.count(F.lit(1)).alias("_now"), F.count("_was").alias("_kept")
    )
    grid = names.crossJoin(F.broadcast(dates))  # factor names × sessions
    value = F.when((F.col("_i") == 1) | F.col("_now").isNull(), 0.0).otherwise(1.0 - F.col("_kept") / F.col("_now"))
    return grid.join(counts, [by, "_i"], "left").select(by, "trade_date", value.alias("turnover"))


def screen(summary: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """Name the gates each factor fails; ``gates`` maps a column to (">=" | "<=", bound); missing fails."""
    fails = []
    for c, (op, bound) in gates.items():
        ok = (F.col(c) >= bound) if op == ">=" else (F.col(c) <= bound)
        fails.append(F.when(~F.coalesce(ok, F.lit(False)), c))
    out = summary.withColumn("failed", F.array_join(F.array_compact(F.array(*fails)), ","))
    return out.withColumn("passed", F.col("failed") == "")


def greedy_uncorrelated(ranked: list[str], pairs: list[tuple[str, str, float]], limit: float) -> list[str]:
    """Walk factors best first, dropping any too close to one kept. Works on the K×K result."""
    corr = {frozenset((a, b)): abs(c) for a, b, c in pairs if c is not None}
    kept: list[str] = []
    for f in ranked:
        if all(corr.get(frozenset((f, k)), 0.0) <= limit for k in kept):
            kept.append(f)
    return kept


def normalised(raw: Column, *keys: str) -> Column:
    """Non-negative weights that sum to 1 per group; equal weights when nothing is positive."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    r = F.coalesce(F.greatest(raw, F.lit(0.0)), F.lit(0.0))
    total = F.sum(r).over(w)
    return F.when(total > 0, r / total).otherwise(1.0 / F.count(F.lit(1)).over(w))


def stratified_ic(panel: DataFrame, factor: str, label: str, axes: list[str], min_pairs: int = 3) -> DataFrame:
    """IC per date inside every bucket of every axis, summarised per (axis, bucket), axes as rows."""
    long = panel.unpivot(["symbol", "trade_date", factor, label], axes, "axis", "bucket").where("bucket is not null")
    ic = ic_by_date(long, factor, label, by=["axis", "bucket"]).where(F.col("pairs") >= min_pairs)
    sd = F.stddev_samp("ic")
    return ic.where("ic is not null").groupBy("axis", "bucket").agg(
        F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean_ic"), F.when(sd > 1e-12, F.avg("ic") / sd).alias("icir")
    )


def top_k_excess(panel: DataFrame, score: str, label: str, k: int, by: list[str] | None = None) -> DataFrame:
    """Per date: mean label of the k best scores minus the mean of all, ties by symbol."""
    keys = [*(by or []), "trade_date"]
    rows = panel.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(tie_key(F.col(score)).desc(), "symbol"))
    return rows.withColumn("_rn", rn).groupBy(*keys).agg(
        F.avg(F.when(F.col("_rn") <= k, F.col(label))).alias("top_return"), F.avg(label).alias("universe_return")
    ).withColumn("excess", F.col("top_return") - F.col("universe_return"))


def walk_forward_folds(sessions: int, n_splits: int, valid: int, min_train: int, embargo: int = 0, purge: int = 0, mode: str = "expanding", rolling: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_from, train_to, valid_from, valid_to) as 1-based session numbers, anchored at the end."""
    lead = min_train + embargo + purge
    achievable = min(n_splits, max(0, sessions - lead) // valid)
    out = []
    for i in range(achievable):
        start = sessions - (achievable - i) * valid + 1
        train_to = start - 1 - embargo - purge
        if train_to < 1:
            continue
        train_from = max(1, train_to - rolling + 1) if mode == "rolling" else 1
        out.append((i, train_from, train_to, start, start + valid - 1))
    return out


def tag_folds(sessions: DataFrame, folds: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(fold, role, trade_date): the fold plan range-joined to numbered sessions; both sides are tiny."""
    spark = sessions.sparkSession
    plan = [(f, "train", a, b) for f, a, b, _, _ in folds] + [(f, "valid", c, d) for f, _, _, c, d in folds]
    table = spark.createDataFrame(plan, "fold int, role string, lo int, hi int")
    return sessions.join(F.broadcast(table), F.col("session").between(F.col("lo"), F.col("hi"))).select("fold", "role", "trade_date")


def purged_folds(
    samples: DataFrame, start: str, end: str, n_splits: int = 5, embargo: float = 0.01, tie: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Every (fold, sample) with role train / test / purged / embargo.

    Fold spans are one aggregated row per fold, so tagging is a broadcast of ``n_splits`` rows.
    Samples are numbered by their start in equal contiguous folds.
    """
    counted = number_rows(samples.withColumn("_g", F.lit(1)), ["_g"], [start, end, *tie], F.col(start), "_i").drop("_g")
    size = samples.agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.crossJoin(F.broadcast(size))  # one row
    n, i = F.col("_n"), F.col("_i")
    base = F.floor(n / n_splits)
    extra = n % n_splits
    wide = extra * (base + 1)
    fold = F.when(i < wide, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - wide) / F.greatest(base, F.lit(1))))
    numbered = counted.withColumn("_fold", fold.cast("int"))
    spans = numbered.groupBy(F.col("_fold").alias("fold")).agg(
        F.min(start).alias("_t0"), F.max(end).alias("_t1"), F.max("_i").alias("_last"), F.max("_n").alias("_all")
    )
    reach = F.ceil(F.col("_all") * F.lit(embargo))
    role = (
        F.when(F.col("_fold") == F.col("fold"), "test")
        .when((F.col(end) >= F.col("_t0")) & (F.col(start) <= F.col("_t1")), "purged")
        .when((F.col("_i") > F.col("_last")) & (F.col("_i") <= F.col("_last") + reach), "embargo")
        .otherwise("train")
    )
    return numbered.crossJoin(F.broadcast(spans)).select(*samples.columns, "fold", role.alias("role"))
