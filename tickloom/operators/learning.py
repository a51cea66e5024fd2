"""Linear and logistic models over panels, learned fold by fold from moments or by Spark ML."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import clean
from tickloom.operators.cross import pct_rank
from tickloom.operators.pit import session_index
from tickloom.session import shared_folder

Fold = tuple[int, int, int, int, int]


def cross_transform(panel: DataFrame, features: list[str], method: str, date: str = "trade_date") -> DataFrame:
    """Features as their date's percent ranks (missing: one half), z-scores (missing: 0) or as they are (missing: 0)."""
    if method == "rank":
        return panel.withColumns({f: F.coalesce(pct_rank(clean(F.col(f)), date), F.lit(0.5)) for f in features})
    if method == "zscore":
        stats = panel.groupBy(date).agg(*[e for f in features for e in (F.avg(clean(F.col(f))).alias(f"_m_{f}"), F.stddev_samp(clean(F.col(f))).alias(f"_s_{f}"))])
        wide = panel.join(stats, date)
        score = {f: F.coalesce(F.when(F.col(f"_s_{f}") > 0, (clean(F.col(f)) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")), F.lit(0.0)) for f in features}
        return wide.withColumns(score).select(*panel.columns)
    if method == "none":
        return panel.withColumns({f: F.coalesce(clean(F.col(f)), F.lit(0.0)) for f in features})
    raise ValueError(f"unknown transform {method}")


def segment_moments(rows: DataFrame, features: list[str], label: str, segment: str) -> DataFrame:
    """One row per ``segment``: count, sums, and sums of products of the features and the label. Partial sums leave each
    task as one row per segment, so no group is gathered."""
    z = [F.lit(1.0), *[F.col(f) for f in features], F.col(label)]
    sums = [F.sum(z[i] * z[j]).alias(f"m_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    return rows.where(F.col(label).isNotNull()).groupBy(segment).agg(*sums)


def fold_moments(rows: DataFrame, features: list[str], label: str, folds: list[Fold], session: str = "session") -> dict[int, np.ndarray]:
    """Each fold's moment matrix of (1, features, label) over its training sessions, in one pass for any number of folds.

    The folds' borders cut the calendar into segments; a fold's moments are the sum of the segments in it. At most two
    segments a fold come to the driver.
    """
    borders = sorted({b for _, a, z, _, _ in folds for b in (a, z + 1)})
    segment = sum(((F.col(session) >= b).cast("int") for b in borders), F.lit(0))
    size = len(features) + 2
    found: dict[int, np.ndarray] = {}
    for row in segment_moments(rows.withColumn("_segment", segment), features, label, "_segment").collect():
        m = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                m[i, j] = m[j, i] = row[f"m_{i}_{j}"]
        found[row["_segment"]] = m
    zero = np.zeros((size, size))
    return {f: sum((found.get(k + 1, zero) for k, b in enumerate(borders) if a <= b <= z), zero) for f, a, z, _, _ in folds}


def ridge_from_moments(m: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, weights) that minimise |y - Xw - b|² + alpha |w|², the intercept unpenalised."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    w = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(len(c) - 1), c[:-1, -1])
    return np.concatenate([[mean[-1] - w @ mean[:-1]], w])


def elastic_from_moments(m: np.ndarray, alpha: float, l1_ratio: float, tolerance: float = 1e-12, rounds: int = 10_000) -> np.ndarray:
    """(intercept, weights) that minimise |y - Xw - b|² / 2n + alpha (l1_ratio |w|₁ + (1 - l1_ratio) |w|² / 2), by
    coordinate descent on the moments: a round costs features² whatever the rows."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] / n - np.outer(mean, mean)
    gram, target = c[:-1, :-1], c[:-1, -1]
    w = np.zeros(len(target))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            pull = target[j] - gram[j] @ w + gram[j, j] * w[j]
            held = gram[j, j] + alpha * (1 - l1_ratio)
            new = math.copysign(max(abs(pull) - alpha * l1_ratio, 0.0), pull) / held if held > 0 else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= tolerance:
            break
    return np.concatenate([[mean[-1] - w @ mean[:-1]], w])


def coefficient_table(rows: DataFrame, coefficients: dict[int, np.ndarray], features: list[str]) -> DataFrame:
    names = ["_intercept", *[f"_w_{f}" for f in features]]
    schema = ", ".join(["fold int", *[f"`{n}` double" for n in names]])
    return rows.sparkSession.createDataFrame([(f, *map(float, c)) for f, c in coefficients.items()], schema)


def walk_forward_linear(
    panel: DataFrame, features: list[str], label: str, folds: list[Fold], transform: str = "rank", label_rank: bool = True, alpha: float = 1.0, l1_ratio: float | None = None,
    date: str = "trade_date",
) -> DataFrame:
    """(symbol, date, fold, prediction) of every row in a fold's validation sessions.

    ``folds`` are (fold, train from, train to, valid from, valid to) by session number. Features and, with
    ``label_rank``, the label are transformed inside each date, so nothing crosses a fold's border. Ridge without
    ``l1_ratio``, else elastic net. A fold without labelled training rows gives no predictions.
    """
    keep = [c for c in ("symbol", date, label, *features) if c in panel.columns]
    rows = cross_transform(panel.select(*keep), features, transform, date)
    y = pct_rank(clean(F.col(label)), date) if label_rank else clean(F.col(label))
    rows = rows.withColumn("_y", y).join(F.broadcast(session_index(panel, date)), date)  # one row per session
    moments = {f: m for f, m in fold_moments(rows, features, "_y", folds).items() if m[0, 0] > 0}
    fit = {f: ridge_from_moments(m, alpha) if l1_ratio is None else elastic_from_moments(m, alpha, l1_ratio) for f, m in moments.items()}
    span = F.coalesce(*[F.when(F.col("session").between(lo, hi), F.lit(f)) for f, _, _, lo, hi in folds]) if folds else F.lit(None).cast("int")
    scored = rows.withColumn("fold", span).join(F.broadcast(coefficient_table(rows, fit, features)), "fold")  # one row per fold
    return scored.select("symbol", date, "fold", sum((F.col(f) * F.col(f"_w_{f}") for f in features), F.col("_intercept")).alias("prediction"))


# -- meta labels ---------------------------------------------------------------------------


def size_of_bet(p: Column, floor: float = 0.5) -> Column:
    """0 below ``floor``, then growing to 1 at certainty."""
    return F.when(p >= floor, F.least(F.greatest((p - floor) / max(1.0 - floor, 1e-12), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def standardised(rows: DataFrame, features: list[str], stats: dict[str, float]) -> DataFrame:
    """Features less their mean by their deviation; missing ones become 0."""
    return rows.withColumns({f"_z_{f}": F.coalesce((clean(F.col(f)) - stats[f"m_{f}"]) / stats[f"s_{f}"], F.lit(0.0)) for f in features})


def fit_meta_label(rows: DataFrame, features: list[str], label: str, c: float = 1.0, path: str | None = None) -> tuple[LogisticRegressionModel, dict[str, float]]:
    """A balanced logistic model of ``label`` (0 or 1) with penalty 1 / (c n), learned by Spark ML from all labelled
    rows, and the features' means and deviations. With ``path`` the model is written there and read back."""
    known = rows.where(F.col(label).isin(0, 1))
    sums = [F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("ones")]
    sums += [e for f in features for e in (F.avg(clean(F.col(f))).alias(f"m_{f}"), F.stddev_pop(clean(F.col(f))).alias(f"s_{f}"))]
    stats = known.agg(*sums).first().asDict()
    n, ones = stats["n"], stats["ones"] or 0
    if not 0 < ones < n:
        raise ValueError("the label must have both classes")
    for f in features:
        stats[f"m_{f}"], stats[f"s_{f}"] = stats[f"m_{f}"] or 0.0, stats[f"s_{f}"] or 1.0
    weighed = standardised(known, features, stats).withColumn("_w", F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones))))
    vectors = VectorAssembler(inputCols=[f"_z_{f}" for f in features], outputCol="_x").transform(weighed).select("_x", F.col(label).cast("double").alias("_label"), "_w")
    model = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_w", regParam=1.0 / (c * n), standardization=False, maxIter=1000, tol=1e-16).fit(vectors)
    if path is not None:
        model.write().overwrite().save(path)
        model = LogisticRegressionModel.load(path)
    return model, stats


def meta_label_filter(panel: DataFrame, features: list[str], label: str, folds: list[Fold], floor: float = 0.5, c: float = 1.0, date: str = "trade_date") -> DataFrame:
    """(symbol, date, fold, p_success, size) for the rows of each fold's validation sessions.

    A fold's model sees its training sessions only; models are kept in the shared folder. There are few folds, and
    each scores its own sessions in the JVM.
    """
    keep = ["symbol", date, *features, label]
    rows = panel.select(*keep).join(F.broadcast(session_index(panel, date)), date)  # one row per session
    out = None
    for fold, a, z, lo, hi in folds:
        path = f"{shared_folder(panel.sparkSession)}/meta-label-{fold}-{uuid.uuid4().hex}"
        model, stats = fit_meta_label(rows.where(F.col("session").between(a, z)), features, label, c, path)
        valid = standardised(rows.where(F.col("session").between(lo, hi)), features, stats)
        scored = model.transform(VectorAssembler(inputCols=[f"_z_{f}" for f in features], outputCol="_x").transform(valid))
        p = vector_to_array("probability")[1]
        one = scored.select("symbol", date, F.lit(fold).alias("fold"), p.alias("p_success")).withColumn("size", size_of_bet(F.col("p_success"), floor))
        out = one if out is None else out.unionAll(one)
    if out is None:
        raise ValueError("no folds")
    return out
