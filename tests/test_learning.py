"""Calibration, linear folds, meta labels and combinatorial folds against plain versions."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import calibration as CA
from tickloom.operators import combinatorial as CP
from tickloom.operators import learning as LE


def plain_isotonic(x, y):
    """Pool adjacent violators over distinct x: (block x, block y)."""
    blocks = []
    for v in np.unique(x):
        blocks.append([v * (x == v).sum(), y[x == v].sum(), (x == v).sum()])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


def samples(kind, n=3000):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 900, n) / 900.0
    y = {"noisy": (rng.random(n) < x).astype(float), "rising": x, "falling": 1 - x, "wave": np.sin(20 * x), "flat": np.ones(n)}[kind]
    return x, y


@pytest.mark.parametrize("kind", ["noisy", "rising", "falling", "wave", "flat"])
@pytest.mark.parametrize("partitions, one_task", [(1, 10**6), (50, 10**6), (50, 20)])
def test_isotonic_matches_plain_for_any_partitioning(spark, kind, partitions, one_task):
    x, y = samples(kind)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (0.5, None), (float("nan"), 1.0)], "x double, y double")
    got = CA.isotonic_blocks(df, "x", "y", partitions, one_task).orderBy("part", "pos").toPandas()
    bx, by = plain_isotonic(x, y)
    np.testing.assert_allclose(got["x"], bx, rtol=1e-9)
    np.testing.assert_allclose(got["y"], by, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_isotonic_lookup_interpolates(spark, buckets):
    x, y = samples("noisy")
    blocks = CA.isotonic_blocks(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "x", "y", 6)
    at = [*np.linspace(-0.2, 1.2, 400), *x[:50]]
    asked = spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)] + [(-1, None)], "i int, v double")
    got = {r.i: r.p for r in CA.isotonic_lookup(asked, "v", blocks, "p", buckets).collect()}
    bx, by = plain_isotonic(x, y)
    np.testing.assert_allclose([got[i] for i in range(len(at))], np.interp(at, bx, by), atol=1e-12)
    assert got[-1] is None and len(got) == len(at) + 1


def test_empty_fit_says_one_half(spark):
    empty = spark.createDataFrame([], "x double, y double")
    blocks = CA.isotonic_blocks(empty, "x", "y")
    assert [r.p for r in CA.isotonic_lookup(spark.createDataFrame([(0.3,)], "v double"), "v", blocks, "p").collect()] == [0.5]


FOLDS = [(0, 1, 30, 33, 40), (1, 1, 40, 43, 50), (2, 11, 50, 53, 60)]


def panel(spark, days=60, names=15):
    rng = np.random.default_rng(8)
    a, b, c = (rng.normal(size=(days, names)) for _ in range(3))
    y = 0.4 * a - 0.2 * b + rng.normal(size=a.shape)
    rows = [
        (s, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", *(None if (d + s + k) % 17 == 0 else float(v[d, s]) for k, v in enumerate((a, b, c))), None if (d * s) % 23 == 1 else float(y[d, s]))
        for d in range(days) for s in range(names)
    ]
    return spark.createDataFrame(rows, "symbol int, d string, a double, b double, c double, y double").selectExpr("symbol", "to_date(d) AS trade_date", "a", "b", "c", "y")


def plain_fit(x, y, alpha, l1_ratio):
    xm, ym = x.mean(0), y.mean()
    z, t = x - xm, y - ym
    if l1_ratio is None:
        w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ t)
    else:
        w, n = np.zeros(x.shape[1]), len(y)
        for _ in range(3000):
            for j in range(len(w)):
                r = t - z @ w + z[:, j] * w[j]
                pull = z[:, j] @ r / n
                w[j] = math.copysign(max(abs(pull) - alpha * l1_ratio, 0), pull) / (z[:, j] @ z[:, j] / n + alpha * (1 - l1_ratio))
    return ym - w @ xm, w


@pytest.mark.parametrize("transform, alpha, l1_ratio", [("rank", 1.0, None), ("zscore", 2.0, None), ("none", 0.01, 0.5), ("zscore", 0.02, 0.9)])
def test_walk_forward_equals_a_fit_per_fold(spark, transform, alpha, l1_ratio):
    df = panel(spark)
    got = LE.walk_forward_linear(df, ["a", "b", "c"], "y", FOLDS, transform, True, alpha, l1_ratio).toPandas().sort_values(["fold", "trade_date", "symbol"])
    wide = df.toPandas().sort_values(["trade_date", "symbol"])
    session = wide["trade_date"].rank(method="dense").astype(int)
    g = wide.groupby("trade_date")
    cols = ["a", "b", "c"]
    x = {"rank": lambda: g[cols].rank(pct=True).fillna(0.5), "zscore": lambda: ((wide[cols] - g[cols].transform("mean")) / g[cols].transform("std")).fillna(0.0), "none": lambda: wide[cols].fillna(0.0)}[transform]()
    y = g["y"].rank(pct=True)
    want = []
    for _, a, z, lo, hi in FOLDS:
        train, valid = session.between(a, z) & y.notna(), session.between(lo, hi)
        b, w = plain_fit(x[train].to_numpy(), y[train].to_numpy(), alpha, l1_ratio)
        want += list(b + x[valid].to_numpy() @ w)
    np.testing.assert_allclose(got["prediction"], want, rtol=1e-7, atol=1e-9)


def test_one_pass_over_the_panel_serves_all_folds(spark):
    rows = panel(spark).where("a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL").withColumn("session", F.dense_rank().over(__import__("pyspark.sql").sql.Window.orderBy("trade_date")))
    many = [(k, 1 + k % 7, 20 + k, 0, 0) for k in range(30)]
    found = LE.fold_moments(rows, ["a", "b"], "y", many)
    pdf = rows.toPandas()
    for f, a, z, _, _ in many:
        part = pdf[pdf["session"].between(a, z)]
        m = np.column_stack([np.ones(len(part)), part[["a", "b", "y"]]])
        np.testing.assert_allclose(found[f], m.T @ m, rtol=1e-9, atol=1e-9)


def test_meta_label_fits_the_balanced_optimum(spark):
    df = panel(spark).withColumn("won", (F.col("y") > 0.5).cast("int"))
    got = LE.meta_label_filter(df, ["a", "b"], "won", FOLDS[:1]).toPandas().sort_values(["trade_date", "symbol"])
    wide = df.toPandas().sort_values(["trade_date", "symbol"])
    session = wide["trade_date"].rank(method="dense").astype(int)
    train, valid = session.between(1, 30) & wide["won"].notna(), session.between(33, 40)
    mean, std = wide[train][["a", "b"]].mean(), wide[train][["a", "b"]].std(ddof=0)
    z = ((wide[["a", "b"]] - mean) / std).fillna(0.0).to_numpy()
    x, y = np.column_stack([np.ones(train.sum()), z[train]]), wide[train]["won"].to_numpy(dtype=float)
    n, ones = len(y), y.sum()
    sw, beta, pen = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones))), np.zeros(3), np.diag([0, 1 / n, 1 / n])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (sw * p * (1 - p))[:, None]).T @ x / n + pen, x.T @ (sw * (p - y)) / n + pen @ beta)
    want = 1 / (1 + np.exp(-np.column_stack([np.ones(valid.sum()), z[valid]]) @ beta))
    np.testing.assert_allclose(got["p_success"], want, atol=1e-5)
    np.testing.assert_allclose(got["size"], np.where(want >= 0.5, (want - 0.5) / 0.5, 0), atol=1e-4)


def test_combinatorial_folds_match_plain(spark):
    df = panel(spark).select("trade_date").distinct()
    days = sorted(r.trade_date for r in df.collect())
    span = spark.createDataFrame([(d, days[i + 3] if i + 3 < len(days) else None) for i, d in enumerate(days)], "t0 date, t1 date")
    got = {(r.split, r.t0): r for r in CP.combinatorial_folds(span, "t0", "t1", 5, 2, 0.05).collect()}
    n, ends = len(days), [days[i + 3] if i + 3 < len(days) else None for i in range(len(days))]
    bounds = np.linspace(0, n, 6, dtype=int)
    group = [int(np.searchsorted(bounds, i, side="right")) - 1 for i in range(n)]
    paths = {}
    for split, combo in enumerate(combinations(range(5), 2)):
        test = [i for i in range(n) if group[i] in combo]
        lo, hi = days[min(test)], max(ends[i] for i in test if ends[i])
        for i in range(n):
            after = any(bounds[g + 1] <= i < bounds[g + 1] + math.ceil(0.05 * n) for g in combo)
            role = "test" if i in test else "purged" if ends[i] and ends[i] >= lo and days[i] <= hi else "embargo" if after else "train"
            assert got[split, days[i]].role == role, (split, i)
            if role == "test":
                paths.setdefault(got[split, days[i]].path, []).append(i)
    assert all(sorted(p) == list(range(n)) for p in paths.values()) and len(paths) == 4
