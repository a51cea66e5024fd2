"""Factor stages as array steps: Spark partitions and sorts the panel, tasks fold whole groups batch by batch.

A sliding frame in the JVM is evaluated anew for every row and expression, and each ranked column is a sort of its own.
Here one stage is one exchange and one sort; its nodes are computed over many whole series (or dates) at once, lag by
lag in row order, so sums and moments are the ones Spark's own aggregates give. NaN stands for NULL inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from tickloom.functions.columns import WHOLE
from tickloom.functions.factor import Factor
from tickloom.plans.blocks import packed, portions_read

#: Rows a task gathers before it computes the groups that are complete.
BATCH_ROWS = 32_768
TIE_SCALE = 1e10


def tie_key(x: np.ndarray) -> np.ndarray:
    return np.rint(x * TIE_SCALE) + 0.0


def tie_value(x: np.ndarray) -> np.ndarray:
    """``x`` to the decimals that a rank tells apart; its ``tie_key`` stays."""
    key = tie_key(x)
    return np.where(np.abs(key) < WHOLE, key / TIE_SCALE, x)


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest whole number, halves away from zero."""
    near = np.floor((np.floor(np.abs(y) * 2.0) + 1.0) / 2.0)
    return np.where(np.abs(y) < WHOLE, np.copysign(near, y), y)


def tidy_values(x: np.ndarray) -> np.ndarray:
    """``columns.tidy`` of an array."""
    x = x * 1.00000000001
    a = np.abs(x)
    return np.where(a < 100, nearest(x * 1e6) / 1e6, np.where(a < 1e6, nearest(x * 100.0) / 100.0, nearest(x / 1000.0) * 1000.0)) + 0.0


# -- row arithmetic ------------------------------------------------------------------------


def row_value(n: Factor, sub: Callable[[Factor], np.ndarray], size: int) -> np.ndarray:
    op = n.op
    if op == "const":
        return np.full(size, n.opts[0])
    a = [sub(x) for x in n.args]
    if op in ("add", "sub", "mul"):
        return {"add": np.add, "sub": np.subtract, "mul": np.multiply}[op](a[0], a[1])
    if op == "div":
        return np.divide(a[0], np.where(a[1] == 0, np.nan, a[1]))
    if op == "neg":
        return -a[0]
    if op == "abs":
        return np.abs(a[0])
    if op == "sign":
        return np.sign(a[0])
    if op == "ln":
        return np.log(np.where(a[0] > 0, a[0], np.nan))
    if op == "sqrt":
        return np.sqrt(np.where(a[0] >= 0, a[0], np.nan))
    if op == "pow":
        return np.where(np.isnan(a[0]) | np.isnan(a[1]), np.nan, np.power(a[0], a[1]))
    if op == "emin":
        return np.minimum(a[0], a[1])
    if op == "emax":
        return np.maximum(a[0], a[1])
    if op in ("lt", "le", "eq"):
        return {"lt": np.less, "le": np.less_equal, "eq": np.equal}[op](a[0], a[1])
    if op == "and":
        return a[0] & a[1]
    if op == "or":
        return a[0] | a[1]
    if op == "where":
        return np.where(a[0], a[1], a[2])
    if op == "only":
        return np.where(a[0], a[1], np.nan)
    if op == "truth":
        return np.where(a[0], 1.0, 0.0)
    if op == "filled":
        return np.where(np.isnan(a[0]), a[1], a[0])
    if op == "known":
        return ~np.isnan(a[0])
    raise ValueError(f"unknown factor operator {op}")


# -- one series after the other, in row order ----------------------------------------------


class Runs:
    """Groups that lie one after the other in a batch: where each begins, and each row's place in it."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if self.size else np.zeros(0, int)
        self.ends = np.r_[first, self.size]
        lengths = np.diff(self.ends)
        self.group = np.repeat(np.arange(len(lengths)), lengths)
        self.pos = np.arange(self.size) - np.repeat(first, lengths)
        self.left = np.repeat(lengths, lengths) - self.pos - 1

    def lags(self, x: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """The trailing n rows of every row, oldest first (before a series begins: rows of another one)."""
        padded = np.r_[np.full(n - 1, np.nan), x]
        for j in range(n):
            yield padded[j : j + self.size]

    def known(self, x: np.ndarray, n: int) -> np.ndarray:
        """How many of the trailing n rows of the own series are known."""
        seen = np.r_[0, np.cumsum(~np.isnan(x))]
        at = np.arange(self.size)
        return seen[at + 1] - seen[at - np.minimum(self.pos, n - 1)]


def shifted(runs: Runs, x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(runs.size, np.nan)
    if k >= 0:
        out[k:] = x[: runs.size - k] if k else x
        out[runs.pos < k] = np.nan
    else:
        out[:k] = x[-k:]
        out[runs.left < -k] = np.nan
    return out


def moments(runs: Runs, x: np.ndarray, n: int, order: int, partial: bool) -> tuple:
    """Count, mean and central sums of the trailing rows, updated row by row as Spark's aggregates do."""
    zero = lambda: np.zeros(runs.size)
    c, avg, m2, m3, m4 = zero(), zero(), zero(), zero(), zero()
    for j, v in enumerate(runs.lags(x, n)):
        if partial:
            use = ~np.isnan(v) & (runs.pos >= n - 1 - j)
            c = c + use
            v = np.where(use, v, avg)  # no step of its own
            delta = v - avg
            part = delta / np.maximum(c, 1.0)
        else:
            c = float(j + 1)
            delta = v - avg
            part = delta / c
        avg = avg + part
        m2 = m2 + delta * (delta - part)
        if order > 2:
            d2, p2 = delta * delta, part * part
            m3 = m3 - 3.0 * part * m2 + delta * (d2 - p2)
            if order > 3:
                m4 = m4 - 4.0 * part * m3 - 6.0 * p2 * m2 + delta * (delta * d2 - part * p2)
    return c, avg, m2, m3, m4


def rolling(op: str, runs: Runs, x: np.ndarray, n: int, least: int) -> np.ndarray:
    known = runs.known(x, n)
    partial = least < n
    inside = lambda v, j, other: np.where(~np.isnan(v) & (runs.pos >= n - 1 - j), v, other) if partial else v
    if op in ("mean", "sum"):
        out = np.zeros(runs.size)
        for j, v in enumerate(runs.lags(x, n)):
            out += inside(v, j, 0.0)
        if op == "mean":
            out = out / (np.maximum(known, 1) if partial else float(n))
    elif op in ("min", "max"):
        pick, start = (np.minimum, np.inf) if op == "min" else (np.maximum, -np.inf)
        out = np.full(runs.size, start)
        for j, v in enumerate(runs.lags(x, n)):
            out = pick(out, inside(v, j, start))
    elif op in ("std", "pstd"):
        c, _, m2, _, _ = moments(runs, x, n, 2, partial)
        base = c - 1.0 if op == "std" else c
        out = np.sqrt(m2 / np.where(np.asarray(base) > 0, base, np.nan))
    else:
        low, high = rolling("min", runs, x, n, least), rolling("max", runs, x, n, least)
        c, _, m2, m3, m4 = moments(runs, x, n, 4 if op == "kurt" else 3, partial)
        m = float(n)
        if op == "skew":
            out = np.sqrt(c) * m3 / np.sqrt(m2 * m2 * m2) * ((m * (m - 1)) ** 0.5 / (m - 2))
        else:
            out = (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * (c * m4 / (m2 * m2) - 3.0) + 6.0)
        out = np.where(low < high, out, np.nan)
    return np.where(known >= max(least, 1), out, np.nan)


def joint(op: str, runs: Runs, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Rolling covariance or correlation over rows where both are known."""
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = np.where(both, x, np.nan), np.where(both, y, np.nan)
    if op == "corr" and n == 2:
        step = np.sign(x - shifted(runs, x, 1)) * np.sign(y - shifted(runs, y, 1))
        return np.where(step == 0, np.nan, step)
    ax, ay, mx, my, cov = (np.zeros(runs.size) for _ in range(5))
    for j, (u, v) in enumerate(zip(runs.lags(x, n), runs.lags(y, n))):
        c = float(j + 1)
        dx, dy = u - ax, v - ay
        px, py = dx / c, dy / c
        ax, ay = ax + px, ay + py
        cov += dx * (v - ay)
        if op == "corr":
            mx += dx * (dx - px)
            my += dy * (dy - py)
    if op == "cov":
        out = cov / (n - 1.0) if n > 1 else np.full(runs.size, np.nan)
    else:
        varied = (rolling("min", runs, x, n, n) < rolling("max", runs, x, n, n)) & (rolling("min", runs, y, n, n) < rolling("max", runs, y, n, n))
        spread = np.sqrt(mx / n) * np.sqrt(my / n)
        out = np.where(varied, cov / n / np.where(spread == 0, np.nan, spread), np.nan)
    return np.where(runs.known(x, n) == n, out, np.nan)


def series_value(node: Factor, a: list[np.ndarray], runs: Runs) -> np.ndarray:
    op, o, x = node.op, node.opts, a[0]
    if op == "delay":
        return shifted(runs, x, o[0])
    if op == "lead":
        return shifted(runs, x, -o[0])
    if op in ("mean", "std", "pstd", "sum", "min", "max", "skew", "kurt"):
        return rolling(op, runs, x, o[0], o[1])
    if op in ("corr", "cov"):
        return joint(op, runs, x, a[1], o[0])
    if op == "ewm":
        smooth = pd.Series(x).groupby(runs.group).ewm(alpha=o[0], adjust=False, min_periods=o[1]).mean()
        return smooth.to_numpy()
    if op in ("runmax", "runsum"):
        seen = runs.known(x, runs.size + 1) > 0
        out = np.where(np.isnan(x), -np.inf if op == "runmax" else 0.0, x)
        step = np.maximum.accumulate if op == "runmax" else np.cumsum
        for start, end in zip(runs.ends[:-1], runs.ends[1:]):
            out[start:end] = step(out[start:end])
        return np.where(seen, out, np.nan)
    n = o[0]
    out = np.ones(runs.size) if op == "product" else np.zeros(runs.size)
    if op == "tsrank":
        key = tie_key(x)
        for v in runs.lags(key, n):
            out += (v < key) + 0.5 * (v == key)
        out = (out + 0.5) / float(n)
    elif op in ("argmax", "argmin"):
        better = np.greater if op == "argmax" else np.less
        best = np.full(runs.size, -np.inf if op == "argmax" else np.inf)
        for j, v in enumerate(runs.lags(tie_key(x), n)):
            found = better(v, best) | (j == 0)
            best, out = np.where(found, v, best), np.where(found, j + 1.0, out)
    elif op == "decay":
        for j, v in enumerate(runs.lags(x, n)):
            out += v * (j + 1.0)
        out = out / (n * (n + 1) / 2.0)
    elif op == "product":
        for v in runs.lags(x, n):
            out *= v
    else:
        raise ValueError(f"unknown series operator {op}")
    return np.where(runs.known(x, n) == n, out, np.nan)


# -- one date after the other --------------------------------------------------------------


def ranked(x: np.ndarray, runs: Runs) -> np.ndarray:
    """Average-tie percent rank of the known values of each group."""
    out = np.full(runs.size, np.nan)
    key = tie_key(x)
    for start, end in zip(runs.ends[:-1], runs.ends[1:]):
        k = key[start:end]
        at = np.argsort(k)  # unknown values last
        n = int(np.count_nonzero(~np.isnan(k)))
        if n == 0:
            continue
        at = at[:n]
        k = k[at]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        last = np.r_[first[1:], n]
        out[start + at] = np.repeat((first + 1 + last) / 2.0 / n, last - first)
    return out


def cross_value(node: Factor, x: np.ndarray, runs: Runs, groups: Callable[[tuple], np.ndarray]) -> np.ndarray:
    if node.op == "rank":
        return ranked(x, runs)
    ids = groups(node.opts if node.op in ("zscore", "demean") else ())
    known = ~np.isnan(x)
    total = lambda v: np.bincount(ids[known], v[known], minlength=int(ids.max()) + 1)[ids]
    count = total(np.ones(runs.size))
    some = np.where(count > 0, count, np.nan)
    if node.op == "count_x":
        return count
    if node.op == "scale":
        size = total(np.abs(x))
        return np.where(size > 0, x * node.opts[0] / np.where(size > 0, size, np.nan), np.nan)
    base = np.full(int(ids.max()) + 1, np.nan)
    base[ids[known][::-1]] = x[known][::-1]  # the group's first value: a group without spread keeps none
    off = x - base[ids]
    mean = total(off) / some
    if node.op == "xmean":
        return base[ids] + mean
    if node.op == "demean":
        return off - mean
    dev = np.sqrt(total((off - mean) ** 2) / some)
    return np.where(dev > 1e-12, (off - mean) / np.where(dev > 1e-12, dev, np.nan), np.nan)


# -- batches -------------------------------------------------------------------------------


def codes_of(column: pa.ChunkedArray) -> np.ndarray:
    plain = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return plain.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least: int = BATCH_ROWS) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``key``; a group is never cut."""
    held: list[pa.RecordBatch] = []
    rows, target = 0, least
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        table = pa.Table.from_batches(held)
        codes = codes_of(table.column(key))
        other = np.flatnonzero(codes != codes[-1])
        if len(other) == 0:
            target = 2 * rows
            continue
        cut = int(other[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows = sum(b.num_rows for b in held)
        target = max(least, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)


def pack_task(key: str, portions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The panel's rows as blocks for the first stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((pa.Table.from_batches([b]) for b in batches if b.num_rows), key, portions)

    return run


@dataclass(frozen=True)
class Source:
    """What a stage finds beside panel columns: the column of each tree by its key, and factors already complete."""

    trees: dict[str, str]
    ends: set[str] | None


@dataclass(frozen=True)
class Target:
    """What a stage hands on: panel columns, trees by column name, and factors that are complete by now.

    Trees that nothing but ranks will read (``ranked``) keep no more decimals than ranks tell apart.
    """

    kept: list[str]
    trees: dict[str, Factor]
    ends: list[str]
    ranked: frozenset[str] = frozenset()


TRUTHS = ("lt", "le", "eq", "and", "or", "known")


def stage_task(
    kind: str, key: str, other: str, layers: list[list[Factor]], names: dict[str, str], source: Source, target: Target, factors: dict[str, Factor], tidied: bool, schema: pa.Schema | None, portions: int | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task of one stage for ``mapInArrow``.

    It reads rows sorted by group, or blocks of ``schema``; it returns rows with all factors (``portions`` is None), or
    blocks for the next stage, whose groups are ``other``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = whole_groups(batches, key) if schema is None else portions_read(batches, schema, [key, other], BATCH_ROWS)
        if portions is None:
            for table in tables:
                yield from compute(table).to_batches()
        else:
            shares = tuple(c for c, v in target.trees.items() if v.op == "rank") if kind == "cross" else ()
            yield from packed(map(compute, tables), other, portions, shares=shares, within=key)

    def compute(table: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            return staged(table)

    def staged(table: pa.Table) -> pa.Table:
        size = table.num_rows
        runs = Runs(codes_of(table.column(key)))
        have: dict[str, np.ndarray] = {}
        built: dict[str, np.ndarray] = {}

        def column(name: str) -> np.ndarray:
            if name not in have:
                values = table.column(name)
                have[name] = values.to_numpy().astype("float64") if values.null_count == 0 else values.to_pandas().to_numpy(dtype="float64", na_value=np.nan)
            return have[name]

        def sub(node: Factor) -> np.ndarray:
            if node.key in built:
                return built[node.key]
            if node.key in source.trees:
                value = column(source.trees[node.key])
                built[node.key] = value > 0.5 if node.op in TRUTHS else value
            elif node.op == "col":
                return column(node.opts[0])
            elif node.op == "optional":
                return column(node.opts[0]) if node.opts[0] in table.column_names else np.full(size, np.nan if node.opts[1] is None else float(node.opts[1]))
            elif node.key in names:
                return column(names[node.key])
            else:
                built[node.key] = row_value(node, sub, size)
            return built[node.key]

        def groups(extra: tuple) -> np.ndarray:
            ids = runs.group
            for g in extra:
                c = codes_of(table.column(g)).astype("int64") + 1
                ids = np.unique(ids * (int(c.max()) + 1) + c, return_inverse=True)[1]
            return ids

        def tree(name: str) -> np.ndarray:
            value = sub(target.trees[name]).astype("float64")
            return tie_value(value) if name in target.ranked else value

        def end(name: str) -> pa.Array | pa.ChunkedArray:
            if name in (source.ends or ()):
                return table.column(name)
            value = sub(factors[name]).astype("float64")
            value = np.where(np.isinf(value), np.nan, value)
            return pa.array(tidy_values(value) if tidied else value, pa.float64(), from_pandas=True)

        for layer in layers:
            for node in layer:
                a = [sub(x) for x in node.args]
                have[names[node.key]] = cross_value(node, a[0], runs, groups) if kind == "cross" else series_value(node, a, runs)
        ends = list(factors) if portions is None else target.ends
        out = [table.column(c) for c in target.kept] + [pa.array(tree(name), pa.float64(), from_pandas=True) for name in target.trees] + [end(name) for name in ends]
        return pa.Table.from_arrays(out, names=[*target.kept, *target.trees, *ends])

    return run
