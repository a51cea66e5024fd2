"""Lower factor trees to DataFrame stages."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.functions import columns as C
from tickloom.functions.factor import Factor, inputs, lookback, stages, walk
from tickloom.operators import cross as X
from tickloom.operators import series as S
from tickloom.plans import blocks
from tickloom.plans.arrays import Source, Target, pack_task, stage_task
from tickloom.plans.blocks import PORTIONS
from tickloom.session import cut_lineage
from tickloom.sizes import Layout


def _row(node: Factor, sub, have: set[str]) -> Column:
    op = node.op
    if op == "col":
        return F.col(node.opts[0])
    if op == "optional":
        name, default = node.opts
        return F.col(name).cast("double") if name in have else F.lit(default).cast("double")
    if op == "const":
        return F.lit(node.opts[0])
    a = [sub(x) for x in node.args]
    if op == "add":
        return a[0] + a[1]
    if op == "sub":
        return a[0] - a[1]
    if op == "mul":
        return a[0] * a[1]
    if op == "div":
        return C.ratio(a[0], a[1])
    if op == "neg":
        return -a[0]
    if op == "abs":
        return F.abs(a[0])
    if op == "sign":
        return F.signum(a[0])
    if op == "ln":
        return F.ln(a[0])
    if op == "sqrt":
        return F.when(a[0] >= 0, F.sqrt(a[0]))
    if op == "pow":
        return F.pow(a[0], a[1])
    if op == "emin":
        return C.both_min(a[0], a[1])
    if op == "emax":
        return C.both_max(a[0], a[1])
    if op == "lt":
        return C.is_true(a[0] < a[1])
    if op == "le":
        return C.is_true(a[0] <= a[1])
    if op == "eq":
        return C.is_true(a[0] == a[1])
    if op == "and":
        return a[0] & a[1]
    if op == "or":
        return a[0] | a[1]
    if op == "where":
        return F.when(a[0], a[1]).otherwise(a[2])
    if op == "only":
        return F.when(a[0], a[1])
    if op == "truth":
        return C.flag(a[0])
    if op == "filled":
        return F.coalesce(a[0], a[1])
    if op == "known":
        return a[0].isNotNull()
    raise ValueError(f"unknown factor operator {op}")


def _series(node: Factor, a: list[Column], w: WindowSpec) -> Column:
    op, o = node.op, node.opts
    if op == "delay":
        return F.lag(a[0], o[0]).over(w)
    if op == "lead":
        return F.lead(a[0], o[0]).over(w)
    if op in ("mean", "std", "pstd", "sum", "min", "max", "skew", "kurt"):
        return S.rolling(op, a[0], w, o[0], o[1])
    if op == "tsrank":
        return S.ts_rank(a[0], w, o[0])
    if op == "argmax":
        return S.ts_argmax(a[0], w, o[0])
    if op == "argmin":
        return S.ts_argmin(a[0], w, o[0])
    if op == "corr":
        return S.rolling_corr(a[0], a[1], w, o[0])
    if op == "cov":
        return S.rolling_cov(a[0], a[1], w, o[0])
    if op == "decay":
        return S.decay_linear(a[0], w, o[0])
    if op == "product":
        return S.rolling_product(a[0], w, o[0])
    if op == "runmax":
        return F.max(a[0]).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if op == "runsum":
        return F.sum(a[0]).over(w.rowsBetween(Window.unboundedPreceding, 0))
    raise ValueError(f"unknown series operator {op}")


def _cross(node: Factor, a: list[Column], date: str) -> Column:
    keys = [date, *node.opts] if node.op in ("zscore", "demean") else [date]
    if node.op == "rank":
        return X.pct_rank(a[0], date)
    if node.op == "zscore":
        return X.group_zscore(a[0], *keys)
    if node.op == "scale":
        return X.group_scale(a[0], node.opts[0], date)
    if node.op == "demean":
        return X.group_demean(a[0], *keys)
    if node.op == "xmean":
        return F.avg(a[0]).over(Window.partitionBy(date))
    if node.op == "count_x":
        return X.group_count(a[0], date).cast("double")
    raise ValueError(f"unknown cross operator {node.op}")


def _cross_split(df: DataFrame, layer: dict[str, Factor], sub, lay: Layout) -> DataFrame:
    """A cross layer by partial aggregates and bucketed ranks, never a whole date in one task."""
    ranks = {name: sub(n.args[0]) for name, n in layer.items() if n.op == "rank"}
    if ranks:
        df = X.split_rank(df, ranks, [lay.date], [lay.series], lay.rank_buckets)
    for name, n in layer.items():
        if n.op == "rank":
            continue
        x = sub(n.args[0])
        keys = [lay.date, *n.opts] if n.op in ("zscore", "demean") else [lay.date]
        need = {"_m": F.avg(x), "_s": F.stddev_pop(x), "_z": F.sum(F.abs(x)), "_c": F.count(x)}
        df = X.split_moments(df, keys, need)
        value = {
            "zscore": F.when(F.col("_s") > 1e-12, (x - F.col("_m")) / F.col("_s")),
            "demean": x - F.col("_m"),
            "scale": F.when(F.col("_z") > 0, x * F.lit(n.opts[0] if n.op == "scale" else 1.0) / F.col("_z")),
            "xmean": F.col("_m"),
            "count_x": F.col("_c").cast("double"),
        }[n.op]
        df = df.withColumn(name, value).drop(*need)
    return df


def pinned(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's full partition count.

    Long window frames cost far more than their bytes suggest; left alone, adaptive execution
    would merge these small-looking partitions into one or two tasks. The window reuses this
    exchange, so it adds no shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def ewm_columns(df: DataFrame, specs: dict[str, tuple[Column, float, int]], series: str, order: str) -> DataFrame:
    """Recursive exponential means, several at once, one Arrow batch per series.

    A window frame cannot be recursive. A daily series is bounded by the trading calendar, so
    one series always fits a task.
    """
    inp = {f"_in_{i}": spec[0].cast("double") for i, spec in enumerate(specs.values())}
    staged = df.withColumns(inp)
    kept = [f for f in staged.schema.fields if not f.name.startswith("_in_")]
    schema = T.StructType(kept + [T.StructField(n, T.DoubleType()) for n in specs])
    plan = [(n, f"_in_{i}", a, least) for i, (n, (_, a, least)) in enumerate(specs.items())]
    names = [f.name for f in kept]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        out = part[names].copy()
        for name, src, alpha, least in plan:
            smooth = part[src].astype("float64").ewm(alpha=alpha, adjust=False, min_periods=least).mean()
            out[name] = smooth
        return out

    return staged.groupBy(series).applyInPandas(fold, schema)


def _plain_numbers(df: DataFrame, roots: list[Factor]) -> bool:
    """True when every column the trees compute with is a plain number."""
    used = {n.opts[0] for n in walk(roots) if n.op in ("col", "optional")}
    return all(t in ("double", "float", "bigint", "int", "smallint", "tinyint") for c, t in df.dtypes if c in used)


def _carried(consumers: list[Factor], finals: dict[str, Factor], done: set[str], columns: list[str]) -> tuple[list[str], dict[str, Factor], list[str]]:
    """What one stage hands on: panel columns, values of trees, and the factors that are complete.

    A later node reads the largest trees that are ready; a complete factor is one rounded column. Trees that need no
    more than panel columns and other trees handed on are computed again, where that makes the row shorter.
    """

    def ready(node: Factor) -> bool:
        return node.kind == "row" and all(ready(a) for a in node.args) or node.key in done

    parts: dict[str, Factor] = {}

    def split(node: Factor) -> None:
        if ready(node):
            if node.op != "const" and any(n.op in ("col", "optional") or n.kind != "row" for n in walk([node])):
                parts[node.key] = node
        else:
            for a in node.args:
                split(a)

    whole = {name: node for name, node in finals.items() if ready(node)}
    for node in [*consumers, *(n for name, n in finals.items() if name not in whole)]:
        split(node)
    used = sorted({n.opts[0] for n in walk([*parts.values(), *whole.values()]) if n.op in ("col", "optional") and n.opts[0] in columns})

    def told(node: Factor, have: set[str], own: str = "") -> bool:
        if node.key in have and node.key != own:
            return True
        if node.op in ("col", "optional"):
            return node.op == "optional" and node.opts[0] not in columns
        return node.kind == "row" and all(told(a, have) for a in node.args)

    best = None
    for kept in product(*([(True, False)] * len(used))):
        cols = [c for c, k in zip(used, kept) if k]
        have = {n.key for n in walk([*parts.values(), *whole.values()]) if n.op in ("col", "optional") and n.opts[0] in cols}
        trees = dict(parts)
        for key in list(trees):
            if told(trees[key], have | (trees.keys() - {key})):
                del trees[key]
        ends = [name for name, node in whole.items() if not told(node, have | trees.keys())]
        width = 4.0 * len(cols) + 7.0 * len(trees) + 3.0 * len(ends)  # about the bytes of each
        if best is None or width < best[0]:
            best = (width, cols, trees, ends)
    return best[1:]


def _values_read(later: list[Factor], roots: list[Factor], trees: set[str], done: set[str]) -> set[str]:
    """Which trees are read by more than ranks to come."""
    out: set[str] = set()

    def use(node: Factor) -> None:
        if node.key in trees:
            out.add(node.key)
        elif node.op == "rank" and node.key not in done:
            if node.args[0].key not in trees:
                use(node.args[0])
        else:
            for a in node.args:
                use(a)

    for node in [*later, *roots]:
        use(node)
    return out


def _array_stages(df: DataFrame, factors: dict[str, Factor], stage_list: list, names: dict[str, str], base: list[str], lay: Layout, tidied: bool) -> DataFrame:
    """Every stage as one exchange, one sort and one pass in Arrow; what later stages read moves on in column blocks."""
    merged: list[tuple[str, list[list[Factor]]]] = []
    for kind, layers in stage_list:
        kind = "cross" if kind == "cross" else "series"
        if merged and merged[-1][0] == kind:
            merged[-1][1].extend(layers)
        else:
            merged.append((kind, list(layers)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    portions = n * max(1, -(-PORTIONS // n))
    panel = [c for c in df.columns]
    done: set[str] = set()
    source = Source({}, None)
    for i, (kind, layers) in enumerate(merged):
        last = i == len(merged) - 1
        key, other = (lay.date, lay.series) if kind == "cross" else (lay.series, lay.date)
        done |= {n.key for layer in layers for n in layer}
        if last:
            out = Target(base, {}, [])
        else:
            later = [n for _, ls in merged[i + 1 :] for layer in ls for n in layer]
            cols, trees, ends = _carried([a for n in later for a in n.args], factors, done, panel)
            groups = {g for n in later if n.op in ("zscore", "demean") for g in n.opts}
            kept = [c for c in panel if c in base or c in cols or c in groups]
            trees = {k: v for k, v in trees.items() if not (v.op in ("col", "optional") and v.opts[0] in kept)}
            named = {f"_t{j}": v for j, v in enumerate(trees.values())}
            out = Target(kept, named, ends, frozenset(c for c, v in named.items() if v.key not in _values_read(later, [v for c, v in factors.items() if c not in ends], set(trees), done)))
        if len(merged) == 1:  # nothing to pack for
            df = pinned(df, key).sortWithinPartitions(key, *([] if kind == "cross" else [other]))
            schema = df.schema
        else:
            if i == 0:
                schema = df.schema
                df = df.mapInArrow(pack_task(key, portions), blocks.SCHEMA)
            df = df.repartitionById(n, F.col("_portion") % n).sortWithinPartitions("_portion")
        target = T.StructType([schema[c] for c in out.kept] + [T.StructField(c, T.DoubleType()) for c in [*out.trees, *(factors if last else out.ends)]])
        task = stage_task(kind, key, other, layers, names, source, out, factors, tidied, None if len(merged) == 1 else to_arrow_schema(schema), None if last else portions)
        df = df.mapInArrow(task, target if last else blocks.SCHEMA)
        schema, source, panel = target, Source({v.key: c for c, v in out.trees.items()}, set(out.ends)), out.kept
    return df


def evaluate(
    panel: DataFrame,
    factors: dict[str, Factor],
    layout: Layout | None = None,
    keep: list[str] | None = None,
    tidied: bool = False,
) -> DataFrame:
    """One column per factor, next to the panel keys (wide form).

    ``tidied`` rounds the factors as ``columns.tidy`` does: in the last stage's arrays, since a projection of many such
    columns is one generated method too long for the JVM to compile.
    """
    lay = layout or Layout()
    have = set(panel.columns)
    roots = list(factors.values())
    missing = [c for c in inputs(roots) if c not in have]
    if missing:
        raise KeyError(f"panel lacks {missing}")
    stage_list = stages(roots)
    order = [n for n in walk(roots) if n.kind != "row"]
    names = {n.key: f"_f{i}" for i, n in enumerate(order)}

    built: dict[str, Column] = {}

    def sub(node: Factor) -> Column:
        if node.key not in built:
            built[node.key] = F.col(names[node.key]) if node.key in names else _row(node, sub, have)
        return built[node.key]

    base = [lay.series, lay.date, *[c for c in (keep or []) if c not in (lay.series, lay.date)]]
    wanted = set(inputs(roots)) | {n.opts[0] for n in walk(roots) if n.op == "optional" and n.opts[0] in have}
    wanted |= {g for n in walk(roots) if n.op in ("zscore", "demean") for g in n.opts}
    df = panel.select(*dict.fromkeys([*base, *[c for c in panel.columns if c in wanted]]))
    if stage_list and not lay.split_series and not lay.split_dates and _plain_numbers(df, roots):
        return _array_stages(df, factors, stage_list, names, base, lay, tidied)
    if lay.split_series:
        df = S.number_rows(df, [lay.series], [lay.date], F.trunc(F.col(lay.date), "month"))
    w = Window.partitionBy(lay.series).orderBy(lay.date)
    for kind, layers in stage_list:
        if kind == "series" and lay.split_series:
            reach = sum(max(lookback(n) for n in layer) for layer in layers)

            def run(part: DataFrame, spec: WindowSpec, layers=layers) -> DataFrame:
                for layer in layers:
                    part = part.withColumns({names[n.key]: _series(n, [sub(x) for x in n.args], spec) for n in layer})
                return part

            df = S.over_chunks(df, [lay.series], [lay.date], reach, run, lay.chunk_rows)
            continue
        if kind == "cross" and lay.split_dates:
            df = cut_lineage(df)  # a split rank reads its input several times; plans must not multiply
        else:
            df = pinned(df, lay.date if kind == "cross" else lay.series)
        for layer in layers:
            if kind == "series":
                df = df.withColumns({names[n.key]: _series(n, [sub(x) for x in n.args], w) for n in layer})
            elif kind == "fold":
                specs = {names[n.key]: (sub(n.args[0]), n.opts[0], n.opts[1]) for n in layer}
                df = ewm_columns(df, specs, lay.series, lay.date)
            elif lay.split_dates:
                df = cut_lineage(df) if layer is not layers[0] else df
                df = _cross_split(df, {names[n.key]: n for n in layer}, sub, lay)
            else:
                df = df.withColumns({names[n.key]: _cross(n, [sub(x) for x in n.args], lay.date) for n in layer})
    out = df.select(*base, *[C.clean(sub(n)).alias(name) for name, n in factors.items()])
    return out.withColumns({name: C.tidy(F.col(name)) for name in factors}) if tidied else out


def to_long(wide: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """(keys..., factor_name, factor_value); missing values stay as rows."""
    return wide.unpivot(keys, factors, "factor_name", "factor_value")


__all__ = ["evaluate", "ewm_columns", "to_long", "Layout"]
