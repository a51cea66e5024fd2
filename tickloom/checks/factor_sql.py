"""Text of a factor tree as staged DuckDB SQL, the second opinion on ``plans.factors``."""

from __future__ import annotations

from tickloom.functions.factor import Factor, stages, walk
from tickloom.plans.inputs import tidy_sql


def _row(n: Factor, sub) -> str:
    if n.op == "col":
        return n.opts[0]
    if n.op == "optional":
        return "NULL::DOUBLE" if n.opts[1] is None else f"{n.opts[1]!r}::DOUBLE"
    if n.op == "const":
        return f"({n.opts[0]!r}::DOUBLE)"
    a = [sub(x) for x in n.args]
    return {
        "add": lambda: f"({a[0]} + {a[1]})",
        "sub": lambda: f"({a[0]} - {a[1]})",
        "mul": lambda: f"({a[0]} * {a[1]})",
        "div": lambda: f"({a[0]} / nullif({a[1]}, 0))",
        "neg": lambda: f"(-{a[0]})",
        "abs": lambda: f"abs({a[0]})",
        "sign": lambda: f"sign({a[0]})::DOUBLE",
        "ln": lambda: f"(CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END)",
        "sqrt": lambda: f"(CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END)",
        "pow": lambda: f"pow({a[0]}, {a[1]})",
        "emin": lambda: f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN least({a[0]}, {a[1]}) END)",
        "emax": lambda: f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN greatest({a[0]}, {a[1]}) END)",
        "lt": lambda: f"coalesce({a[0]} < {a[1]}, false)",
        "le": lambda: f"coalesce({a[0]} <= {a[1]}, false)",
        "eq": lambda: f"coalesce({a[0]} = {a[1]}, false)",
        "and": lambda: f"({a[0]} AND {a[1]})",
        "or": lambda: f"({a[0]} OR {a[1]})",
        "where": lambda: f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)",
        "only": lambda: f"(CASE WHEN {a[0]} THEN {a[1]} END)",
        "truth": lambda: f"(CASE WHEN {a[0]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
        "filled": lambda: f"coalesce({a[0]}, {a[1]})",
        "known": lambda: f"({a[0]} IS NOT NULL)",
    }[n.op]()


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _tie(x: str) -> str:
    return f"round_even({x} * 1e10, 0)"


def _series(n: Factor, a: list[str]) -> str:
    op, o = n.op, n.opts
    x = a[0]
    seq = "OVER (PARTITION BY symbol ORDER BY trade_date)"
    if op == "delay":
        return f"lag({x}, {o[0]}) {seq}"
    if op == "lead":
        return f"lead({x}, {o[0]}) {seq}"
    if op in ("runmax", "runsum"):
        return f"{'max' if op == 'runmax' else 'sum'}({x}) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING)"
    fr = _frame(o[0])
    if op in ("mean", "std", "pstd", "sum", "min", "max", "skew", "kurt"):
        fn = {"mean": "avg", "std": "stddev_samp", "pstd": "stddev_pop", "skew": "skewness", "kurt": "kurtosis"}.get(op, op)
        varied = f" AND min({x}) {fr} < max({x}) {fr}" if op in ("skew", "kurt") else ""
        return f"CASE WHEN count({x}) {fr} >= {o[1]}{varied} THEN {fn}({x}) {fr} END"
    full = f"CASE WHEN count({x}) {fr} = {o[0]} THEN "
    if op == "tsrank":
        t = _tie(x)
        lst = f"list({t}) {fr}"
        return (
            full + f"(len(list_filter({lst}, lambda v: v < {t})) + (len(list_filter({lst}, lambda v: v = {t})) + 1) / 2.0)"
            f" / {o[0]}.0 END"
        )
    if op in ("argmax", "argmin"):
        t = _tie(x)
        pick = "list_max" if op == "argmax" else "list_min"
        return full + f"list_position(list({t}) {fr}, {pick}(list({t}) {fr}))::DOUBLE END"
    if op == "decay":
        return full + f"list_dot_product(list(coalesce({x}, 0.0)) {fr}, {[float(k) for k in range(1, o[0] + 1)]}::DOUBLE[]) / {o[0] * (o[0] + 1) / 2.0} END"
    if op == "product":
        return full + f"list_product(list({x}) {fr}) END"
    if op in ("corr", "cov"):
        p = f"(CASE WHEN {a[1]} IS NOT NULL THEN {a[0]} END)"
        q = f"(CASE WHEN {a[0]} IS NOT NULL THEN {a[1]} END)"
        if op == "cov":
            return f"CASE WHEN count({p}) {fr} = {o[0]} THEN covar_samp({p}, {q}) {fr} END"
        if o[0] == 2:
            return f"nullif(sign({p} - lag({p}) {seq}) * sign({q} - lag({q}) {seq}), 0)::DOUBLE"
        return (
            f"CASE WHEN count({p}) {fr} = {o[0]} AND min({p}) {fr} < max({p}) {fr} AND min({q}) {fr} < max({q}) {fr} "
            f"THEN covar_pop({p}, {q}) {fr} / (stddev_pop({p}) {fr} * stddev_pop({q}) {fr}) END"
        )
    raise ValueError(op)


def _cross(n: Factor, x: str) -> str:
    keys = ", ".join(["trade_date", *(n.opts if n.op in ("zscore", "demean") else ())])
    over = f"OVER (PARTITION BY {keys})"
    if n.op == "rank":
        t = _tie(x)
        return (
            f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {t} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY trade_date, {t}) - 1) / 2.0) / count({x}) {over} END"
        )
    if n.op == "zscore":
        return f"CASE WHEN stddev_pop({x}) {over} > 1e-12 THEN ({x} - avg({x}) {over}) / stddev_pop({x}) {over} END"
    if n.op == "scale":
        return f"{x} * {n.opts[0]} / nullif(sum(abs({x})) {over}, 0)"
    if n.op == "demean":
        return f"{x} - avg({x}) {over}"
    if n.op == "xmean":
        return f"avg({x}) {over}"
    if n.op == "count_x":
        return f"count({x}) {over}::DOUBLE"
    raise ValueError(n.op)


def factor_sql(prefix: str, factors: dict[str, Factor], source: str = "bars", keep: tuple[str, ...] = ()) -> str:
    """A full SELECT: ``prefix`` holds the CTEs that define ``source``."""
    roots = list(factors.values())
    order = [n for n in walk(roots) if n.kind != "row"]
    names = {n.key: f"f{i}_" for i, n in enumerate(order)}

    def sub(n: Factor) -> str:
        return names[n.key] if n.key in names else _row(n, sub)

    ctes = [f"p0 AS MATERIALIZED (SELECT * FROM {source})"]
    k = 0
    for kind, layers in stages(roots):
        for layer in layers:
            k += 1
            if kind == "fold":
                # y, w: smoothed value and the weight it still carries, advanced row by row
                pick = [f"({sub(n.args[0])})::DOUBLE AS x{i}" for i, n in enumerate(layer)]
                ctes.append(
                    f"n{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn{k}, "
                    + ", ".join(pick) + f" FROM p{k - 1})"
                )
                slim = ", ".join(f"x{i}" for i in range(len(layer)))
                first = ", ".join(f"x{i} AS y{i}, 1.0::DOUBLE AS w{i}, (x{i} IS NOT NULL)::INT AS c{i}" for i in range(len(layer)))
                steps = []
                for i, n in enumerate(layer):
                    a = n.opts[0]
                    w = f"r.w{i} * {1 - a!r}"
                    steps.append(
                        f"CASE WHEN b.x{i} IS NULL THEN r.y{i} WHEN r.y{i} IS NULL THEN b.x{i} "
                        f"ELSE ({w} * r.y{i} + {a!r} * b.x{i}) / ({w} + {a!r}) END, "
                        f"CASE WHEN r.y{i} IS NULL OR b.x{i} IS NOT NULL THEN 1.0::DOUBLE ELSE {w} END, "
                        f"r.c{i} + (b.x{i} IS NOT NULL)::INT"
                    )
                ctes.append(
                    f"r{k} AS (SELECT symbol, rn{k}, {first} FROM n{k} WHERE rn{k} = 1 UNION ALL "
                    f"SELECT b.symbol, b.rn{k}, {', '.join(steps)} FROM r{k} r JOIN (SELECT symbol, rn{k}, {slim} FROM n{k}) b "
                    f"ON b.symbol = r.symbol AND b.rn{k} = r.rn{k} + 1)"
                )
                done = ", ".join(
                    f"CASE WHEN r.c{i} >= {n.opts[1]} THEN r.y{i} END AS {names[n.key]}" for i, n in enumerate(layer)
                )
                drop = ", ".join([f"rn{k}"] + [f"x{i}" for i in range(len(layer))])
                ctes.append(
                    f"p{k} AS MATERIALIZED (SELECT n.* EXCLUDE ({drop}), {done} FROM n{k} n JOIN r{k} r ON n.symbol = r.symbol AND n.rn{k} = r.rn{k})"
                )
                continue
            cells = []
            for n in layer:
                a = [sub(x) for x in n.args]
                cells.append(f"{_series(n, a) if kind == 'series' else _cross(n, a[0])} AS {names[n.key]}")
            ctes.append(f"p{k} AS MATERIALIZED (SELECT *, {', '.join(cells)} FROM p{k - 1})")
    out = ", ".join(f"{tidy_sql(sub(n))} AS {name}" for name, n in factors.items())
    keys = ", ".join(("symbol", "trade_date", *keep))
    return f"WITH RECURSIVE {prefix}, {', '.join(ctes)} SELECT {keys}, {out} FROM p{k}"
