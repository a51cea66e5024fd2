"""User factors: a name, its meaning, and a function from panel to values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.factor import Factor
from tickloom.operators.series import rolling_list
from tickloom.plans.factors import Layout, evaluate, to_long


@dataclass(frozen=True)
class FactorMeta:
    name: str
    category: str
    horizon_days: int = 5
    required: tuple[str, ...] = ()
    direction: int = 1
    description: str = ""
    pit_safe: bool = True


class FactorSet:
    """Named expression trees and frame functions that evaluate together."""

    def __init__(self) -> None:
        self._trees: dict[str, tuple[FactorMeta, Factor]] = {}
        self._functions: dict[str, tuple[FactorMeta, Callable[[DataFrame], DataFrame]]] = {}

    def add(self, meta: FactorMeta, tree: Factor) -> None:
        self._check(meta.name)
        self._trees[meta.name] = (meta, tree)

    def add_function(self, meta: FactorMeta, compute: Callable[[DataFrame], DataFrame]) -> None:
        """``compute`` returns (symbol, trade_date, <name>)."""
        self._check(meta.name)
        self._functions[meta.name] = (meta, compute)

    def _check(self, name: str) -> None:
        if name in self._trees or name in self._functions:
            raise ValueError(f"factor {name} is already registered")

    def names(self) -> list[str]:
        return [*self._trees, *self._functions]

    def wide(self, panel: DataFrame, names: list[str] | None = None, layout: Layout | None = None) -> DataFrame:
        picked = names or self.names()
        unknown = [n for n in picked if n not in self.names()]
        if unknown:
            raise KeyError(f"unknown factors {unknown}")
        out = evaluate(panel, {n: self._trees[n][1] for n in picked if n in self._trees}, layout)
        for n in picked:
            if n in self._functions:
                values = self._functions[n][1](panel).select("symbol", "trade_date", F.col(n).cast("double").alias(n))
                out = out.join(values, ["symbol", "trade_date"], "left")
        return out.select("symbol", "trade_date", *picked)

    def long(self, panel: DataFrame, names: list[str] | None = None, layout: Layout | None = None) -> DataFrame:
        picked = names or self.names()
        return to_long(self.wide(panel, picked, layout), ["symbol", "trade_date"], picked)


def from_definition(node: dict | str | float) -> Factor:
    """A factor tree from its JSON form: column name, number, or {"op", "args", "params"}."""
    if isinstance(node, str):
        return Factor("col", (), (node,))
    if isinstance(node, (int, float)):
        return Factor("const", (), (float(node),))
    args = tuple(from_definition(a) for a in node.get("args", ()))
    return Factor(node["op"], args, tuple(node.get("params", ())))


def rolling_apply(x: Column, w: WindowSpec, n: int, fn: Callable[[list[float]], float]) -> Column:
    """Any Python function of the trailing n values, in Arrow batches. Prefer the built-in operators."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else float(fn(v)))

    return run(rolling_list(x, w, n))
