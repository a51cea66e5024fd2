"""Factor libraries on daily bars."""

from __future__ import annotations

from tickloom.checks.factor_sql import factor_sql
from tickloom.checks.registry import query
from tickloom.functions.factor import Factor
from tickloom.plans.alpha101 import FORMULAS, alpha_name, alphas
from tickloom.plans.cicc80 import FAMILIES, cicc80
from tickloom.plans.default18 import default18
from tickloom.plans.factors import evaluate
from tickloom.plans.gtja import gtja
from tickloom.plans.inputs import BARS_SQL, bars, bars_layout


def factor_query(name: str, factors: dict[str, Factor]) -> None:
    @query(name, factor_sql(BARS_SQL, factors))
    def run(spark, root, factors=factors):
        return evaluate(bars(spark, root), factors, bars_layout(spark, root), tidied=True)


factor_query("factors_default18", default18())

_numbers = list(FORMULAS)
for _i in range(0, len(_numbers), 12):
    _part = _numbers[_i : _i + 12]
    factor_query(f"alpha101_{alpha_name(_part[0])[5:]}_{alpha_name(_part[-1])[5:]}", alphas(_part))

_gtja = gtja()
_recursive = [k for k, v in _gtja.items() if "ewm(" in v.key]
factor_query("gtja_recursive", {k: _gtja[k] for k in _recursive})
_plain = [k for k in _gtja if k not in _recursive]
for _i in range(0, len(_plain), 17):
    factor_query(f"gtja_{_plain[_i][4:]}_{_plain[min(_i + 16, len(_plain) - 1)][4:]}", {k: _gtja[k] for k in _plain[_i : _i + 17]})

_cicc = cicc80()
for _fam in FAMILIES:
    factor_query(f"cicc_{_fam}", {k: v for k, v in _cicc.items() if k.split("_")[1] == _fam})
