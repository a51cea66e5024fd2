"""Factor expressions: small trees a user composes, lowered to DataFrame stages.

A tree mixes three families. Row arithmetic becomes one Column. *Series* nodes (delay, rolling
mean, rank in time ...) are windows over one series in date order. *Cross* nodes (rank, z-score,
scale, demean) are windows over one date. Spark refuses a window inside a window, so each window
node becomes a column of its own, and all nodes that can run next to each other share a stage:
many factors cost the shuffles of the deepest one, not the sum.
"""

from __future__ import annotations

from collections.abc import Iterable

SERIES = {
    "delay", "mean", "std", "pstd", "sum", "min", "max", "tsrank", "argmax", "argmin", "corr", "cov",
    "decay", "product", "skew", "kurt", "count", "median", "runmax", "runsum", "lead",
}
CROSS = {"rank", "zscore", "scale", "demean", "xmean", "count_x"}
FOLD = {"ewm"}


class Factor:
    """An immutable expression node; equal trees have equal ``key``."""

    __slots__ = ("op", "args", "opts", "key")

    def __init__(self, op: str, args: tuple = (), opts: tuple = ()):
        self.op, self.args, self.opts = op, args, opts
        self.key = f"{op}({','.join([a.key for a in args] + [repr(o) for o in opts])})"

    def __add__(self, o): return Factor("add", (self, wrap(o)))
    def __radd__(self, o): return Factor("add", (wrap(o), self))
    def __sub__(self, o): return Factor("sub", (self, wrap(o)))
    def __rsub__(self, o): return Factor("sub", (wrap(o), self))
    def __mul__(self, o): return Factor("mul", (self, wrap(o)))
    def __rmul__(self, o): return Factor("mul", (wrap(o), self))
    def __truediv__(self, o): return Factor("div", (self, wrap(o)))
    def __rtruediv__(self, o): return Factor("div", (wrap(o), self))
    def __neg__(self): return Factor("neg", (self,))
    def __lt__(self, o): return Factor("lt", (self, wrap(o)))
    def __le__(self, o): return Factor("le", (self, wrap(o)))
    def __gt__(self, o): return Factor("lt", (wrap(o), self))
    def __ge__(self, o): return Factor("le", (wrap(o), self))
    def __and__(self, o): return Factor("and", (self, o))
    def __or__(self, o): return Factor("or", (self, o))
    def eq(self, o): return Factor("eq", (self, wrap(o)))

    @property
    def kind(self) -> str:
        if self.op in SERIES:
            return "series"
        if self.op in CROSS:
            return "cross"
        return "fold" if self.op in FOLD else "row"


def wrap(x) -> Factor:
    return x if isinstance(x, Factor) else Factor("const", (), (float(x),))


def col(name: str) -> Factor: return Factor("col", (), (name,))
def optional(name: str, default: float | None = None) -> Factor: return Factor("optional", (), (name, default))
def const(v: float) -> Factor: return wrap(v)
def where(cond: Factor, a, b) -> Factor: return Factor("where", (cond, wrap(a), wrap(b)))
def only(cond: Factor, a) -> Factor: return Factor("only", (cond, wrap(a)))
def absolute(x): return Factor("abs", (x,))
def sign(x): return Factor("sign", (x,))
def ln(x): return Factor("ln", (x,))
def log_floor(x): return Factor("ln", (emax(x, 1e-12),))
def sqrt(x): return Factor("sqrt", (x,))
def power(x, p): return Factor("pow", (x, wrap(p)))
def signed_power(x, p): return sign(x) * power(absolute(x), p)
def emin(a, b): return Factor("emin", (wrap(a), wrap(b)))
def emax(a, b): return Factor("emax", (wrap(a), wrap(b)))
def truth(cond): return Factor("truth", (cond,))
def filled(x, v=0.0): return Factor("filled", (x, wrap(v)))
def known(x): return Factor("known", (x,))


def delay(x, k=1): return Factor("delay", (x,), (k,))
def lead(x, k=1): return Factor("lead", (x,), (k,))
def delta(x, k=1): return x - delay(x, k)
def returns(x, k=1): return x / delay(x, k) - 1
def mean(x, n, least=None): return Factor("mean", (x,), (n, least or n))
def std(x, n, least=None): return Factor("std", (x,), (n, least or n))
def pstd(x, n, least=None): return Factor("pstd", (x,), (n, least or n))
def total(x, n, least=None): return Factor("sum", (x,), (n, least or n))
def lowest(x, n, least=None): return Factor("min", (x,), (n, least or n))
def highest(x, n, least=None): return Factor("max", (x,), (n, least or n))
def skew(x, n): return Factor("skew", (x,), (n, n))
def kurt(x, n): return Factor("kurt", (x,), (n, n))
def ts_rank(x, n): return Factor("tsrank", (x,), (n,))
def argmax(x, n): return Factor("argmax", (x,), (n,))
def argmin(x, n): return Factor("argmin", (x,), (n,))
def since_high(x, n): return n - argmax(x, n)
def since_low(x, n): return n - argmin(x, n)
def corr(x, y, n): return Factor("corr", (x, y), (n,))
def cov(x, y, n): return Factor("cov", (x, y), (n,))
def decay(x, n): return Factor("decay", (x,), (n,))
def product(x, n): return Factor("product", (x,), (n,))
def count_true(cond, n): return total(truth(cond), n)
def sum_if(x, cond, n): return total(where(cond, x, 0.0), n)
def running_max(x): return Factor("runmax", (x,))
def running_sum(x): return Factor("runsum", (x,))
def ewm(x, alpha: float, least: int = 1): return Factor("ewm", (x,), (float(alpha), least))
def sma(x, n, m): return ewm(x, m / n)
def span_ewm(x, span, least: int = 1): return ewm(x, 2.0 / (span + 1), least)


def rank(x): return Factor("rank", (x,))
def zscore(x): return Factor("zscore", (x,))
def group_zscore(x, group: str): return Factor("zscore", (x,), (group,))
def scale(x, k=1.0): return Factor("scale", (x,), (float(k),))
def demean(x, group: str | None = None): return Factor("demean", (x,), (group,) if group else ())
def cross_mean(x): return Factor("xmean", (x,))
def cross_count(x): return Factor("count_x", (x,))


def walk(roots: Iterable[Factor]) -> list[Factor]:
    """Every distinct node, children first."""
    seen: dict[str, Factor] = {}

    def visit(node: Factor) -> None:
        if node.key in seen:
            return
        for child in node.args:
            visit(child)
        seen[node.key] = node

    for root in roots:
        visit(root)
    return list(seen.values())


def inputs(roots: Iterable[Factor]) -> list[str]:
    """Panel columns the trees read."""
    return sorted({n.opts[0] for n in walk(roots) if n.op == "col"})


def lookback(node: Factor) -> int:
    """Rows before the current one that a single series node reads."""
    if node.kind != "series":
        return 0
    if node.op == "delay":
        return int(node.opts[0])
    if node.op in ("runmax", "runsum", "lead"):
        raise ValueError(f"{node.op} has no finite look-back")
    return int(node.opts[0]) - 1


def stages(roots: list[Factor]) -> list[tuple[str, list[list[Factor]]]]:
    """Group window nodes into alternating series / fold / cross stages.

    Each stage is a list of layers; layers of one stage share a partitioning, so only the step
    from one stage to the next needs a shuffle.
    """
    nodes = [n for n in walk(roots) if n.kind != "row"]
    done: set[str] = set()

    def ready(node: Factor) -> bool:
        return all(c.key in done for c in walk(node.args) if c.kind != "row")

    out: list[tuple[str, list[list[Factor]]]] = []
    pending = list(nodes)
    while pending:
        before = len(pending)
        for kind in ("series", "fold", "cross"):
            layers = []
            while True:
                layer = [n for n in pending if n.kind == kind and ready(n)]
                if not layer:
                    break
                layers.append(layer)
                done.update(n.key for n in layer)
                pending = [n for n in pending if n.key not in done]
            if layers:
                out.append((kind, layers))
        if len(pending) == before:
            raise ValueError("factor tree cannot be staged")
    return out
