"""URL verdicts: fixed domain rules first, then association rules mined level by level from labelled URLs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import UPPER, widened
from tickloom.session import stored

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD, GOOD = "class=bad", "class=good"


@dataclass(frozen=True)
class Mining:
    """``support``: share of the labelled URLs that hold a rule's tokens and its class, and ``rows`` of them at least;
    ``confidence``: share of the URLs with its tokens that are of its class. URLs of any length are learned from."""

    support: float = 0.002
    rows: int = 20
    confidence: float = 0.6


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path, names in the query, and a fragment's text."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    mark = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^#]*#(.*)$", 1), F.lit(""))
    parts = [
        F.transform(F.split(host_of(url), r"\.", -1), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(path_of(url), r"[/.]", -1), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(F.split(query, "&", -1), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "(?s)^[^=]*", 0))),
        F.array(F.concat(F.lit("f:"), mark)),
    ]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: F.length(x) > 2))


def domain_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting (action, host, path) rule as a struct (rule, action); null if none fits."""
    found = F.lit(None).cast("struct<rule: string, action: string>")
    for action, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def larger(baskets: DataFrame, kept: set[tuple[int, ...]], size: int) -> DataFrame:
    """(items, bad, good) of the sets in ``baskets`` of ``size`` + 1 tokens, all of whose subsets of ``size`` are ``kept``."""
    sent = baskets.sparkSession.sparkContext.broadcast((kept, {x[:i] for x in kept for i in range(1, size + 1)}))
    names = ["items", "bad", "good"]

    def batch_of(counts: dict) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.list_(pa.int32())), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, heads = sent.value
        counts: dict[tuple[int, ...], list[int]] = {}
        for batch in batches:
            for items, bad, good in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inside: list[tuple[tuple[int, ...], int]] = [((), 0)]
                for _ in range(size):
                    inside = [((*x, items[i]), i + 1) for x, at in inside for i in range(at, len(items)) if (*x, items[i]) in heads]
                for x, at in inside:
                    for t in items[at:]:
                        y = (*x, t)
                        if all(y[:i] + y[i + 1 :] in kept for i in range(size)):
                            held = counts.setdefault(y, [0, 0])
                            held[0], held[1] = held[0] + bad, held[1] + good
                    if len(counts) > 100_000:
                        yield batch_of(counts)
                        counts = {}
        yield batch_of(counts)

    return baskets.mapInArrow(task, "items array<int>, bad long, good long").groupBy("items").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def mine(labelled: DataFrame, url: str = "url", label: str = "bad", p: Mining = Mining()) -> list[tuple[frozenset, str, float, float]]:
    """(tokens, class, confidence, support) of the rules that pass, from rows whose label is 0 or 1 (null: left out).

    A rule goes when one with fewer of its tokens and the same class is at least as sure. Below ``rows`` labelled
    URLs there are no rules. Tokens too rare for any rule are left out of the URLs first, which changes no count. Sets
    then grow by a token at a time; those that no rule can come from are not grown: too rare ones, ones with as many URLs
    as a part of them (that part is as sure), and ones with URLs of one class alone (nothing is surer). Frequent sets are
    held on the driver; how many there are depends on support and on what URLs share, not on the number of rows.
    """
    sides = F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0)
    tagged = labelled.select(tokens_of(F.col(url)).alias("items"), sides.alias("bad")).filter("bad is not null and size(items) > 0")
    tagged = tagged.withColumn("good", 1 - F.col("bad"))
    count = tagged.count()
    fewest = max(p.rows, ceil(p.support * count - 1e-9))
    if count < p.rows:
        return []
    often = lambda df: df.filter(F.greatest("bad", "good") >= fewest)
    single = often(tagged.select(F.explode("items").alias("token"), "bad", "good").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))).collect()
    tokens = sorted(r.token for r in single)
    number = {t: i for i, t in enumerate(tokens)}
    sent = labelled.sparkSession.sparkContext.broadcast(number)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            items = [sorted(number[t] for t in ts if t in number) for ts in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.int32())), *batch.columns[1:]], names=["items", "bad", "good"])

    shorter = tagged.mapInArrow(task, "items array<int>, bad int, good int").filter("size(items) > 1")
    baskets = stored(shorter.groupBy("items").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "url-baskets")
    sets = {(number[r.token],): (r.bad, r.good) for r in single}
    level, size = dict(sets), 1
    while kept := {x for x, c in level.items() if min(c)}:
        level = {}
        for r in often(larger(baskets, kept, size)).collect():
            x = tuple(r["items"])
            if all(r.bad + r.good < sum(sets[x[:i] + x[i + 1 :]]) for i in range(size + 1)):
                level[x] = (r.bad, r.good)
        sets, size = sets | level, size + 1
    surest = {(x, side): n / sum(c) for x, c in sets.items() for side, n in zip((BAD, GOOD), c, strict=True) if n >= fewest and n / sum(c) >= p.confidence}
    rules = [
        (frozenset(tokens[i] for i in x), side, sure, sets[x][side == GOOD] / count)
        for (x, side), sure in surest.items()
        if not any(surest.get((x[:i] + x[i + 1 :], side), 0) >= sure for i in range(len(x)))
    ]
    return sorted(rules, key=lambda r: (len(r[0]), sorted(r[0]), r[1]))


def judge(df: DataFrame, mined: list, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """All columns of ``df`` with ``__host``, ``__path``, ``__rule``, ``__verdict`` (allow or block), ``__why``.

    A fitting domain rule decides. Else the surest mined rule whose tokens are all in the URL (then the one with more
    support, then by its tokens) blocks if its class is bad; without one the URL is allowed. Matching is by an inverted
    index: each token of a URL counts for the rules in its posting list, and a rule fires when all its tokens came.
    """
    ranked = sorted(mined, key=lambda r: (-r[2], -r[3], sorted(r[0]), r[1]))
    postings = defaultdict(list)
    for number, (tokens, *_) in enumerate(ranked):
        for token in tokens:
            postings[token].append(number)
    sent = df.sparkSession.sparkContext.broadcast((dict(postings), [len(r[0]) for r in ranked], [(r[1], " & ".join(sorted(r[0]))) for r in ranked]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sizes, what = sent.value
        for batch in batches:
            sides, why = [], []
            for tokens in batch.column(batch.num_columns - 1).to_pylist():
                counts: dict[int, int] = defaultdict(int)
                for token in tokens or ():
                    for number in index.get(token, ()):
                        counts[number] += 1
                first = min((n for n, c in counts.items() if c == sizes[n]), default=None)
                sides.append(None if first is None else what[first][0])
                why.append(None if first is None else what[first][1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sides, pa.string()), pa.array(why, pa.string())], names=[*names, "__side", "__why"])

    names = df.columns
    told = df.withColumn("__tokens", tokens_of(F.col(url))).mapInArrow(task, widened(df, "__side string, __why string"))
    told = told.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    told = told.withColumn("__fit", domain_rule(F.col("__host"), F.col("__path"), rules))
    verdict = F.coalesce(F.col("__fit.action"), F.when(F.col("__side") == BAD, "block").otherwise("allow"))
    return told.withColumns({"__rule": F.col("__fit.rule"), "__verdict": verdict}).drop("__fit", "__side")
