"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import mix, widened, word_runs

_BIGRAM, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner. ``sample`` bounds the labelled rows that are learned from: it is the documented
    bound of the fit, the same at every size of input, and keeps the one learning task small."""

    bits: int = 20
    sample: int = 12_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.1
    #: Weight of a row with label 1, which is the rare one.
    positive: float = 6.0


def grams(words: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the text each belongs to: words, pairs of neighbours, and pairs that skip one word."""
    near, far = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    hashes = [words, mix(words[:-1][near] * _BIGRAM ^ words[1:][near]), mix(words[:-2][far] * _SKIP ^ words[2:][far])]
    return (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([owner, owner[:-1][near], owner[:-2][far]])


def owners(borders: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(borders) - 1), np.diff(borders))


def logits(words: np.ndarray, borders: np.ndarray, dense: np.ndarray, bits: int) -> np.ndarray:
    """Sum of the weights of each text's distinct features."""
    f, owner = grams(words, owners(borders), bits)
    hit = dense[f] != 0
    pairs = np.unique(owner[hit] << bits | f[hit])
    return np.bincount(pairs >> bits, weights=dense[pairs & ((1 << bits) - 1)], minlength=len(borders) - 1)


def learn(texts: pa.Array, labels: np.ndarray, p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers and weights that are not zero, and the intercept."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    zb = nb = 0.0
    rows = []
    for _, words, b in word_runs(texts):
        f, owner = grams(words, owners(b), p.bits)
        pairs = np.unique(owner << p.bits | f)
        rows += np.split(pairs & ((1 << p.bits) - 1), np.searchsorted(pairs >> p.bits, np.arange(1, len(b) - 1)))
    for _ in range(p.epochs):
        for f, y in zip(rows, labels, strict=True):
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= p.l1, 0.0, (np.sign(zf) * p.l1 - zf) / ((p.beta + np.sqrt(nf)) / p.alpha + p.l2))
            wb = -zb / ((p.beta + np.sqrt(nb)) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -30, 30))) - y
            g *= p.positive if y else 1.0
            z[f] += g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / p.alpha * w
            n[f] = nf + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * wb
            nb += g * g
    held = np.flatnonzero(np.abs(z) > p.l1)
    weights = (np.sign(z[held]) * p.l1 - z[held]) / ((p.beta + np.sqrt(n[held])) / p.alpha + p.l2)
    return held, weights, float(-zb / ((p.beta + np.sqrt(nb)) / p.alpha))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", order: Column | None = None, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights from the ``p.sample`` labelled rows that come first by ``order`` (an evenly spread
    64-bit hash; default of the text).

    Rows without a label are left out; null texts are empty. Without any row the weights are empty and every score is
    0.5 at most. At most ``2^bits`` weights reach the driver, whatever the input: they are broadcast afterwards.
    """
    order = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if order is None else order
    known = labelled.filter(F.col(label).isNotNull()).select(order.alias("o"), F.col(text).alias("t"), F.col(label).cast("double").alias("y"))
    share = 1.2 * (p.sample + 100) / max(1, known.select("y").count())
    if share < 1:  # of evenly spread hashes the first ones are below this; only they are gathered and sorted
        known = known.filter(F.col("o") < int(share * 2**64) - 2**63)
    chosen = known.orderBy("o", "t", "y").limit(p.sample)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), pa.schema([("t", pa.string()), ("y", pa.float64())]))
        held, weights, intercept = learn(whole["t"].combine_chunks(), whole["y"].to_numpy(), p)
        yield pa.RecordBatch.from_pydict({"f": np.append(held, -1), "w": np.append(weights, intercept)})

    rows = chosen.select("t", "y").coalesce(1).mapInArrow(task, "f long, w double").toPandas().sort_values("f")
    held, weights = rows["f"].to_numpy(), rows["w"].to_numpy()
    if not len(held):
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
    return held[1:], weights[1:], float(weights[0])


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", name: str = "score", p: Ftrl = Ftrl()) -> DataFrame:
    """``df`` with the column ``name``: the probability of label 1 for the whole text; null and empty texts get the
    intercept's. Only the text is looked at; all columns of ``df`` stay, whatever their names."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights, intercept = sent.value
        dense = np.zeros(1 << p.bits)
        dense[held] = weights
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, words, b in word_runs(batch.column(names.index(text))):
                out[first : first + len(b) - 1] = logits(words, b, dense, p.bits) + intercept
            scores = pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, name])

    names = df.columns
    return df.mapInArrow(task, widened(df, f"{name} double"))
