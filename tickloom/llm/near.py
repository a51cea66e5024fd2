"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bytes_of, mix, widened, word_runs
from tickloom.llm.graph import components
from tickloom.session import stored

_STEP = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)


@dataclass(frozen=True)
class Near:
    """``words`` a shingle, ``percent`` similarity at least, ``bands`` of ``rows`` bins.

    At a Jaccard similarity of exactly 0.75 a pair shares no band with probability (1 - 0.75^5)^40 = 2e-5, and above
    it less. ``block``: members of a bucket that meet as many others in one task, where a star did not settle it.
    ``rounds``: how often every text first meets one centre only, before the stars that are still open meet in full. ``split``: members that are compared with a centre in one go.
    """

    words: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    block: int = 256
    rounds: int = 2
    split: int = 2000


def shingle_runs(words: np.ndarray, borders: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text its distinct 64-bit shingle hashes in ascending order; a text of fewer words than a shingle makes one
    of all its words, a text without words none."""

    def hashed(parts: list[np.ndarray]) -> np.ndarray:
        total = reduce(lambda a, b: a + b, (w * np.uint64(_STEP[k % len(_STEP)] + 2 * (k // len(_STEP))) for k, w in enumerate(parts)))
        return mix(total + np.uint64(len(parts)))

    last = len(words) - size + 1
    whole = hashed([words[k : last + k] for k in range(size)]) if last > 0 else words[:0]
    out = []
    for low, high in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if high - low >= size:
            found = np.sort(whole[low : high - size + 1])
            found = found[np.append(True, found[1:] != found[:-1])]
        else:
            found = hashed([words[k : k + 1] for k in range(low, high)]) if high > low else words[:0]
        out.append(found)
    return out


class Shared:
    """How many shingles a text shares with each text of a small group, by an inverted index of the group."""

    def __init__(self, texts: pa.ChunkedArray, size: int) -> None:
        each = [h for _, words, b in word_runs(texts) for h in shingle_runs(words, b, size)]
        self.ends = np.cumsum([0, *map(len, each)])
        _, self.number = np.unique(np.concatenate(each), return_inverse=True)
        order = np.argsort(self.number, kind="stable")
        self.owner = np.repeat(np.arange(len(each)), np.diff(self.ends))[order]
        self.count = np.bincount(self.number)
        self.start = np.cumsum(self.count) - self.count

    def with_all(self, i: int) -> np.ndarray:
        mine = self.number[self.ends[i] : self.ends[i + 1]]
        count = self.count[mine]
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.bincount(self.owner[np.repeat(self.start[mine], count) + steps], minlength=len(self.ends) - 1)


class Sketcher:
    """Bins of one permutation, filled up by optimal densification: an empty bin takes the value of the first full bin
    in a random order of its own, which is the same order for every text."""

    def __init__(self, p: Near) -> None:
        self.p, self.bins = p, p.bands * p.rows
        rng = np.random.default_rng(20240229)
        self.asks = np.argsort(rng.random((self.bins, self.bins)), axis=1)  # asks[b][t]: the bin that b asks in try t
        self.place = np.argsort(self.asks, axis=1).astype(np.int16)  # place[b][c]: in which try b asks c
        self.weights = mix(np.arange(1, p.rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.band = mix(np.arange(1000, 1000 + p.bands, dtype=np.uint64))

    def fill(self, hashes: np.ndarray) -> np.ndarray:
        """All bins for the sorted distinct shingle hashes of a text."""
        at = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))  # hashes ascend, so a bin's first is its least
        full = at[first]
        bins = np.zeros(self.bins, dtype=np.uint64)
        bins[full] = hashes[first]
        held = np.zeros(self.bins, dtype=bool)
        held[full] = True
        empty = np.flatnonzero(~held)
        if len(full) < 24:
            bins[empty] = bins[full[self.place[np.ix_(empty, full)].argmin(axis=1)]]
            return bins
        source, waiting, t = np.arange(self.bins), empty, 0
        while len(waiting):
            asked = self.asks[waiting, t]
            hit = held[asked]
            source[waiting[hit]] = asked[hit]
            waiting, t = waiting[~hit], t + 1
        return bins[source]

    def keys(self, bins: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        return mix((bins.reshape(self.p.bands, self.p.rows) * self.weights).sum(axis=1, dtype=np.uint64) + self.band)


def class_of(raw: np.ndarray) -> bytes:
    """A 128-bit digest of the words in the bytes of a text."""
    return hashlib.blake2b(b" ".join(raw.tobytes().lower().split()), digest_size=16).digest()


def sketches(df: DataFrame, p: Near) -> DataFrame:
    """(id, text) → (id, shingles, class, bands). ``class`` is a 128-bit digest of the words, null without words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(p)
        for batch in batches:
            count = np.zeros(batch.num_rows, dtype=np.int32)
            keys, classes = [None] * batch.num_rows, [None] * batch.num_rows
            raw, offsets = bytes_of(batch.column(1))
            for first, words, b in word_runs(batch.column(1)):
                for row, hashes in enumerate(shingle_runs(words, b, p.words), first):
                    if len(hashes):
                        count[row], keys[row] = len(hashes), sketcher.keys(sketcher.fill(hashes)).view(np.int64)
                        classes[row] = class_of(raw[offsets[row] : offsets[row + 1]])
            columns = [batch.column(0), pa.array(count), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shingles", "class", "bands"])

    return df.mapInArrow(task, "id long, shingles int, class binary, bands array<long>")


def classed(df: DataFrame, text: str = "text", name: str = "class") -> DataFrame:
    """``df`` with the class of each text, as ``sketches`` tells it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column(batch.schema.get_field_index(text)))
            found = [class_of(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, name])

    return df.mapInArrow(task, widened(df, f"`{name}` binary"))


def shingle_set(text: str, size: int) -> set:
    """The shingles themselves: every comparison that decides a link is made on them."""
    words = text.encode().lower().split()
    size = min(size, len(words))
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if size else set()


def confirmed(pairs: DataFrame, texts: DataFrame, p: Near) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets are similar enough.

    The texts of all b that meet one a travel once each, and that of a once for every ``split`` of them; they meet in
    order, so a task holds one shingle set at a time and a centre with very many members is many tasks.
    """
    held = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / p.split).cast("int").alias("parts")).filter("parts > 1")
    dealt = pairs.join(held, "a", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int"))
    members = dealt.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("kind"), "b")
    centres = dealt.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("kind"), F.col("a").alias("b")).distinct()
    asked = stored(members.unionAll(centres), "near-asked")  # its size is known, so Spark moves it and not the texts while it is small
    met = asked.join(texts, "id").select("a", "part", "kind", "b", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: set = set()
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            kinds, texts = batch.column(2).to_pylist(), batch.column(4)
            for i, kind in enumerate(kinds):
                other = shingle_set(texts[i].as_py(), p.words)
                if kind == 0:
                    centre = other
                else:
                    both = len(centre & other)
                    keep[i] = 100 * both >= p.percent * (len(centre) + len(other) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(3).filter(mask)], names=["a", "b"])

    return met.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(task, "a long, b long")


def star_pairs(active: DataFrame, groups: DataFrame, p: Near) -> DataFrame:
    """(a, b) of each bucket's smallest id and its other members whose set sizes allow the similarity and whose
    component is not the centre's. Repeats once for every bucket that two texts share."""
    labelled = active.join(groups.withColumnRenamed("component", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    centres = labelled.groupBy("bucket").agg(F.min(F.struct("id", "shingles", "group")).alias("c"))
    met = labelled.join(centres, "bucket").filter(F.col("group") != F.col("c.group"))
    least, most = F.least("shingles", "c.shingles"), F.greatest("shingles", "c.shingles")
    return met.filter(100 * least >= p.percent * most).select(F.col("c.id").alias("a"), F.col("id").alias("b"))


def rest_pairs(active: DataFrame, groups: DataFrame, texts: DataFrame, p: Near) -> DataFrame:
    """Distinct (a < b) that the stars left open: pairs of one bucket whose members are in different components.

    A bucket of one component is settled, and so is its smallest id, which met every member. The others of an open
    bucket are dealt to blocks by a hash, and each pair of blocks meets in one group of at most about ``2 * block``
    rows. There all pairs of different components whose set sizes allow the similarity are compared by their shingle
    hashes in place. A group emits a spanning forest of the links that it finds, so fewer pairs than it has rows.
    """
    labelled = active.join(groups.withColumnRenamed("component", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    spread = labelled.groupBy("bucket").agg(F.min("id").alias("centre"), F.min("group").alias("least"), F.max("group").alias("most"), F.count(F.lit(1)).alias("held"))
    spread = spread.filter("least <> most and held > 2").select("bucket", "centre", "held")
    left = labelled.join(spread, "bucket").filter("id <> centre")
    blocks = F.ceil(F.col("held") / p.block).cast("int")
    dealt = left.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "shingles", "group")
    whole = stored(dealt, "near-dealt").join(texts, "id")

    def compare(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, group, own = (rows[c].to_numpy() for c in ("id", "shingles", "group", "own"))
        x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        shared, root, out = None, np.arange(len(ids)), []
        for i in left.tolist():
            others = right[right > i] if x == y else right
            least, most = np.minimum(sizes[i], sizes[others]).astype(np.int64), np.maximum(sizes[i], sizes[others]).astype(np.int64)
            fits = (group[others] != group[i]) & (root[others] != root[i]) & (100 * least >= p.percent * most)
            others = others[fits]
            if len(others):
                shared = shared or Shared(rows["text"], p.words)
                both = shared.with_all(i)[others]
                for k in others[100 * both >= p.percent * (sizes[i].astype(np.int64) + sizes[others] - both)].tolist():
                    if root[k] != root[i]:
                        out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                        root[root == root[k]] = root[i]
        found = np.array(out, dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of the group that has not ended
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.column_stack([held[c].to_numpy() for c in ("bucket", "x", "y")])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in compare(held.slice(start, end - start).combine_chunks())], names=["a", "b"])
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in compare(held.combine_chunks())], names=["a", "b"])

    met = whole.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return met.mapInArrow(task, "a long, b long").filter("a <> b").distinct()


def near_links(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], p: Near) -> DataFrame:
    """Confirmed links (a, b) between classes that share a band; inside a component that the stars found, only the
    stars' own links. ``texts_of`` gives (id, text) of the ids it is handed.

    Each bucket is a star around its smallest id. In the first rounds every text meets one centre alone, the smallest
    that it has not met and is not joined to, so a large group of copies costs as many pairs as it has members.
    Then the stars that are still open meet in full, and what they leave open is compared by ``rest_pairs``. A pair is
    lost only if it shares no band: see ``Near``.
    """
    banded = classes.select("id", "shingles", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("bucket")
    active = stored(banded.join(shared, "bucket"), "near-buckets")
    texts = stored(texts_of(active.select("id").distinct()), "near-texts")
    groups = classes.select("id", F.col("id").alias("component")).limit(0)
    met, links = None, None
    for number in range(p.rounds + 1):
        open_pairs = star_pairs(active, groups, p)
        if met is not None:
            open_pairs = open_pairs.join(met, ["a", "b"], "left_anti")
        if number < p.rounds:
            open_pairs = open_pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        pairs = stored(open_pairs.distinct(), "near-pairs")
        found = stored(confirmed(pairs, texts, p), "near-links")
        met, links = pairs if met is None else met.union(pairs), found if links is None else links.union(found)
        groups = components(links)
    further = stored(rest_pairs(active, groups, texts, p), "near-pairs")
    return links.union(stored(confirmed(further, texts, p), "near-links"))


def near_rows(df: DataFrame, id: str = "doc_id", text: str = "text", p: Near = Near()) -> DataFrame:
    """One row per row of ``df``: id, shingles, class, component. See ``near_duplicates``."""
    source = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    drawn = stored(sketches(source, p), "near-sketches")
    known = drawn.filter("class is not null and id is not null")
    members = stored(known.groupBy("class").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "near-classes")
    whole = known.join(members, (known["class"] == members["class"]) & (known["id"] == members["rep"])).select("node", "shingles", "bands")
    single = whole.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()  # no row is repeated
    classes = (whole if single else whole.dropDuplicates(["node"])).withColumnRenamed("node", "id")

    def texts_of(nodes: DataFrame) -> DataFrame:
        asked = stored(members.join(nodes.withColumnRenamed("id", "node"), "node", "left_semi"), "near-asked")
        told = classed(source.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
        found = told.join(asked, "class").filter("id = rep").select(F.col("node").alias("id"), "text")
        return found if single else found.dropDuplicates(["id"])

    groups = components(near_links(classes, texts_of, p))
    joined = members.join(groups, members["node"] == groups["id"]).select("class", "rep", "component")
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    named = members.join(joined.join(least, "component").select("class", "least"), "class", "left").select("class", F.coalesce("least", "rep").alias("named"))
    placed = drawn.select("id", "shingles", "class").join(named, "class", "left")
    return placed.select("id", "shingles", "class", F.when(F.col("id").isNotNull(), F.coalesce("named", "id")).alias("component"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", p: Near = Near()) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    Texts are linked when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of word shingles; a component's id is the
    smallest id in it. Null, empty and blank texts have no shingles and are linked with nothing. Equal word sequences
    form a class, the node of the graph: copies are counted in, never paired with each other. A row with a null id has
    a null component and is kept; a repeated row repeats in the result, and the texts of an id with several texts are
    joined and kept each for itself. Other columns are not looked at. Empty tables give an empty result.
    """
    rows = near_rows(df, id, text, p)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return rows.select(F.col("id").alias(id), F.col("shingles").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def kept_rows(df: DataFrame, id: str = "doc_id", text: str = "text", p: Near = Near()) -> DataFrame:
    """The rows of ``df`` that ``near_duplicates`` keeps, with all their columns. Where an id stands for several texts,
    only the rows of its dropped texts go."""
    rows = stored(near_rows(df, id, text, p), "near-rows")
    gone = stored(rows.filter("id <> component").select("id", "class").distinct(), "near-gone")  # its size is known to the joins below
    mixed = rows.join(gone.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("some")).filter("some").select("id")
    mixed, name, word = stored(mixed, "near-mixed"), "__near_id__", "__near_class__"
    plain = df.join(gone.select(F.col("id").alias(name)), F.col(id) == F.col(name), "left_anti")
    several = classed(df.join(mixed.withColumnRenamed("id", name), F.col(id) == F.col(name), "left_semi"), text, word)
    apart = several.join(gone.select(F.col("id").alias(name), F.col("class").alias("__gone__")), (F.col(id) == F.col(name)) & (F.col(word) == F.col("__gone__")), "left_anti")
    return plain.unionByName(apart.drop(word))
