"""Cross-tokenizer alignment: common token ends by galloping intersection, overlap ranges by rank differences."""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ROW
from tickloom.llm.tokens import _WIDE, BytePairs
from tickloom.session import stored

BLANK = "▁"
#: Stretches a task remembers; beyond, those in use since the last such change are kept.
REMEMBERED = 150_000
#: Bytes of texts that are aligned in one go.
AT_ONCE = 1 << 21
#: Most id pairs whose counts are sent to every task; the counts of all others are joined by shuffle.
COMMON = 200_000
#: A blank after anything but white space or the blank mark: neither vocabulary has a token across it.
_CUT = re.compile("(?<=[^ \t\n\r\x0b\x0c▁])(?= )")


def galloping(short: list[int], long: list[int]) -> list[tuple[int, int]]:
    """Ranks (i, j) of the values in both ascending lists. Each value of ``short`` doubles its step through ``long``
    from where the last one ended, and is then searched by halving within the last step."""
    out, low, n = [], 0, len(long)
    for i, value in enumerate(short):
        if low < n and long[low] < value:
            step, high = 1, low + 1
            while high < n and long[high] < value:
                low, step = high, 2 * step
                high += step
            low = bisect_left(long, value, low + 1, min(high, n))
        if low == n:
            break
        if long[low] == value:
            out.append((i, low))
    return out


def common_ranks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranks of the common ends of two tokenisations; the shorter list drives."""
    return galloping(a, b) if len(a) <= len(b) else [(i, j) for j, i in galloping(b, a)]


def overlaps(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, first, last): token i of the ends ``a`` overlaps the tokens first … last - 1 of the ends ``b``."""
    start = 0
    for i, end in enumerate(a):
        if end > start:
            yield i, bisect_right(b, start), bisect_left(b, end) + 1
        start = end


#: A text or a stretch of it: tokens of A, tokens of B, groups, the groups as text, and a * 2^32 + b of every link as bytes.
Aligned = tuple[int, int, int, str, bytes]
NOTHING: Aligned = (0, 0, 0, "", b"")


def aligned(a: list[int], a_bytes: list[bytes], b: list[int], b_bytes: list[bytes]) -> Aligned:
    """Groups between common ends, and all pairs of overlapping tokens, which lie inside one group. Both byte lists make
    the same text."""
    a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
    groups, links, i, j = [], [], 0, 0
    for x, y in common_ranks(a_ends, b_ends):
        if x == i and y == j:
            groups.append(f"{a[i]}|{b[j]}")
            links.append(a[i] << 32 | b[j])
        else:
            of_a, of_b = a[i : x + 1], b[j : y + 1]
            groups.append(f"{','.join(map(str, of_a))}|{','.join(map(str, of_b))}")
            if x == i or y == j:  # one token over all of the others
                links += [p << 32 | q for p in of_a for q in of_b]
            else:
                start = a_ends[i - 1] if i else 0
                inside = overlaps([e - start for e in a_ends[i : x + 1]], [e - start for e in b_ends[j : y + 1]])
                links += [of_a[k] << 32 | q for k, first, last in inside for q in of_b[first:last]]
        i, j = x + 1, y + 1
    return len(a), len(b), len(groups), ";".join(groups), array("q", links).tobytes()


def byte_level() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Aligns texts of two vocabularies: byte-level pairs (A, of a blank and the text) and pieces (B, which put the
    blank there themselves). Stretches between blanks are aligned once and remembered."""

    def __init__(self, byte_pairs: tuple[str, str, str], model: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = BytePairs(*byte_pairs)
        self.a.special = []  # their strings are plain text here
        alphabet = byte_level()
        self.a_bytes = {i: bytes(alphabet[c] for c in p) for p, i in Tokenizer.from_file(byte_pairs[0]).get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in p)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.cuts = not any(" " in p or BLANK in p.lstrip(BLANK) for p in names)
        self.known: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def learn(self, stretches: set[str]) -> None:
        """Align the stretches that are not known yet; those known from before the last change of memory are kept."""
        new = []
        for s in stretches:
            if s not in self.known:
                if s in self.older:
                    self.known[s] = self.older[s]
                else:
                    new.append(s)
        ids = iter(self.b.encode([s[1:] for s in new if len(s) > 1]))
        for s in new:
            a, b = self.a.core.encode_ordinary(s), next(ids) if len(s) > 1 else [self.b.piece_to_id(BLANK)]
            a_bytes, b_bytes, plain = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b], s.encode()
            self.known[s] = aligned(a, a_bytes, b, b_bytes) if b"".join(a_bytes) == plain == b"".join(b_bytes) else None

    def texts(self, texts: list[str | None]) -> Iterator[Aligned]:
        """The alignment of each text, in order."""
        split = [self.stretches(t) for t in texts]
        self.learn({s for stretches in split for s in stretches})
        for stretches in split:
            parts = [self.known[s] for s in stretches]
            if not parts or None in parts:
                yield NOTHING
            else:
                a, b, n, groups, links = zip(*parts, strict=True)
                yield sum(a), sum(b), sum(n), ";".join(groups), b"".join(links)
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}

    def stretches(self, text: str | None) -> list[str]:
        if not text or BLANK in text:
            return []
        whole = " " + text
        return _CUT.split(whole) if self.cuts and not _WIDE.search(whole) else [whole]  # such white space ends no chunk


@lru_cache(maxsize=1)
def aligner_of(byte_pairs: tuple[str, str, str], model: str) -> Aligner:
    """One aligner per Python worker, whose memory serves task after task."""
    return Aligner(byte_pairs, model)


def alignments(df: DataFrame, id: str, text: str, byte_pairs: tuple[str, str, str], model: str) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row per text, with its distinct id pairs
    and how often each is linked."""
    kinds = pa.schema([
        (ROW, pa.int64()), (id, pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(byte_pairs, model)
        for batch in batches:
            ids, texts = [batch.column(k).to_pylist() for k in range(2)], batch.column(2)
            sizes = np.cumsum([0, *(n or 0 for n in pc.binary_length(texts).to_pylist())])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + AT_ONCE, side="right")) - 1)
                found = list(aligner.texts(texts.slice(start, end - start).to_pylist()))
                links = [np.unique(np.frombuffer(raw, dtype=np.int64), return_counts=True) for *_, raw in found]
                borders = np.cumsum([0, *(len(p) for p, _ in links)]).astype(np.int32)
                columns = [
                    pa.array(ids[0][start:end], pa.int64()), pa.array(ids[1][start:end], pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)),
                    pa.array([len(f[4]) // 8 for f in found], pa.int64()), pa.array([hashlib.sha256(f[3].encode()).hexdigest() if f[0] else "" for f in found], pa.string()),
                    *(pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate([v[k] for v in links]), t)) for k, t in ((0, pa.int64()), (1, pa.int32()))),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
                start = end

    source = df.select(F.monotonically_increasing_id().alias(ROW), F.col(id).cast("long").alias(id), F.col(text).alias("__text__"))
    schema = f"`{ROW}` long, `{id}` long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return stored(source.mapInArrow(task, schema), "aligned")


def pair_counts(told: DataFrame) -> DataFrame:
    """(pair, held, best): in how many texts each id pair is linked, and whether no pair of its A id is linked in more.

    Each batch adds its own pairs up before the shuffle.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, held = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(held.astype(np.int64))], names=["pair", "held"])

    counts = told.select("pairs").mapInArrow(task, "pair long, held long").groupBy("pair").agg(F.sum("held").alias("held"))
    a_id = F.shiftright("pair", 32)
    most = F.max("held").over(Window.partitionBy(a_id))
    return stored(counts.withColumn("most", most).select("pair", "held", (F.col("held") == F.col("most")).alias("best")), "aligned-pairs")


def align(df: DataFrame, byte_pairs: tuple[str, str, str], model: str, id: str = "doc_id", text: str = "text", common: int = COMMON) -> DataFrame:
    """One row per row of ``df``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A's tokens of a blank and the text, and B's tokens of the text, are cut into groups where tokens of both end.
    ``n_links`` counts the pairs of overlapping tokens, ``count_sum`` adds for each how many texts hold its id pair
    linked, ``n_best`` counts links whose pair is held by as many texts as any pair of its A id. Texts that are null,
    empty or not given back byte by byte by both vocabularies have no tokens: zeros and an empty digest. Repeated rows
    count as texts of their own and repeat in the result; a null id is kept as null. Other columns are not looked at.
    An empty table gives an empty result.

    The ``common`` most frequent pairs are looked up in a table sent to every task (at most that many rows of 24
    bytes); a text's other pairs are joined with their counts by shuffle, so every link is counted.
    """
    told = alignments(df, id, text, byte_pairs, model)
    counts = pair_counts(told)
    known = counts.orderBy(F.desc("held"), "pair").limit(common).toArrow()
    codes = known["pair"].to_numpy()
    order = np.argsort(codes)
    codes, held, best = codes[order], known["held"].to_numpy()[order], known["best"].to_numpy()[order].astype(np.int64)
    table = df.sparkSession.sparkContext.broadcast((codes, held, best))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, best = table.value
        for batch in batches:
            pairs, times = (batch.column(k) for k in (1, 2))
            sizes = pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(codes, flat), max(len(codes) - 1, 0))
            hit = codes[at] == flat if len(codes) else np.zeros(len(flat), dtype=bool)
            total, chosen = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(total, owner[hit], held[at[hit]] * weight[hit])
            np.add.at(chosen, owner[hit], best[at[hit]] * weight[hit])
            borders = np.searchsorted(owner[~hit], np.arange(batch.num_rows + 1)).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(borders), pa.array(v[~hit])) for v in (flat, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(chosen), *rest], names=["row", "total", "chosen", "pairs", "times"])

    looked = stored(told.select(ROW, "pairs", "times").mapInArrow(task, "row long, total long, chosen long, pairs array<long>, times array<long>"), "aligned-counted")
    rest = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    further = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("held") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_chosen"))
    sums = looked.select("row", "total", "chosen").join(further, "row", "left")
    sums = sums.select(F.col("row").alias(ROW), (F.col("chosen") + F.coalesce("more_chosen", F.lit(0))).alias("n_best"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("count_sum"))
    return told.select(ROW, id, "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, ROW).select(id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
