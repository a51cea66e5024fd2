"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import widened

BLANK = "▁"
#: Stretches a Python worker remembers; beyond, the memory is emptied and fills again with those in use.
REMEMBERED = 200_000
NEVER = float("-inf")
#: Characters of a stretch that is encoded side by side with others, and how many of them at once.
SHORT, SIDE_BY_SIDE = 64, 8192
#: Bits of a character's code in a trie edge; the id that stands for none. An unknown character's id is ``~code``.
CODE, NONE = 21, -(1 << 31)
#: Characters after which the paths are looked at for a boundary that they share.
COMMIT = 16
#: Blanks and what follows them up to the next blank.
STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: A piece's kind in the model file.
NORMAL, BYTE = 1, 6


class Remembered(dict):
    """Ids of short stretches met before; those of others are made by ``ids``."""

    def __init__(self, ids: Callable[[str], bytes]) -> None:
        self.ids = ids

    def __missing__(self, text: str) -> bytes:
        return self.ids(text)


class Vocabulary:
    """Pieces and scores of a model file: by text, and as a trie whose edges lie in one sorted array."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models that leave characters as they are can be decoded exactly")
        self.prefix = spec.add_dummy_prefix
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        usual = [p for p in proto.pieces if p.type == NORMAL]
        self.longest = max(len(p.piece) for p in usual)
        self.unknown = min(p.score for p in usual) - 10.0
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.grow()
        #: No piece goes from another character into a blank, so the paths always meet before such a blank.
        self.meets = all(BLANK not in p.piece.lstrip(BLANK) for p in usual)
        self.shown = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(BLANK, " ").encode() for p in proto.pieces]
        self.seen = Remembered(self.ids)

    def grow(self) -> None:
        """The trie: edge (node, character) → node, and the piece and score of every node. Node 0 is the root."""
        numbers = {"": 0}
        for p in self.pieces:
            for end in range(1, len(p) + 1):
                numbers.setdefault(p[:end], len(numbers))
        edges = sorted((numbers[p[:-1]] << CODE | ord(p[-1]), number) for p, number in numbers.items() if p)
        self.edge, self.below = (np.array(c, dtype=np.int64) for c in zip(*edges))
        told = [self.pieces.get(p, (~ord(p), self.unknown) if len(p) == 1 else (NONE, NEVER)) for p in numbers]
        self.piece, self.gain = np.array([i for i, _ in told], dtype=np.int32), np.array([g for _, g in told])

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def stream(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(end, ids) of stretches of ``text`` in order: the best segmentation by summed scores, committed as it is sure.

        Only states no further back than the longest piece can be reached by a later piece. They are the window: each
        holds its score and the ids since the last commit, and whenever all of them share a boundary on their paths,
        what lies before it is committed and dropped. An unknown character costs ``unknown`` and is spelled in bytes.
        Ties go to the longer last piece.
        """
        n, done, pieces, stranger = len(text), 0, self.pieces, (NONE, self.unknown)
        #: By place since the last commit: best score, and where the last step of the best path starts.
        score, start = [0.0], [0]
        for low in range(0, n, COMMIT):
            high = min(low + COMMIT, n)
            room = high + self.longest + 1 - done - len(score)
            score += [NEVER] * room
            start += [0] * room
            for at in range(low, high):
                here = at - done
                for end in range(at + 1, min(at + self.longest, n) + 1):
                    found = pieces.get(text[at:end]) or (stranger if end == at + 1 else None)
                    if found and score[here] + found[1] > score[end - done]:
                        score[end - done], start[end - done] = score[here] + found[1], here
            meet = self.common([e for e in range(high - done, len(score)) if score[e] > NEVER], start) if high < n else n - done
            if meet:
                yield done + meet, self.path(text[done : done + meet], start)
                done += meet
                del score[:meet]
                start = [s - meet for s in start[meet:]]

    def path(self, text: str, start: list[int]) -> list[int]:
        """Ids of the best path over ``text``, which begins at the last commit."""
        ids: list[int] = []
        end = len(text)
        while end:
            low = start[end]
            found = self.pieces.get(text[low:end])
            ids += [found[0]] if found else reversed(self.spell(text[low:end]))
            end = low
        ids.reverse()
        return ids

    @staticmethod
    def common(alive: list[int], start: list[int]) -> int:
        """The last boundary that the paths of all living states share: the highest one steps back until all are equal."""
        states = set(alive)
        while len(states) > 1:
            top = max(states)
            states.remove(top)
            states.add(start[top])
        return states.pop()

    def ids(self, text: str) -> bytes:
        ids = [i for _, part in self.stream(text) for i in part]
        return pack(f"<{len(ids)}I", *ids)

    def short(self, stretches: list[str]) -> Iterator[bytes]:
        """Ids of stretches of at most ``SHORT`` characters, which go through the same search side by side: one array
        operation makes one step of all of them. Their ends are where all their paths meet."""
        lengths = np.array([len(s) for s in stretches])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        most, count = int(lengths[0]), len(stretches)
        chars = np.zeros((count, most), dtype=np.int64)
        chars[np.arange(most) < lengths[:, None]] = np.frombuffer("".join(stretches[i] for i in order).encode("utf-32-le"), dtype="<u4")
        chars = np.ascontiguousarray(chars.T)
        longer = [int((lengths > at).sum()) for at in range(most)]
        score = np.full((most + 1, count), NEVER)
        score[0] = 0.0
        start, last = np.zeros((most + 1, count), dtype=np.int64), np.full((most + 1, count), NONE, dtype=np.int32)
        for at in range(most):
            rows, node = np.arange(longer[at]), np.zeros(longer[at], dtype=np.int64)
            for end in range(at + 1, min(at + self.longest, most) + 1):
                fit = int(np.searchsorted(rows, longer[end - 1]))
                rows, key = rows[:fit], node[:fit] << CODE | chars[end - 1, rows[:fit]]
                place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                known = self.edge[place] == key
                if end == at + 1:
                    strange = rows[~known]
                    strange = strange[score[at, strange] + self.unknown > score[end, strange]]
                    score[end, strange], start[end, strange], last[end, strange] = score[at, strange] + self.unknown, at, ~chars[at, strange]
                rows, node = rows[known], self.below[place[known]]
                if not len(rows):
                    break
                sums = score[at, rows] + self.gain[node]
                better = sums > score[end, rows]
                won = rows[better]
                score[end, won], start[end, won], last[end, won] = sums[better], at, self.piece[node[better]]
        ids = np.full((count, most), NONE, dtype=np.int32)
        rows, ends, step = np.arange(count), lengths, most
        while len(rows):
            step -= 1
            ids[rows, step] = last[ends, rows]
            ends = start[ends, rows]
            rows, ends = rows[ends > 0], ends[ends > 0]
        used = ids != NONE
        strange = ((ids < 0) & used).any(axis=1)
        blob, limits = ids[used].astype("<u4").tobytes(), 4 * np.cumsum([0, *used.sum(axis=1)])
        place = np.argsort(order)
        for i in place.tolist():
            if strange[i]:
                told = [x for id in ids[i][used[i]].tolist() for x in ([id] if id >= 0 else self.spell(chr(~id)))]
                yield pack(f"<{len(told)}I", *told)
            else:
                yield blob[limits[i] : limits[i + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit bytes. Where no piece crosses a boundary between a blank and
        what comes before it, the paths meet there, so the stretches between such boundaries are encoded, and remembered,
        alone; those longer than ``SHORT`` go through ``stream``."""
        plain = [(BLANK if self.prefix else "") + t.replace(" ", BLANK) if t else "" for t in texts]
        if not self.meets:
            return [self.ids(p) for p in plain]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        cut = [STRETCH.findall(p) for p in plain]
        fresh = [s for s in set().union(*cut).difference(self.seen) if len(s) <= SHORT]
        for low in range(0, len(fresh), SIDE_BY_SIDE):
            block = fresh[low : low + SIDE_BY_SIDE]
            self.seen.update(zip(block, self.short(block)))
        return [b"".join(map(self.seen.__getitem__, parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ``ids``. Runs of byte pieces become characters again; blanks become spaces."""
        text = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text else text


@lru_cache(maxsize=1)
def loaded(model_path: str) -> Vocabulary:
    """The vocabulary of this Python worker: read once, with the stretches it remembers, for all tasks it serves."""
    return Vocabulary(model_path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that only these rows' texts and ids are Python objects at one time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def encoded(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns but ``text``, with ``ids`` (array of int). Null and empty texts have no ids.

    A blank character U+2581 of a text is the vocabulary's own space and decodes to a space; all else comes back.
    """
    kept = [c for c in df.columns if c != text]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(model_path)
        for part in slices(batches):
            ids = vocabulary.encode([t or "" for t in part.column(0).to_pylist()])
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends), values)], names=[*kept, "ids"])

    return df.select(text, *kept).mapInArrow(task, widened(df.select(*kept), "ids array<int>"))


def decoded(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """All columns but ``ids``, with ``text``, and the ids' number and CRC-32 (unsigned, of little-endian 32-bit ids)."""
    kept = [c for c in df.columns if c != ids]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(model_path)
        for batch in slices(batches):
            column = batch.column(0)
            raw = [column[i].values.to_numpy().astype("<u4").tobytes() if column[i].is_valid else b"" for i in range(batch.num_rows)]
            added = [pa.array([vocabulary.decode(r) for r in raw]), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], names=[*kept, "text", "n_ids", "ids_crc32"])

    schema = widened(df.select(*kept), "text string, n_ids long, ids_crc32 long")
    return df.select(ids, *kept).mapInArrow(task, schema)
