"""Word hashing over Arrow text columns, text normalisation and row numbering shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name of the internal row number; chosen so that it cannot clash with a table's own columns.
ROW = "__llm_row__"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection of 64-bit values that spreads every bit."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random-looking 64-bit value per byte, after lower-casing A-Z only; white space counts nothing.
_BYTE = mix(np.arange(256, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(1 << 12)


def hash_words(raw: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of ``raw`` (UTF-8 bytes), and how many words start before each of ``limits``.

    A word is a run of bytes other than space, tab, line feed, vertical tab, form feed, carriage return;
    ``limits`` are ascending byte offsets at which a word ends in any case (borders of texts). A-Z count as a-z.
    """
    global _POWERS
    black = ~_SPACE[raw]
    first = black.copy()
    first[1:] &= ~black[:-1]
    inner = limits[(limits > 0) & (limits < len(raw))]
    first[inner] = black[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(limits), dtype=np.int64)
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    while int(lengths.max()) > len(_POWERS):
        _POWERS = powers(2 * len(_POWERS))
    weighed = _BYTE[raw[starts[0] :]] * _POWERS[place]
    return mix(np.add.reduceat(weighed, starts - starts[0])), np.searchsorted(starts, limits)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and each row's offsets in them; null is empty. No copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def word_runs(column: pa.Array, at_once: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, borders) for runs of rows: row first+i has hashes[borders[i]:borders[i+1]].

    About ``at_once`` bytes are expanded at a time, so temporary arrays stay small; a longer text is hashed in
    stretches cut at white space, and only its 8-byte word hashes are kept.
    """
    raw, offsets = bytes_of(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + at_once, side="right")) - 1)
        low, high = int(offsets[row]), int(offsets[until])
        if until > row + 1 or high - low <= at_once:
            yield row, *hash_words(raw[low:high], offsets[row : until + 1] - low)
        else:
            parts = []
            while low < high:
                cut = min(low + at_once, high)
                while cut < high and not _SPACE[raw[cut]]:
                    cut += 1
                parts.append(hash_words(raw[low:cut], np.array([0]))[0])
                low = cut
            words = np.concatenate(parts)
            yield row, words, np.array([0, len(words)])
        row = until


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty. Pure-ASCII texts take the fast built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored with a row number: the number belongs to the stored row, so lost executors cannot change it."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def widened(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` and further ``fields`` (DDL), all of which may be null."""
    added = T.StructType.fromDDL(fields)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in [*df.schema, *added]])
