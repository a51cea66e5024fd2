"""Best-fit packing of token pieces into sequences by hierarchical residual rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ROW, widened
from tickloom.llm.tokens import BytePairs
from tickloom.session import stored

#: Pieces that one task packs at once, and groups whose open bins meet in one task of the next round.
GROUP_PIECES = 50_000
FAN_IN = 8


def pieces(df: DataFrame, text: str, tokenizer: tuple[str, str, str], capacity: int, end_id: int = 0) -> DataFrame:
    """``df`` without ``text`` and with a row per piece: piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``. A longer one than ``capacity`` is cut into whole sequences, of which the
    first may be shorter; others stay in one piece.
    """
    kept = [c for c in df.columns if c != text]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairs(*tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, value in enumerate(batch.column(0)):
                ids = memoryview(encoder.encode(value.as_py() or "") + end)
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[4 * a : 4 * b]))
            taken = pa.array(rows, pa.int64())
            columns = [c.take(taken) for c in batch.columns[1:]]
            columns += [pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "piece", "start", "length", "ids_crc32"])

    schema = widened(df.select(*kept), "piece int, start long, length long, ids_crc32 long")
    return df.select(text, *kept).mapInArrow(task, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each item, and each bin's fill.

    Bins wait in stacks by their free space, and the set bits of one integer tell which stacks hold any, so the
    tightest bin for an item is the lowest set bit from its size on.
    """
    place, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        above = mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            stack = stacks[free]
            bin_ = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            free, bin_ = capacity, len(fills)
            fills.append(0)
        place[item], offset[item] = bin_, fills[bin_]
        fills[bin_] += size
        free -= size
        if free:
            stacks[free].append(bin_)
            mask |= 1 << free
    return place, offset, fills


def open_bins(fills: np.ndarray, capacity: int, slack: int, fan_in: int) -> np.ndarray:
    """Which bins go up to the next round.

    Bins with ``slack`` or less free are nearly full and are emitted. Best fit leaves at most one bin per group that
    is half full or less, so the next round over ``fan_in`` groups makes fewer than ``fan_in`` merges: each group's
    emptiest ``fan_in`` bins are all that can take part, and fuller ones are emitted too.
    """
    up = np.zeros(len(fills), dtype=bool)
    emptiest = np.argsort(fills, kind="stable")[: fan_in + 1]
    up[emptiest] = fills[emptiest] < capacity - slack
    return up


def pack(items: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, fan_in: int = FAN_IN, slack: int = 8) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; ``length`` is 1 to ``capacity``.

    Round 0: the pieces are dealt evenly by row number, and each group is packed by best-fit decreasing. Then groups
    meet ``fan_in`` at a time, with their underfull bins as items, in a tree of best-fit rounds until one group is left.
    Each round moves a bounded number of bins per group, so no task grows with the input. Any number of equal rows is
    fine; an empty table gives an empty result.
    """
    items = stored(items.withColumn(ROW, F.monotonically_increasing_id()), "pack-items")
    spark, groups = items.sparkSession, max(1, -(-items.count() // group_pieces))

    def first(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        place, offset, fills = best_fit(frame["length"].to_numpy(), capacity)
        fills = np.array(fills)
        up = open_bins(fills, capacity, slack, fan_in)
        number = key[0] * (1 << 40) + place
        return pd.DataFrame({ROW: frame[ROW], "bin": number, "offset": offset, "fill": fills[place], "up": up[place]})

    dealt = items.select(ROW, F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64(ROW), F.lit(groups)).alias("group"))
    placed = stored(dealt.groupBy("group").applyInPandas(first, f"{ROW} long, bin long, offset long, fill long, up boolean"), "pack-placed")
    level = placed.filter("up and offset = 0").select((F.col("bin") / F.lit(1 << 40)).cast("long").alias("group"), "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"))
    members = "members array<struct<bin: long, shift: long>>"

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        place, offset, fills = best_fit(frame["fill"].to_numpy(), capacity)
        held: list[list] = [[] for _ in fills]
        for bin_, shift, inner in zip(place, offset, frame["members"], strict=True):
            held[bin_] += [{"bin": m["bin"], "shift": m["shift"] + int(shift)} for m in inner]
        up = open_bins(np.array(fills), capacity, slack, fan_in)
        return pd.DataFrame({"group": frame["group"].iloc[0], "fill": fills, "members": held, "up": up})

    ended = []
    while groups > 1:
        groups = -(-groups // fan_in)
        merged = stored(
            level.withColumn("group", (F.col("group") / fan_in).cast("long")).groupBy("group").applyInPandas(merge, f"group long, fill long, {members}, up boolean"), "pack-merged",
        )
        ended.append(merged.filter("not up"))
        level = merged.filter("up").drop("up")
    moved = level.select("members")
    for part in ended:
        moved = moved.union(part.select("members"))
    moves = moved.select(F.col("members")[0]["bin"].alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), "m.shift")
    where = placed.join(moves, "bin", "left").select(
        ROW, F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    return items.join(where, ROW).drop(ROW)
