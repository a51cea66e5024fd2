"""Exact duplicates by an extendible-hash index kept as files in the shared folder. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower
from tickloom.session import stored

#: Chain heads a bucket holds before the directory doubles there.
BUCKET_HEADS = 100_000
#: Directory levels beyond the one that an even spread of keys would need.
EXTRA_LEVELS = 6


def directory(heads: DataFrame, bucket_heads: int = BUCKET_HEADS, extra: int = EXTRA_LEVELS) -> tuple[DataFrame, int]:
    """Extendible-hash directory over ``key`` (64-bit) of ``heads``: a row per cell with its bucket and local depth.

    The global depth starts where an even spread fills the buckets. Each doubling looks at one more leading bit
    of the key and splits the buckets that are still overfull; the others keep their local depth, so several
    cells point to them. Only counts per cell are handled, and there are at most ``rows / bucket_heads * 2^extra``.
    Returns the directory (``cell``, ``bucket``, ``depth``) and the number of leading bits that make a cell.
    """
    start = max(0, math.ceil(math.log2(max(1, heads.count()) / bucket_heads)))
    levels = min(start + extra, 40)
    cells = heads.groupBy(cell_of(F.col("key"), levels).alias("cell")).agg(F.count(F.lit(1)).alias("held")).withColumn("depth", F.lit(start))
    for depth in range(start, levels):
        bucket = Window.partitionBy(F.shiftrightunsigned("cell", levels - depth))
        overfull = (F.col("depth") == depth) & (F.sum("held").over(bucket) > bucket_heads)
        cells = cells.withColumn("depth", F.when(overfull, F.lit(depth + 1)).otherwise(F.col("depth")))
    bucket = F.expr(f"shiftleft(shiftrightunsigned(cell, cast({levels} - depth as int)), cast({levels} - depth as int))")
    return cells.select("cell", bucket.alias("bucket"), "depth"), levels


def cell_of(key, levels: int):
    return F.shiftrightunsigned(key, 64 - levels) if levels else F.lit(0).cast("long")


def exact_index(entries: DataFrame, bucket_heads: int = BUCKET_HEADS) -> DataFrame:
    """Write the index files of ``entries`` (key, sha, bytes, id, row) and return them.

    Entries fold to chain heads first (one per distinct fingerprint, counted before the shuffle), so a text with a
    third of all rows is one entry of its bucket. Owner tasks then hold ranges of buckets and write them in key
    order; heads with one ``key`` and different fingerprints follow one another there as a chain.
    """
    heads = stored(
        entries.groupBy("key", "sha", "bytes").agg(F.max(F.struct("id", "row")).alias("head"), F.count(F.lit(1)).alias("group_size")), "exact-heads",
    )
    cells, levels = directory(heads, bucket_heads)
    owned = heads.withColumn("cell", cell_of(F.col("key"), levels)).join(cells, "cell").select("bucket", "depth", "key", "sha", "bytes", "head", "group_size")
    return stored(owned.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "exact-index")


def exact_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", bucket_heads: int = BUCKET_HEADS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays, one of them if an identical row repeats; a null id is below every other, and a group
    with null ids alone has a null ``keep_id`` and one kept row. Further columns of ``df`` are not looked at. An
    empty table gives an empty result.

    A 64-bit key places a text in the index; length and SHA-256 separate colliding keys in its chain, and members
    of a group are compared byte by byte with its head. A member that differs all the same leaves the group and is
    grouped by its bytes.
    """
    plain = ascii_lower(F.col("text"))
    entries = stored(
        df.select(F.col(id).alias("id"), F.col(text).alias("text"))
        .select("id", plain.alias("plain"))
        .select(
            "id", F.monotonically_increasing_id().alias("row"), F.xxhash64("plain").alias("key"), F.unhex(F.sha2("plain", 256)).alias("sha"),
            F.octet_length("plain").alias("bytes"),
        ),
        "exact-entries",
    )
    index = exact_index(entries, bucket_heads)
    placed = entries.join(index.select("key", "sha", "bytes", "head", "group_size"), ["key", "sha", "bytes"])
    odd = differing(placed, df, id, text)
    own = odd.join(odd.groupBy("key", "sha", "plain").agg(F.max("id").alias("own_id"), F.count(F.lit(1)).alias("own_size")), ["key", "sha", "plain"])
    gone = odd.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("gone"))
    whole = placed.join(own.select("key", "sha", "id", "own_id", "own_size"), ["key", "sha", "id"], "left").join(gone, ["key", "sha"], "left")
    return whole.select(
        F.col("id").alias(id),
        F.coalesce("own_id", F.col("head")["id"]).alias("keep_id"),
        F.coalesce("own_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        F.coalesce(F.col("id") == F.col("own_id"), F.col("row") == F.col("head")["row"]).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def differing(placed: DataFrame, df: DataFrame, id: str, text: str) -> DataFrame:
    """Members (key, sha, id, plain) of groups whose bytes are not those of their group's head: the byte comparison.

    Only texts of groups with several members are moved past the first join; lower-casing is repeated for them alone.
    """
    texts = df.select(F.col(id).alias("text_id"), F.col(text).alias("text"))
    asked = placed.filter(F.col("group_size") > 1).select("key", "sha", "id", F.col("head")["id"].alias("head_id")).distinct()
    seen = stored(
        asked.join(texts, F.col("id") == F.col("text_id"))
        .select("key", "sha", "id", "head_id", ascii_lower(F.col("text")).alias("plain"))
        .filter(F.xxhash64("plain") == F.col("key")),
        "exact-compared",
    )
    heads = seen.filter(F.col("id") == F.col("head_id")).groupBy("key", "sha").agg(F.min("plain").alias("head_plain"))
    members = seen.filter(F.col("id") != F.col("head_id"))
    return members.join(heads, ["key", "sha"]).filter(F.col("plain") != F.col("head_plain")).select("key", "sha", "id", "plain").distinct()
