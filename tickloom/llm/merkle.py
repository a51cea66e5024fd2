"""Merkle manifest of a table: ternary hash trees by source, stored as blocks in van Emde Boas order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import stored

FAN = 3
#: Levels of a stored block: it holds at most ``FAN ** BLOCK`` leaves, whatever the size of a source.
BLOCK = 7
_TOP = "top"


def joined_digest(*parts: Column) -> Column:
    """SHA-256 of values told apart by their UTF-8 byte counts; a null is a dash."""
    shown = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*shown).cast("binary"), 256))


def size_of(levels: int) -> int:
    """Nodes of a full tree of ``levels`` levels."""
    return (FAN**levels - 1) // (FAN - 1)


def addresses(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Where the nodes ``number`` of level ``depth`` (0 is the root) lie in a tree of ``levels`` levels.

    A tree is cut at half its height: the upper half lies first, then the subtrees below it from left to right, each
    laid out the same way. So a node's address is the sum of whole subtrees before it, down to a single level.
    """
    at, number = np.zeros(len(number), dtype=np.int64), number.astype(np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = FAN ** (depth - upper)
        at += size_of(upper) + (number // below) * size_of(levels - upper)
        levels, depth, number = levels - upper, depth - upper, number % below
    return at


def digest_of(parts: list[bytes]) -> bytes:
    """SHA-256 of digests written one after another as lower-case hexadecimal text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FAN), height + 1
    return height


class Block:
    """An aligned subtree of ``height`` levels above ``held`` leaves, its nodes in one array in van Emde Boas order."""

    def __init__(self, height: int, held: int, nodes: bytes | None = None) -> None:
        self.height, self.held = height, held
        self.nodes = bytearray(32 * size_of(height + 1)) if nodes is None else nodes
        self.places, self.counts = [], []  # from the leaves up
        for depth in range(height, -1, -1):
            self.counts.append(held if depth == height else -(-self.counts[-1] // FAN))
            self.places.append(32 * addresses(height + 1, depth, np.arange(self.counts[-1])))

    def node(self, level: int, number: int) -> bytes:
        at = self.places[level][number]
        return bytes(self.nodes[at : at + 32])

    @classmethod
    def build(cls, height: int, leaves: list[bytes]) -> "Block":
        block = cls(height, len(leaves))
        for at, leaf in zip(block.places[0].tolist(), leaves, strict=True):
            block.nodes[at : at + 32] = leaf
        for level in range(1, height + 1):
            for number, at in enumerate(block.places[level].tolist()):
                low = FAN * number
                block.nodes[at : at + 32] = digest_of([block.node(level - 1, k) for k in range(low, min(low + FAN, block.counts[level - 1]))])
        return block

    def siblings(self, number: int) -> bytes:
        """The way from a leaf to the block's root: for each level a byte (siblings to the left, and to the right) and
        the siblings themselves, read from their addresses."""
        way = []
        for level in range(self.height):
            low = number - number % FAN
            high = min(low + FAN, self.counts[level])
            way.append(bytes([(number - low) << 4 | (high - number - 1)]))
            way += [self.node(level, k) for k in range(low, high) if k != number]
            number //= FAN
        return b"".join(way)

    @property
    def root(self) -> bytes:
        return bytes(self.nodes[:32])


def steps(way: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(left siblings, right siblings) of each level of a way."""
    at = 0
    while at < len(way):
        left, right = way[at] >> 4, way[at] & 15
        found = [way[k : k + 32] for k in range(at + 1, at + 1 + 32 * (left + right), 32)]
        yield found[:left], found[left:]
        at += 1 + 32 * (left + right)


def folded(leaf: bytes, way: bytes) -> bytes:
    """The root that a leaf and its way give."""
    for left, right in steps(way):
        leaf = digest_of([*left, leaf, *right])
    return leaf


def proof_digest(way: bytes) -> bytes:
    return digest_of([s for left, right in steps(way) for s in (*left, *right)])


def numbered_leaves(leaves: DataFrame) -> DataFrame:
    """``leaves`` (key, id, leaf, …) with their place in their key's order and the key's count.

    Rows are sorted by ranges of key, id and leaf, so a key with very many rows is spread over tasks, and numbered
    from the counts of the ranges.
    """
    line = stored(leaves.repartitionByRange("key", "id", "leaf").sortWithinPartitions("key", "id", "leaf").withColumn("at", F.monotonically_increasing_id()), "merkle-line")
    told = line.withColumn("part", F.shiftright("at", 33))
    runs = told.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    so_far, whole = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    starts = runs.select("key", "part", "first", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("held"))
    return told.join(starts, ["key", "part"]).withColumn("number", F.col("start") + F.col("at") - F.col("first")).drop("at", "part", "first", "start")


def blocks_of(nodes: DataFrame, height: int = BLOCK) -> DataFrame:
    """(key, block, kept, root, rest, tree) of ``nodes`` (key, number, held, digest): one block for every
    ``FAN ** height`` nodes of a key. ``rest`` is how many roots the key has left."""
    width = FAN**height

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        held = rows["held"][0].as_py()
        block = Block.build(min(height, height_of(held)), rows["digest"].to_pylist())
        found = {"key": [key[0].as_py()], "block": [key[1].as_py()], "kept": [block.held], "height": [block.height], "rest": [-(-held // width)], "root": [block.root], "tree": [bytes(block.nodes)]}
        return pa.table(found, schema=pa.schema([("key", pa.string()), ("block", pa.int64()), ("kept", pa.int64()), ("height", pa.int32()), ("rest", pa.int64()), ("root", pa.binary()), ("tree", pa.binary())]))

    dealt = nodes.select("key", F.floor(F.col("number") / width).cast("long").alias("block"), "number", "held", "digest")
    return stored(dealt.groupBy("key", "block").applyInArrow(build, "key string, block long, kept long, height int, rest long, root binary, tree binary"), "merkle-blocks")


def ways_down(blocks: DataFrame, ways: DataFrame | None) -> DataFrame:
    """(key, number, way) of the nodes below ``blocks``: their siblings in the block, then the way of its root."""
    above = blocks.withColumn("way", F.lit(b"")) if ways is None else blocks.join(ways.withColumnRenamed("number", "block"), ["key", "block"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                block = Block(one["height"], one["kept"], one["tree"])
                first = one["block"] * one["width"]
                found = [block.siblings(k) + one["way"] for k in range(block.held)]
                yield pa.RecordBatch.from_arrays([pa.array([one["key"]] * block.held), pa.array(range(first, first + block.held), pa.int64()), pa.array(found, pa.binary())], names=["key", "number", "way"])

    return above.select("key", "block", "width", "kept", "height", "tree", "way").mapInArrow(task, "key string, number long, way binary")


def forest(nodes: DataFrame, height: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every layer, the leaves' layer first, and (key, root). The roots of a layer's blocks are the next
    layer's leaves until each key has one; a layer is ``FAN ** height`` times smaller than the one below."""
    layers = []
    while True:
        blocks = blocks_of(nodes, height)
        layers.append(blocks.withColumn("width", F.lit(FAN**height)))
        if (blocks.agg(F.max("rest")).first()[0] or 0) <= 1:
            return layers, blocks.select("key", "root")
        nodes = blocks.select("key", F.col("block").alias("number"), F.col("rest").alias("held"), F.col("root").alias("digest"))


def merkle_manifest(df: DataFrame, id: str = "doc_id", source: str = "source", lang: str = "lang", chars: str = "n_chars", text: str = "text", height: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of id, source, lang, chars and text. A source's leaves ascend by id (null first, then by
    leaf, so repeated rows have one defined order); every three consecutive nodes become their digest until one, the
    subroot, remains, and the subroots in the order of their sources (null first, bytewise) become the root likewise.
    ``proof_sha256`` is the digest of the leaf's siblings up to the root. Where the CRC-32 of the id's decimal text is
    even, the text is tampered with by deleting its line feeds; ``folded_root`` is what the tampered, else the
    original, leaf gives with the original siblings, and ``verified`` whether that is the root. A null id or text is
    never tampered with. Other columns are not looked at. An empty table gives an empty result.

    Trees are kept as blocks of ``height`` levels in van Emde Boas order in the shared folder; a block's siblings are
    read by address. No task holds more than a block of a source.
    """
    columns = [F.col(id).cast("long"), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(chars).cast("long"), F.col(text).cast("string")]
    number, body = columns[0], columns[4]
    tampers = (F.crc32(number.cast("string").cast("binary")) % 2 == 0) & F.contains(body, F.lit("\n"))
    leaves = stored(
        df.select(
            F.coalesce(F.concat(F.lit("s"), columns[1]), F.lit("")).alias("key"), number.alias("id"), joined_digest(*columns).alias("leaf"),
            F.when(tampers, joined_digest(*columns[:4], F.replace(body, F.lit("\n"), F.lit("")))).alias("changed"),
        ),
        "merkle-leaves",
    )
    line = stored(numbered_leaves(leaves), "merkle-leaves")
    layers, subroots = forest(line.select("key", "number", "held", F.col("leaf").alias("digest")), height)
    above = subroots.select(F.lit(_TOP).alias("key"), F.col("key").alias("id"), F.col("root").alias("leaf"))
    order = stored(numbered_leaves(above), "merkle-sources")
    upper, roots = forest(order.select("key", "number", "held", F.col("leaf").alias("digest")), height)
    top = None
    for blocks in reversed(upper):
        top = stored(ways_down(blocks, top), "merkle-ways")
    found = roots.first()  # one digest, none for an empty table
    named = order.select("number", F.col("id").alias("name"), F.col("leaf").alias("subroot"), F.lit(found["root"] if found else b"").alias("whole"))
    by_source = stored(top.join(named, "number").select(F.col("name").alias("key"), "subroot", "whole", "way"), "merkle-source-ways")
    ways = by_source.select("key", F.lit(0).cast("long").alias("number"), "way")
    for blocks in reversed(layers[1:]):
        ways = stored(ways_down(blocks, ways), "merkle-ways")
    trees = layers[0].join(ways.withColumnRenamed("number", "block"), ["key", "block"]).join(by_source.select("key", "subroot", "whole"), "key")
    width = FAN**height
    shape = pa.schema([(id, pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def prove(rows: pa.Table, tree: pa.Table) -> pa.Table:
        one = {name: tree[name][0].as_py() for name in tree.column_names}
        block, whole = Block(one["height"], one["kept"], one["tree"]), one["whole"]
        out = []
        for key, place, leaf, changed in zip(*(rows[c].to_pylist() for c in ("id", "number", "leaf", "changed")), strict=True):
            way = block.siblings(place % width) + one["way"]
            got = folded(changed or leaf, way)
            out.append((key, leaf.hex(), one["subroot"].hex(), whole.hex(), proof_digest(way).hex(), got.hex(), got == whole))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    dealt = line.select("key", F.floor(F.col("number") / width).cast("long").alias("block"), "id", "number", "leaf", "changed")
    schema = f"`{id}` long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return dealt.groupBy("key", "block").cogroup(trees.groupBy("key", "block")).applyInArrow(prove, schema)
