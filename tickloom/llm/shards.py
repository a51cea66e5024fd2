"""Sharding by a consistent-hash ring with virtual nodes and bounded loads. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.session import stored

#: Places of one shard on the ring.
VIRTUAL = 32
#: Ring places have this many hexadecimal digits; the first ``_CELL`` of them name a cell of the ring.
_DIGITS, _CELL = 15, 3


def place_of(key: Column) -> Column:
    """The place of a text key on the ring: the leading digits of its MD5 digest as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, _DIGITS), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """(arc, shard, place): the virtual nodes in clockwise order; arc k ends at node k.

    The ring is cut open at 0, so its first node stands once more at the end, for the keys after the last node.
    ``shards * virtual + 1`` rows, whatever the data.
    """
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
    placed = nodes.withColumn("place", place_of(F.concat_ws("#", F.lit("shard"), "shard", "copy")))
    again = placed.groupBy().agg(F.min_by("shard", F.struct("place", "shard")).alias("shard")).select("shard", F.lit(-1).cast("long").alias("copy"), F.lit(1 << (4 * _DIGITS)).cast("long").alias("place"))
    return placed.union(again).select((F.row_number().over(Window.orderBy("place", "shard")) - 1).cast("long").alias("arc"), "shard", "place")


def cells(nodes: DataFrame) -> DataFrame:
    """(cell, nodes): for each of 16^3 equal cells of the ring its virtual nodes and the first one after it, clockwise.

    A key's node is the first of its cell's list that does not lie before the key.
    """
    cell = F.shiftright("place", 4 * (_DIGITS - _CELL))
    held = nodes.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list(F.struct("place", "arc"))).alias("own"))
    every = nodes.sparkSession.range(16**_CELL + 1).select(F.col("id").alias("cell")).join(held, "cell", "left")
    after = F.first(F.col("own")[0], ignorenulls=True).over(Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing))
    return every.select("cell", "own", F.array(after).alias("after")).filter(F.col("after")[0].isNotNull()).select("cell", F.when(F.col("own").isNull(), F.col("after")).otherwise(F.concat("own", "after")).alias("nodes"))


def sorted_places(entries: DataFrame) -> DataFrame:
    """``entries`` with their rank in ring order (place, id, row): sorted by ranges of all three, so one place with
    very many rows is spread too, and numbered from the ranges' counts."""
    line = stored(entries.repartitionByRange("place", "id", "row").sortWithinPartitions("place", "id", "row").withColumn("at", F.monotonically_increasing_id()), "shard-line")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    told = line.withColumns({"part": part, "within": within})
    sizes = told.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # one row per range
    return told.join(F.broadcast(starts), "part").select("id", "size", "crc", "place", (F.col("start") + F.col("within")).alias("rank"))


def capacities(total: Column, shard: Column, shards: int, slack: float) -> Column:
    """How many rows a shard may hold. Without slack the shares of all rows, at most one apart."""
    even = F.floor(total / shards) + F.when(shard < total % shards, 1).otherwise(0)
    return F.greatest(even, F.ceil(total * (1 + slack) / shards)).cast("long") if slack else even.cast("long")


def overflow(arcs: DataFrame, laps: int = 2) -> DataFrame:
    """(arc, runs): where the rows of each arc go that its own shard has no room for.

    ``arcs`` has (arc, shard, own, room): rows on the arc, and how many of them the shard has room for. The surplus of
    all arcs waits in one line in ring order; walking clockwise, each virtual node hands as many from the head of the
    line as its shard has room left to that shard. After the second lap the line is empty. One fold over the virtual
    nodes, which are few and do not grow with the data. ``runs`` are (from, to, shard, slot): places in the arc's own
    surplus, the shard, and the slot of the first.
    """
    one = arcs.select(F.sort_array(F.collect_list(F.struct("arc", "shard", "surplus", "spare"))).alias("nodes"))
    walk = f"flatten(transform(sequence(1, {laps}), lap -> transform(nodes, v -> named_struct('lap', lap, 'v', v))))"
    none = "array_repeat(named_struct('from', 0L, 'to', 0L, 'shard', 0, 'left', 0L), 0)"
    zero = f"named_struct('waiting', 0L, 'taken', 0L, 'room', map_from_entries(array_distinct(transform(nodes, v -> struct(v.shard, v.spare)))), 'runs', {none})"
    waits = "(s.waiting + IF(x.lap = 1, x.v.surplus, 0L))"
    given = f"least({waits}, s.room[x.v.shard])"
    step = f"""(s, x) -> named_struct(
        'waiting', {waits} - {given}, 'taken', s.taken + {given},
        'room', transform_values(s.room, (k, r) -> IF(k = x.v.shard, r - {given}, r)),
        'runs', IF({given} > 0, concat(s.runs, array(named_struct('from', s.taken, 'to', s.taken + {given}, 'shard', x.v.shard, 'left', s.room[x.v.shard]))), s.runs))"""
    runs = one.select(F.expr(f"aggregate({walk}, {zero}, {step}).runs").alias("runs")).select(F.inline("runs"))
    run = runs.join(arcs.select("shard", "spare", "kept").distinct(), "shard").select("from", "to", "shard", (F.col("kept") + F.col("spare") - F.col("left")).alias("slot"))
    waiting = arcs.filter("surplus > 0").select("arc", F.col("before").alias("low"), (F.col("before") + F.col("surplus")).alias("high"))
    met = waiting.join(F.broadcast(run), (F.col("from") < F.col("high")) & (F.col("to") > F.col("low")))
    low, high = F.greatest("from", "low"), F.least("to", "high")
    cut = F.struct((low - F.col("low")).alias("from"), (high - F.col("low")).alias("to"), "shard", (F.col("slot") + low - F.col("from")).alias("slot"))
    return met.groupBy("arc").agg(F.sort_array(F.collect_list(cut)).alias("runs"))


def sharded(df: DataFrame, id: str = "doc_id", text: str = "text", shards: int = 24, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, law, shard, slot, grown_shard.

    Keys are texts: equal texts share a place on the ring and go to one shard while it has room. Each shard owns the
    arcs before its ``virtual`` places and takes their rows clockwise up to its capacity; rows beyond continue
    clockwise to the next place whose shard has room left. With ``slack`` 0 capacities are the even shares, so the law
    is ``rows``: counts are at most one apart. With more slack shards hold at most ``(1 + slack)`` times the mean,
    and ``law`` is null. ``slot`` counts from 0 without gaps in each shard; ``grown_shard`` is null, since bounded
    loads may move rows between old shards when one is added (a test measures how many).

    A null text counts as empty (size 8, checksum 0); a null id orders before every other; repeated rows get slots of
    their own. Other columns are not looked at. An empty table gives an empty result.

    No row meets another: rows are sorted once by ranges, and everything else is arithmetic on their ranks with two
    tables over the virtual nodes.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    entries = stored(
        df.select(F.col(id).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), place_of(body).alias("place"), F.monotonically_increasing_id().alias("row")),
        "shard-entries",
    )
    nodes = stored(ring(spark, shards, virtual), "shard-ring")
    node = F.element_at(F.filter("nodes", lambda v: v["place"] >= F.col("place")), 1)["arc"]
    line = sorted_places(entries).withColumn("cell", F.shiftright("place", 4 * (_DIGITS - _CELL))).join(F.broadcast(cells(nodes)), "cell")
    line = stored(line.select("id", "size", "crc", "rank", node.alias("arc")), "shard-ranks")
    held = line.groupBy("arc").agg(F.count(F.lit(1)).alias("own"), F.min("rank").alias("first"))
    every, earlier = Window.partitionBy(), Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    arcs = nodes.join(held, "arc", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    arcs = arcs.withColumns({"prior": F.coalesce(F.sum("own").over(earlier), F.lit(0)), "load": F.sum("own").over(Window.partitionBy("shard")), "total": F.sum("own").over(every)})
    arcs = arcs.withColumn("capacity", capacities(F.col("total"), F.col("shard"), shards, slack))
    arcs = arcs.withColumns({"stay": F.greatest(F.least(F.col("own"), F.col("capacity") - F.col("prior")), F.lit(0)), "kept": F.least("load", "capacity")})
    arcs = arcs.withColumns({"surplus": F.col("own") - F.col("stay"), "spare": F.col("capacity") - F.col("kept")})
    before = F.sum("surplus").over(Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1))
    arcs = stored(arcs.select("arc", F.col("shard").alias("owner"), "first", "prior", "stay", "kept", "surplus", "spare", F.coalesce(before, F.lit(0)).alias("before")), "shard-arcs")
    table = arcs.join(overflow(arcs.withColumnRenamed("owner", "shard")), "arc", "left").select("arc", "owner", "first", "prior", "stay", "runs")
    placed = line.join(F.broadcast(table), "arc").withColumn("over", F.col("rank") - F.col("first") - F.col("stay"))
    run = F.element_at(F.filter("runs", lambda r: r["to"] > F.col("over")), 1)
    placed = placed.withColumn("run", F.when(F.col("over") >= 0, run))
    stays = F.col("over") < 0
    return placed.select(
        F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit(None if slack else "rows").cast("string").alias("law"),
        F.when(stays, F.col("owner")).otherwise(F.col("run.shard")).alias("shard"),
        F.when(stays, F.col("prior") + F.col("rank") - F.col("first")).otherwise(F.col("run.slot") + F.col("over") - F.col("run.from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
