"""Current state per key on a stream, with redelivered and late events counted and named, and the same replay on a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.series import previous_value

#: Fixed value: the state store that keeps large states outside the heap.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = "at long, id long, state string, admitted long, illegal long, duplicates long, late long, ids array<long>, seen array<long>"
LEDGER = "kind string, event_id long, event_time timestamp, state string, admitted long, illegal long, duplicates long, late long, seen long"


def key_ledger(legal: list[tuple[str, str]], keep: float) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What is known of one key: its current state, and how many events were admitted, repeated or late.

    An event is a duplicate when its id was seen, and late when it sorts before the last admitted one. Ids are kept
    for ``keep`` seconds of event time behind the last admitted event; an older event is late whether seen or not, so
    nothing is taken in twice and the memory of a key is bounded. The state comes and goes with the key's rows, so no
    event asks the state store by itself. Times are microseconds.
    """
    allowed, behind, columns = set(legal), round(keep * 1e6), ["key", *[f.split()[0] for f in LEDGER.split(", ")]]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for frame in frames:
            rows.extend(zip(frame["event_time"].tolist(), frame["event_id"].tolist(), frame["state"].tolist(), strict=True))
        rows.sort(key=lambda r: r[:2])
        at, last, state, admitted, illegal, duplicates, late, known, seen = held.get if held.exists else (None, 0, None, 0, 0, 0, 0, [], [])
        frontier = None if at is None else (int(at), int(last))  # of earlier batches and of this one
        ids = dict(zip([int(i) for i in known], [int(t) for t in seen], strict=True))
        out = []
        for time, ident, kind in rows:
            if ident in ids:
                duplicates += 1
                out.append(("duplicate", ident, time, kind))
            elif frontier is not None and (time, ident) < frontier:
                late += 1
                out.append(("late", ident, time, kind))
            else:
                illegal += int(state is not None and (state, kind) not in allowed)
                frontier, state, admitted = (time, ident), kind, admitted + 1
                ids[ident] = time
        if frontier is not None:
            ids = {i: t for i, t in ids.items() if t >= frontier[0] - behind}
            held.update((*frontier, state, admitted, illegal, duplicates, late, list(ids), list(ids.values())))
        counts = (admitted, illegal, duplicates, late, admitted + duplicates + late)
        out.append(("state", frontier[1], frontier[0], state))
        yield pd.DataFrame([(*key, *row, *counts) for row in out], columns=columns)

    return fold


def key_states(events: DataFrame, key: str, time: str, ident: str, state: str, legal: list[tuple[str, str]], keep: float) -> DataFrame:
    """The ledger of a stream: per batch and key one ``state`` row, and a row for every duplicate and late event.

    Micro-batches are bounded by the source's options; a key's rows of one batch meet in its task, as its state does.
    """
    told = events.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("event_time"), F.col(ident).alias("event_id"), F.col(state).alias("state"))
    kind = dict(told.dtypes)["key"]
    grouped = told.where("event_time IS NOT NULL AND event_id IS NOT NULL").groupBy("key")
    schema = f"key {kind}, {LEDGER.replace('event_time timestamp', 'event_time long')}"
    out = grouped.applyInPandasWithState(key_ledger(legal, keep), schema, _HELD, "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("event_time", F.timestamp_micros("event_time"))


def run_ledger(events: DataFrame, out: str, checkpoint: str, **kw: Any) -> StreamingQuery:
    """Drain what has arrived into ``out``; a restart resumes from the checkpoint with the state of every key."""
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        query = key_states(events, **kw).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
    finally:
        conf.set(name, before)
    return query


def current_states(ledger: DataFrame) -> DataFrame:
    """The last ``state`` row of each key."""
    cols = ["event_id", "event_time", "state", "admitted", "illegal", "duplicates", "late"]
    return ledger.where("kind = 'state'").groupBy("key").agg(F.max_by(F.struct(*cols), "seen").alias("_s")).select("key", "_s.*")


def replay_states(events: DataFrame, key: str, time: str, ident: str, state: str, arrival: str, legal: list[tuple[str, str]], bucket: Column) -> DataFrame:
    """The same ledger from a table whose ``arrival`` numbers the batches: key, event_id, event_time, state and counts.

    Rows of one (key, id) are one event delivered several times. An event is late when an earlier arrival of its key
    holds a later one, and its repeats are late with it; repeats of an admitted event are duplicates. States follow
    one another in event order, carried over buckets of time, so no key is read in one piece. Ids are kept for ever
    here: a stream gives the same when its ``keep`` covers the longest redelivery.
    """
    e = events.select(F.col(key).alias("key"), F.col(time).alias("at"), F.col(ident).alias("id"), F.col(state).alias("state"), F.col(arrival).alias("arrival"), bucket.alias("bucket"))
    e = e.where("at IS NOT NULL AND id IS NOT NULL")
    known = e.groupBy("key", "id").agg(F.min(F.struct("arrival", "at", "state", "bucket")).alias("f"), (F.count(F.lit(1)) - 1).alias("repeats")).select("key", "id", "f.*", "repeats")
    tops = known.groupBy("key", "arrival").agg(F.max(F.struct("at", "id")).alias("top"))
    w = Window.partitionBy("key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("key", "arrival", F.max("top").over(w).alias("frontier"))  # one row per key and batch
    marked = known.join(tops, ["key", "arrival"]).withColumn("late", F.coalesce(F.struct("at", "id") < F.col("frontier"), F.lit(False)))
    allowed = [F.concat_ws("\0", F.lit(a), F.lit(b)) for a, b in legal]
    taken = previous_value(marked.where("NOT late"), ["key"], ["at", "id"], F.col("bucket"), "state", "previous")
    bad = F.col("previous").isNotNull() & ~F.coalesce(F.concat_ws("\0", "previous", "state").isin(allowed), F.lit(False))
    both = taken.withColumn("illegal", bad).unionByName(marked.where("late").withColumn("illegal", F.lit(False)), allowMissingColumns=True)
    on_time = ~F.col("late")
    last = F.max_by(F.struct("id", "at", "state"), F.when(on_time, F.struct("at", "id")))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return both.groupBy("key").agg(
        last.alias("_l"), total(on_time.cast("long")).alias("admitted"), total(F.col("illegal").cast("long")).alias("illegal"), total(F.when(on_time, F.col("repeats"))).alias("duplicates"),
        total(F.when(F.col("late"), F.col("repeats") + 1)).alias("late"),
    ).select("key", F.col("_l.id").alias("event_id"), F.col("_l.at").alias("event_time"), F.col("_l.state").alias("state"), "admitted", "illegal", "duplicates", "late")
