"""Event streams: duplicates, lateness, order, bars and digests, the same code in batch where possible."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.intraday import bar_end
from tickloom.operators.series import number_rows, previous_value

ORDER = ["event_time", "kind", "source", "event_id"]


def file_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """New files below a path as a stream (arriving snapshots, logs)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def unique_events(events: DataFrame, time: str, delay: str, key: str = "event_id") -> DataFrame:
    """Drop repeats of an event id seen within the watermark; state is bounded by the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_bars(events: DataFrame, minutes: int, time: str, price: str, size: str, delay: str) -> DataFrame:
    """Session bars in append mode: a bar is emitted once, when the watermark on bar ends passes it.

    The key and the folds are those of the batch operator, so both give the same bars.
    """
    keyed = events.withColumn("bar_end", bar_end(F.col(time), minutes)).where("bar_end is not null")
    return keyed.withWatermark("bar_end", delay).groupBy("symbol", "bar_end").agg(
        F.min_by(price, time).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, time).alias("close"),
        F.sum(size).alias("volume"), F.sum(F.col(price) * F.col(size)).alias("amount"),
    )


def sliding_stats(events: DataFrame, time: str, value: str, size: str, slide: str, keys: list[str]) -> DataFrame:
    """Count, mean and last value per sliding window; works on streams (with a watermark) and tables."""
    return events.groupBy(*keys, F.window(time, size, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.avg(value).alias("mean"), F.max_by(value, time).alias("last")
    ).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "mean", "last")


def visible_at(events: DataFrame, frontier: Column, available: str = "available_at") -> DataFrame:
    """Nothing whose availability is unknown or beyond the decision frontier may be read."""
    return events.where(F.col(available).isNotNull() & (F.col(available) <= frontier))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain everything that has arrived into parquet and stop; a restart resumes from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def ordered_sink(events: DataFrame, out: str, late: str, checkpoint: str, time: str = "event_time", order: list[str] | None = None) -> StreamingQuery:
    """Write each micro-batch in total order; rows sorting before what was already written go to ``late``.

    Spark drops late rows silently, so lateness is decided here against the frontier of earlier
    batches, which is read back from the output itself. Batches write their own partition, so a
    replayed batch overwrites itself and nothing is emitted twice.
    """
    keys = order or ORDER

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        frontier = None
        try:
            done = spark.read.parquet(out).where(F.col("batch_id") < batch_id)
            frontier = done.agg(F.max(F.struct(*keys))).first()[0]  # one key
        except Exception as e:  # first batch: nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        tagged = batch.withColumn("_late", F.lit(False) if frontier is None else F.struct(*keys) < F.struct(*(F.lit(frontier[k]).alias(k) for k in keys)))
        for flag, path in ((False, out), (True, late)):
            rows = tagged.where(F.col("_late") == flag).drop("_late")
            rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = events.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ordered_digest(events: DataFrame, order: list[str], ident: str, bucket: Column, chunk: int = 4096) -> DataFrame:
    """Digest of ids in total order, the same for any arrival order or partitioning.

    A plain chain is sequential. Here rows get their exact position, blocks of ``chunk`` ids are
    hashed, then blocks of block hashes, until one block is left; every group is bounded by ``chunk``.
    """
    left = max(2, events.count())
    numbered = number_rows(events.withColumn("_all", F.lit(1)), ["_all"], order, bucket, "_i")
    level = numbered.select(F.col("_i").alias("_i"), F.col(ident).cast("string").alias("_h"))
    while left > 1:
        left = -(-left // chunk)
        level = level.groupBy(F.floor(F.col("_i") / chunk).cast("long").alias("_g")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda s: s["_h"]), ","), 256).alias("_h")
        ).withColumnRenamed("_g", "_i")
    return level.select(F.col("_h").alias("digest"))


def transition_audit(events: DataFrame, key: str, order: str, state: str, legal: list[tuple[str, str]], bucket: Column) -> DataFrame:
    """Every state change with whether it is legal; keys of any length are read bucket by bucket."""
    prev = previous_value(events, [key], [order], bucket, state, "previous")
    allowed = events.sparkSession.createDataFrame(legal, f"previous string, {state} string").withColumn("_ok", F.lit(True))
    out = prev.join(F.broadcast(allowed), ["previous", state], "left")  # a short list of state pairs
    return out.withColumn("legal", F.col("previous").isNull() | F.coalesce("_ok", F.lit(False))).drop("_ok")


def resolve_ambiguity(stop_hit: Column, target_hit: Column, policy: str) -> Column:
    """Outcome of a bar that may touch both levels, under a stated policy."""
    both = {"pessimistic": "stop", "optimistic": "target", "undetermined": "undetermined"}[policy]
    return F.when(stop_hit & target_hit, both).when(stop_hit, "stop").when(target_hit, "target").otherwise("none")


def settle_forward(log: DataFrame, returns: DataFrame, sessions: DataFrame, ahead: int, keys: list[str]) -> DataFrame:
    """Settle frozen rows once ``ahead`` later sessions exist: pool mean return minus universe mean."""
    s = sessions.select("trade_date", "session")
    last = sessions.agg(F.max("session").alias("_last"))
    r = returns.join(F.broadcast(s), "trade_date")  # one row per session
    entry = r.select("symbol", F.col("session").alias("_s"), F.col("close").alias("_c0"))
    exit_ = r.select("symbol", (F.col("session") - ahead).alias("_s"), F.col("close").alias("_c1"))
    gain = entry.join(exit_, ["symbol", "_s"]).select("symbol", F.col("_s").alias("session"), (F.col("_c1") / F.col("_c0") - 1).alias("_g"))
    market = gain.groupBy("session").agg(F.avg("_g").alias("universe"))
    rows = log.join(F.broadcast(s), "trade_date").crossJoin(F.broadcast(last)).where(F.col("session") + ahead <= F.col("_last"))
    return rows.join(gain, ["symbol", "session"]).groupBy(*keys, "trade_date", "session").agg(F.avg("_g").alias("pool")).join(market, "session").select(
        *keys, "trade_date", "pool", "universe", (F.col("pool") - F.col("universe")).alias("excess")
    )


