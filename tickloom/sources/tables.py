"""Table sources and sinks: suffix formats, roots of files, append, journal, manifest, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.series import number_rows


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV by suffix; CSV and JSON take a declared schema and never scan to guess one."""
    suffix = path.rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "parquet" or "." not in path.rsplit("/", 1)[-1]:
        return reader.parquet(path)
    if suffix in ("csv", "txt"):
        return reader.option("header", True).csv(path)
    if suffix in ("json", "jsonl"):
        return reader.json(path)
    if suffix == "orc":
        return reader.orc(path)
    raise ValueError(f"unsupported table suffix: {path}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write by suffix; a partitioned write first gathers each partition's rows, so files stay few."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    writer = df.write.mode(mode)
    if partition_by:
        writer = df.repartition(*partition_by).write.mode(mode).partitionBy(*partition_by)
    if suffix in ("csv", "txt"):
        writer.option("header", True).csv(path)
    elif suffix == "json":
        writer.json(path)
    elif suffix == "orc":
        writer.orc(path)
    elif suffix == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported table suffix: {path}")


def read_panel(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A daily panel limited to symbols and dates; both filters reach the file scan."""
    df = read_table(spark, path)
    if symbols:
        df = df.where(F.col("symbol").isin(*symbols))
    if start:
        df = df.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return df


def read_root(spark: SparkSession, root: str) -> DataFrame:
    """Every parquet below a root as one table, each row knowing its file stem."""
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(root)
    return df.withColumn("file_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet", 1))


def union_roots(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def wide_series(long: DataFrame, at: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Many small series to one wide table; the name list is given, so no extra job collects it."""
    return long.groupBy(at).pivot(name, names).agg(F.max(value))


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet: what a daily append writes."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def keep_last(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union where an incoming row replaces the stored one of the same key."""
    values = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    packed = F.struct(*[F.col(c) for c in values])
    return both.groupBy(*keys).agg(F.max_by(packed, F.struct("_v", F.xxhash64(*values))).alias("_r")).select(*keys, "_r.*")


def first_provider(rows: DataFrame, symbol: str, rank: str) -> DataFrame:
    """Each symbol's whole history from its best provider only: an aggregate and a join, no window."""
    best = rows.groupBy(symbol).agg(F.min(rank).alias("_best"))
    return rows.join(best, symbol).where(F.col(rank) == F.col("_best")).drop("_best")


def journal_decisions(stored: DataFrame, incoming: DataFrame, keys: list[str], content: Column, supersede: bool = False) -> DataFrame:
    """Verdict per incoming partition: NEW, DEDUPLICATED (same content) or CONFLICT / SUPERSEDED."""
    s = stored.select(*keys, F.col("content_hash").alias("_stored"))
    i = incoming.withColumn("content_hash", content)
    other = "SUPERSEDED" if supersede else "CONFLICT"
    verdict = F.when(F.col("_stored").isNull(), "NEW").when(F.col("_stored") == F.col("content_hash"), "DEDUPLICATED").otherwise(other)
    return i.join(s, keys, "left").withColumn("decision", verdict).drop("_stored")


def content_hash(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free digest per group: row count plus the sums of two independent 64-bit row hashes.

    Columns are hashed by name order and sums do not depend on row order, so any layout of the
    same rows gives the same digest, with partial aggregation.
    """
    cols = sorted(df.columns)
    a = F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")
    b = F.xxhash64(*[F.col(c) for c in reversed(cols)], F.lit("salt")).cast("decimal(38,0)")
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(a).alias("_a"), F.sum(b).alias("_b"))
    return g.select(*by, "rows", F.sha2(F.concat_ws("|", F.lit(",".join(cols)), "rows", "_a", "_b"), 256).alias("content_hash"))


def manifest(df: DataFrame, required: list[str], symbol: str = "symbol", date: str = "trade_date", pit_violation: Column | None = None) -> DataFrame:
    """One row: size, symbols, date span, missing counts of required columns, point-in-time violations."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(symbol).alias("symbols"), F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in required],
        *([F.sum(pit_violation.cast("long")).alias("pit_violations")] if pit_violation is not None else []),
    )


def ingest_sequence(df: DataFrame, order: list[str], bucket: Column, start: int = 0) -> DataFrame:
    """Gap-free storage order from ``start``, numbered bucket by bucket and never in one sort."""
    out = number_rows(df.withColumn("_all", F.lit(1)), ["_all"], order, bucket, "ingest_sequence")
    return out.withColumn("ingest_sequence", F.col("ingest_sequence") + start).drop("_all")


def static_export(df: DataFrame, features: list[str], labels: list[str], keys: tuple[str, str] = ("symbol", "trade_date")) -> DataFrame:
    """Keys plus a feature and a label struct; label-like feature names are refused."""
    unsafe = [f for f in features if f.startswith(("forward_", "future_", "label"))]
    if unsafe:
        raise ValueError(f"label-like feature columns: {unsafe}")
    return df.select(*keys, F.struct(*features).alias("features"), F.struct(*labels).alias("labels"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


