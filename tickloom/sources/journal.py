"""A partitioned event journal: appended once, superseded by record, read by partition, counted without its data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tickloom.sources.tables import content_hash

#: Receipts of all versions of all partitions, beside the data.
RECEIPTS = "_receipts"


def _receipts(spark: SparkSession, root: str, keys: list[str], types: dict[str, str]) -> DataFrame:
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "rows long, content_hash string, version string, number int, decision string"])
    try:
        return spark.read.schema(schema).parquet(f"{root}/{RECEIPTS}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_journal(batch: DataFrame, root: str, keys: list[str], supersede: bool = False) -> DataFrame:
    """Write the partitions of ``batch`` and return a receipt for each: keys, rows, content_hash, decision.

    Partitions with a content that the journal holds already are ``DEDUPLICATED`` and not written again. A partition
    held with other content is a ``CONFLICT`` and stays as it is, unless ``supersede`` adds the new content as its
    next version (``SUPERSEDED``); the old version stays on disk and is read no more. All rows of a call are one new
    version, and become visible with their receipts, which are written last: a call that dies leaves nothing to read,
    and may be repeated.
    """
    spark, types = batch.sparkSession, dict(batch.dtypes)
    version = uuid.uuid4().hex
    held = current_receipts(_receipts(spark, root, keys, types), keys).select(*keys, F.col("content_hash").alias("_held"), F.col("number").alias("_number"))
    met = F.lit(True)
    incoming = content_hash(batch, keys)
    for k in keys:
        met = met & incoming[k].eqNullSafe(held[k])
    other = "SUPERSEDED" if supersede else "CONFLICT"
    decision = F.when(F.col("_held").isNull(), "NEW").when(F.col("_held") == F.col("content_hash"), "DEDUPLICATED").otherwise(other)
    told = incoming.join(held, met, "left").select(*[incoming[k] for k in keys], "rows", "content_hash", F.lit(version).alias("version"), (F.coalesce("_number", F.lit(-1)) + 1).cast("int").alias("number"), decision.alias("decision"))
    staged = f"{root}/_verdicts/{version}"
    told.write.parquet(staged)
    told = spark.read.schema(told.schema).parquet(staged)
    fresh = told.where("decision IN ('NEW', 'SUPERSEDED')")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = batch.join(fresh.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), same, "left_semi").withColumn("version", F.lit(version))
    rows.repartition(*keys).write.mode("append").partitionBy(*keys, "version").parquet(f"{root}/data")
    fresh.coalesce(1).write.mode("append").parquet(f"{root}/{RECEIPTS}")  # one row per new partition
    return told.select(*keys, "rows", "content_hash", "decision")


def current_receipts(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each partition."""
    cols = [c for c in receipts.columns if c not in keys]
    return receipts.groupBy(*keys).agg(F.max_by(F.struct(*cols), "number").alias("_r")).select(*keys, "_r.*")


def read_journal(spark: SparkSession, root: str, schema: str, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """Rows of the current version of every partition that ``wanted`` (some of the key columns) names; without it, of all.

    The receipts, cut to the wanted partitions, are joined with the data on the partition columns: the scan then reads
    the directories that the join leaves (dynamic partition pruning), never those of other keys or older versions.
    Plain filters on key columns prune as well.
    """
    whole = StructType.fromDDL(schema)
    types = {f.name: f.dataType.simpleString() for f in whole}
    current = current_receipts(_receipts(spark, root, keys, types), keys)
    if wanted is not None:
        current = current.join(wanted.distinct(), wanted.columns, "left_semi")
    data = spark.read.schema(f"{schema}, version string").parquet(f"{root}/data")
    live = current.select(*keys, "version")
    return data.join(live, [*keys, "version"]).drop("version").select(*[f.name for f in whole])  # Spark broadcasts the receipts where they are small


def inventory(spark: SparkSession, root: str, schema: str, keys: list[str]) -> DataFrame:
    """One row per partition: keys, rows, content_hash, versions. Reads the receipts alone, no data file."""
    types = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    receipts = _receipts(spark, root, keys, types)
    w = Window.partitionBy(*keys)
    return current_receipts(receipts.withColumn("versions", F.count(F.lit(1)).over(w)), keys).select(*keys, "rows", "content_hash", "versions")
