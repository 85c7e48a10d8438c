"""Aggregates over a folder of files, some files at a time: each micro-batch's partials are merged into the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orrery.session import scratch

#: Column for the number of a micro-batch.
BATCH = "__batch"


def stream_files(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", pattern).parquet(folder)


def aggregate(stream: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Run the grouped (or global) aggregate over all that there is, then give its result as a batch.

    Each micro-batch writes the groups that it changed to the shared folder, over what a failed run of it
    left; the last state of each group is the result. Groups never come to the driver. Without any file
    the result is that of an empty table.
    """
    spark, folder = stream.sparkSession, scratch(stream.sparkSession, "bounded")
    grouped = stream.groupBy(*keys).agg(*aggregates)
    numbers: list[int] = []

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/groups/{BATCH}={number}")
        numbers.append(number)

    run = grouped.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
    query = run.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not numbers:
        return spark.createDataFrame([], stream.schema).groupBy(*keys).agg(*aggregates)
    states = spark.read.schema(StructType([*grouped.schema.fields, StructField(BATCH, LongType())])).parquet(f"{folder}/groups")
    if not keys:
        return states.orderBy(F.desc(BATCH)).limit(1).select(*(F.col(f"`{c}`") for c in grouped.columns))
    named, values = grouped.columns[: len(keys)], grouped.columns[len(keys) :]
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in values)), BATCH).alias("__last")
    return states.groupBy(*(F.col(f"`{c}`") for c in named)).agg(last).select(*(F.col(f"`{c}`") for c in named), "__last.*")


def rows(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Row-wise stages (filter, projection) written as they come, then read as a batch."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder)
