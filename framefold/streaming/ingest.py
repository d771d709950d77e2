"""Following a growing folder: scores and catalogue rows as files arrive.

Structured Streaming keeps which files it has seen, so a restart resumes; cancelling is query.stop().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framefold.functions import paths
from framefold.operators.sharpness import measures


def watched(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def arriving_images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, kind) of image files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "modificationTime", "length").withColumn("kind", F.expr(f"case when {paths.is_standard('path')} then 'standard' when {paths.is_raw('path')} then 'raw' end")).filter("kind is not null")


def scored(rasters: DataFrame) -> DataFrame:
    """Scores of array rasters; a map, so it is the same on streams."""
    return measures(rasters).select(*[c for c in rasters.columns if c != "p"], "score")


def into(stream: DataFrame, folder: str, checkpoint: str, once: bool = False, every: str = "2 seconds") -> StreamingQuery:
    """Appends a stream to a Parquet folder, each row once; `once` works off what is there and ends."""
    out = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def latest(stream: DataFrame, key: list[str], order: str, apply: Callable[[DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each batch's newest row of each key to `apply`, which merges it idempotently (latest wins)."""

    def run(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        newest = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"))
        apply(newest.select(*key, "r.*"))

    out = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def counts_by_stage(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """How many frames each collection got in each window of event time (ts, collection, score)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "collection").agg(F.count(F.lit(1)).alias("frames"), F.max("score").alias("best"))
