"""The tables of a data folder seen as image collections, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.sources.rasters import alpha, frames
from framefold.sources.tables import table

EXTENSIONS = ("jpg", "JPG", "png", "tif", "ARW", "cr2", "txt")
STAGES = ("imported", "sharpness", "aligned", "bunches", "final")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, stage, mtime, width): a file for each document."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 7 + 1).cast("int"))
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d/IMG_"), F.col("doc_id"), F.lit("."), ext).alias("path"), stage.alias("stage"), (F.col("doc_id") % 100).alias("mtime"), (F.col("doc_id") + 4000).alias("width"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, mtime, score): cached scores of the files that have a label."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("doc_id") * 7) % 100).alias("cached_at"), (F.col("doc_id") % 13 + F.col("quality") * 100.0).alias("score"))
    return files(spark, sf_dir).join(known, "id").select("path", F.col("cached_at").alias("mtime"), "score")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collection, seq, score)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.col("event_id").alias("seq"), F.col("value").alias("score"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, seq, m00 .. m12, missing): the items of an order as steps between frames."""
    from pyspark.sql import Window as W

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long"))
    return rows.select(
        F.col("l_orderkey").alias("chain"),
        "seq",
        (1 + F.col("l_discount") / 7).alias("m00"),
        (F.col("l_tax") / 3).alias("m01"),
        (F.col("l_quantity") / 7).alias("m02"),
        (-F.col("l_tax") / 3).alias("m10"),
        (1 + F.col("l_discount") / 7).alias("m11"),
        (-F.col("l_quantity") / 11).alias("m12"),
        (F.col("l_returnflag") == "R").alias("missing"),
    )


def frames_with_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("alpha", F.expr(alpha()))


def keypoints(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """(stack, img, kp_id, response, desc): ten vectors in turn are the keypoints of a frame, five frames are a stack.

    Descriptors are the whole numbers of the raster, or 64-bit codes of where it is above its middle.
    """
    rows = frames(spark, sf_dir)
    code = F.expr("aggregate(sequence(0, 63), 0L, (a, i) -> a | if(p[i] > 127, shiftleft(1L, i), 0L))")
    desc = F.array(code) if binary else F.col("p").cast("array<bigint>")
    return rows.select((F.expr("img div 50")).alias("stack"), F.expr("img div 10").alias("img"), F.expr("img % 10").alias("kp_id"), F.expr("double(p[0])").alias("response"), desc.alias("desc"))
