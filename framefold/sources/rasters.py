"""Rasters: an image is a row of packed bytes, or of an array of whole numbers in row-major order.

Up to a few thousand pixels (fixtures, thumbnails, tiles) the array form stays in one row and is worked on
with array functions, without shuffles; beyond that the packed form goes through numpy in Arrow batches
(operators/kernels.py).  Exploded pixels occur only where rows are grouped by pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.sources.tables import table

SIDE = 8


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stack, img, h, w, p): each embedding as an 8 by 8 grey raster, its label as stack."""
    grey = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("stack"), F.col("vec_id").alias("img"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), grey.alias("p"))


def alpha(p: str = "p") -> str:
    """SQL: a transparency raster for frames(): every seventh pixel is transparent."""
    return f"transform({p}, (v, i) -> if((img + i div w + i % w) % 7 = 0, 0, 255))"


def exploded(rasters: DataFrame, *arrays: str) -> DataFrame:
    """One row for each pixel: y, x, and the element of each array column."""
    keep = [c for c in rasters.columns if c not in arrays]
    zipped = rasters.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("i", "v"))
    return zipped.select(*keep, F.expr("int(i div w)").alias("y"), F.expr("int(i % w)").alias("x"), *[F.col(f"v.{a}").alias(a) for a in arrays])
