"""A whole series: from a folder of pictures to the fused one, with tables that let a run resume.

    FOLDER/*                   the frames: PNG, TIFF and JPEG files
    FOLDER/sharpness/          scores, a table that is replaced
    FOLDER/aligned/            aligned frames, a table that is added to; a frame that is there isn't warped again
    FOLDER/bunches/level=*/    what each round of fusing but the last gave, as L0_B0000.png and so on; a table a level
    FOLDER/.thumbnails/        previews, which clear_cache deletes
    FOLDER/final/result_*.png  results; the smallest free number is taken
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framefold.config import Settings
from framefold.functions import paths
from framefold.operators import catalog, kernels, sharpness
from framefold.plans import align, previews, stack
from framefold.sources import images


def frames_of(spark: SparkSession, folder: str) -> DataFrame:
    """(stack, img, path, h, w, c, data): a folder's pictures, numbered by path; pixels don't enter the numbering."""
    rows = images.read_files(spark, folder)
    places = rows.select("path").withColumn("img", F.row_number().over(W.orderBy("path")).cast("long"))  # names of one folder
    return rows.join(places, "path").withColumn("stack", F.lit(0))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scored(frames: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """K5: the scores of all frames, as a table that replaces the last."""
    path = f"{folder}/sharpness"
    align.scores(frames.select("stack", "img", "path", "h", "w", "c", "data"), settings).write.mode("overwrite").parquet(path)
    return frames.sparkSession.read.parquet(path)


def aligned(frames: DataFrame, scores: DataFrame, folder: str, settings: Settings, resume: bool, most: int, way: str = "features") -> DataFrame:
    """K1, K2, K9: the aligned frames; with resume those that are there stay and only the others are warped."""
    spark, path = frames.sparkSession, f"{folder}/aligned"
    if not resume and "aligned" in catalog.reset_targets("align", resume):
        removed(spark, path)
    sharp = sharpness.without_outliers(scores, ["stack"], settings.sharpness_threshold, settings.iqr_multiplier)
    kept = frames.join(sharp.select("stack", "img"), ["stack", "img"], "left_semi")
    chains = align.places(kept, settings, most, way)
    inputs = kept.withColumn("out_name", F.format_string("%04d.png", "img"))
    if exists(spark, path):
        inputs = catalog.unfinished(inputs, spark.read.parquet(path))
    done = align.warped(inputs, chains).withColumn("out_name", F.format_string("%04d.png", "img"))
    done.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def free_name(spark: SparkSession, folder: str) -> str:
    """K4."""
    if not exists(spark, f"{folder}/final"):
        return "result_0001.png"
    taken = catalog.scan(spark, f"{folder}/final").select(F.lit(0).alias("g"), F.expr(f"try_cast(regexp_extract({paths.filename('path')}, '^result_([0-9]+)[.]png$', 1) as bigint)").alias("n"))
    found = catalog.free_number(taken.filter("n is not null"), ["g"]).first()
    return f"result_{found['n'] if found else 1:04d}.png"


def bunches(spark: SparkSession, folder: str, level: int) -> DataFrame:
    """(stack, img, out_name, h, w, c, data): the bunches of a level that are there."""
    return spark.read.parquet(f"{folder}/bunches/level={level}").withColumnRenamed("ord", "img")


def written_bunches(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], DataFrame]:
    """K3: writes a round's bunches, and gives them as the next round reads them, without their lineage."""

    def keep(rows: DataFrame, level: int) -> DataFrame:
        path = f"{folder}/bunches/level={level}"
        rows.withColumn("out_name", F.format_string("L%d_B%04d.png", F.lit(level), "ord")).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path).select(rows.columns)

    return keep


def run(spark: SparkSession, folder: str, settings: Settings = Settings(), resume: bool = True, most: int = 5000, way: str = "features") -> str:
    """The path of the picture that was written."""
    frames = frames_of(spark, folder)
    done = aligned(frames, scored(frames, folder, settings), folder, settings, resume, most, way)
    if done.limit(1).count() == 0:
        raise ValueError("no frame is sharp enough")
    for stage in catalog.reset_targets("aligned", resume):
        removed(spark, f"{folder}/{stage}")
    result = stack.stack(done.drop("out_name"), settings, align.common_area(done), written_bunches(spark, folder))
    return finished(result, folder)


def restacked(spark: SparkSession, folder: str, settings: Settings = Settings(), level: int = 0) -> str:
    """The path of a picture that is fused from the bunches of a level; they stay, and no others are written.

    It has the whole frame: bunches are cut to no common area, but clear where a frame is.
    """
    return finished(stack.stack(bunches(spark, folder, level), settings), folder)


def finished(result: DataFrame, folder: str) -> str:
    """Writes a fused picture under the smallest free name."""
    name = free_name(result.sparkSession, folder)
    images.write_files(images.as_png(result.select(F.lit(name).alias("name"), "h", "w", "c", "data")), f"{folder}/final")
    return f"{folder}/final/{name}"


def resized(frames: DataFrame, folder: str, height: int, width: int) -> DataFrame:
    """K6: the frames in that size, as a table under FOLDER/resized that replaces the last."""
    path = f"{folder}/resized"
    kernels.mapped(frames.select("stack", "img", "path", "h", "w", "c", "data"), lambda image: kernels.to_bytes(kernels.resized(image.astype(float), height, width, kernels.lanczos_taps))).write.mode("overwrite").parquet(path)
    return frames.sparkSession.read.parquet(path)


def cached_previews(frames: DataFrame, folder: str, width: int = 1920, height: int = 1080) -> DataFrame:
    """K7: (path, content): the frames fitted to a screen, as JPEG files, in a table under FOLDER/.thumbnails that replaces the last."""
    path = f"{folder}/.thumbnails/previews"
    images.as_jpeg(previews.previews(frames.select("path", "h", "w", "c", "data"), width, height)).write.mode("overwrite").parquet(path)
    return frames.sparkSession.read.parquet(path)


def clear_cache(spark: SparkSession, folder: str) -> bool:
    """Deletes a folder's thumbnails; whether there were any."""
    path = f"{folder}/.thumbnails"
    found = exists(spark, path)
    if found:
        removed(spark, path)
    return found
