"""The image catalogue: scans, caches, selections and names as DataFrame operators.

Catalogue tables have a row for each file.  Nothing here gathers a collection in one task, but for
neighbours(), which orders the file names of one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framefold.functions import paths
from framefold.operators.ranking import numbered


def scan(spark: SparkSession, folder: str, raw: bool = True) -> DataFrame:
    """The image files of a folder, not of its subfolders.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    kind = paths.is_standard("path") + (f" or {paths.is_raw('path')}" if raw else "")
    return files.select("path", "modificationTime", "length").filter(F.expr(kind))


def listed(spark: SparkSession, files: list[str]) -> DataFrame:
    """S3: an explicit list, in its given order."""
    return spark.createDataFrame(list(enumerate(files)), "seq long, path string")


def classified(files: DataFrame) -> DataFrame:
    """Extension, kind and whether a file is an image at all."""
    kind = F.expr(f"case when {paths.is_standard('path')} then 'standard' when {paths.is_raw('path')} then 'raw' else 'other' end")
    return files.withColumn("ext", F.expr(paths.extension("path"))).withColumn("kind", kind).withColumn("is_image", F.col("kind") != "other")


def derived_paths(files: DataFrame) -> DataFrame:
    """Names of what is made from a file."""
    folder, stem, name = paths.folder("path"), paths.stem("path"), paths.filename("path")
    return files.withColumns(
        {
            "filename": F.expr(name),
            "stem": F.expr(stem),
            "score_path": F.expr(f"concat({folder}, 'sharpness/', {stem}, '.yml')"),
            "thumb_path": F.expr(f"concat({folder}, '.thumbnails/', {name}, '.png')"),
            "preview_path": F.expr(f"concat({folder}, '.previews/', {stem}, '_1920.jpg')"),
            "resized_path": F.expr(f"concat({folder}, 'resized/', if({paths.is_raw('path')}, concat({stem}, '.png'), {name}))"),
        }
    )


def fresh(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources whose cache entry is no older.  Both have (path, mtime)."""
    return sources.join(cache.select("path", F.col("mtime").alias("cached")), "path").filter("cached >= mtime")


def missing(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources without a fresh cache entry."""
    return sources.join(fresh(sources, cache).select("path"), "path", "left_anti")


def scores_or_cached(computed: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """The cached score where there is one for the whole key, else the computed one.

    The key may hold path, grid size and time, so a stale score is not taken.
    """
    return computed.join(cache.select(*key, F.col("score").alias("cached")), key, "left").withColumn("from_cache", F.col("cached").isNotNull()).withColumn("score", F.coalesce("cached", "score")).drop("cached")


def image_of_score(scores: DataFrame, images: DataFrame) -> DataFrame:
    """A score's image by exact file name, else by stem (the first by path); image_path is null where neither is found.

    scores: (filename, stem, ...); images: (path, filename, stem).  Both joins are equi-joins on distinct keys.
    """
    exact = images.groupBy("filename").agg(F.min("path").alias("by_name"))
    loose = images.groupBy("stem").agg(F.min("path").alias("by_stem"))
    return scores.join(exact, "filename", "left").join(loose, "stem", "left").withColumn("image_path", F.coalesce("by_name", "by_stem")).drop("by_name", "by_stem")


def first_image_by_stem(scores: DataFrame, images: DataFrame) -> DataFrame:
    """Inner equi-join on the stem, first match only."""
    return scores.join(images.groupBy("stem").agg(F.min("path").alias("image_path")), "stem")


def with_image(scores: DataFrame, images: DataFrame) -> DataFrame:
    """Scores whose image exists."""
    return scores.join(images.select("filename"), "filename", "left_semi")


def unfinished(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """K2: inputs whose output name doesn't exist yet, so that a run can resume."""
    return inputs.join(outputs.select("out_name"), "out_name", "left_anti")


def free_number(existing: DataFrame, group: list[str]) -> DataFrame:
    """K4: for each group the smallest n from 1 on that is not taken (column n).

    The taken numbers up to a gap are as many as their rank, so the first break is one more than the
    longest run from 1: a window over distinct numbers, without a table of candidates.
    """
    taken = existing.filter("n >= 1").select(*group, "n").distinct()
    run = taken.withColumn("k", F.row_number().over(W.partitionBy(*group).orderBy("n"))).filter("n = k")
    tops = run.groupBy(*group).agg(F.max("n").alias("top"))
    return existing.select(*group).distinct().join(tops, group, "left").select(*group, (F.coalesce("top", F.lit(0)) + 1).alias("n"))


def toggled(selection: DataFrame, item: DataFrame) -> DataFrame:
    """O1: symmetric difference on path; what is added goes to the end.  Both have (path, place)."""
    kept = selection.join(item.select("path"), "path", "left_anti")
    new = item.join(selection.select("path"), "path", "left_anti")
    last = selection.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("last"))  # one row
    return kept.select("path", "place").unionByName(new.crossJoin(F.broadcast(last)).select("path", (F.col("place") + F.col("last") + 1).alias("place")))


def merged_stages(before: DataFrame, scan_: DataFrame) -> DataFrame:
    """Stages that the scan found replace what was listed; the others stay.  Both have a stage column."""
    found = scan_.select("stage").distinct()
    return before.join(F.broadcast(found), "stage", "left_anti").unionByName(scan_)  # as many rows as there are stages


def without(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table without the deleted files, by path or, for scores, by stem."""
    return {name: rows.join(deleted.select(key).distinct(), key, "left_anti") for name, rows in tables.items() for key in (["stem"] if "path" not in rows.columns else ["path"])}


def preferred_source(originals: DataFrame, resized: DataFrame, group: str) -> DataFrame:
    """for each group the resized files where there are any, else the originals."""
    has = resized.select(group).distinct()
    return resized.unionByName(originals.join(has, group, "left_anti"))


def neighbours(files: DataFrame, group: list[str]) -> DataFrame:
    """Next and previous file of a folder, wrapping round, and how far through the folder a file is."""
    by = W.partitionBy(*group).orderBy("path")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return files.withColumns(
        {
            "next_path": F.coalesce(F.lead("path").over(by), F.first("path").over(whole)),
            "prev_path": F.coalesce(F.lag("path").over(by), F.last("path").over(whole)),
            "progress": F.row_number().over(by) * 100.0 / F.count("path").over(whole),
        }
    )


def tumbling(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Batches of `size` rows in order."""
    return numbered(rows, group, order, "_place").withColumn("batch", F.expr(f"_place div {size}")).drop("_place")


def overlapping(rows: DataFrame, group: list[str], order: list[str], size: int, overlap: int) -> DataFrame:
    """Chunks of `size` rows that share `overlap` with the one before, until one reaches the end.

    A row in the overlap occurs once for each of its chunks; place is its rank in the group.
    """
    if size <= overlap:
        raise ValueError("a chunk must be larger than the overlap")
    step = size - overlap
    ranked = numbered(rows, group, order, "place", "_n")
    last = f"greatest(0L, bigint(ceil((_n - {size}) / {step}D)))"
    lowest = f"greatest(0L, bigint(ceil((place - {size - 1}) / {step}D)))"
    return ranked.withColumn("chunk", F.explode(F.expr(f"sequence({lowest}, least({last}, place div {step}))"))).drop("_n")


def reset_targets(first_input_stage: str, resume: bool) -> tuple[str, ...]:
    """K9: the stages that a run empties before it starts; bunches stay when they are the input."""
    if first_input_stage == "align":
        return () if resume else ("aligned", "bunches")
    return () if first_input_stage == "bunches" else ("bunches",)
