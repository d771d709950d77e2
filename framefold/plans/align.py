"""Aligning a series: score, filter, match, fit, chain, warp and crop as one DataFrame pipeline.

Frames: (stack, img, h, w, c, data).  Pixels are read twice, for features and for the warp; between these only
scores, keypoints and transforms move.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framefold.config import Settings, odd_kernel
from framefold.operators import estimation, kernels, matching, sharpness, transforms


#: What features are found in: rasters made smaller by this.
SMALLER = 0.85


def scores(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(keys..., score, global_score, sharp_areas): a frame's score is that of its best region."""
    return kernels.regional(frames, settings.grid_size).withColumnRenamed("max_regional", "score")


def sharp_frames(frames: DataFrame, settings: Settings = Settings(), cached: DataFrame | None = None) -> DataFrame:
    """(stack, img, score) of the frames that pass the threshold and the quartile filter; cached scores are taken first."""
    slim = frames.select("stack", "img", "h", "w", "c", "data")
    if cached is None:
        found = scores(slim, settings).select("stack", "img", "score")
    else:
        todo = slim.join(cached.select("stack", "img"), ["stack", "img"], "left_anti")
        found = scores(todo, settings).select("stack", "img", "score").unionByName(cached.select("stack", "img", "score"))
    # Quartiles, places and the filter read the scores; pixels are scored once in a call (files may change after it).
    found = found.withColumn("_call", F.lit(uuid4().hex)).persist(StorageLevel.MEMORY_AND_DISK).drop("_call")
    return sharpness.without_outliers(found, ["stack"], settings.sharpness_threshold, settings.iqr_multiplier).select("stack", "img", "score")


def pair_transforms(frames: DataFrame, settings: Settings = Settings(), most: int = 5000) -> DataFrame:
    """(stack, img, m00 .. m12, missing): each frame's step from its own places to those of the frame before it."""
    points = estimation.features(frames.select("img", "h", "w", "c", "data"), most, settings.use_clahe, SMALLER, settings.detector)
    stacks = frames.select("stack", "img")
    keyed = points.join(stacks, "img")
    matches = matching.nearest(matching.consecutive(keyed.select("stack", "img", "kp_id", "desc"), ["stack"]), ["stack"], binary=settings.detector in estimation.BINARY)
    best = matching.best_matches(matches, ["stack", "query_img"])
    before = stacks.withColumn("train_img", F.lag("img").over(W.partitionBy("stack").orderBy("img"))).select("stack", F.col("img").alias("query_img"), "train_img")
    at = keyed.select("stack", "img", "kp_id", "x", "y")
    query = at.select("stack", F.col("img").alias("query_img"), F.col("kp_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    train = at.select("stack", F.col("img").alias("train_img"), F.col("kp_id").alias("train_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    paired = best.join(before, ["stack", "query_img"]).join(query, ["stack", "query_img", "query_id"]).join(train, ["stack", "train_img", "train_id"])
    fits = estimation.fitted(paired.select("stack", F.col("query_img").alias("img"), "qx", "qy", "tx", "ty"), ["stack", "img"])
    good = fits.filter(F.col("found") & transforms.is_valid(settings.max_scale, settings.max_translation, settings.max_determinant))
    rows = stacks.join(good.select("stack", "img", *transforms.M), ["stack", "img"], "left")
    return rows.withColumn("missing", F.col("m00").isNull())


def warped(frames: DataFrame, chains: DataFrame) -> DataFrame:
    """Frames with their transforms applied, as BGRA; alpha is 0 outside the source."""
    rows = transforms.with_transform(frames.select("stack", "img", "h", "w", "c", "data"), chains, ["stack", "img"])
    schema = frames.select("stack", "img", "h", "w", "c", "data").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.single(batches):
            out = []
            for r in batch.to_pylist():
                image = kernels.unpacked(r["data"], r["h"], r["w"], r["c"])
                colour = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]
                own = image[..., 3] if image.ndim == 3 and image.shape[2] == 4 else np.full(image.shape[:2], 255, np.uint8)
                m = np.array([r[c] for c in transforms.M]).reshape(2, 3)
                nearest = kernels.warped(own.astype(np.float32), m, taps=lambda t: [(0, (t < 0.5) * 1.0), (1, (t >= 0.5) * 1.0)])
                done = np.dstack([kernels.to_bytes(kernels.warped(colour.astype(np.float32), m)), kernels.to_bytes(nearest)])
                out.append({k: r[k] for k in ("stack", "img", "h", "w")} | {"c": 4, "data": done.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(n) for n in ("stack", "img", "h", "w", "c", "data")]))

    return rows.mapInArrow(run, schema)


def common_area(aligned: DataFrame) -> DataFrame:
    """(stack, x, y, width, height): the rectangle of pixels that are opaque in every frame.

    Each frame gives its opaque box; what all have in common is the boxes' intersection, so a row a frame
    is shuffled and no pixels are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.single(batches):
            out = []
            for r in batch.to_pylist():
                alpha = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 4)[..., 3] > 0
                ys, xs = np.flatnonzero(alpha.any(axis=1)), np.flatnonzero(alpha.any(axis=0))
                box = (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(xs) else (0, 0, r["w"], r["h"])
                out.append({"stack": r["stack"], **dict(zip(("x0", "y0", "x1", "y1"), box, strict=True))})
            kinds = [batch.schema.field("stack"), *[pa.field(n, pa.int32()) for n in ("x0", "y0", "x1", "y1")]]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    kind = dict(aligned.dtypes)["stack"]
    boxes = aligned.select("stack", "h", "w", "data").mapInArrow(run, f"stack {kind}, x0 int, y0 int, x1 int, y1 int")
    inner = boxes.groupBy("stack").agg(F.max("x0").alias("x"), F.max("y0").alias("y"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    return inner.select("stack", "x", "y", F.greatest(F.col("x1") - F.col("x"), F.lit(0)).alias("width"), F.greatest(F.col("y1") - F.col("y"), F.lit(0)).alias("height"))


def ecc_transforms(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(stack, img, way, m00 .. m12): each frame to its stack's first one, by correlation, with the settings'
    motion, rounds, epsilon, blur, time limit and limits; where that fails by features, and then not at all.

    The first frame of a stack is one raster, which goes to the frames of its stack.
    """
    rows = frames.select("stack", "img", "h", "w", "c", "data")
    first = rows.groupBy("stack").agg(F.min("img").alias("img")).join(rows, ["stack", "img"]).select("stack", F.col("img").alias("first"), F.col("data").alias("ref"), F.col("h").alias("rh"), F.col("w").alias("rw"))
    pairs = rows.join(first, "stack").filter("h = rh and w = rw").select(*rows.columns, "ref", "first")
    limits = (settings.max_scale, settings.max_translation, settings.max_determinant)
    found = estimation.registered(pairs.filter("img <> first").drop("first"), ["stack", "img"], settings.motion, settings.ecc_iterations, settings.ecc_epsilon, limits, odd_kernel(settings.ecc_blur), settings.ecc_timeout_s, settings.use_clahe)
    own = pairs.filter("img = first").select("stack", "img", F.lit("reference").alias("way"), *[F.lit(float(v)).alias(c) for c, v in zip(transforms.M, (1, 0, 0, 0, 1, 0), strict=True)])
    return found.unionByName(own)


def turned_back(found: DataFrame) -> DataFrame:
    """The inverses of transforms m00 .. m12: correlation takes reference places to the frame's, warping the other way."""
    det = F.col("m00") * F.col("m11") - F.col("m01") * F.col("m10")
    a, b, c, d = F.col("m11") / det, -F.col("m01") / det, -F.col("m10") / det, F.col("m00") / det
    other = [x for x in found.columns if x not in transforms.M]
    x, y = -(a * F.col("m02") + b * F.col("m12")), -(c * F.col("m02") + d * F.col("m12"))
    return found.select(*other, *[v.alias(n) for n, v in zip(transforms.M, (a, b, x, c, d, y), strict=True)])


def align(frames: DataFrame, settings: Settings = Settings(), cached: DataFrame | None = None, most: int = 5000, way: str = "features") -> DataFrame:
    """The sharp frames of each stack in the places of its first one: (stack, img, h, w, c, data).

    way: "features" chains each frame's step to the one before it; "ecc" correlates each with the first.
    """
    sharp = frames.join(sharp_frames(frames, settings, cached).select("stack", "img"), ["stack", "img"], "left_semi")
    return warped(sharp, places(sharp, settings, most, way))


def places(sharp: DataFrame, settings: Settings = Settings(), most: int = 5000, way: str = "features") -> DataFrame:
    """(stack, img, m00 .. m12): what brings each frame to its stack's first one."""
    if way == "ecc":
        return turned_back(ecc_transforms(sharp, settings)).select("stack", "img", *transforms.M)
    if way != "features":
        raise ValueError(f"{way}: features or ecc")
    steps = pair_transforms(sharp, settings, most).withColumnRenamed("img", "seq")
    return transforms.chained(steps.select("stack", "seq", *transforms.M, "missing"), ["stack"]).withColumnRenamed("seq", "img")
