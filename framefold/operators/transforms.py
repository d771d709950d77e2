"""Checking, choosing and chaining transforms between frames.  (F4, A17, A24, J8, P31, A18)

A transform is the upper two rows of a matrix, as columns m00 m01 m02 m10 m11 m12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

M = ("m00", "m01", "m02", "m10", "m11", "m12")
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def is_valid(scale: float, shift: float, determinant: float) -> Column:
    """scales within [1/scale, scale], the shift at most `shift`, the determinant's size within [1/determinant, determinant].

    NaN compares above all numbers here, so a transform with NaN is never valid.
    """
    sx, sy = "sqrt(m00 * m00 + m10 * m10)", "sqrt(m01 * m01 + m11 * m11)"
    det = "abs(m00 * m11 - m01 * m10)"
    bounds = [f"{s} between {1 / scale!r}D and {scale!r}D" for s in (sx, sy)]
    return F.expr(f"{' and '.join(bounds)} and sqrt(m02 * m02 + m12 * m12) <= {shift!r}D and {det} between {1 / determinant!r}D and {determinant!r}D")


def near_identity() -> Column:
    """P31."""
    return F.expr("abs(m00 - 1) < 0.01D and abs(m11 - 1) < 0.01D and abs(m01) < 0.01D and abs(m10) < 0.01D and abs(m02) < 1 and abs(m12) < 1")


def by_ladder(candidates: DataFrame, key: list[str], scale: float, shift: float, determinant: float) -> DataFrame:
    """For each key its valid candidate of the least rung, else the identity (rung -1)."""
    good = candidates.filter(is_valid(scale, shift, determinant))
    best = good.groupBy(*key).agg(F.min_by(F.struct(*M), "rung").alias("m"), F.min("rung").alias("rung"))
    rows = candidates.select(*key).distinct().join(best, key, "left")
    return rows.select(*key, F.coalesce("rung", F.lit(-1)).alias("rung"), *[F.coalesce(F.col(f"m.{c}"), F.lit(v)).alias(c) for c, v in zip(M, IDENTITY, strict=True)])


def chained(steps: DataFrame, group: list[str], carry: bool = False) -> DataFrame:
    """Each frame's transform into its chain's first frame: the product of the steps up to it.

    steps: (group..., seq, m..., missing).  A missing step is the identity and starts a new chain; with
    carry it is passed over instead.  A chain's steps are folded in order in one row, which holds what one
    burst of frames has; different chains are different rows.
    """
    by = W.partitionBy(*group).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    island = F.lit(0) if carry else F.sum(F.col("missing").cast("int")).over(by)
    step = F.struct("seq", *[F.when(F.col("missing"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip(M, IDENTITY, strict=True)])
    rows = steps.withColumn("island", island).groupBy(*group, "island").agg(F.sort_array(F.collect_list(step)).alias("s"))
    start = "named_struct('seq', s[0].seq, " + ", ".join(f"'{c}', {v!r}D" for c, v in zip(M, IDENTITY, strict=True)) + ")"
    product = (
        "named_struct('seq', x.seq, 'm00', t.m00 * x.m00 + t.m01 * x.m10, 'm01', t.m00 * x.m01 + t.m01 * x.m11, 'm02', t.m00 * x.m02 + t.m01 * x.m12 + t.m02, "
        "'m10', t.m10 * x.m00 + t.m11 * x.m10, 'm11', t.m10 * x.m01 + t.m11 * x.m11, 'm12', t.m10 * x.m02 + t.m11 * x.m12 + t.m12)"
    )
    # The folded array grows by one a step; its last element is the product so far.
    fold = f"aggregate(s, array({start}), (a, x) -> array_append(a, transform(array(element_at(a, -1)), t -> {product})[0]), a -> slice(a, 2, size(a)))"
    return rows.select(*group, F.explode(F.expr(fold)).alias("t")).select(*group, "t.*")


def with_transform(frames: DataFrame, transforms: DataFrame, key: list[str]) -> DataFrame:
    """A frame's transform, the identity where there is none."""
    joined = frames.join(transforms.select(*key, F.struct(*M).alias("_m")), key, "left")
    return joined.select(*frames.columns, *[F.coalesce(F.col(f"_m.{c}"), F.lit(v)).alias(c) for c, v in zip(M, IDENTITY, strict=True)])


def bounding_box(masks: DataFrame, group: list[str], mask: str = "mask") -> DataFrame:
    """X, y, width, height of the pixels that are opaque in the raster; the whole frame where there are none."""
    places = F.expr(f"filter(transform({mask}, (v, i) -> if(v > 0, i, -1)), i -> i >= 0)")
    rows = masks.withColumn("_i", places)
    xs, ys = "transform(_i, i -> i % w)", "transform(_i, i -> int(i div w))"
    some = F.expr("size(_i) > 0")
    return rows.select(
        *group,
        F.when(some, F.expr(f"array_min({xs})")).otherwise(0).cast("int").alias("x"),
        F.when(some, F.expr(f"array_min({ys})")).otherwise(0).cast("int").alias("y"),
        F.when(some, F.expr(f"array_max({xs}) - array_min({xs}) + 1")).otherwise(F.col("w")).cast("int").alias("width"),
        F.when(some, F.expr(f"array_max({ys}) - array_min({ys}) + 1")).otherwise(F.col("h")).cast("int").alias("height"),
    )
