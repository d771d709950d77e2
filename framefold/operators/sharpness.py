"""Sharpness scores of rasters, by array functions in one row each, and filters on scores.  (A1-A5, A7, A9, A26, F1-F3, T2, T7)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefold.functions.stencils import GAUSS3, LAPLACE5, SOBEL_X, SOBEL_Y, convolved, magnitude
from framefold.operators.ranking import numbered


def energy(rasters: DataFrame, p: str = "p") -> DataFrame:
    """Energy, a raster of whole numbers: the 3 by 3 Gauss sums (over 16) of the absolute Laplacian."""
    laplace = rasters.withColumn("_l", F.expr(f"transform({convolved(p, LAPLACE5)}, v -> abs(v))"))
    return laplace.withColumn("energy", F.expr(convolved("_l", GAUSS3))).drop("_l")


def measures(rasters: DataFrame, p: str = "p") -> DataFrame:
    """A1-A4: lap_var, tenengrad, mod_laplacian and their combination, score.

    The Laplacian works on the Gauss-blurred raster, the gradients on the raster itself.  A raster stays one
    row; sums are whole numbers, so they don't depend on their order.
    """
    blurred = rasters.withColumn("_b", F.expr(convolved(p, GAUSS3)))
    rows = blurred.withColumn("_l", F.expr(convolved("_b", LAPLACE5))).withColumn("_x", F.expr(convolved(p, SOBEL_X))).withColumn("_y", F.expr(convolved(p, SOBEL_Y)))
    n = "double(h * w)"
    total = "aggregate({0}, 0L, (a, v) -> a + {1})"
    mean = total.format("_l", "v")
    square = total.format("_l", "bigint(v) * v")
    gradient = total.format("zip_with(_x, _y, (a, b) -> bigint(a) * a + bigint(b) * b)", "v")
    modified = total.format(f"zip_with(_x, _y, (a, b) -> {magnitude('a', 'b')})", "v")
    return rows.withColumns(
        {
            "lap_var": F.expr(f"({square} / {n} - pow({mean} / {n}, 2)) / 256D"),
            "tenengrad": F.expr(f"{gradient} / {n}"),
            "mod_laplacian": F.expr(f"{modified} / {n}"),
        }
    ).withColumn("score", F.expr(f"(0.4D * lap_var + 0.3D * tenengrad + 0.3D * mod_laplacian) / greatest(sqrt({n} / 1e6D), 0.5D)")).drop("_b", "_l", "_x", "_y")


def cells(rasters: DataFrame, grid: int, least: int = 100, p: str = "p") -> DataFrame:
    """The grid cells of rasters as rasters of their own: (keys..., cell, h, w, p).

    There are min(max(grid, 2), h / least, w / least) cells a side; trailing rows and columns that don't fill
    a cell are left out.  Rasters too small for one cell have none.
    """
    keys = [c for c in rasters.columns if c not in ("h", "w", p)]
    g = f"least(greatest({grid}, 2), h div {least}, w div {least})"
    cut = rasters.withColumn("g", F.expr(f"int({g})")).filter("g >= 1").withColumn("ch", F.expr("int(h div greatest(g, 1))")).withColumn("cw", F.expr("int(w div greatest(g, 1))"))
    each = cut.withColumn("cell", F.explode(F.expr("sequence(0, g * g - 1)")))
    part = f"transform(sequence(0, ch * cw - 1), i -> element_at({p}, ((int(cell div g)) * ch + int(i div cw)) * w + (cell % g) * cw + i % cw + 1))"
    return each.withColumn("_p", F.expr(part)).select(*keys, "cell", F.col("ch").alias("h"), F.col("cw").alias("w"), F.col("_p").alias(p))


def regional(rasters: DataFrame, grid: int, least: int = 100, p: str = "p") -> DataFrame:
    """A5: (keys..., max_regional, global_score, sharp_areas); a cell is sharp from 0.7 of the best on.

    A raster too small for a cell counts as one area with the global score.
    """
    keys = [c for c in rasters.columns if c not in ("h", "w", p)]
    whole = measures(rasters, p).select(*keys, F.col("score").alias("global_score"))
    parts = measures(cells(rasters, grid, least, p), p).groupBy(*keys).agg(F.max("score").alias("m"), F.collect_list("score").alias("s"))  # grid * grid at most
    areas = parts.select(*keys, "m", F.expr("size(filter(s, v -> v >= 0.7D * m))").alias("k"))
    return whole.join(areas, keys, "left").select(*keys, F.coalesce("m", "global_score").alias("max_regional"), "global_score", F.coalesce("k", F.lit(1)).cast("long").alias("sharp_areas"))


def statistics(scores: DataFrame, group: list[str]) -> DataFrame:
    """N, mean, median, stddev (population), q1, q3, low, high; quartiles are the values at sorted places n/2, n/4, 3n/4."""
    ranked = numbered(scores.select(*group, "score"), group, ["score"], "place", "n")

    def at(place: str) -> Column:
        return F.max(F.when(F.col("place") == F.expr(place), F.col("score")))

    return ranked.groupBy(*group).agg(
        F.max("n").alias("n"),
        at("n div 2").alias("median"),
        at("n div 4").alias("q1"),
        at("(3 * n) div 4").alias("q3"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("stddev"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    )


def above(scores: DataFrame, threshold: float) -> DataFrame:
    """F1."""
    return scores.filter(F.col("score") >= threshold)


def without_outliers(scores: DataFrame, group: list[str], threshold: float, k: float = 1.5) -> DataFrame:
    """F2: of the scores above the threshold those above max(q1 - k * (q3 - q1), threshold)."""
    kept = above(scores, threshold)
    cut = statistics(kept, group).select(*group, F.greatest(F.col("q1") - k * (F.col("q3") - F.col("q1")), F.lit(float(threshold))).alias("cut"))
    return kept.join(cut, group).filter("score >= cut")


def counted(scores: DataFrame, group: list[str], threshold: float, k: float = 1.5) -> DataFrame:
    """Total, sharp (F1) and kept (F2) frames."""
    sharp = scores.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= threshold).alias("sharp"))
    kept = without_outliers(scores, group, threshold, k).groupBy(*group).agg(F.count(F.lit(1)).alias("kept"))
    return sharp.join(kept, group, "left").na.fill(0, ["kept"]).withColumn("skipped", F.col("total") - F.col("kept"))


def checked(scores: DataFrame, least: int) -> DataFrame:
    """the scores, or an error when the query runs if there are fewer than `least`."""
    n = scores.agg(F.count(F.lit(1)).alias("_n"))
    message = F.format_string("only %d sharp frames, %d are needed", "_n", F.lit(least))
    # A branch of its own, which gives no rows: the check stays where the other branch is known to be empty.
    none = n.filter(F.when(F.col("_n") < least, F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))
    return scores.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in scores.schema.fields]))


def middle_frame(scores: DataFrame, group: list[str]) -> DataFrame:
    """The frame at place n/2 by falling score, earlier frames first among equals."""
    return numbered(scores, group, ["-score", "seq"], "_place", "_n").filter("_place = _n div 2").drop("_place", "_n")


def first_frame(scores: DataFrame, group: list[str]) -> DataFrame:
    """The earliest frame."""
    return scores.groupBy(*group).agg(F.min("seq").alias("seq"), F.min_by("score", "seq").alias("score"))
