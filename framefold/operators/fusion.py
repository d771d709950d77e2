"""Per-pixel fusion of frames, transparency, and pointwise post-processing.  (A8, A10, A11, A14, A16, A27, P11, P13, P20, P22, P25, S10)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefold.functions.stencils import ELLIPSE11, saturated
from framefold.operators.sharpness import energy
from framefold.sources.rasters import exploded



def winners(rasters: DataFrame, group: list[str], weight: str = "energy") -> DataFrame:
    """(group..., y, x, p, img): each pixel from the frame with the most energy there.

    Frames are taken from the last to the first, and only more energy replaces a pixel, so of equal ones
    the last frame's stays.  The maximum combines before the shuffle: a partition sends a row for each
    pixel of a stack, however many frames the stack has.
    """
    pixels = exploded(rasters.select(*group, "img", "w", "p", F.col(weight).alias("e")), "p", "e")
    best = F.max(F.struct("e", "img", "p")).alias("b")
    return pixels.groupBy(*group, "y", "x").agg(best).select(*group, "y", "x", "b.p", "b.img")


def fused(rasters: DataFrame, group: list[str]) -> DataFrame:
    """The winners by sharpness energy."""
    return winners(energy(rasters), group)


def alpha_weighted(rasters: DataFrame, group: list[str], alpha: str = "alpha", compat: bool = True) -> DataFrame:
    """A10: rasters with energy scaled by transparency (times 255, in whole numbers).

    The first frame that is taken, the last of its stack, is not weighted (compat), or is like the others.
    """
    rows = energy(rasters)
    last = rasters.groupBy(*group).agg(F.max("img").alias("_last"))
    rows = rows.join(last, group)
    scaled = f"if({'img = _last' if compat else 'false'}, bigint(e) * 255, bigint(e) * a)"
    return rows.withColumn("energy", F.expr(f"zip_with(energy, {alpha}, (e, a) -> {scaled})")).drop("_last")


def alpha_and(rasters: DataFrame, group: list[str], alpha: str = "alpha") -> DataFrame:
    """Opaque (255) where all frames are, else 0."""
    pixels = exploded(rasters.select(*group, "w", F.col(alpha).alias("a")), "a")
    return pixels.groupBy(*group, "y", "x").agg(F.when(F.min("a") > 0, 255).otherwise(0).alias("alpha"))


def eroded(rasters: DataFrame, alpha: str = "alpha", reach: tuple[int, ...] = ELLIPSE11) -> DataFrame:
    """The least alpha under the structuring element; beyond the border nothing counts."""
    half = len(reach) // 2
    rows = [f"slice({alpha}, yy * w + greatest(0, int(i % w) - {r}) + 1, least(w - 1, int(i % w) + {r}) - greatest(0, int(i % w) - {r}) + 1)" for r in reach]
    per_row = "case yy - int(i div w) " + " ".join(f"when {k - half} then array_min({s})" for k, s in enumerate(rows)) + " end"
    near = f"sequence(greatest(0, int(i div w) - {half}), least(h - 1, int(i div w) + {half}))"
    return rasters.withColumn("eroded", F.expr(f"transform(sequence(0, int(h * w) - 1), i -> array_min(transform({near}, yy -> {per_row})))"))


def census(rasters: DataFrame, group: list[str], alpha: str = "alpha") -> DataFrame:
    """Least, greatest and mean alpha, and how many pixels are at least 128 and 250."""
    each = rasters.select(
        *group,
        F.expr(f"array_min({alpha})").alias("lo"),
        F.expr(f"array_max({alpha})").alias("hi"),
        F.expr(f"aggregate({alpha}, 0L, (a, v) -> a + v)").alias("s"),
        F.size(alpha).alias("n"),
        F.expr(f"size(filter({alpha}, v -> v >= 128))").alias("h"),
        F.expr(f"size(filter({alpha}, v -> v >= 250))").alias("o"),
    )
    n = F.sum("n")
    return each.groupBy(*group).agg(F.min("lo").alias("min_alpha"), F.max("hi").alias("max_alpha"), (F.sum("s") / n).alias("mean_alpha"), F.sum("h").alias("half_opaque"), F.sum("o").alias("opaque"), (F.sum("o") * 100 / n).alias("opaque_pct"))


def cropped(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The pixels of a rectangle, counted from its corner."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return pixels.filter(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def coloured(b: str, g: str, r: str, saturation: float, contrast: float, brightness: float, fix: bool = False) -> list[Column]:
    """P25: blue, green and red after colour correction.

    The saturation factor scales the value of hue, saturation and value, which is the same as scaling all
    three channels until the largest is 255; with fix it scales the distance from that largest channel
    instead, which is saturation proper.  Contrast and brightness follow.
    """
    top = f"greatest({b}, {g}, {r})"
    held = f"double({saturated(f'{top} * {saturation!r}D')})"
    out = []
    for c in (b, g, r):
        toned = saturated(f"{top} - ({top} - {c}) * {saturation!r}D") if fix else saturated(f"if({top} = 0, 0, {c} * {held} / {top})")
        out.append(F.expr(saturated(f"{toned} * {contrast!r}D + {brightness!r}D")))
    return out


def with_alpha(rasters: DataFrame, p: str = "p") -> DataFrame:
    """A fully opaque alpha raster."""
    return rasters.withColumn("alpha", F.expr(f"transform({p}, v -> 255)"))


def warped_nearest(rasters: DataFrame, mask: str = "alpha") -> DataFrame:
    """P20: the mask under the inverse of the row's transform m00 .. m12, by the nearest pixel; 0 outside the frame."""
    det = "(m00 * m11 - m01 * m10)"
    sx = f"(m11 * (i % w - m02) - m01 * (int(i div w) - m12)) / {det}"
    sy = f"(m00 * (int(i div w) - m12) - m10 * (i % w - m02)) / {det}"
    at = f"transform(array(named_struct('x', int(floor({sx} + 0.5D)), 'y', int(floor({sy} + 0.5D)))), s -> if(s.x between 0 and w - 1 and s.y between 0 and h - 1, element_at({mask}, s.y * w + s.x + 1), 0))[0]"
    return rasters.withColumn("warped", F.expr(f"transform(sequence(0, int(h * w) - 1), i -> {at})"))


def demosaiced(mosaics: DataFrame, black: float | tuple[float, float, float], white: float | tuple[float, float, float], gain: tuple[float, float, float], p: str = "p", layout: str = "RGGB") -> DataFrame:
    """(keys..., y, x, b, g, r): half the size (a pixel at least), by averages over each 2 by 2 block of a mosaic.

    layout: the colours of a block, line by line.  black and white: one number, or one for red, green and blue each.
    Samples are scaled by (v - black) / max(white - black, 1) and held in 0 .. 1; the average of a colour's samples is
    multiplied by its gain over green's, held again and written as 0 .. 255.  A gain of 0 or less is none, and a colour
    without a sample is 0.
    """
    if len(layout) != 4 or set(layout) - set("RGB"):
        raise ValueError(f"{layout}: four of R, G and B")
    keys = [c for c in mosaics.columns if c not in ("h", "w", p)]
    iy, ix = "int(i div greatest(1, int(w div 2)))", "int(i % greatest(1, int(w div 2)))"
    lows, tops = ([v] * 3 if isinstance(v, (int, float)) else list(v) for v in (black, white))
    green_gain = gain[1] if gain[1] > 0 else 1.0

    def shown(colour: str) -> str:
        k = "RGB".index(colour)
        span = max(float(tops[k] - lows[k]), 1.0)
        samples = []
        for place in (n for n, c in enumerate(layout) if c == colour):
            y, x = f"(2 * {iy} + {place // 2})", f"(2 * {ix} + {place % 2})"
            held = f"least(1D, greatest(0D, (element_at({p}, {y} * w + {x} + 1) - {float(lows[k])!r}D) / {span!r}D))"
            samples.append(f"if({y} < h and {x} < w, {held}, null)")
        if not samples:
            return "0"
        total = " + ".join(f"coalesce({s}, 0D)" for s in samples)
        count = " + ".join(f"if({s} is null, 0, 1)" for s in samples)
        factor = gain[k] / green_gain if k != 1 and gain[k] > 0 else 1.0
        return f"int(round(least(1D, ({total}) / greatest(1, {count}) * {factor!r}D) * 255))"

    cells = mosaics.withColumn("i", F.explode(F.expr("sequence(0, greatest(1, int(h div 2)) * greatest(1, int(w div 2)) - 1)")))
    return cells.select(*keys, F.expr(iy).alias("y"), F.expr(ix).alias("x"), *[F.expr(shown(c)).alias(c.lower()) for c in "BGR"])
