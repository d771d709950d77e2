"""Numpy kernels on real-sized rasters, in Arrow batches, and the pyramid fusion of stacks.

A raster crosses as packed 8-bit bytes (height, width, channels); floats exist only inside a kernel.  None of
these gathers a stack: fusion folds one frame at a time into a running pyramid, so a task holds one frame and
one pyramid, and stacks that are larger than a chunk are fused chunk by chunk, level by level.  (A12-A15,
P6, P7, P14-P16, P19, P23, P24)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framefold.functions.stencils import DERIVE3, ELLIPSE11, LAPLACE5, SMOOTH3

BANDS = 7


def reflected(image: np.ndarray, reach: int) -> np.ndarray:
    """The image with a border that mirrors it without its edge pixels; a side of one pixel is repeated."""
    out = image
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.arange(-reach, n + reach)
        if n == 1:
            at[:] = 0
        else:
            at = np.abs(at) % (2 * (n - 1))
            at = np.where(at >= n, 2 * (n - 1) - at, at)
        out = np.take(out, at, axis=axis)
    return out


def filtered(image: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Separable correlation: rows along y, columns along x."""
    reach = len(rows) // 2
    padded = reflected(image, reach)
    tall = sum(k * padded[i : i + image.shape[0]] for i, k in enumerate(rows))
    return sum(k * tall[:, i : i + image.shape[1]] for i, k in enumerate(columns))


def gaussian(image: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    """By sigma, or by a size, from which sigma follows."""
    size = size or 2 * int(np.ceil(3 * sigma)) + 1
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return filtered(image, k / k.sum(), k / k.sum())


def laplacian(image: np.ndarray) -> np.ndarray:
    padded = reflected(image, 2)
    h, w = image.shape[:2]
    return sum(k * padded[dy : dy + h, dx : dx + w] for dy, row in enumerate(LAPLACE5) for dx, k in enumerate(row) if k)


def grey(image: np.ndarray) -> np.ndarray:
    """P10: luminance of blue, green and red, rounded for bytes; a single channel as it is."""
    if image.ndim == 2:
        return image
    bright = image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])
    return np.floor(bright + 0.5).astype(np.uint8) if image.dtype == np.uint8 else bright


_BLUR3, _PYR = np.array([0.25, 0.5, 0.25]), np.array([1, 4, 6, 4, 1]) / 16.0


def focus_energy(image: np.ndarray) -> np.ndarray:
    """A9."""
    return filtered(np.abs(laplacian(grey(image))), _BLUR3, _BLUR3)


def down(image: np.ndarray) -> np.ndarray:
    return filtered(image, _PYR, _PYR)[::2, ::2]


def up(image: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Twice the size, or the odd size just below that shape asks for."""
    h, w = image.shape[0] * 2, image.shape[1] * 2
    wide = np.zeros((h, w, *image.shape[2:]), image.dtype)
    wide[::2, ::2] = image
    return filtered(wide, 2 * _PYR, 2 * _PYR)[: shape[0], : shape[1]]


def built(image: np.ndarray, bands: int = BANDS) -> list[np.ndarray]:
    """`bands` bands and the residual; fewer where a side comes to one pixel."""
    out = []
    for _ in range(bands):
        if min(image.shape[:2]) < 2:
            break
        less = down(image)
        out.append(image - up(less, image.shape))
        image = less
    return [*out, image]


def collapsed(pyramid: list[np.ndarray], clip: bool = True) -> np.ndarray:
    """From coarse to fine, held in 0 .. 255 at every level (clip)."""
    image = pyramid[-1]
    for band in reversed(pyramid[:-1]):
        image = up(image, band.shape) + band
        if clip:
            image = np.clip(image, 0, 255)
    return image


def resized(image: np.ndarray, h: int, w: int, taps: Callable | None = None) -> np.ndarray:
    """Pixel centres aligned; bilinear, or with lanczos_taps the high quality form."""
    y = np.clip((np.arange(h) + 0.5) * image.shape[0] / h - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * image.shape[1] / w - 0.5, 0, image.shape[1] - 1)
    return sampled(image, *np.meshgrid(y, x, indexing="ij"), taps or linear_taps, edge=True)


def area_resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Each pixel the mean of the area that it covers."""

    def spread(n: int, m: int) -> np.ndarray:
        begin = np.arange(m)[:, None] * n / m
        at = np.arange(n)[None, :]
        return np.clip(np.minimum(begin + n / m, at + 1) - np.maximum(begin, at), 0, None) * m / n

    return np.moveaxis(np.tensordot(spread(image.shape[1], w), np.tensordot(spread(image.shape[0], h), image, (1, 0)), (1, 1)), 0, 1)


def linear_taps(t: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(0, 1 - t), (1, t)]


def lanczos_taps(t: np.ndarray, a: int = 4) -> list[tuple[int, np.ndarray]]:
    """2 * a taps, normalised.  Their sines follow from those of t alone, by the sums of angles."""
    ks = range(1 - a, a + 1)
    whole, part, rest = np.sin(np.pi * t), np.sin(np.pi * t / a), np.cos(np.pi * t / a)
    weights = []
    for k in ks:
        far = t - k
        near = np.abs(far) < 1e-9
        wave = (whole if k % 2 == 0 else -whole) * (part * np.cos(np.pi * k / a) - rest * np.sin(np.pi * k / a))
        weights.append(np.where(near, 1.0, wave * a / np.where(near, 1.0, np.pi * far) ** 2))
    total = sum(weights)
    return [(k, v / total) for k, v in zip(ks, weights, strict=True)]


#: Pixels that are sampled at a time: what a strip needs stays in the processor's cache.
STRIP = 1 << 15
#: Pixels beyond the frame that any tap reaches.
MARGIN = 8


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, taps: Callable, edge: bool = False) -> np.ndarray:
    """The image at fractional places; outside it is 0, or the nearest edge pixel.

    The image has a margin of what is outside, so no tap needs a test, and places are taken in strips.
    """
    h, w = image.shape[:2]
    pad = [(MARGIN, MARGIN), (MARGIN, MARGIN)] + [(0, 0)] * (image.ndim - 2)
    kind = np.float32 if image.dtype == np.float32 else np.float64
    wide = np.pad(np.asarray(image, kind), pad, mode="edge" if edge else "constant")
    line, flat = w + 2 * MARGIN, wide.reshape(-1, *image.shape[2:])
    out = np.empty((y.size, *image.shape[2:]), kind)
    ys, xs = y.ravel(), x.ravel()
    for k in range(0, y.size, STRIP):
        # Places beyond the margin see what the margin's middle sees.
        py = np.clip(np.nan_to_num(ys[k : k + STRIP], nan=-MARGIN), -MARGIN / 2, h - 1 + MARGIN / 2)
        px = np.clip(np.nan_to_num(xs[k : k + STRIP], nan=-MARGIN), -MARGIN / 2, w - 1 + MARGIN / 2)
        y0, x0 = np.floor(py).astype(np.intp), np.floor(px).astype(np.intp)
        base = (y0 + MARGIN) * line + x0 + MARGIN
        across = [(dx, wx.astype(kind)) for dx, wx in taps(px - x0)]
        total = 0.0
        for dy, wy in taps(py - y0):
            row = 0.0
            for dx, wx in across:
                part = flat.take(base + (dy * line + dx), axis=0)
                row = row + part * (wx[:, None] if image.ndim == 3 else wx)
            wy = wy.astype(kind)
            total = total + row * (wy[:, None] if image.ndim == 3 else wy)
        out[k : k + STRIP] = total
    return out.reshape(*y.shape, *image.shape[2:])


def warped(image: np.ndarray, m: np.ndarray, shape: tuple[int, int] | None = None, taps: Callable = lanczos_taps) -> np.ndarray:
    """The image under the transform m (2 by 3 or 3 by 3), black and transparent outside."""
    full = np.vstack([m, [0, 0, 1]]) if len(m) == 2 else np.asarray(m, float)
    back = np.linalg.inv(full)
    h, w = shape or image.shape[:2]
    y, x = np.mgrid[:h, :w].astype(float)
    z = back[2, 0] * x + back[2, 1] * y + back[2, 2]
    return sampled(image, (back[1, 0] * x + back[1, 1] * y + back[1, 2]) / z, (back[0, 0] * x + back[0, 1] * y + back[0, 2]) / z, taps)


def equalised(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation of an 8-bit grey image, blended between tiles."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    area = th * tw
    limit = max(1, int(clip * area / 256))
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            extra = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + extra // 256
            hist[: extra % 256] += 1
            maps[i, j] = np.clip(np.rint(hist.cumsum() * 255.0 / area), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    i0, j0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - i0)[:, None], (x - j0)[None, :]
    i0, i1, j0, j1 = (np.clip(v, 0, tiles - 1) for v in (i0, i0 + 1, j0, j0 + 1))
    pick = lambda i, j: maps[i[:, None], j[None, :], image]
    out = (1 - fy) * ((1 - fx) * pick(i0, j0) + fx * pick(i0, j1)) + fy * ((1 - fx) * pick(i1, j0) + fx * pick(i1, j1))
    return np.rint(out).astype(np.uint8)


def bilateral(image: np.ndarray, strength: float) -> np.ndarray:
    """Diameter 9, colour spread 50 * strength, space spread 10 * strength; alpha is kept."""
    colour = image[..., :3] if image.ndim == 3 else image[..., None]
    padded, h, w = reflected(colour, 4).astype(np.int16), *colour.shape[:2]
    # Colours are bytes, so their distance is one of a few whole numbers.
    fade = np.exp(-(np.arange(255 * colour.shape[2] + 1.0) ** 2) / (2 * (50 * strength) ** 2)).astype(np.float32)
    out = np.empty(colour.shape, np.uint8)
    lines = max(1, STRIP // max(w, 1))
    for y in range(0, h, lines):
        here = padded[4 + y : 4 + min(y + lines, h), 4 : 4 + w]
        n = len(here)
        total, weight = np.zeros(here.shape, np.float32), np.zeros((n, w, 1), np.float32)
        for dy in range(-4, 5):
            for dx in range(-4, 5):
                if dy * dy + dx * dx <= 16:
                    near = padded[4 + y + dy : 4 + y + dy + n, 4 + dx : 4 + dx + w]
                    far = np.abs(near - here).sum(axis=2, dtype=np.int32)
                    k = (fade.take(far) * np.float32(np.exp(-(dy * dy + dx * dx) / (2 * (10 * strength) ** 2))))[..., None]
                    total += k * near
                    weight += k
        out[y : y + n] = to_bytes(total / weight)
    return np.dstack([out, image[..., 3:]]) if image.ndim == 3 else out[..., 0]


def sharpened(image: np.ndarray, strength: float) -> np.ndarray:
    """Unsharp masking with sigma 3 * strength on all channels; nothing at strength 0."""
    if not strength:
        return image
    real = image.astype(float)
    return to_bytes(real + strength * (real - gaussian(real, 3 * strength)))


def eroded(mask: np.ndarray, reach: tuple[int, ...]) -> np.ndarray:
    """The least value under a structuring element, of rows that reach so far; beyond the border nothing counts."""
    half, (h, w) = len(reach) // 2, mask.shape
    out = np.full((h, w), 255, np.uint8)
    for k, r in enumerate(reach):
        wide = np.pad(mask, ((0, 0), (r, r)), constant_values=255)
        least = np.lib.stride_tricks.sliding_window_view(wide, 2 * r + 1, axis=1).min(axis=2) if r else mask
        dy = k - half
        np.minimum(out[max(0, -dy) : h - max(0, dy)], least[max(0, dy) : h - max(0, -dy)], out=out[max(0, -dy) : h - max(0, dy)])
    return out


def to_bytes(image: np.ndarray) -> np.ndarray:
    """Rounded half to even, and saturated."""
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def unpacked(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(h, w, c)
    return flat[..., 0] if c == 1 else flat


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches one by one if they are large, and some at a time if they are small (a million bytes or so)."""
    for batch in batches:
        rows = max(1, (1 << 20) * batch.num_rows // max(batch.nbytes, 1))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def mapped(rasters: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel on each packed raster (keys..., h, w, c, data); what else a row has stays."""
    schema = rasters.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in single(batches):
            rows = batch.to_pylist()
            for r in rows:
                out = kernel(unpacked(r["data"], r["h"], r["w"], r["c"]))
                r |= {"h": out.shape[0], "w": out.shape[1], "c": 1 if out.ndim == 2 else out.shape[2], "data": np.ascontiguousarray(out).tobytes()}
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return rasters.mapInArrow(run, schema)


class Stack:
    """The running pyramid of a stack: bands by most energy, alpha where all frames are opaque."""

    def __init__(self, compat: bool = True) -> None:
        self.bands: list[np.ndarray] = []
        self.most: list[np.ndarray] = []
        self.alpha: np.ndarray | None = None
        self.compat = compat

    def add(self, image: np.ndarray) -> None:
        alpha = image[..., 3] if image.ndim == 3 and image.shape[2] == 4 else None
        levels = built((image[..., :3] if image.ndim == 3 else image).astype(float))
        first = not self.bands
        for k, level in enumerate(levels):
            e = focus_energy(level)
            if alpha is not None and not (first and self.compat):
                e = e * resized(alpha.astype(float), *level.shape[:2]) / 255
            if first:
                self.bands.append(level)
                self.most.append(e)
            else:
                better = e > self.most[k]
                self.bands[k] = np.where(better[..., None] if level.ndim == 3 else better, level, self.bands[k])
                self.most[k] = np.where(better, e, self.most[k])
        if alpha is not None:
            self.alpha = alpha if self.alpha is None else np.where((self.alpha > 0) & (alpha > 0), 255, 0).astype(np.uint8)

    def result(self) -> np.ndarray:
        """The collapsed pyramid in bytes, with the alpha, five pixels narrower, if there is one."""
        out = to_bytes(collapsed(self.bands))
        return out if self.alpha is None else np.dstack([out, eroded(self.alpha, ELLIPSE11)])


def fused_once(rasters: DataFrame, group: list[str], compat: bool = True) -> DataFrame:
    """(group..., ord, h, w, c, data): one raster for each group, its frames folded in the order of `ord`.

    A group is a chunk of a stack (see stacked), so its packed frames and one pyramid fit a task.
    """
    schema = rasters.select(*group, "ord", "h", "w", "c", "data").schema

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = sorted((r for batch in held for r in batch.to_pylist()), key=lambda r: r["ord"])
        stack = Stack(compat)
        for r in rows:
            stack.add(unpacked(r["data"], r["h"], r["w"], r["c"]))
        out = stack.result()
        made = {g: k.as_py() for g, k in zip(group, key, strict=True)}
        made |= {"ord": rows[0]["ord"], "h": out.shape[0], "w": out.shape[1], "c": 1 if out.ndim == 2 else out.shape[2], "data": out.tobytes()}
        yield pa.RecordBatch.from_pylist([made], schema=held[0].schema)

    return rasters.select(*group, "ord", "h", "w", "c", "data").groupBy(*group).applyInArrow(run, schema)


def stacked(rasters: DataFrame, group: list[str], size: int = 12, overlap: int = 2, compat: bool = True, keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(group..., ord, h, w, c, data): chunks of `size` frames that overlap are fused, then what they give, until each group is one raster.

    ord counts a group's frames from 0 in the order in which they are taken (the last frame first).  A group in one task is a chunk, so
    `size` rasters at most; the number of rounds is the logarithm of the longest stack.  keep gets what each round but
    the last gives, with the round's number from 0, and returns what the next one reads: a table of it, say.
    """
    if size <= overlap:
        raise ValueError("a chunk must be larger than the overlap")
    step = size - overlap
    rows = rasters.select(*group, "ord", "h", "w", "c", "data")
    # Counts alone, without a pixel: how many rounds there are, and where each group's last chunk begins.
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    longest, level = counts.agg(F.max("_n")).first()[0] or 0, 0
    while longest > 1:
        if longest <= size:
            return fused_once(rows, group, compat)
        lowest, last = f"greatest(0L, bigint(ceil((ord - {size - 1}) / {step}D)))", f"greatest(0L, bigint(ceil((_n - {size}) / {step}D)))"
        dealt = rows.join(counts, group).withColumn("chunk", F.explode(F.expr(f"sequence({lowest}, least({last}, ord div {step}))"))).drop("_n")
        # A round is read once by the next: chunks follow from places and counts.
        rows = fused_once(dealt, [*group, "chunk"], compat).withColumn("ord", F.col("chunk").cast("long")).drop("chunk")
        rows, level = keep(rows, level) if keep else rows, level + 1
        counts = counts.withColumn("_n", F.expr(f"{last} + 1"))
        longest = 1 + -(-(longest - size) // step)
    return rows


def score(image: np.ndarray) -> tuple[float, float, float, float]:
    """A1-A4: variance of the Laplacian, Tenengrad, modified Laplacian, and their combination, as operators/sharpness.py has them."""
    real = grey(image).astype(float)
    variance = float(laplacian(filtered(real, _BLUR3, _BLUR3)).var())
    gx, gy = filtered(real, np.array(SMOOTH3), np.array(DERIVE3)), filtered(real, np.array(DERIVE3), np.array(SMOOTH3))
    gradient = float((gx * gx + gy * gy).mean())
    modified = float(np.minimum(255, np.minimum(255, np.abs(gx)) + np.minimum(255, np.abs(gy))).mean())
    return variance, gradient, modified, (0.4 * variance + 0.3 * gradient + 0.3 * modified) / max(np.sqrt(real.size / 1e6), 0.5)


def regions(image: np.ndarray, grid: int, least: int = 100) -> tuple[float, float, int]:
    """A5: the best cell's score, the whole raster's, and how many cells have 0.7 of the best; (whole, whole, 1) for small rasters."""
    whole = score(image)[3]
    h, w = image.shape[:2]
    g = min(max(grid, 2), h // least, w // least)
    if g < 1:
        return whole, whole, 1
    ch, cw = h // g, w // g
    each = [score(image[i * ch : (i + 1) * ch, j * cw : (j + 1) * cw])[3] for i in range(g) for j in range(g)]
    return max(each), whole, sum(v >= 0.7 * max(each) for v in each)


def _per_raster(rasters: DataFrame, kernel: Callable[[np.ndarray], tuple], columns: dict[str, str]) -> DataFrame:
    """Numbers of each packed raster, beside what else its row has."""
    keys = [f for f in rasters.schema.fields if f.name not in ("h", "w", "c", "data")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", " + ", ".join(f"{k} {t}" for k, t in columns.items())
    kinds = [{"double": pa.float64(), "long": pa.int64()}[t] for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in single(batches):
            made = [kernel(unpacked(r["data"], r["h"], r["w"], r["c"])) for r in batch.select(["h", "w", "c", "data"]).to_pylist()]
            found = [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keys], *found], names=[*[f.name for f in keys], *columns])

    return rasters.mapInArrow(run, schema)


def measures(rasters: DataFrame) -> DataFrame:
    """(keys..., lap_var, tenengrad, mod_laplacian, score) of packed rasters."""
    return _per_raster(rasters, score, {"lap_var": "double", "tenengrad": "double", "mod_laplacian": "double", "score": "double"})


def regional(rasters: DataFrame, grid: int, least: int = 100) -> DataFrame:
    """(keys..., max_regional, global_score, sharp_areas) of packed rasters."""
    return _per_raster(rasters, lambda image: regions(image, grid, least), {"max_regional": "double", "global_score": "double", "sharp_areas": "long"})


def in_reverse(frames: DataFrame, group: list[str], seq: str = "img") -> DataFrame:
    """Ord counts from the last frame down."""
    return frames.withColumn("ord", (F.row_number().over(W.partitionBy(*group).orderBy(F.desc(seq))) - 1).cast("long"))


def packed(rasters: DataFrame, p: str = "p") -> DataFrame:
    """Array rasters as packed bytes: (keys..., h, w, c, data)."""
    hexed = F.expr(f"unhex(array_join(transform({p}, v -> lpad(hex(v), 2, '0')), ''))")
    return rasters.withColumn("c", F.lit(1)).withColumn("data", hexed).drop(p)
