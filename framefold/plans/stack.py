"""Fusing a series: chunks, pyramids, crop and post-processing.  Frames: (stack, img, h, w, c, data)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.config import Settings
from framefold.operators import kernels


def cropped(rasters: DataFrame, areas: DataFrame) -> DataFrame:
    """Rasters cut to their stack's (x, y, width, height); an empty area leaves them whole."""
    rows = rasters.join(areas, "stack")
    schema = rasters.schema
    names = [f.name for f in schema.fields]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                image = kernels.unpacked(r["data"], r["h"], r["w"], r["c"])
                if r["width"] > 0 and r["height"] > 0:
                    image = image[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]]
                out.append({n: r[n] for n in names} | {"h": image.shape[0], "w": image.shape[1], "data": np.ascontiguousarray(image).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(n) for n in names]))

    return rows.select(*names, "x", "y", "width", "height").mapInArrow(run, schema)


def finished(settings: Settings):
    """The kernel of the post-processing chain: noise, then sharpness, then colour, each if it is on.  (P26)"""

    def run(image: np.ndarray) -> np.ndarray:
        if settings.denoise:
            image = kernels.bilateral(image, settings.noise_reduction)
        if settings.sharpen:
            image = kernels.sharpened(image, settings.sharpening)
        if settings.colour and image.ndim == 3:
            colour = image[..., :3].astype(float)
            top = colour.max(axis=2, keepdims=True)
            held = np.clip(np.rint(top * settings.saturation), 0, 255)
            toned = kernels.to_bytes(np.divide(colour * held, top, out=np.zeros_like(colour), where=top > 0)).astype(float)
            image = np.dstack([kernels.to_bytes(toned * settings.contrast + settings.brightness), image[..., 3:]])
        return image

    return run


def stack(frames: DataFrame, settings: Settings = Settings(), areas: DataFrame | None = None, keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """One raster for each stack, the last frame taken first; keep: see kernels.stacked."""
    rows = kernels.in_reverse(frames.select("stack", "img", "h", "w", "c", "data"), ["stack"]).drop("img")
    fused = kernels.stacked(rows, ["stack"], settings.stack_batch, settings.stack_overlap, keep=keep)
    if areas is not None:
        fused = cropped(fused, areas)
    if settings.denoise or settings.sharpen or settings.colour:
        fused = kernels.mapped(fused, finished(settings))
    return fused.select("stack", F.col("h"), "w", "c", "data")
