"""Thumbnails and previews of packed rasters.  (P7-P9, S14, K7)"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from framefold.operators.kernels import area_resized, mapped, to_bytes


def rgba(image: np.ndarray) -> np.ndarray:
    """Grey, BGR or BGRA as RGBA; other channel counts are an error."""
    if image.ndim == 2:
        return np.dstack([image] * 3 + [np.full_like(image, 255)])
    if image.shape[2] not in (3, 4):
        raise ValueError(f"{image.shape[2]} channels")
    alpha = image[..., 3] if image.shape[2] == 4 else np.full(image.shape[:2], 255, image.dtype)
    return np.dstack([image[..., 2], image[..., 1], image[..., 0], alpha])


def thumbnail(image: np.ndarray, box: int = 800) -> np.ndarray:
    """Fitted into a square, up or down, sizes cut to whole pixels (one at least)."""
    h, w = image.shape[:2]
    scale = min(box / w, box / h)
    return rgba(to_bytes(area_resized(image.astype(float), max(1, int(h * scale)), max(1, int(w * scale)))))


def preview(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Fitted to a screen, down only, and left as it is where that is hardly smaller."""
    h, w = image.shape[:2]
    scale = min(width / w, height / h, 1.0)
    return image if scale >= 0.95 else to_bytes(area_resized(image.astype(float), max(1, int(h * scale)), max(1, int(w * scale))))


def thumbnails(rasters: DataFrame, box: int = 800) -> DataFrame:
    return mapped(rasters, lambda image: thumbnail(image, box))


def previews(rasters: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    return mapped(rasters, lambda image: preview(image, width, height))
