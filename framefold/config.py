"""Processing settings: one validated record, saved as JSON.  (P27-P30, S15, K8)"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

#: Permitted ranges of the settings.
LIMITS: dict[str, tuple[float, float]] = {
    "sharpness_threshold": (10, 10000),
    "grid_size": (4, 16),
    "iqr_multiplier": (0.5, 5),
    "ecc_iterations": (3000, 30000),
    "ecc_epsilon": (1e-8, 1e-4),
    "ecc_blur": (3, 15),
    "ecc_timeout_s": (10, 300),
    "max_scale": (1.1, 3),
    "max_translation": (100, 1000),
    "max_determinant": (1.5, 5),
    "noise_reduction": (1, 10),
    "sharpening": (0, 5),
    "contrast": (0.5, 3),
    "brightness": (-100, 100),
    "saturation": (0, 3),
    "stack_batch": (3, 64),
}
DETECTORS = ("orb", "sift", "akaze")
MOTIONS = ("translation", "euclidean", "affine", "homography")


@dataclass(frozen=True)
class Settings:
    sharpness_threshold: float = 30.0
    grid_size: int = 4
    iqr_multiplier: float = 1.5
    detector: str = "orb"
    motion: str = "euclidean"
    ecc_iterations: int = 10000
    ecc_epsilon: float = 1e-6
    ecc_blur: int = 7
    ecc_timeout_s: int = 60
    use_clahe: bool = True
    max_scale: float = 1.5
    max_translation: float = 500.0
    max_determinant: float = 2.5
    stack_batch: int = 12
    stack_overlap: int = 2
    denoise: bool = False
    noise_reduction: float = 3.0
    sharpen: bool = False
    sharpening: float = 1.0
    colour: bool = False
    contrast: float = 1.0
    brightness: float = 0.0
    saturation: float = 1.0

    def __post_init__(self) -> None:
        for name, (low, high) in LIMITS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.detector not in DETECTORS or self.motion not in MOTIONS:
            raise ValueError(f"detector must be one of {DETECTORS}, motion one of {MOTIONS}")
        if self.stack_batch <= self.stack_overlap:
            raise ValueError("a batch must be larger than the overlap, or chunks never advance")

    def saved(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def loaded(text: str | None) -> Settings:
        """Any error, a missing field included, gives all defaults."""
        try:
            found = json.loads(text or "")
            return Settings(**{f.name: found[f.name] for f in fields(Settings)})
        except (ValueError, KeyError, TypeError):
            return Settings()


def odd_kernel(size: int) -> int:
    """The next odd size."""
    return size | 1


def slider_epsilon(exponent: float) -> float:
    return 10.0**exponent


def image_megabytes(width: int, height: int, channels: int) -> float:
    """What a picture takes in memory, with half as much again for what is made of it."""
    return width * height * channels / 2**20 * 1.5
