"""Options of the image pipeline: ranges, defaults, clamping."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields

CORNERS = ("top-left", "bottom-left", "top-right", "bottom-right")
METHODS = ("none", *CORNERS, "rgb")
OUTLINES = ("none", "rounded", "sharp")
DITHERS = ("none", "floyd-steinberg", "bayer-2x2", "bayer-4x4", "bayer-8x8", "ordered")


@dataclass(frozen=True)
class Range:
    least: float
    most: float
    default: float

    def clamp_int(self, value: float) -> int:
        v = math.trunc(value) if math.isfinite(value) else self.default
        return int(min(self.most, max(self.least, v)))

    def clamp(self, value: float) -> float:
        return min(self.most, max(self.least, value if math.isfinite(value) else self.default))

    def clamp_optional(self, value: float | None) -> int | None:
        return None if value is None or not math.isfinite(value) else self.clamp_int(value)


# Least, most, default.
RANGES = {
    "detection_step": Range(1, 128, 64),
    "sample_window": Range(1, 9, 3),
    "tolerance": Range(0, 255, 64),
    "trim_alpha": Range(1, 255, 16),
    "floating_percent": Range(0, 100, 3),
    "floating_pixels": Range(0, 1_000_000, 0),
    "force_w": Range(1, 1024, 0),
    "force_h": Range(1, 1024, 0),
    "color_count": Range(2, 256, 32),
    "dither_strength": Range(0, 100, 0),
}


@dataclass
class PipelineOptions:
    """What one image is processed with; values are clamped when an object is made."""

    remove_before: bool = True
    remove_after: bool = True
    remove_inner: bool = False
    tolerance: float = 64
    method: str = "top-left"
    background: str | None = None
    trim: bool = True
    trim_alpha: float = 16
    floating_pixels: float = 0
    grid_detection: bool = True
    grid_from_trimmed: bool = True
    fast_grid: bool = True
    force_w: float | None = None
    force_h: float | None = None
    sample_window: float = 3
    detection_step: float = 64
    max_cells_w: int = 128
    max_cells_h: int = 128
    strips: int = 12
    mask_background: bool = True
    reduce_colors: bool = False
    color_mode: str = "none"
    color_count: float = 32
    palette: list[tuple[int, int, int]] | None = None
    dither: str = "none"
    dither_strength: float = 0
    outline: str = "none"
    outline_color: tuple[int, int, int] = (255, 255, 255)
    seed: int = 0

    def __post_init__(self) -> None:
        for name in ("tolerance", "trim_alpha", "floating_pixels", "sample_window", "detection_step", "color_count", "dither_strength"):
            setattr(self, name, RANGES[name].clamp_int(getattr(self, name)))
        self.force_w = RANGES["force_w"].clamp_optional(self.force_w)
        self.force_h = RANGES["force_h"].clamp_optional(self.force_h)
        for name, known in (("method", METHODS), ("outline", OUTLINES), ("dither", DITHERS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is {getattr(self, name)!r}, not one of {', '.join(known)}")

    @classmethod
    def from_dict(cls, values: dict) -> PipelineOptions:
        """Unknown keys are ignored, as presets may come from other versions."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def to_dict(self) -> dict:
        return asdict(self)


def percent_to_pixels(percent: float, total: int, background: bool = True) -> int:
    """How many pixels a share of an image is: at least one, none without background removal."""
    if not background or percent <= 0:
        return 0
    return min(total, max(1, math.ceil(percent / 100 * total)))


