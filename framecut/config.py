"""Detector settings: frozen, validated before any plan is built."""

from __future__ import annotations

import dataclasses
import math

SUPPRESS, MERGE_LAST = "suppress", "merge_last"
REVIEW_SHARE = 0.8


def _finite(name: str, value: float, low: float = -math.inf, high: float = math.inf) -> None:
    if not math.isfinite(value) or not low <= value <= high:
        raise ValueError(f"{name} must be a finite number from {low} to {high}, not {value}")


@dataclasses.dataclass(frozen=True)
class Options:
    """min_scene_len: frames; policy: what becomes of a short last scene."""

    min_scene_len: int = 15
    policy: str = SUPPRESS

    def __post_init__(self):
        if self.min_scene_len < 0 or self.policy not in (SUPPRESS, MERGE_LAST):
            raise ValueError(f"invalid options: {self}")


@dataclasses.dataclass(frozen=True)
class Content:
    """weights: of hue, saturation, value and edge changes; luma_only counts value changes alone."""

    name = "content"
    threshold: float = 27.0
    weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 0.0)
    luma_only: bool = False

    def __post_init__(self):
        _finite("threshold", self.threshold)
        if len(self.weights) != 4:
            raise ValueError("weights are four numbers")

    @property
    def used_weights(self) -> tuple[float, float, float, float]:
        return (0.0, 0.0, 1.0, 0.0) if self.luma_only else tuple(map(float, self.weights))


@dataclasses.dataclass(frozen=True)
class Adaptive:
    name = "adaptive"
    threshold: float = 3.0
    min_content_val: float = 15.0
    frame_window: int = 2

    def __post_init__(self):
        _finite("threshold", self.threshold)
        if self.frame_window < 0:
            raise ValueError("frame_window is not negative")


@dataclasses.dataclass(frozen=True)
class Fade:
    """Frames below threshold are dark; fade_bias from -1 (first dark frame) to 1 (first light frame) places the cut."""

    name = "threshold"
    threshold: float = 12.0
    fade_bias: float = 0.0
    add_last_scene: bool = True

    def __post_init__(self):
        _finite("threshold", self.threshold)
        _finite("fade_bias", self.fade_bias, -1.0, 1.0)


@dataclasses.dataclass(frozen=True)
class Histogram:
    name = "histogram"
    threshold: float = 0.05
    bins: int = 256

    def __post_init__(self):
        _finite("threshold", self.threshold, 0.0, 1.0)
        if not 1 <= self.bins <= 256:
            raise ValueError("bins are 1 to 256")

    @property
    def metric(self) -> str:
        return f"hist_diff [bins={self.bins}]"


@dataclasses.dataclass(frozen=True)
class Hash:
    name = "hash"
    threshold: float = 0.395
    size: int = 16
    lowpass: int = 2

    def __post_init__(self):
        _finite("threshold", self.threshold, 0.0, 1.0)
        if not (1 <= self.size <= 256 and 1 <= self.lowpass <= 256):
            raise ValueError("size and lowpass are 1 to 256")

    @property
    def metric(self) -> str:
        return f"hash_dist [size={self.size} lowpass={self.lowpass}]"


DETECTORS = {c.name: c for c in (Content, Adaptive, Fade, Histogram, Hash)}


def load(detector: str, settings: dict | None = None):
    """A detector from its name and a partial set of settings; unknown names and settings are errors."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}: {', '.join(DETECTORS)}")
    kind, settings = DETECTORS[detector], dict(settings or {})
    unknown = set(settings) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings of {detector}: {', '.join(sorted(unknown))}")
    for name in ("bins", "size", "lowpass", "frame_window"):
        if settings.get(name) == 0:
            raise ValueError(f"{name} is above 0")
    if "weights" in settings:
        settings["weights"] = tuple(settings["weights"])
    return kind(**settings)


def review_threshold(detector, threshold: float | None = None) -> float:
    """Score from which a frame is shown for review; only content and adaptive scores have reviews."""
    if detector.name not in ("content", "adaptive"):
        raise ValueError(f"boundary review is not supported for {detector.name}")
    return detector.threshold * REVIEW_SHARE if threshold is None else threshold
