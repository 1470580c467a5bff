"""Options as a user states them: durations as text, ranges checked before anything is read."""

from __future__ import annotations

import re

from facetline.functions.constants import BOX_SCALE, MATCH_THRESHOLD
from facetline.kernels import redaction, tracker

#: Seconds of a unit: fixed values.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
STYLES = ("pixel", "black", "gauss", "secure")
MODES = ("blur-all", "targeted")
PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")
DURATION = re.compile(rf"([+-]?)((?:{PART.pattern})+|0)")


class OptionError(ValueError):
    """An option that is out of range, or options that exclude each other."""


def seconds(text: str, name: str = "duration", positive: bool = False) -> float:
    """Seconds of a duration such as "1.5s", "100ms" or "1m30s"."""
    m = DURATION.fullmatch(text)
    if not m:
        raise OptionError(f"{name}: {text!r} is no duration such as '2s' or '500ms'")
    total = sum(float(n) * UNITS[u] for n, u in PART.findall(m[2])) * (-1 if m[1] == "-" else 1)
    if positive and total <= 0:
        raise OptionError(f"{name} must be positive")
    return total


def fraction(value: float, name: str) -> float:
    """A number from 0 to 1; NaN is none."""
    if not 0 <= value <= 1:
        raise OptionError(f"{name} must be between 0 and 1, not {value}")
    return float(value)


def scan_options(threshold: float = MATCH_THRESHOLD, nth: int = 1, grace: str = "2s", blip: str = "100ms", fps: float = 25.0, detection: float = 0.5, timeout: str = "30s") -> tracker.Options:
    """Options of a scan. detection and timeout are the detector's; they are only checked here."""
    if nth < 1:
        raise OptionError(f"every nth frame: nth must be 1 or more, not {nth}")
    if not fps > 0:
        raise OptionError(f"fps must be positive, not {fps}")
    fraction(detection, "detection threshold")
    seconds(timeout, "timeout", positive=True)
    return tracker.Options(fraction(threshold, "match threshold"), seconds(grace, "grace period", True), seconds(blip, "blip duration", True), float(fps), nth)


def redact_mode(mode: str | None, targets: list[int]) -> str:
    """The mode in effect: targets alone mean targeted, nothing means all faces."""
    if mode is None:
        return "targeted" if targets else "blur-all"
    if mode not in MODES:
        raise OptionError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    if mode == "targeted" and not targets:
        raise OptionError("targeted mode needs targets")
    if mode == "blur-all" and targets:
        raise OptionError("targets and mode blur-all exclude each other")
    return mode


def redact_options(
    targets: list[int], mode: str | None = None, style: str = "pixel", strength: int = 15, threshold: float = MATCH_THRESHOLD, linger: str = "1s", fps: float = 25.0, paranoid: bool = False, strict: bool = False, scale: float = BOX_SCALE, detection: float = 0.5
) -> redaction.Options:
    """Options of a redaction. style and strength go to the painter; they are only checked here."""
    if style not in STYLES:
        raise OptionError(f"style must be one of {', '.join(STYLES)}, not {style!r}")
    if strength < 0:
        raise OptionError(f"strength must not be negative, not {strength}")
    if not scale > 0:
        raise OptionError(f"box scale must be positive, not {scale}")
    if not fps > 0:
        raise OptionError(f"fps must be positive, not {fps}")
    fraction(detection, "detection threshold")
    return redaction.Options(redact_mode(mode, targets), fraction(threshold, "match threshold"), seconds(linger, "linger"), float(fps), paranoid, strict, float(scale))
