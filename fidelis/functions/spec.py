"""Metric specifications: ``name[:domain]``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import UnknownMetric, UnsupportedInput

# Spellings of metrics, channel sets and masks.
METRIC_NAMES = {
    "mse": "mse", "rmse": "rmse", "psnr": "psnr", "mae": "mae",
    "maxae": "maxae", "max_ae": "maxae", "max-error": "maxae",
    "ssim": "ssim", "global-ssim": "ssim", "global_ssim": "ssim",
    "wssim": "wssim", "windowed-ssim": "wssim", "windowed_ssim": "wssim", "ssim-windowed": "wssim", "ssim_windowed": "wssim",
    "ms-ssim": "ms-ssim", "ms_ssim": "ms-ssim", "msssim": "ms-ssim",
}
CHANNEL_SETS = {
    "rgb": "rgb", "rgba": "rgba", "gray": "gray", "grey": "gray", "luma": "gray",
    "binary": "binary", "mask": "binary", "bin": "binary", "hsv": "hsv", "hsva": "hsva",
}
MASKS = {"all": "all", "visible": "visible", "opaque": "opaque", "nonblack": "nonblack", "non-black": "nonblack"}
CHANNEL_LABELS = {
    "rgb": ("red", "green", "blue"), "rgba": ("red", "green", "blue", "alpha"), "gray": ("gray",), "binary": ("binary",),
    "hsv": ("hue", "saturation", "value"), "hsva": ("hue", "saturation", "value", "alpha"),
}
ERROR_METRICS = ("mse", "rmse", "psnr", "mae", "maxae")
DEFAULT_METRICS = ("psnr", "ssim", "mse", "mae", "maxae")
# Unit and direction of each metric.
UNITS = {
    "mse": ("normalized_code^2", "lower"), "rmse": ("normalized_code", "lower"), "psnr": ("dB", "higher"), "mae": ("normalized_code", "lower"),
    "maxae": ("normalized_code", "lower"), "ssim": ("unitless", "higher"), "wssim": ("unitless", "higher"), "ms-ssim": ("unitless", "higher"),
}
_INTERIOR = re.compile(r"interior(?:(\d+)px)?$")


@dataclass(frozen=True)
class Domain:
    """Which samples are compared: luma, color, all (stored channels), plane, or render (channels, mask, radius)."""

    kind: str = "luma"
    plane: int = 0
    channels: str = "rgb"
    mask: str = "all"
    radius: int = 0

    def label(self) -> str:
        if self.kind == "luma":
            return ""
        if self.kind == "plane":
            return f"plane{self.plane}"
        if self.kind != "render":
            return self.kind
        if self.radius == 0:
            if self.mask == "all":
                return "rgb-all" if self.channels == "rgb" else self.channels
            return f"{self.channels}-{self.mask}"
        inner = {"visible": "visible-interior", "nonblack": "nonblack-interior"}.get(self.mask, "interior")
        return f"{self.channels}-{inner}{self.radius}px"


def _mask(text: str) -> tuple[str, int] | None:
    if text in MASKS:
        return MASKS[text], 0
    base, rest = "opaque", text
    for spelling, name in sorted(MASKS.items(), key=lambda m: -len(m[0])):
        if spelling != "all" and text.startswith(spelling + "-"):
            base, rest = name, text[len(spelling) + 1 :]
            break
    found = _INTERIOR.match(rest)
    if not found:
        return None
    radius = int(found[1]) if found[1] else 1
    return (base, radius) if radius > 0 else None


def parse_domain(text: str) -> Domain:
    """luma, y, color, rgb, all, rgba, planeN, or <channels>[-<mask>] where a mask may have an interior radius."""
    t = text.strip().lower()
    if t in ("", "luma", "y"):
        return Domain()
    if t in ("color", "rgb"):
        return Domain("color")
    if t == "all":
        return Domain("all")
    if found := re.fullmatch(r"plane(\d+)", t):
        return Domain("plane", plane=int(found[1]))
    channels, dash, rest = t.partition("-")
    mask = _mask(rest if dash else "all")
    if channels in CHANNEL_SETS and mask:
        return Domain("render", channels=CHANNEL_SETS[channels], mask=mask[0], radius=mask[1])
    raise UnsupportedInput(f"unknown sample domain {text!r}")


@dataclass(frozen=True)
class MetricSpec:
    name: str
    domain: Domain = Domain()

    @classmethod
    def parse(cls, text: str) -> MetricSpec:
        name, _, domain = text.strip().partition(":")
        return cls(name.strip().lower(), parse_domain(domain))

    @property
    def canonical(self) -> str:
        try:
            return METRIC_NAMES[self.name]
        except KeyError:
            raise UnknownMetric(self.name) from None

    @property
    def key(self) -> str:
        """The name of the metric's rows: with the domain for error metrics off luma; SSIM kinds are always of luma."""
        label = self.domain.label() if self.canonical in ERROR_METRICS else ""
        return f"{self.canonical}:{label}" if label else self.canonical


def parse_specs(text: str | list[str] | tuple[str, ...] | None) -> list[MetricSpec]:
    """A comma-separated list, or a list of specifications; None: the defaults. Unknown names fail here."""
    parts = DEFAULT_METRICS if text is None else [p for p in text.split(",") if p.strip()] if isinstance(text, str) else text
    specs = [MetricSpec.parse(p) for p in parts]
    if not specs:
        raise UnsupportedInput("no metrics")
    for s in specs:
        _ = s.canonical
    return specs
