"""Kernel form of the metrics: both frames of a pair in memory, all metrics from shared scans."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np

from ..functions.errors import IncompatibleFrames, UnsupportedInput
from ..functions.spec import CHANNEL_LABELS, ERROR_METRICS, UNITS, Domain, MetricSpec
from .pixels import Frame, Pixels

# Bins of the error and window histograms, codes beyond which samples are counted, percentiles.
BINS = 4096
LSB = (1, 2, 4, 8)
PERCENTILES = (("p50", 0.50), ("p90", 0.90), ("p95", 0.95), ("p99", 0.99))
#: Pixels of a band.
BAND_PIXELS = 1 << 15
# SSIM constants and multi-scale weights.
C1, C2 = 0.01**2, 0.03**2
MS_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def guard(a: Pixels, b: Pixels) -> None:
    if (a.width, a.height) != (b.width, b.height):
        raise IncompatibleFrames(f"dimensions differ: {a.width}x{a.height} and {b.width}x{b.height}")


def histogram(absolute: np.ndarray) -> np.ndarray:
    scaled = absolute * BINS + 0.5
    if not scaled.max(initial=0.0) < BINS + 1:  # also where anything is NaN
        scaled = np.where(np.isfinite(absolute) & (absolute < 1.0), scaled, float(BINS))
    return np.bincount(scaled.astype(np.int32).ravel(), minlength=BINS + 1)


def histogram_percentile(counts: np.ndarray, n: int, largest: float, p: float) -> float:
    rank = max(1, math.ceil(p * n))
    at = int(np.searchsorted(np.cumsum(counts), rank))
    if at > BINS:
        return largest
    return largest if at == BINS and largest > 1.0 else at / BINS


@dataclass
class Partial:
    """Mergeable error statistics of one channel, or of all."""

    count: int = 0
    squares: float = 0.0
    absolute: float = 0.0
    signed: float = 0.0
    largest: float = 0.0
    bins: np.ndarray = field(default_factory=lambda: np.zeros(BINS + 1, np.int64))

    @classmethod
    def of(cls, delta: np.ndarray) -> Partial:
        a, flat = np.abs(delta), delta.ravel()
        return cls(delta.size, float(flat @ flat), float(a.sum()), float(delta.sum()), float(a.max(initial=0.0)), histogram(a))

    def __add__(self, o: Partial) -> Partial:
        return Partial(self.count + o.count, self.squares + o.squares, self.absolute + o.absolute, self.signed + o.signed, max(self.largest, o.largest), self.bins + o.bins)

    @property
    def mse(self) -> float:
        return self.squares / self.count

    @property
    def mae(self) -> float:
        return self.absolute / self.count

    def details(self, prefix: str = "") -> dict[str, float]:
        out = {"samples": float(self.count), "mse": self.mse, "rmse": math.sqrt(self.mse), "mae": self.mae, "mean_error": self.signed / self.count}
        if prefix:
            out |= {"max_delta": self.largest, "psnr": psnr(self.mse), "mae_code": self.mae * 255.0, "mean_error_code": out["mean_error"] * 255.0, "max_delta_code": self.largest * 255.0}
        for label, p in PERCENTILES:
            v = histogram_percentile(self.bins, self.count, self.largest, p)
            out |= {f"abs_error_{label}": v, f"abs_error_{label}_code": v * 255.0}
        return {f"{prefix}_{k}": v for k, v in out.items()} if prefix else out


@dataclass
class ErrorStats:
    """Error statistics of one domain; sums of row ranges add up to the statistics of the whole."""

    total: Partial
    channels: list[Partial]
    labels: tuple[str, ...]
    pixels: int
    observed: int
    changed: int = 0
    beyond: tuple[int, ...] = (0, 0, 0, 0)
    changed_pixels: int = 0
    pixels_beyond: tuple[int, ...] = (0, 0, 0, 0)
    largest_pixel: float = 0.0
    place: tuple[int, int, int] | None = None

    def __add__(self, o: ErrorStats) -> ErrorStats:
        add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
        place = o.place if o.total.largest > self.total.largest else self.place
        return ErrorStats(
            self.total + o.total, [a + b for a, b in zip(self.channels, o.channels, strict=True)], self.labels, self.pixels + o.pixels, self.observed + o.observed, self.changed + o.changed, add(self.beyond, o.beyond),
            self.changed_pixels + o.changed_pixels, add(self.pixels_beyond, o.pixels_beyond), max(self.largest_pixel, o.largest_pixel), place,
        )

    def details(self) -> dict[str, float]:
        t = self.total
        out = t.details() | {"channel_sample_count": float(t.count), "pixel_count": float(self.pixels), "max_channel_delta": t.largest, "max_pixel_delta": self.largest_pixel}
        if self.place is not None:
            out |= dict(zip(("max_error_x", "max_error_y", "max_error_channel"), map(float, self.place), strict=True))
        out |= {"mse_code": t.mse * 255.0 * 255.0, "rmse_code": out["rmse"] * 255.0, "mae_code": t.mae * 255.0, "mean_error_code": out["mean_error"] * 255.0}
        out |= {"max_channel_delta_code": t.largest * 255.0, "max_pixel_delta_code": self.largest_pixel * 255.0, "changed_samples": float(self.changed), "changed_sample_ratio": self.changed / t.count}
        if self.observed == self.pixels:
            out |= {"changed_pixels": float(self.changed_pixels), "changed_pixel_ratio": self.changed_pixels / self.pixels}
            for k, n in zip(LSB, self.pixels_beyond, strict=True):
                out |= {f"pixels_beyond_{k}_lsb": float(n), f"pixel_ratio_beyond_{k}_lsb": n / self.pixels}
        for k, n in zip(LSB, self.beyond, strict=True):
            out |= {f"samples_beyond_{k}_lsb": float(n), f"sample_ratio_beyond_{k}_lsb": n / t.count}
        out |= {"error_histogram_bins": float(BINS), "channel_count": float(len(self.channels))}
        for i, c in enumerate(self.channels):
            out |= c.details(f"channel_{i}")
            if i < len(self.labels):
                out |= c.details(self.labels[i])
        return out


def _stats(delta: np.ndarray, labels: tuple[str, ...], coords: tuple[np.ndarray, np.ndarray] | None) -> ErrorStats:
    """``delta``: pixels by channels; ``coords``: x and y of the pixels in row order, where places are reported."""
    if not delta.size:
        raise UnsupportedInput("zero comparable samples")
    a = np.abs(delta)
    single = delta.shape[1] == 1
    top = a[:, 0] if single else a.max(axis=1)
    total = Partial.of(delta)
    channels = [total] if single else [Partial.of(delta[:, c]) for c in range(delta.shape[1])]
    place = None
    if coords is not None and total.largest > 0:
        n, c = np.unravel_index(int(a.argmax()), a.shape)
        place = (int(coords[0][n]), int(coords[1][n]), int(c))
    codes = a * 255.0
    changed, beyond = np.count_nonzero(a), tuple(int(np.count_nonzero(codes > k)) for k in LSB)
    if single:
        changed_pixels, pixels_beyond, norm = changed, beyond, total.largest
    else:
        codes = top * 255.0
        changed_pixels, pixels_beyond = np.count_nonzero(top), tuple(int(np.count_nonzero(codes > k)) for k in LSB)
        norm = float(np.sqrt(np.einsum("ij,ij->i", delta, delta).max()))
    return ErrorStats(total, channels, labels, len(delta), len(delta), int(changed), beyond, int(changed_pixels), pixels_beyond, norm, place)


def stored_labels(a: Pixels, b: Pixels) -> tuple[str, ...]:
    if a.format.name != b.format.name:
        return ()
    name = a.format.name
    if a.format.is_yuv:
        return ("y", "u", "v")
    if a.format.is_binary:
        return ("binary",)
    labels = ("luma",) if a.format.channels == 1 else CHANNEL_LABELS["hsv" if name.startswith("hsv") else "rgb"]
    if name.startswith("bgr"):
        labels = labels[::-1]
    return (*labels, "alpha") if a.format.has_alpha else labels


def mask_of(a: Pixels, b: Pixels, mask: str, inner: bool = False) -> np.ndarray:
    if mask == "visible":
        return (a.alpha() > 0) & (b.alpha() > 0) if inner else (a.alpha() > 0) | (b.alpha() > 0)
    if mask == "opaque":
        return (a.alpha() >= 1) & (b.alpha() >= 1)
    if mask == "nonblack":
        return (a.rgb() > 0).any(axis=2) | (b.rgb() > 0).any(axis=2)
    return np.ones((a.height, a.width), bool)


def render_mask(a: Pixels, b: Pixels, domain: Domain) -> np.ndarray:
    """Pixels of a render domain; with a radius, those whose whole neighbourhood is included."""
    r = domain.radius
    base = mask_of(a, b, domain.mask, inner=r > 0)
    if not r:
        return base
    out = np.zeros_like(base)
    if r >= a.width or r >= a.height or 2 * r >= a.width or 2 * r >= a.height:
        return out
    sums = np.zeros((a.height + 1, a.width + 1), np.int64)
    sums[1:, 1:] = np.cumsum(np.cumsum(base, axis=0), axis=1)
    k = 2 * r + 1
    out[r : a.height - r, r : a.width - r] = sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k] == k * k
    return out


def wrap_hue(delta: np.ndarray) -> np.ndarray:
    return np.where(np.abs(delta) <= 0.5, delta, np.where(delta > 0, delta - 1.0, delta + 1.0))


def error_stats(a: Pixels, b: Pixels, domain: Domain) -> ErrorStats:
    """Statistics of a domain; packed frames are taken in bands of rows that stay in the processor's cache."""
    guard(a, b)
    step = max(1, BAND_PIXELS // a.width)
    if domain.kind in ("luma", "color", "all") and a.format.bytes_per_pixel and b.format.bytes_per_pixel and a.height > step:
        total = None
        for y in range(0, a.height, step):
            part = _error_stats(a.rows(y, min(y + step, a.height)), b.rows(y, min(y + step, a.height)), domain)
            if part.place is not None:
                part.place = (part.place[0], part.place[1] + y, part.place[2])
            total = part if total is None else total + part
        return total
    return _error_stats(a, b, domain)


def _error_stats(a: Pixels, b: Pixels, domain: Domain) -> ErrorStats:
    whole = lambda d: _stats(d.reshape(-1, d.shape[-1]), labels, _grid(a.width, a.height))
    if domain.kind == "luma":
        labels: tuple[str, ...] = ("luma",)
        return whole((a.luma() - b.luma())[..., None])
    if domain.kind == "color":
        labels = CHANNEL_LABELS["rgb"]
        return whole(a.rgb() - b.rgb())
    if domain.kind == "plane":
        _same_format(a, b, "plane comparison")
        a.format.plane_shape(a.width, a.height, domain.plane)
        d = (a.planes[domain.plane].astype(float) - b.planes[domain.plane].astype(float)) / 255.0
        return _stats(d.reshape(-1, 1), ("plane",), None)
    if domain.kind == "all" and (a.format.is_yuv or b.format.is_yuv):
        _same_format(a, b, "stored YUV comparison")
        return _yuv_stats(a, b)
    if domain.kind == "all":
        if a.format.channels != b.format.channels:
            raise IncompatibleFrames(f"channel counts differ: {a.format.channels} and {b.format.channels}")
        labels = stored_labels(a, b)
        return whole(a.stored() - b.stored())
    keep = render_mask(a, b, domain)
    d = a.channels(domain.channels) - b.channels(domain.channels)
    if domain.channels.startswith("hsv"):
        d[..., 0] = wrap_hue(d[..., 0])
    ys, xs = np.nonzero(keep)
    return _stats(d[keep], CHANNEL_LABELS[domain.channels], (xs, ys))


def _grid(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(width * height)
    return at % width, at // width


def _same_format(a: Pixels, b: Pixels, what: str) -> None:
    if a.format.name != b.format.name:
        raise IncompatibleFrames(f"{what} needs identical pixel formats")


def _yuv_stats(a: Pixels, b: Pixels) -> ErrorStats:
    """Stored samples by plane; there is no pixel to which a sample belongs, so no pixel counts."""
    parts: list[np.ndarray] = [np.empty(0)] * 3
    for i, (p, q) in enumerate(zip(a.planes, b.planes, strict=True)):
        d = (p.astype(float) - q.astype(float)) / 255.0
        if a.format.name == "nv12" and i == 1:
            parts[1], parts[2] = d[:, 0::2].ravel(), d[:, 1::2].ravel()
        else:
            parts[i] = d.ravel()
    every = np.abs(np.concatenate(parts))
    channels = [Partial.of(p) for p in parts]
    total = channels[0] + channels[1] + channels[2]
    return ErrorStats(total, channels, ("y", "u", "v"), a.width * a.height, 0, int((every != 0).sum()), tuple(int((every * 255.0 > k).sum()) for k in LSB), largest_pixel=total.largest)


def psnr(mse: float, peak: float = 1.0) -> float:
    return math.inf if mse == 0.0 else 10.0 * math.log10(peak * peak / mse)


Row = dict[str, Any]


def row(name: str, score: float, unit: str, direction: str, details: dict[str, float]) -> Row:
    return {"name": name, "score": float(score), "unit": unit, "direction": direction, "details": {k: float(v) for k, v in details.items()}}


def error_score(stats: ErrorStats, metric: str) -> float:
    t = stats.total
    return {"mse": t.mse, "rmse": math.sqrt(t.mse), "psnr": psnr(t.mse), "mae": t.mae, "maxae": t.largest}[metric]


def _ssim_of(mx: Any, my: Any, vx: Any, vy: Any, cxy: Any, c1: float, c2: float) -> tuple[Any, Any]:
    cs = (2.0 * cxy + c2) / (vx + vy + c2)
    return (2.0 * mx * my + c1) / (mx * mx + my * my + c1) * cs, cs


def global_ssim(a: Pixels, b: Pixels, c1: float = C1, c2: float = C2) -> Row:
    guard(a, b)
    x, y = (p.luma().reshape(-1).copy() if p.format.is_yuv else p.luma().reshape(-1) for p in (a, b))
    n, mx, my = x.size, x.mean(), y.mean()
    x -= mx
    y -= my
    d = max(n - 1, 1)
    vx, vy, cxy = x @ x / d, y @ y / d, x @ y / d
    score, cs = _ssim_of(mx, my, vx, vy, cxy, c1, c2)
    details = {"contrast_structure": cs, "mean_reference": mx, "mean_distorted": my, "variance_reference": vx, "variance_distorted": vy, "covariance": cxy, "samples": n}
    return row("ssim", score, *UNITS["ssim"], details)


def window_starts(size: int, window: int, stride: int) -> list[int]:
    """Every ``stride``, the last start moved to the edge."""
    last = max(size - window, 0)
    return [*range(0, last, max(stride, 1)), last]


@dataclass(frozen=True)
class Windows:
    """Layout of local windows: size and stride; sizes are cut to the image."""

    width: int = 8
    height: int = 8
    stride_x: int = 4
    stride_y: int = 4

    def __post_init__(self) -> None:
        if min(self.width, self.height, self.stride_x, self.stride_y) <= 0:
            raise UnsupportedInput("windows and strides must be positive")


def window_stats(x: np.ndarray, y: np.ndarray, layout: Windows, c1: float = C1, c2: float = C2) -> dict[str, float]:
    h, w = x.shape
    ww, wh = min(layout.width, w), min(layout.height, h)
    xs, ys = np.array(window_starts(w, ww, layout.stride_x)), np.array(window_starts(h, wh, layout.stride_y))

    def sums(v: np.ndarray) -> np.ndarray:
        # columns first, then rows: a view of one axis at a time holds no window of both
        columns = np.lib.stride_tricks.sliding_window_view(v, ww, axis=1)[:, xs].sum(axis=2)
        return np.lib.stride_tricks.sliding_window_view(columns, wh, axis=0)[ys].sum(axis=2)

    n, d = ww * wh, max(ww * wh - 1, 1)
    sx, sy, sxx, syy, sxy = sums(x), sums(y), sums(x * x), sums(y * y), sums(x * y)
    vx, vy = np.maximum(sxx - sx * sx / n, 0.0) / d, np.maximum(syy - sy * sy / n, 0.0) / d
    s, cs = _ssim_of(sx / n, sy / n, vx, vy, (sxy - sx * sy / n) / d, c1, c2)
    counts = np.bincount(np.floor((np.clip(s, -1.0, 1.0) + 1.0) * 0.5 * BINS + 0.5).astype(int).ravel(), minlength=BINS + 1)
    cumulative = np.cumsum(counts)
    worst_y, worst_x = np.unravel_index(int(s.argmin()), s.shape)
    low = lambda p: float(np.searchsorted(cumulative, max(1, math.ceil(p * s.size)))) / BINS * 2.0 - 1.0
    return {
        "mean": float(s.mean()), "cs": float(cs.mean()), "min": float(s.min()), "max": float(s.max()), "x": float(xs[worst_x]), "y": float(ys[worst_y]),
        "p01": low(0.01), "p05": low(0.05), "p50": low(0.50), "windows": float(s.size), "width": float(ww), "height": float(wh),
    }


def windowed_ssim(a: Pixels, b: Pixels, layout: Windows | None = None, c1: float = C1, c2: float = C2) -> Row:
    guard(a, b)
    layout = layout or Windows(8, 8, 8, 8)
    s = window_stats(a.luma(), b.luma(), layout, c1, c2)
    details = {
        "windows": s["windows"], "samples": a.width * a.height, "window_width": s["width"], "window_height": s["height"], "stride_x": layout.stride_x, "stride_y": layout.stride_y,
        "mean_contrast_structure": s["cs"], "unweighted_mean": s["mean"], "min_window_ssim": s["min"], "max_window_ssim": s["max"], "worst_window_x": s["x"], "worst_window_y": s["y"],
        "p01_window_ssim": s["p01"], "p05_window_ssim": s["p05"], "p50_window_ssim": s["p50"], "window_ssim_histogram_bins": BINS,
    }
    return row("wssim", s["mean"], *UNITS["wssim"], details)


def halve(v: np.ndarray) -> np.ndarray:
    """Means of 2x2 boxes, of what there is at ragged edges."""
    h, w = v.shape
    rows, cols = np.arange(0, h, 2), np.arange(0, w, 2)
    add = lambda z: np.add.reduceat(np.add.reduceat(z, rows, axis=0), cols, axis=1)
    return add(v) / add(np.ones_like(v))


def ms_ssim(a: Pixels, b: Pixels, layout: Windows | None = None, c1: float = C1, c2: float = C2, weights: tuple[float, ...] = MS_WEIGHTS) -> Row:
    guard(a, b)
    layout = layout or Windows()
    x, y, scales = a.luma(), b.luma(), []
    for i in range(len(weights)):
        scales.append(window_stats(x, y, layout, c1, c2) | {"w": float(x.shape[1]), "h": float(x.shape[0])})
        if i + 1 == len(weights) or x.shape == (1, 1):
            break
        x, y = halve(x), halve(y)
    used = sum(weights[: len(scales)])
    if not (used > 0 and math.isfinite(used)):
        raise UnsupportedInput("weights must sum to a positive finite value")
    score = 1.0
    for i, s in enumerate(scales):
        term = s["mean"] if i + 1 == len(scales) else s["cs"]
        score *= (0.0 if math.isnan(term) else min(max(term, 0.0), 1.0)) ** (weights[i] / used)
    details = {"scales": len(scales), "window_width": layout.width, "window_height": layout.height, "stride_x": layout.stride_x, "stride_y": layout.stride_y, "weight_sum": used}
    for i, s in enumerate(scales, 1):
        for label, k in (("ssim", "mean"), ("contrast_structure", "cs"), ("width", "w"), ("height", "h"), ("windows", "windows"), ("min_window_ssim", "min"), ("p05_window_ssim", "p05"), ("worst_window_x", "x"), ("worst_window_y", "y")):
            details[f"scale{i}_{label}"] = s[k]
    return row("ms-ssim", score, *UNITS["ms-ssim"], details)


CustomMetric = Callable[[Pixels, Pixels], Row]


def compare(reference: Frame, distorted: Frame, specs: list[MetricSpec], custom: dict[str, CustomMetric] | None = None) -> list[Row]:
    """Metric rows of one pair in the order of the specifications, then the custom metrics; one scan per domain."""
    a, b = Pixels(reference), Pixels(distorted)
    guard(a, b)
    seen: dict[Domain, ErrorStats] = {}
    out = []
    for s in specs:
        if s.canonical in ERROR_METRICS:
            stats = seen.get(s.domain)
            if stats is None:
                stats = seen[s.domain] = error_stats(a, b, s.domain)
            out.append(row(s.key, error_score(stats, s.canonical), *UNITS[s.canonical], stats.details()))
        else:
            out.append({"ssim": global_ssim, "wssim": windowed_ssim, "ms-ssim": ms_ssim}[s.canonical](a, b))
    return out + [f(a, b) for f in (custom or {}).values()]


def alpha_diagnostics(reference: Frame, distorted: Frame) -> dict[str, Any]:
    a, b = Pixels(reference), Pixels(distorted)
    guard(a, b)
    p, q = (np.floor(np.clip(f.alpha(), 0, 1) * 255.0 + 0.5).astype(int) for f in (a, b))
    d = np.abs(p - q)
    bucket = lambda v: {"transparent": int((v == 0).sum()), "opaque": int((v == 255).sum()), "partial": int(((v > 0) & (v < 255)).sum())}
    return {"reference": bucket(p), "distorted": bucket(q), "mismatch_count": int((d != 0).sum()), "max_delta": int(d.max()), "mismatches_beyond_one_lsb": int((d > 1).sum())}


def _display(p: Pixels) -> np.ndarray:
    f = p.format
    if f.is_yuv or f.is_binary or f.name.startswith("hsv"):
        raise UnsupportedInput("difference images need packed RGB or gray input")
    return np.clip(np.concatenate([p.rgb(), p.alpha()[..., None]], axis=2), 0.0, 1.0)


def _bytes(v: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(v, 0.0, 1.0) * 255.0 + 0.5).astype(np.uint8)


def heat(t: np.ndarray) -> np.ndarray:
    """Blue, cyan, yellow, red."""
    t = np.clip(t, 0.0, 1.0)
    k = np.select([t < 0.25, t < 0.5, t < 0.75], [t / 0.25, (t - 0.25) / 0.25, (t - 0.5) / 0.25], (t - 0.75) / 0.25)
    part = np.digitize(t, [0.25, 0.5, 0.75])
    zero, one = np.zeros_like(t), np.ones_like(t)
    return np.stack([np.choose(part, (zero, zero, k, one)), np.choose(part, (k, one, one, 1.0 - k)), np.choose(part, (one, 1.0 - k, zero, zero)), one], axis=-1)


def diff_image(reference: Frame, distorted: Frame, mode: str = "heatmap", scale: float = 4.0, include_alpha: bool = False) -> Frame:
    """An rgba8 frame: absolute, heatmap or signed_luma."""
    p, q = Pixels(reference), Pixels(distorted)
    guard(p, q)
    a, b = _display(p), _display(q)
    if mode == "absolute":
        d = np.abs(a - b) * scale
        d[..., 3] = d[..., 3] if include_alpha else 1.0
    elif mode == "heatmap":
        d = heat(np.sqrt(((a - b)[..., :3] ** 2).sum(axis=2) / 3.0) * scale)
    elif mode == "signed_luma":
        kr, kg, kb = (0.2126, 0.7152, 0.0722)
        s = ((b - a)[..., 0] * kr + (b - a)[..., 1] * kg + (b - a)[..., 2] * kb) * scale
        d = np.stack([np.maximum(s, 0), np.zeros_like(s), np.maximum(-s, 0), np.ones_like(s)], axis=-1)
    else:
        raise UnsupportedInput(f"unknown difference mode {mode!r}")
    return {"width": p.width, "height": p.height, "format": {"pixel_format": "rgba8", "color_space": "srgb", "transfer": "srgb", "range": "full"}, "planes": [{"data": _bytes(d).tobytes(), "stride": 4 * p.width}]}


def rgba8_code_stats(reference: Frame, distorted: Frame, channels: str = "all") -> dict[str, Any]:
    """Error statistics in 8-bit codes of two rgba8 frames; ``channels``: all four, or color."""
    a, b = Pixels(reference), Pixels(distorted)
    guard(a, b)
    if a.format.name != "rgba8" or b.format.name != "rgba8":
        raise UnsupportedInput("code statistics need rgba8 frames")
    d = (a.stored() - b.stored()).reshape(-1, 4) * 255.0
    d = np.round(d)
    part = d if channels == "all" else d[:, :3]
    return {
        "channel_mse": (d * d).mean(axis=0).tolist(), "channel_mae": np.abs(d).mean(axis=0).tolist(), "channel_max": np.abs(d).max(axis=0).tolist(),
        "mse": float((part * part).mean()), "mae": float(np.abs(part).mean()), "max": float(np.abs(part).max()), "samples": int(part.size), "psnr": psnr(float((part * part).mean()), 255.0),
    }


def with_windows(metric: str, layout: Windows) -> CustomMetric:
    """A windowed metric with a layout of its own, for ``custom``."""
    f = {"wssim": windowed_ssim, "ms-ssim": ms_ssim}[metric]
    return lambda a, b: f(a, b, replace(layout))
