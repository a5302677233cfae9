"""Statistics of a single image: channels, luma, hue and saturation, balance, tendencies, regions, histograms."""

from __future__ import annotations

from typing import Any

import numpy as np

from ..functions.errors import InvalidFrame
from .pixels import Frame, Pixels

_EPS = float(np.finfo(float).eps)


def _channel(v: np.ndarray) -> dict[str, float]:
    s = np.sort(v)
    n = len(s)
    pick = lambda p: float(s[int((n - 1) * p + 0.5)])  # noqa: E731  nearest index
    share = np.array(_histogram(v, 256)) / n
    share = share[share > 0]
    mean = float(s.mean())
    return {
        "min": float(s[0]), "max": float(s[-1]), "mean": mean, "std_dev": float(np.sqrt(((s - mean) ** 2).mean())), "median": pick(0.5), "p01": pick(0.01), "p05": pick(0.05), "p95": pick(0.95), "p99": pick(0.99),
        "entropy_bits": float(-(share * np.log2(share)).sum()) + 0.0, "clipped_low_ratio": float((s <= 1 / 255).mean()), "clipped_high_ratio": float((s >= 254 / 255).mean()),
    }


def _histogram(v: np.ndarray, bins: int) -> list[int]:
    return np.bincount(np.minimum(np.floor(np.clip(v, 0, 1) * bins), bins - 1).astype(int), minlength=bins).tolist()


def _hsv(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    safe = np.where(d <= _EPS, 1.0, d)
    hue = np.select([d <= _EPS, np.abs(top - r) <= _EPS, np.abs(top - g) <= _EPS], [0.0, 60.0 * np.mod((g - b) / safe, 6.0), 60.0 * ((b - r) / safe + 2.0)], 60.0 * ((r - g) / safe + 4.0))
    return hue, np.where(top <= _EPS, 0.0, d / np.where(top <= _EPS, 1.0, top)), top


def image_statistics(frame: Frame, bins: int = 16) -> dict[str, Any]:
    """The whole profile; rgb8, rgba8, bgr8, bgra8 and luma8 frames only."""
    p = Pixels(frame)
    if p.format.name not in ("rgb8", "rgba8", "bgr8", "bgra8", "luma8"):
        raise InvalidFrame(f"statistics need 8-bit RGB or gray, not {p.format.name}")
    bins = min(max(bins, 1), 256)
    r, g, b = (c.ravel() for c in np.moveaxis(p.rgb(), -1, 0))
    alpha = p.alpha().ravel() if p.format.has_alpha else None
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    hue, sat, val = _hsv(r, g, b)
    cr, cg, cb, cl, cs, cv = map(_channel, (r, g, b, luma, sat, val))
    ca = _channel(alpha) if alpha is not None else None
    turns = hue / 360.0 * 2 * np.pi
    mr, mg, mb = cr["mean"], cg["mean"], cb["mean"]
    total = max(mr + mg + mb, _EPS)
    share = [mr / total, mg / total, mb / total]
    rmb, gm = mr - mb, mg - (mr + mb) * 0.5
    balance = {
        "red_mean": mr, "green_mean": mg, "blue_mean": mb, "normalized_rgb": share, "red_minus_blue": rmb, "green_magenta": gm, "warm_cool_score": rmb + 0.25 * (mg - mb),
        "white_balance_gains": [total / 3.0 / max(m, 1 / 255) for m in (mr, mg, mb)], "dominant_channel": max((mr, 0, "red"), (mg, 1, "green"), (mb, 2, "blue"))[2],
    }
    # Thresholds and names of the tendencies.
    three = lambda v, low, high, names: names[0] if v < low else names[2] if v > high else names[1]
    tendencies = {
        "exposure": three(cl["mean"], 0.25, 0.75, ("dark", "balanced", "bright")), "contrast": three(cl["std_dev"], 0.08, 0.24, ("low", "medium", "high")),
        "saturation": three(cs["mean"], 0.10, 0.55, ("muted", "moderate", "vivid")), "temperature": three(rmb, -0.05, 0.05, ("cool", "neutral", "warm")), "tint": three(gm, -0.04, 0.04, ("magenta", "neutral", "green")),
        "likely_grayscale": cs["mean"] < 0.03, "shadow_clipping": cl["clipped_low_ratio"] > 0.01, "highlight_clipping": cl["clipped_high_ratio"] > 0.01, "color_cast": max(abs(rmb), abs(gm)) > 0.06,
        "has_transparency": bool(ca and ca["min"] < 1.0), "mostly_transparent": bool(ca and ca["mean"] < 0.5), "dominant_channel_bias": any(abs(s - 1 / 3) > 0.08 for s in share), "low_dynamic_range": cl["p95"] - cl["p05"] < 0.20,
    }
    w, h = p.width, p.height
    ys, xs = np.divmod(np.arange(w * h), w)
    center = (xs >= w // 4) & (xs < w * 3 // 4) & (ys >= h // 4) & (ys < h * 3 // 4)
    mean = lambda m: float(luma[m].mean()) if m.any() else 0.0
    spatial = {"center_luma_mean": mean(center), "border_luma_mean": mean(~center), "top_luma_mean": mean(ys < h // 2), "bottom_luma_mean": mean(ys >= h // 2), "left_luma_mean": mean(xs < w // 2), "right_luma_mean": mean(xs >= w // 2)}
    spatial["center_border_delta"] = spatial["center_luma_mean"] - spatial["border_luma_mean"]
    named = {"red": r, "green": g, "blue": b, "alpha": alpha, "luma": luma, "hue": hue / 360.0, "saturation": sat, "value": val}
    return {
        "width": w, "height": h, "pixels": w * h, "pixel_format": p.format.name, "channels": {"red": cr, "green": cg, "blue": cb, "alpha": ca}, "luma": cl,
        "hsv": {"mean_hue_degrees": float(np.mod(np.degrees(np.arctan2(np.sin(turns).sum(), np.cos(turns).sum())), 360.0)), "mean_saturation": cs["mean"], "mean_value": cv["mean"], "saturation": cs, "value": cv},
        "color_balance": balance, "tendencies": tendencies, "spatial": spatial, "histograms": {"bins": bins} | {k: None if v is None else _histogram(v, bins) for k, v in named.items()},
    }
