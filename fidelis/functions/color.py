"""Color functions as columns; each has a numpy twin where kernels need one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights and YUV matrices (red by v, green by u and v, blue by u).
LUMA_WEIGHTS = {"bt601": (0.299, 0.587, 0.114), "bt2020": (0.2627, 0.6780, 0.0593)}
LUMA_DEFAULT = (0.2126, 0.7152, 0.0722)
YUV_MATRICES = {"bt601": (1.402, 0.344136, 0.714136, 1.772), "bt2020": (1.4746, 0.164553, 0.571353, 1.8814)}
YUV_DEFAULT = (1.5748, 0.187324, 0.468124, 1.8556)
# Constants of the HLG and PQ transfers.
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
PQ_M1, PQ_M2 = 2610.0 / 16384.0, 2523.0 / 32.0
PQ_C1, PQ_C2, PQ_C3 = 3424.0 / 4096.0, 2413.0 / 128.0, 2392.0 / 128.0


def luma_weights(space: str) -> tuple[float, float, float]:
    return LUMA_WEIGHTS.get(space, LUMA_DEFAULT)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def luma(r: Column, g: Column, b: Column, space: str = "srgb") -> Column:
    kr, kg, kb = luma_weights(space)
    return r * kr + g * kg + b * kb


def expand_luma_range(v: Column, range_: str) -> Column:
    return clamp01((v * 255.0 - 16.0) / 219.0) if range_ == "limited" else v


def expand_chroma_range(v: Column, range_: str) -> Column:
    return clamp01((v * 255.0 - 16.0) / 224.0) if range_ == "limited" else v


def decode_transfer(v: Column, transfer: str, standard_hlg: bool = False) -> Column:
    """Signal to linear light; ``standard_hlg`` takes the published HLG inverse instead of the default form."""
    v = clamp01(v)
    if transfer == "srgb":
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    if transfer == "bt1886":
        return F.pow(v, F.lit(2.4))
    if transfer == "hlg":
        upper = (F.exp((v - HLG_C) / HLG_A) + HLG_B) / 12.0 if standard_hlg else (F.exp(v - HLG_C) + HLG_B) / 12.0 / float(np.exp(HLG_A))
        return F.when(v <= 0.5, v * v / 3.0).otherwise(upper)
    if transfer == "pq":
        p = F.pow(v, F.lit(1.0 / PQ_M2))
        return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (F.lit(PQ_C2) - p * PQ_C3), F.lit(1.0 / PQ_M1))
    return v


def encode_transfer(v: Column, transfer: str) -> Column:
    """Linear light to signal."""
    v = clamp01(v)
    if transfer == "srgb":
        return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1.0 / 2.4)) * 1.055 - 0.055)
    if transfer == "bt1886":
        return F.pow(v, F.lit(1.0 / 2.4))
    if transfer == "hlg":
        return F.when(v <= 1.0 / 12.0, F.sqrt(v * 3.0)).otherwise(F.ln(F.greatest(v * 12.0 - HLG_B, F.lit(1e-12))) * HLG_A + HLG_C)
    if transfer == "pq":
        p = F.pow(v, F.lit(PQ_M1))
        return F.pow((p * PQ_C2 + PQ_C1) / (p * PQ_C3 + 1.0), F.lit(PQ_M2))
    return v


def rgb_to_luma(r: Column, g: Column, b: Column, space: str = "srgb", transfer: str = "srgb", range_: str = "full", linearise: bool = False) -> Column:
    """Luma in 0..1, after expansion of a limited range, and linearised where asked for."""
    channels = [expand_luma_range(c, range_) for c in (r, g, b)]
    if linearise:
        channels = [decode_transfer(c, transfer) for c in channels]
    return clamp01(luma(*channels, space=space))


def yuv_to_rgb(y: Column, u: Column, v: Column, space: str = "bt709", range_: str = "full") -> tuple[Column, Column, Column]:
    """RGB in 0..1, honouring the range; metrics read YUV as full range whatever the frame says."""
    y, u, v = expand_luma_range(y, range_), expand_chroma_range(u, range_) - 0.5, expand_chroma_range(v, range_) - 0.5
    rv, gu, gv, bu = YUV_MATRICES.get(space, YUV_DEFAULT)
    return clamp01(y + v * rv), clamp01(y - u * gu - v * gv), clamp01(y + u * bu)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue as a share of the circle, exact comparisons."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(top - low, F.lit(0.0))
    six = lambda c: c - F.floor(c / 6.0) * 6.0
    hue = F.when(d.isNull(), 0.0).when(top == r, six((g - b) / d) / 6.0).when(top == g, ((b - r) / d + 2.0) / 6.0).otherwise(((r - g) / d + 4.0) / 6.0)
    return hue, F.when(top == 0.0, 0.0).otherwise((top - low) / F.nullif(top, F.lit(0.0))), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    s, v = clamp01(s), clamp01(v)
    h = (h - F.floor(h)) * 6.0
    i = F.floor(h)
    f = h - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *by_sector: F.element_at(F.array(*by_sector), (F.least(i, F.lit(5)) + 1).cast("int"))
    gray = s == 0.0
    return F.when(gray, v).otherwise(pick(v, q, p, p, t, v)), F.when(gray, v).otherwise(pick(t, v, v, q, p, p)), F.when(gray, v).otherwise(pick(p, p, t, v, v, q))


def rgb_to_hsv_degrees(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The profile's variant: hue in degrees, comparisons within machine epsilon."""
    eps = float(np.finfo(float).eps)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    gray = top - low <= eps
    d = F.when(~gray, top - low)
    six = lambda c: c - F.floor(c / 6.0) * 6.0
    hue = F.when(gray, 0.0).when(F.abs(top - r) <= eps, six((g - b) / d) * 60.0).when(F.abs(top - g) <= eps, ((b - r) / d + 2.0) * 60.0).otherwise(((r - g) / d + 4.0) * 60.0)
    return hue, F.when(top <= eps, 0.0).otherwise((top - low) / F.when(top > eps, top)), top
