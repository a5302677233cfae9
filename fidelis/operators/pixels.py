"""Numpy decoding of frames into sample arrays; a frame is a dict as in the frames schema."""

from __future__ import annotations

from typing import Any

import numpy as np

from ..functions.color import LUMA_DEFAULT, LUMA_WEIGHTS, YUV_DEFAULT, YUV_MATRICES
from ..functions.errors import InvalidFrame, UnsupportedInput
from ..functions.formats import PixelFormat, pixel_format

Frame = dict[str, Any]
#: 8-bit codes as samples.
_UNIT = np.arange(256) / 255.0


class Pixels:
    """One validated frame; every ``read`` returns float64 arrays of shape (height, width[, channels])."""

    def __init__(self, frame: Frame) -> None:
        self.width, self.height = int(frame["width"] or 0), int(frame["height"] or 0)
        if self.width <= 0 or self.height <= 0:
            raise InvalidFrame("dimensions must be positive")
        spec = frame["format"]
        self.format: PixelFormat = pixel_format(spec["pixel_format"])
        self.space = spec.get("color_space") or "srgb"
        planes = frame["planes"] or []
        if len(planes) != self.format.planes:
            raise InvalidFrame(f"{len(planes)} planes instead of {self.format.planes}")
        self.planes = [self._rows(p, i) for i, p in enumerate(planes)]

    def _rows(self, plane: dict[str, Any], index: int) -> np.ndarray:
        row, rows = self.format.plane_shape(self.width, self.height, index)
        raw, stride = np.frombuffer(plane["data"] or b"", np.uint8), int(plane["stride"] or 0)
        if stride < row or len(raw) < stride * (rows - 1) + row:
            raise InvalidFrame(f"plane {index} is shorter than its rows")
        return np.lib.stride_tricks.as_strided(raw, (rows, row), (stride, 1), writeable=False)

    def rows(self, begin: int, end: int) -> Pixels:
        """The rows of a packed frame as a frame of their own, without copying."""
        part = object.__new__(Pixels)
        part.width, part.height, part.format, part.space = self.width, end - begin, self.format, self.space
        part.planes = [self.planes[0][begin:end]]
        return part

    def stored(self) -> np.ndarray:
        """Stored channels of a packed format, divided by the largest code."""
        f, plane = self.format, self.planes[0]
        if f.is_binary or f.is_yuv:
            raise UnsupportedInput("stored channels need a packed format")
        if f.bytes_per_pixel == f.channels:
            return _UNIT[plane.reshape(self.height, self.width, f.channels)]
        kind = {2: np.dtype("<u2"), 4: np.dtype("=f4")}[f.bytes_per_pixel // f.channels]
        samples = np.ascontiguousarray(plane).view(kind).reshape(self.height, self.width, f.channels)
        return samples.astype(float) / f.max_code

    def bits(self) -> np.ndarray:
        order = "little" if self.format.name.endswith("lsb") else "big"
        return np.unpackbits(self.planes[0], axis=1, bitorder=order)[:, : self.width].astype(float)

    def yuv(self) -> np.ndarray:
        y, f = self.planes[0].astype(float), self.format.name
        if f == "nv12":
            u, v = self.planes[1][:, 0::2], self.planes[1][:, 1::2]
        else:
            u, v = self.planes[1], self.planes[2]
        rows = np.arange(self.height) // (2 if f in ("yuv420p8", "nv12") else 1)
        cols = np.arange(self.width) // (1 if f == "yuv444p8" else 2)
        return np.stack([y, u[rows][:, cols].astype(float), v[rows][:, cols].astype(float)], axis=-1) / 255.0

    def rgb(self) -> np.ndarray:
        f = self.format
        if f.is_binary:
            return np.repeat(self.bits()[..., None], 3, axis=2)
        if f.is_yuv:
            y, u, v = np.moveaxis(self.yuv() - np.array([0.0, 0.5, 0.5]), -1, 0)
            rv, gu, gv, bu = YUV_MATRICES.get(self.space, YUV_DEFAULT)
            return np.clip(np.stack([y + rv * v, y - gu * u - gv * v, y + bu * u], axis=-1), 0.0, 1.0)
        c = self.stored()
        if f.channels == 1:
            return np.repeat(c, 3, axis=2)
        if f.name.startswith("hsv"):
            return hsv_to_rgb(c[..., :3])
        return c[..., 2::-1] if f.name.startswith("bgr") else c[..., :3]

    def luma(self) -> np.ndarray:
        f = self.format
        if f.is_binary:
            return self.bits()
        if f.is_yuv:
            return self.planes[0].astype(float) / 255.0
        if f.channels == 1:
            return self.stored()[..., 0]
        kr, kg, kb = LUMA_WEIGHTS.get(self.space, LUMA_DEFAULT)
        if f.name in ("rgb8", "rgba8", "bgr8", "bgra8"):  # one table per channel instead of arithmetic
            codes = self.planes[0].reshape(self.height, self.width, f.channels)
            r, b = (2, 0) if f.name.startswith("bgr") else (0, 2)
            return (_UNIT * kr)[codes[..., r]] + (_UNIT * kg)[codes[..., 1]] + (_UNIT * kb)[codes[..., b]]
        rgb = self.rgb()
        return rgb[..., 0] * kr + rgb[..., 1] * kg + rgb[..., 2] * kb

    def alpha(self) -> np.ndarray:
        return self.stored()[..., 3] if self.format.has_alpha else np.ones((self.height, self.width))

    def hsv(self) -> np.ndarray:
        return self.stored()[..., :3] if self.format.name.startswith("hsv") else rgb_to_hsv(self.rgb())

    def binary(self) -> np.ndarray:
        alpha = self.alpha()
        return np.where(alpha < 1.0, alpha > 0.0, self.luma() >= 0.5).astype(float)

    def channels(self, kind: str) -> np.ndarray:
        """Samples of a render channel set, channels last."""
        if kind in ("gray", "binary"):
            return (self.luma() if kind == "gray" else self.binary())[..., None]
        base = self.rgb() if kind.startswith("rgb") else self.hsv()
        return np.concatenate([base, self.alpha()[..., None]], axis=2) if kind.endswith("a") else base

    def packed(self) -> bytes:
        """The planes without stride padding."""
        return b"".join(np.ascontiguousarray(p).tobytes() for p in self.planes)


def rgb_to_hsv(rgb: np.ndarray) -> np.ndarray:
    r, g, b = np.moveaxis(rgb, -1, 0)
    top, low = rgb.max(axis=-1), rgb.min(axis=-1)
    d = top - low
    safe = np.where(d == 0, 1.0, d)
    hue = np.select([d == 0, top == r, top == g], [0.0, np.mod((g - b) / safe, 6.0) / 6.0, ((b - r) / safe + 2.0) / 6.0], ((r - g) / safe + 4.0) / 6.0)
    return np.stack([hue, np.where(top == 0, 0.0, d / np.where(top == 0, 1.0, top)), top], axis=-1)


def hsv_to_rgb(hsv: np.ndarray) -> np.ndarray:
    h, s, v = np.mod(hsv[..., 0], 1.0) * 6.0, np.clip(hsv[..., 1], 0, 1), np.clip(hsv[..., 2], 0, 1)
    i = np.floor(h)
    f = h - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    i = np.minimum(i.astype(int), 5)
    out = np.stack([np.choose(i, c) for c in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q))], axis=-1)
    return np.where((s == 0)[..., None], v[..., None], out)
