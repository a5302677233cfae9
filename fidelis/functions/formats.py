"""Pixel formats, frame formats, and the validity of frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidFrame

# Wire code, name, planes, bytes per pixel (0: not packed), channels, largest code.
FORMATS = (
    (1, "luma8", 1, 1, 1, 255.0),
    (2, "rgb8", 1, 3, 3, 255.0),
    (3, "rgba8", 1, 4, 4, 255.0),
    (4, "bgr8", 1, 3, 3, 255.0),
    (5, "bgra8", 1, 4, 4, 255.0),
    (6, "luma16le", 1, 2, 1, 65535.0),
    (7, "rgb16le", 1, 6, 3, 65535.0),
    (8, "rgba16le", 1, 8, 4, 65535.0),
    (9, "rgbf32", 1, 12, 3, 1.0),
    (10, "rgbaf32", 1, 16, 4, 1.0),
    (11, "yuv444p8", 3, 0, 3, 255.0),
    (12, "yuv422p8", 3, 0, 3, 255.0),
    (13, "yuv420p8", 3, 0, 3, 255.0),
    (14, "nv12", 2, 0, 3, 255.0),
    (15, "hsv8", 1, 3, 3, 255.0),
    (16, "hsva8", 1, 4, 4, 255.0),
    (17, "binary1lsb", 1, 0, 1, 1.0),
    (18, "binary1msb", 1, 0, 1, 1.0),
)
# Wire codes of color spaces, transfers and ranges.
COLOR_SPACES = {"srgb": 1, "linear_rgb": 2, "bt601": 3, "bt709": 4, "bt2020": 5, "unknown": 65535}
TRANSFERS = {"srgb": 1, "linear": 2, "bt1886": 3, "hlg": 4, "pq": 5, "unknown": 65535}
RANGES = {"full": 1, "limited": 2}


@dataclass(frozen=True)
class PixelFormat:
    code: int
    name: str
    planes: int
    bytes_per_pixel: int
    channels: int
    max_code: float

    @property
    def is_yuv(self) -> bool:
        return self.name in ("yuv444p8", "yuv422p8", "yuv420p8", "nv12")

    @property
    def is_binary(self) -> bool:
        return self.name.startswith("binary1")

    @property
    def has_alpha(self) -> bool:
        return self.name in ("rgba8", "bgra8", "rgba16le", "rgbaf32", "hsva8")

    def plane_shape(self, width: int, height: int, plane: int) -> tuple[int, int]:
        """(bytes in a row, rows) of a plane."""
        if not 0 <= plane < self.planes:
            raise InvalidFrame(f"plane {plane} of {self.planes}")
        half_w, half_h = -(-width // 2), -(-height // 2)
        if self.is_binary:
            return -(-width // 8), height
        if not self.is_yuv:
            return width * self.bytes_per_pixel, height
        if plane == 0 or self.name == "yuv444p8":
            return width, height
        if self.name == "nv12":
            return 2 * half_w, half_h
        return half_w, height if self.name == "yuv422p8" else half_h


BY_NAME = {f[1]: PixelFormat(*f) for f in FORMATS}
BY_CODE = {f.code: f for f in BY_NAME.values()}

FORMAT_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("pixel_format", "color_space", "transfer", "range")])
PLANE_TYPE = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("stride", T.IntegerType())])
FRAME_FIELDS = [
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("format", FORMAT_TYPE),
    T.StructField("planes", T.ArrayType(PLANE_TYPE)),
]
FRAME_TYPE = T.StructType(FRAME_FIELDS)
FRAMES_SCHEMA = T.StructType([T.StructField("frame_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), *FRAME_FIELDS])


def pixel_format(name: str) -> PixelFormat:
    try:
        return BY_NAME[name.lower()]
    except KeyError:
        raise InvalidFrame(f"unknown pixel format {name!r}") from None


def default_spec(name: str) -> dict[str, str]:
    """Color defaults of a format: YUV is BT.709 with its display transfer, all else sRGB, range full."""
    yuv = pixel_format(name).is_yuv
    return {"pixel_format": name, "color_space": "bt709" if yuv else "srgb", "transfer": "bt1886" if yuv else "srgb", "range": "full"}


def format_table(spark: SparkSession) -> DataFrame:
    """The formats as a small table to join or show."""
    return spark.createDataFrame(list(FORMATS), "code int, pixel_format string, planes int, bytes_per_pixel int, channels int, max_code double")


def _shape_columns(name: Column, width: Column, height: Column, plane: Column) -> tuple[Column, Column]:
    half_w, half_h = F.ceil(width / 2), F.ceil(height / 2)
    packed = F.lit(0)
    for f in BY_NAME.values():
        if f.bytes_per_pixel:
            packed = F.when(name == f.name, F.lit(f.bytes_per_pixel)).otherwise(packed)
    row = (
        F.when(packed > 0, width * packed)
        .when(name.startswith("binary1"), F.ceil(width / 8))
        .when((plane == 0) | (name == "yuv444p8"), width)
        .when(name == "nv12", half_w * 2)
        .otherwise(half_w)
    )
    rows = F.when((plane > 0) & name.isin("yuv420p8", "nv12"), half_h).otherwise(height)
    return row.cast("long"), rows.cast("long")


def frame_error(width: Column, height: Column, fmt: Column, planes: Column) -> Column:
    """Null for a valid frame, else what is wrong with it; a plane's last row needs no padding."""
    w, h = width.cast("long"), height.cast("long")
    wanted = F.lit(None).cast("int")
    for f in BY_NAME.values():
        wanted = F.when(fmt["pixel_format"] == f.name, F.lit(f.planes)).otherwise(wanted)

    def bad(p: Column, i: Column) -> Column:
        row, rows = _shape_columns(fmt["pixel_format"], w, h, i)
        stride = p["stride"].cast("long")
        return p["data"].isNull() | stride.isNull() | (stride < row) | (F.octet_length(p["data"]) < stride * (rows - 1) + row)

    broken = F.size(F.filter(F.transform(planes, bad), lambda b: b)) > 0
    return (
        F.when(w.isNull() | h.isNull() | (w <= 0) | (h <= 0), F.lit("dimensions must be positive"))
        .when(wanted.isNull(), F.lit("unknown pixel format"))
        .when(planes.isNull() | (F.size(planes) != wanted), F.lit("wrong number of planes"))
        .when(broken, F.lit("a plane is shorter than its rows"))
    )


def validate_frames(frames: DataFrame) -> DataFrame:
    """``frames`` with a column ``error``: null where width, height, format and planes go together."""
    return frames.withColumn("error", frame_error(F.col("width"), F.col("height"), F.col("format"), F.col("planes")))
