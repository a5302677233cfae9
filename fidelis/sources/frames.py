"""Frames from encoded images, raw bytes, bit-packed gray, numpy arrays and generators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import InvalidFrame, QualityError
from ..functions.formats import FRAME_TYPE, default_spec, pixel_format
from ..operators.pixels import Frame, Pixels

# Names of the encodings that readers may be asked for; the reader below decodes what the JVM can.
IMAGE_FORMATS = ("avif", "bmp", "dds", "exr", "farbfeld", "gif", "hdr", "ico", "jpeg", "png", "pnm", "qoi", "tga", "tiff", "webp")


def image_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in IMAGE_FORMATS], "format string")


def packed(data: bytes, width: int, height: int, name: str, stride: int | None = None) -> Frame:
    """A frame of one plane."""
    row, _ = pixel_format(name).plane_shape(width, height, 0)
    frame = {"width": width, "height": height, "format": default_spec(name), "planes": [{"data": bytes(data), "stride": stride or row}]}
    Pixels(frame)
    return frame


def planar(planes: list[bytes], width: int, height: int, name: str, color_space: str | None = None) -> Frame:
    """A frame of tight planes, YUV or NV12."""
    f = pixel_format(name)
    if len(planes) != f.planes:
        raise InvalidFrame(f"{len(planes)} planes instead of {f.planes}")
    spec = default_spec(name) | ({"color_space": color_space} if color_space else {})
    frame = {"width": width, "height": height, "format": spec, "planes": [{"data": bytes(p), "stride": f.plane_shape(width, height, i)[0]} for i, p in enumerate(planes)]}
    Pixels(frame)
    return frame


def from_array(a: np.ndarray) -> Frame:
    """An 8-bit array (height, width[, 1, 3 or 4]) as a gray, rgb or rgba frame."""
    a = np.ascontiguousarray(a, np.uint8)
    name = {1: "luma8", 3: "rgb8", 4: "rgba8"}.get(a.shape[2] if a.ndim == 3 else 1)
    if name is None:
        raise InvalidFrame(f"no format for an array of shape {a.shape}")
    return packed(a.tobytes(), a.shape[1], a.shape[0], name)


def synthetic(width: int, height: int, phase: int = 0) -> Frame:
    """The benchmark frame: r = x + p, g = 3y + p, b = x + y + p modulo 256, opaque."""
    y, x = np.mgrid[:height, :width]
    rgba = np.stack([x + phase, 3 * y + phase, x + y + phase, np.full_like(x, 255)], axis=-1) % 256
    return from_array(rgba.astype(np.uint8))


def synthetic_pixels(spark: SparkSession, width: int, height: int, phases: DataFrame | None = None) -> DataFrame:
    """The benchmark frame as rows (y, x, r, g, b, a), for each row of ``phases`` (with a column phase)."""
    grid = spark.range(width * height).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    if phases is None:
        p = F.lit(0)
    else:
        at = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("i")
        grid = phases.select("*", at).select(*phases.columns, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"))
        p = F.col("phase")
    return grid.select(*(phases.columns if phases is not None else []), "y", "x", ((F.col("x") + p) % 256).alias("r"), ((F.col("y") * 3 + p) % 256).alias("g"), ((F.col("x") + F.col("y") + p) % 256).alias("b"), F.lit(255).alias("a"))


def tight(frame: Frame) -> Frame:
    """The frame without stride padding."""
    p = Pixels(frame)
    planes = [{"data": np.ascontiguousarray(v).tobytes(), "stride": v.shape[1]} for v in p.planes]
    return {**frame, "planes": planes}


def bit_packed_gray(data: bytes, width: int, height: int, bits: int, lsb_first: bool = True, stride: int | None = None) -> Frame:
    """1, 2 or 4 bits per pixel, widened to 8 by integer division."""
    if bits not in (1, 2, 4):
        raise InvalidFrame(f"{bits} bits per pixel")
    row = -(-width * bits // 8)
    stride = row if stride is None else stride
    if stride < row or len(data) < stride * (height - 1) + row:
        raise InvalidFrame("bit-packed rows are longer than the data")
    rows = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (height, row), (stride, 1), writeable=False)
    at = np.arange(width) * bits
    shift = at % 8 if lsb_first else 8 - bits - at % 8
    mask = (1 << bits) - 1
    values = (rows[:, at // 8] >> shift.astype(np.uint8)) & mask
    return from_array((values.astype(np.uint16) * 255 // mask).astype(np.uint8))


def bit_packed_value(byte: Column, x: Column, bits: int, lsb_first: bool = True) -> Column:
    """The same for a byte (0..255) and the pixel's place within its row, as a column."""
    at = (x * bits) % 8
    shift = at if lsb_first else F.lit(8 - bits) - at
    mask = (1 << bits) - 1
    return F.floor((F.floor(byte / F.pow(F.lit(2.0), shift)).cast("int").bitwiseAND(F.lit(mask)) * 255) / mask).cast("int")


def _decoded(files: DataFrame, inputs: list[str], work: Any) -> DataFrame:
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("frame", FRAME_TYPE), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                values = [batch.column(k)[i].as_py() for k in range(batch.num_columns)]
                try:
                    out = {"path": values[0], "frame": work(*values[1:]), "error": None}
                except QualityError as e:
                    out = {"path": values[0], "frame": None, "error": f"{e.kind}: {e}"}
                yield pa.RecordBatch.from_pylist([out], arrow)

    return files.select(*inputs).mapInArrow(run, schema)


def raw_frames(files: DataFrame, width: int, height: int, name: str, stride: int | None = None) -> DataFrame:
    """(path, frame, error) of files (path, content) of packed samples."""
    pixel_format(name)
    return _decoded(files, ["path", "content"], lambda content: packed(content or b"", width, height, name, stride))


def bit_packed_frames(files: DataFrame, width: int, height: int, bits: int, lsb_first: bool = True, stride: int | None = None) -> DataFrame:
    return _decoded(files, ["path", "content"], lambda content: bit_packed_gray(content or b"", width, height, bits, lsb_first, stride))


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, error) of encoded stills, as rgba8; what the JVM can't decode gives an error row."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    read = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").withColumn("path", F.regexp_replace("origin", "^file:/+", "file:/"))

    def rgba(height: int, width: int, channels: int, data: bytes) -> Frame:
        a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        if channels == 1:
            a = np.repeat(a, 3, axis=2)
        elif channels >= 3:
            a = np.concatenate([a[..., 2::-1], a[..., 3:4]], axis=2)
        if a.shape[2] == 3:
            a = np.concatenate([a, np.full((*a.shape[:2], 1), 255, np.uint8)], axis=2)
        return from_array(a)

    good = _decoded(read, ["path", "height", "width", "nChannels", "data"], rgba)
    return files.join(good, "path", "left").withColumn("error", F.coalesce("error", F.when(F.col("frame").isNull(), F.lit("unsupported_input: not a decodable image"))))


def write_png(frame: Frame) -> bytes:
    """An 8-bit rgba, rgb or gray frame as PNG."""
    import struct
    import zlib

    p = Pixels(tight(frame))
    kind = {"luma8": 0, "rgb8": 2, "rgba8": 6}.get(p.format.name)
    if kind is None:
        raise InvalidFrame(f"no PNG form of {p.format.name}")
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    rows = b"".join(b"\0" + r.tobytes() for r in p.planes[0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", p.width, p.height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_frames(videos: DataFrame, decoder: Any, width: int | None = None, height: int | None = None) -> DataFrame:
    """(path, frame_index, frame) by a caller's decoder: ``decoder(path, width, height)`` yields rgba8 frames.

    It runs on the executors; both sizes, or none, may ask it to scale.
    """
    if (width is None) != (height is None):
        raise InvalidFrame("scaling needs both width and height")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("frame_index", T.LongType()), T.StructField("frame", FRAME_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for i, frame in enumerate(decoder(path, width, height)):
                    yield pa.RecordBatch.from_pylist([{"path": path, "frame_index": i, "frame": frame}], arrow)

    return videos.select("path").mapInArrow(run, schema)
