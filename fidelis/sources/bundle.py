"""Raw frame bundles: an ordered container of labelled, tagged frames.

Layout, little endian: magic, u32 record count; per record u32 width, u32 height, four u16 codes (pixel format,
color space, transfer, range), a label (u32 length, all ones for none), u32 tag count, u32 plane count, the tags,
and the planes (u64 stride, u64 length, bytes).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import BundleError, QualityError
from ..functions.formats import BY_CODE, BY_NAME, COLOR_SPACES, FRAME_FIELDS, RANGES, TRANSFERS
from ..operators.pixels import Pixels

# The magic of the format, and the length that stands for no label.
MAGIC = b"IMQRAW1\n"
NO_LABEL = 0xFFFFFFFF
_SPACES, _TRANSFERS, _RANGES = ({v: k for k, v in d.items()} for d in (COLOR_SPACES, TRANSFERS, RANGES))

RECORD_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("record_index", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), *FRAME_FIELDS, T.StructField("error", T.StringType())])
Record = dict[str, Any]


def encode(records: list[Record]) -> bytes:
    """Records are dicts with label, tags, width, height, format, planes."""
    out = [MAGIC, struct.pack("<I", len(records))]
    for r in records:
        Pixels(r)  # raises for a frame that is not valid
        f = r["format"]
        codes = (BY_NAME[f["pixel_format"]].code, COLOR_SPACES[f["color_space"]], TRANSFERS[f["transfer"]], RANGES[f["range"]])
        out.append(struct.pack("<II4H", r["width"], r["height"], *codes))
        label, tags = r.get("label"), r.get("tags") or []
        raw = b"" if label is None else label.encode()
        out.append(struct.pack("<I", NO_LABEL if label is None else len(raw)) + raw)
        out.append(struct.pack("<II", len(tags), len(r["planes"])))
        out += [struct.pack("<I", len(t)) + t for t in (tag.encode() for tag in tags)]
        for p in r["planes"]:
            out += [struct.pack("<QQ", p["stride"], len(p["data"])), bytes(p["data"])]
    return b"".join(out)


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = memoryview(data), 0

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> memoryview:
        if n > self.left:
            raise BundleError(f"cut short at byte {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def numbers(self, kinds: str) -> tuple[int, ...]:
        return struct.unpack("<" + kinds, self.take(struct.calcsize("<" + kinds)))

    def text(self, n: int) -> str:
        try:
            return bytes(self.take(n)).decode("utf-8")
        except UnicodeDecodeError:
            raise BundleError("text is not UTF-8") from None


def records(data: bytes, wanted: set[int] | None = None, check: bool = True) -> Iterator[tuple[int, Record]]:
    """(index, record) of a bundle; planes of records that aren't wanted are skipped, not copied."""
    c = _Cursor(data)
    if bytes(c.take(min(8, c.left))) != MAGIC:
        raise BundleError("not a bundle")
    (count,) = c.numbers("I")
    if count > c.left // 28:  # the shortest record
        raise BundleError(f"{count} records don't fit")
    for index in range(count):
        width, height, *codes = c.numbers("II4H")
        for code, known in zip(codes, (BY_CODE, _SPACES, _TRANSFERS, _RANGES), strict=True):
            if code not in known:
                raise BundleError(f"unknown code {code} in record {index}")
        fmt = {"pixel_format": BY_CODE[codes[0]].name, "color_space": _SPACES[codes[1]], "transfer": _TRANSFERS[codes[2]], "range": _RANGES[codes[3]]}
        (n,) = c.numbers("I")
        label = None if n == NO_LABEL else c.text(n)
        n_tags, n_planes = c.numbers("II")
        if n_planes != BY_CODE[codes[0]].planes or n_tags > c.left // 4:
            raise BundleError(f"impossible counts in record {index}")
        tags = [c.text(c.numbers("I")[0]) for _ in range(n_tags)]
        keep, planes = wanted is None or index in wanted, []
        for _ in range(n_planes):
            stride, size = c.numbers("QQ")
            raw = c.take(size)
            planes.append({"data": bytes(raw) if keep else b"", "stride": stride})
        if keep:
            r = {"label": label, "tags": tags, "width": width, "height": height, "format": fmt, "planes": planes}
            if check:
                Pixels(r)
            yield index, r
    if c.left:
        raise BundleError(f"{c.left} bytes after the last record")


def decode(data: bytes, limit: int | None = None) -> list[Record]:
    if limit is not None and len(data) > limit:
        raise BundleError(f"{len(data)} bytes are over the limit of {limit}")
    return [r for _, r in records(data)]


def record_count(data: bytes) -> int:
    return sum(1 for _ in records(data))


def decode_record(data: bytes, index: int) -> Record:
    found = [r for i, r in records(data, {index}) if i == index]
    if not found:
        raise BundleError(f"no record {index}")
    return found[0]


def find_tag(data: bytes, tag: str) -> int:
    """Index of the first record with the tag."""
    for i, r in records(data, check=False):
        if tag in r["tags"]:
            return i
    raise BundleError(f"no record has the tag {tag!r}")


def read_bundles(files: DataFrame, limit: int | None = None, wanted: set[int] | None = None) -> DataFrame:
    """One row per record of the files (path, content), as ``spark.read.format("binaryFile")`` gives them.

    A file that can't be read gives a single row with ``error``; ``limit`` keeps longer files from being loaded.
    """
    files = files.select("path", *(["length"] if "length" in files.columns else []), "content")
    if limit is not None:
        size = F.col("length") if "length" in files.columns else F.octet_length("content")
        files = files.withColumn("content", F.when(size <= limit, F.col("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD_SCHEMA)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                try:
                    if raw is None:
                        raise BundleError("missing, or over the byte limit")
                    for i, r in list(records(raw, wanted)):
                        yield pa.RecordBatch.from_pylist([{"path": path, "record_index": i, **r, "error": None}], schema)
                except QualityError as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": f"{e.kind}: {e}"}], schema)

    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def load_bundles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return read_bundles(spark.read.format("binaryFile").load(path), limit)


def by_tag(rows: DataFrame, tag: str) -> DataFrame:
    """The first record of each bundle with the tag."""
    hits = rows.where(F.array_contains("tags", tag))
    first = hits.groupBy("path").agg(F.min("record_index").alias("record_index"))
    return hits.join(first, ["path", "record_index"])


def by_index(rows: DataFrame, index: int) -> DataFrame:
    return rows.where(F.col("record_index") == index)


def bundle_info(rows: DataFrame) -> DataFrame:
    """path, index, label, tags, dimensions, formats, planes, bytes: a row per record."""
    size = F.aggregate("planes", F.lit(0).cast("long"), lambda acc, p: acc + F.octet_length(p["data"]))
    return rows.select("path", F.col("record_index").alias("index"), F.coalesce("label", F.lit("")).alias("label"), F.array_join("tags", ",").alias("tags"), "width", "height", "format.pixel_format", "format.color_space", "format.transfer", "format.range", F.size("planes").alias("planes"), size.alias("bytes"))


def encode_bundles(frames: DataFrame, key: str = "bundle", order: str = "record_index") -> DataFrame:
    """(key, content): the frames of each key (label, tags, width, height, format, planes) packed in order.

    A bundle is one value, so a key's frames meet in one task.
    """
    cols = ["label", "tags", "width", "height", "format", "planes"]

    def pack(t: pa.Table) -> pa.Table:
        rows = t.sort_by(order).select(cols).to_pylist()
        return pa.table([t.column(key).slice(0, 1), pa.array([encode(rows)], pa.binary())], [key, "content"])

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, order, *cols).groupBy(key).applyInArrow(pack, f"{key} {kind}, content binary")


def pack_labels(inputs: list[str], labels: list[str] | None = None) -> list[str]:
    """A label per input; without labels the inputs themselves."""
    if labels and len(labels) != len(inputs):
        raise BundleError(f"{len(labels)} labels for {len(inputs)} inputs")
    return list(labels or inputs)


def pack_tags(count: int, specs: list[str]) -> list[list[str]]:
    """Tags per input from ``TAG``, ``all:TAG`` and ``N:TAG`` (1-based)."""
    out: list[list[str]] = [[] for _ in range(count)]
    for spec in specs:
        target, colon, tag = spec.partition(":")
        if not colon or target.lower() == "all":
            for tags in out:
                tags.append(tag if colon else spec)
            continue
        if not target.isdigit() or not 1 <= int(target) <= count:
            raise BundleError(f"tag target {target!r} is not one of 1..{count}")
        out[int(target) - 1].append(tag)
    return out


def frame_column() -> Column:
    """The frame of a record row as one struct."""
    return F.struct("width", "height", "format", "planes")


def compare_records(data: bytes, reference: int | str, distorted: int | str, metrics: object = None) -> list[dict[str, Any]]:
    """Metric rows of two records of one bundle, each given by index or tag."""
    from ..functions.spec import parse_specs
    from ..operators.kernels import compare

    at = [find_tag(data, k) if isinstance(k, str) else k for k in (reference, distorted)]
    return compare(decode_record(data, at[0]), decode_record(data, at[1]), parse_specs(metrics))  # type: ignore[arg-type]
