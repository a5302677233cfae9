"""Zstandard WARC archives: writer, and a reader that validates what it decodes.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame per record. The
dictionary may itself be a Zstandard frame. Archives travel as binary columns, so any store that Spark reads
will do: a table of this writer, or real files through ``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table

SKIPPABLE = 0x184D2A5D
_ZSTD = 0xFD2FB528
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
RECORDS = "archive string, position int, page_id long, uri string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, headers map<string,string>, error string"


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """An id that others can derive from page and payload; ``place`` sets apart what no record refers to."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest} {place}')}>"


def _clean(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def build_record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z", place: str = "") -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header only."""
    own = "" if refers_to is None and page_id is not None else place
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, own)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary of at most ``size`` bytes; empty where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def split_frames(data: memoryview) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, skippable) of each frame, by walking block headers; ValueError where one is cut short."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"cut frame header at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + size
            if end > len(data):
                raise ValueError(f"cut skippable frame at {at}")
            yield at, end, True
        elif magic == _ZSTD:
            end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
            checksum = data[at + 4] >> 2 & 1
            last = 0
            while not last:
                if end + 3 > len(data):
                    raise ValueError(f"cut block header at {end}")
                word = data[end] | data[end + 1] << 8 | data[end + 2] << 16
                last, kind = word & 1, word >> 1 & 3
                if kind == 3:
                    raise ValueError(f"reserved block type at {end}")
                end += 3 + (1 if kind == 1 else word >> 3)
            end += 4 * checksum
            if end > len(data):
                raise ValueError(f"cut frame at {at}")
            yield at, end, False
        else:
            raise ValueError(f"no frame at {at}")
        at = end


def parse_record(raw: bytes) -> dict:
    """Validate and take apart one record; ValueError says what is wrong with it."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise ValueError(f"no {need}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("length differs from Content-Length")
    block = rest[:-4]
    if (want := fields.get("warc-block-digest")) and want != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    out = {"fields": fields, "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"), "payload": None, "payload_bytes": None, "digest": None}
    out["page_id"] = int(fields["x-page-id"]) if "x-page-id" in fields else None
    out["refers_to"] = int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None
    if fields.get("content-type", "").startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("no end of the HTTP header")
        sizes = [v.strip() for k, c, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"]
        out["payload_bytes"] = int(sizes[0]) if sizes else len(payload)
        out["digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if out["record_type"] == "response":
            own = hashlib.sha1(payload).hexdigest()
            if len(payload) != out["payload_bytes"] or out["digest"] not in (None, own):
                raise ValueError("payload length or digest differs")
            out["payload"], out["digest"] = payload, own
        elif out["record_type"] == "revisit" and (out["refers_to"] is None or "warc-profile" not in fields):
            raise ValueError("revisit without target or profile")
    return out


def read_archive(data: bytes) -> Iterator[tuple[int, dict | None, str | None]]:
    """(position, record, error) of each record frame; an archive that can't be walked on ends in an error row."""
    view, reader, position = memoryview(data), zstandard.ZstdDecompressor(), 0
    try:
        for begin, end, skippable in split_frames(view):
            if skippable:
                if begin == 0:
                    held = bytes(view[begin + 8 : end])
                    if held[:4] == struct.pack("<I", _ZSTD):
                        held = zstandard.ZstdDecompressor().decompress(held)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
                continue
            try:
                frame = view[begin:end]
                size = zstandard.frame_content_size(bytes(frame[:18]))
                raw = reader.decompress(frame) if size >= 0 else reader.decompressobj().decompress(frame)
                yield position, parse_record(raw), None
            except (ValueError, zstandard.ZstdError) as e:
                yield position, None, str(e)
            position += 1
    except (ValueError, zstandard.ZstdError) as e:
        yield position, None, str(e)


def with_revisits(pages: DataFrame, least_bytes: int = 1000, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads the largest page_id is kept, others point to it."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    groups = p.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
    groups = persist_table(groups.where("n > 1").select("digest", "leader"), "repeated")
    few = groups.count() <= broadcast_rows  # its size is checked; beyond that the pages are shuffled by digest
    joined = p.join(F.broadcast(groups) if few else groups, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("leader") != F.coalesce("page_id", F.col("leader") - 1), F.col("leader")).alias("refers_to"))


def write_archives(records: DataFrame, dictionary: bytes, level: int = 3) -> DataFrame:
    """(archive, content) rows from page_id, url, payload, digest, refers_to."""
    lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True, write_content_size=True)

        def close(frames: list[bytes]) -> pa.RecordBatch:
            content = b"".join(frames)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest() + ".warc.zst"]), pa.array([content], pa.binary())], ["archive", "content"])

        frames, size, part, at = [lead], 0, TaskContext.get().partitionId(), 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames.append(squeeze.compress(build_record(*row, place=f"{part}/{at}")))
                at += 1
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield close(frames)
                    frames, size = [lead], 0
        if size:
            yield close(frames)

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives (archive, content); what can't be decoded or validated has ``error``.

    A null or empty content gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "position", "page_id", "uri", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "headers", "error"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for position, r, error in read_archive(content.as_py() or b""):
                    r = r or {"fields": {}}
                    rows.append((archive, position, r.get("page_id"), r.get("uri"), r.get("record_type"), r.get("payload"), r.get("payload_bytes"), r.get("digest"), r.get("refers_to"), list(r["fields"].items()), error))
                    held += len(r.get("payload") or b"")
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select("archive", "content").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, sample_rows: int = 1000, least_bytes: int = 1000) -> DataFrame:
    """Write pages (page_id, url, html) as archives into the shared folder; returns (archive, content) read back.

    The dictionary is trained on the at most ``sample_rows`` pages with the smallest hashes of page_id. A null
    html is an empty payload; a null url gives no target header. Rows that repeat the largest page_id of a
    payload are responses too, and share their record id; all other records have ids of their own. A null page_id never is what others refer to. No pages: no archives.
    """
    some = pages.where("page_id is not null").select(F.xxhash64("page_id").alias("h"), "page_id").orderBy("h", "page_id").limit(sample_rows)
    chosen = pages.join(F.broadcast(some.select("page_id").distinct()), "page_id").where(F.octet_length("html") < 65536).select(F.col("html").cast("binary")).limit(2 * sample_rows)
    samples = [bytes(r[0]) for r in chosen.collect() if r[0]]
    return persist_table(write_archives(with_revisits(pages, least_bytes), train_dictionary(samples)), "archives")
