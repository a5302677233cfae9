"""Where inputs are: paths, standard input, ssh URIs; explicit frame pairs; remote shell quoting."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import UnsupportedInput

# Extensions that name videos.
VIDEO_EXTENSIONS = ("avi", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "webm", "wmv")
#: Bytes that a remote input may have by default.
REMOTE_LIMIT = 512 << 20
TRANSFER_MODES = ("stream", "copy-input", "copy-frame", "copy-source")


@dataclass(frozen=True)
class Locator:
    kind: str  # local, stdin or ssh
    path: str
    user: str | None = None
    host: str | None = None
    port: int | None = None

    @property
    def target(self) -> str:
        """user@host for a remote shell."""
        return f"{self.user}@{self.host}" if self.user else str(self.host)

    @property
    def copy_target(self) -> str:
        host = f"[{self.host}]" if ":" in str(self.host) else str(self.host)
        return f"{self.user}@{host}" if self.user else host

    @property
    def uri(self) -> str:
        if self.kind != "ssh":
            return "stdin" if self.kind == "stdin" else self.path
        return f"ssh://{self.copy_target}{f':{self.port}' if self.port else ''}{self.path}"

    @property
    def extension(self) -> str | None:
        name = self.path.rsplit("/", 1)[-1]
        return name.rsplit(".", 1)[1] if "." in name and self.kind != "stdin" else None


def _component(what: str, value: str) -> str:
    if not value or value.startswith("-") or re.search(r"[\s\x00-\x1f]", value):
        raise UnsupportedInput(f"invalid ssh {what} {value!r}")
    return value


def parse_locator(text: str) -> Locator:
    """A path, ``-`` for standard input, or ssh://[user@]host[:port]/path with IPv6 hosts in brackets."""
    if text == "-":
        return Locator("stdin", "")
    if not text.startswith("ssh://"):
        return Locator("local", text)
    authority, slash, path = text[6:].partition("/")
    if not slash or not authority:
        raise UnsupportedInput(f"an ssh URI needs a host and an absolute path: {text!r}")
    user, at, rest = authority.rpartition("@")
    if rest.startswith("["):
        host, bracket, tail = rest[1:].partition("]")
        if not bracket or tail and not tail.startswith(":"):
            raise UnsupportedInput(f"invalid IPv6 host in {text!r}")
        port = tail[1:] if tail else None
    elif rest.count(":") > 1:
        raise UnsupportedInput(f"IPv6 hosts need brackets in {text!r}")
    else:
        host, colon, number = rest.partition(":")
        port = number if colon else None
    if port is not None and not (port.isdigit() and 0 < int(port) < 65536):
        raise UnsupportedInput(f"invalid port in {text!r}")
    if "\0" in path or at and "@" in user:
        raise UnsupportedInput(f"invalid ssh URI {text!r}")
    return Locator("ssh", "/" + path, _component("user", user) if at else None, _component("host", host), int(port) if port else None)


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*VIDEO_EXTENSIONS)


def quote_posix(text: str) -> str:
    return "'" + text.replace("'", "'\\''") + "'"


_NUMBER = r"\s*(\d+)\s*"
_ITEM = re.compile(rf"(?:\s*\({_NUMBER},{_NUMBER}(?:,{_NUMBER})?\)\s*|{_NUMBER}->{_NUMBER}|{_NUMBER}:{_NUMBER}|{_NUMBER})")


def parse_frame_pairs(text: str) -> list[tuple[int, int, int | None]]:
    """(reference, distorted, label) from ``N``, ``A:B``, ``A->B``, ``(A,B)`` and ``(A,B,LABEL)``."""
    out, at = [], 0
    while True:
        m = _ITEM.match(text, at)
        if not m:
            raise UnsupportedInput(f"invalid frame pairs {text!r}")
        numbers = [int(g) for g in m.groups() if g is not None]
        a, b = numbers[0], numbers[1] if len(numbers) > 1 else numbers[0]
        out.append((a, b, numbers[2] if len(numbers) > 2 else None))
        at = m.end()
        if at == len(text):
            return out
        if text[at] != ",":
            raise UnsupportedInput(f"invalid frame pairs {text!r}")
        at += 1


def frame_pair_table(spark: SparkSession, text: str) -> DataFrame:
    """The pairs in their order: pair_index, reference_index, distorted_index, label."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(parse_frame_pairs(text))], "pair_index long, reference_index long, distorted_index long, label long")
