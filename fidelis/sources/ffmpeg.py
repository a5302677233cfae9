"""Frames and probe JSON of videos from the ffmpeg programs, where these are installed on the executors."""

from __future__ import annotations

import subprocess
import tempfile
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.errors import InvalidFrame, UnsupportedInput
from .frames import Frame, packed


@dataclass(frozen=True)
class Programs:
    """The programs' names, how long each may run (seconds), and the largest frame that is accepted (bytes).

    An instance is a decoder for :func:`fidelis.sources.frames.decode_frames`.
    """

    ffmpeg: str = "ffmpeg"
    ffprobe: str = "ffprobe"
    timeout: float = 600.0
    max_frame_bytes: int = 1 << 30

    def probe_json(self, path: str, frames: bool = False) -> str:
        """JSON of the first video stream and its container, or of all its frames."""
        shown = ["-show_frames"] if frames else ["-show_streams", "-show_format"]
        try:
            done = subprocess.run([self.ffprobe, "-v", "error", "-select_streams", "v:0", *shown, "-of", "json", path], capture_output=True, text=True, timeout=self.timeout, check=False)
        except (subprocess.TimeoutExpired, OSError) as e:
            raise UnsupportedInput(f"{path}: {e}") from e
        if done.returncode:
            raise UnsupportedInput(f"{path}: status {done.returncode}: {done.stderr[:1000].strip()}")
        return done.stdout

    def size(self, path: str) -> tuple[int, int]:
        import json

        streams = json.loads(self.probe_json(path)).get("streams") or []
        if not streams or not streams[0].get("width") or not streams[0].get("height"):
            raise UnsupportedInput(f"{path}: no video stream with a size")
        return int(streams[0]["width"]), int(streams[0]["height"])

    def __call__(self, path: str, width: int | None = None, height: int | None = None, start: float | None = None) -> Iterator[Frame]:
        """rgba8 frames in decode order, one in memory at a time, scaled where a size is given, from ``start`` seconds on."""
        scale = ["-vf", f"scale={width}:{height}"] if width and height else []
        w, h = (width, height) if width and height else self.size(path)
        length = w * h * 4
        if length > self.max_frame_bytes:
            raise InvalidFrame(f"{path}: a frame of {length} bytes; at most {self.max_frame_bytes} are accepted")
        seek = ["-ss", str(start)] if start is not None else []
        command = [self.ffmpeg, "-v", "error", "-nostdin", *seek, "-i", path, "-map", "0:v:0", *scale, "-fps_mode", "passthrough", "-f", "rawvideo", "-pix_fmt", "rgba", "pipe:1"]
        late = threading.Event()
        with tempfile.TemporaryFile() as said:  # a pipe that no one reads could block the program
            try:
                run = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=said)
            except OSError as e:
                raise UnsupportedInput(f"{path}: {e}") from e
            watch = threading.Timer(self.timeout, lambda: (late.set(), run.kill()))
            watch.start()
            try:
                while data := run.stdout.read(length):
                    if late.is_set():
                        break
                    if len(data) < length:
                        run.wait()
                        if not late.is_set() and run.returncode == 0:
                            raise InvalidFrame(f"{path}: the last frame has {len(data)} of {length} bytes")
                        break
                    yield packed(data, w, h, "rgba8")
                status = run.wait()
                if late.is_set():
                    raise UnsupportedInput(f"{path}: not decoded in {self.timeout:g} s")
                if status:
                    said.seek(0)
                    raise UnsupportedInput(f"{path}: status {status}: {said.read(1000).decode(errors='replace').strip()}")
            finally:
                watch.cancel()
                run.kill()
                run.stdout.close()
                run.wait()


def run_probes(videos: DataFrame, programs: Programs | None = None, frames: bool = False) -> DataFrame:
    """(input, json, error) of videos (path): what :mod:`fidelis.sources.probe` reads; a failed probe keeps its row."""
    from ..functions.errors import QualityError

    tool = programs or Programs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    text, error = tool.probe_json(path, frames), None
                except QualityError as e:
                    text, error = None, f"{e.kind}: {e}"
                yield pa.RecordBatch.from_pydict({"input": pa.array([path], pa.string()), "json": pa.array([text], pa.string()), "error": pa.array([error], pa.string())})

    return videos.select("path").mapInArrow(run, "input string, json string, error string")
