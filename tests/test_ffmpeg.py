"""Stand-ins take the place of the programs: a clip is a JSON file of its size and its frames' gray values."""

import json
import sqlite3
import sys
import time

import pytest

from fidelis import cli
from fidelis.functions.errors import InvalidFrame, UnsupportedInput
from fidelis.sources import bundle, ffmpeg, frames, sinks

PROBE = """
import json, sys
clip = json.load(open(sys.argv[-1]))
if "-show_frames" in sys.argv:
    print(json.dumps({"frames": [{"pts_time": str(i / 10), "key_frame": 1} for i in range(len(clip["values"]))]}))
else:
    print(json.dumps({"streams": [{"index": 0, "width": clip["width"], "height": clip["height"], "codec_name": "toy", "avg_frame_rate": "10/1", "nb_frames": str(len(clip["values"]))}]}))
"""
DECODE = """
import json, sys, time
a = sys.argv
clip = json.load(open(a[a.index("-i") + 1]))
w, h = map(int, a[a.index("-vf") + 1].split("=")[1].split(":")) if "-vf" in a else (clip["width"], clip["height"])
skip = round(float(a[a.index("-ss") + 1]) * 10) if "-ss" in a else 0
for v in clip["values"][skip:]:
    sys.stdout.buffer.write(bytes([v, v, v, 255]) * (w * h))
sys.stdout.buffer.write(b"x" * clip.get("tail", 0))
sys.stdout.flush()
time.sleep(clip.get("sleep", 0))
sys.stderr.write("e" * 200_000 if clip.get("status") else "")
sys.exit(clip.get("status", 0))
"""


@pytest.fixture
def tool(tmp_path):
    for name, code in (("decode", DECODE), ("probe", PROBE)):
        (tmp_path / name).write_text(f"#!{sys.executable}\n{code}")
        (tmp_path / name).chmod(0o755)
    return ffmpeg.Programs(str(tmp_path / "decode"), str(tmp_path / "probe"), timeout=20)


def clip(folder, name, values, **more):
    path = folder / f"{name}.clip"
    path.write_text(json.dumps({"width": 3, "height": 2, "values": values, **more}))
    return str(path)


def test_decoder_and_its_failures(tool, tmp_path):
    good = clip(tmp_path, "a", [1, 2, 3])
    assert [f["planes"][0]["data"][0] for f in tool(good)] == [1, 2, 3]
    assert [(f["width"], f["height"]) for f in tool(good, 5, 4, start=0.2)] == [(5, 4)]
    assert next(tool(good))["width"] == 3  # a decoder that is left early ends its program
    with pytest.raises(InvalidFrame, match="7 of 24"):
        list(tool(clip(tmp_path, "cut", [1], tail=7)))
    with pytest.raises(UnsupportedInput, match="status 3"):
        list(tool(clip(tmp_path, "bad", [1], status=3)))
    began = time.time()
    with pytest.raises(UnsupportedInput, match="not decoded in 1 s"):
        list(ffmpeg.Programs(tool.ffmpeg, tool.ffprobe, 1)(clip(tmp_path, "slow", [1], sleep=30)))
    assert time.time() - began < 10
    with pytest.raises(InvalidFrame, match="at most 8"):
        list(ffmpeg.Programs(tool.ffmpeg, tool.ffprobe, max_frame_bytes=8)(good))
    for missing in (ffmpeg.Programs("no-such-program", tool.ffprobe), ffmpeg.Programs(tool.ffmpeg, "no-such-program")):
        with pytest.raises(UnsupportedInput):
            list(missing(good))


def test_probes(spark, tool, tmp_path):
    df = spark.createDataFrame([(clip(tmp_path, "a", [1, 2]),), (str(tmp_path / "none.clip"),)], "path string")
    got = {r.input.rsplit("/", 1)[1]: r for r in ffmpeg.run_probes(df, tool).collect()}
    assert json.loads(got["a.clip"].json)["streams"][0]["width"] == 3 and got["none.clip"].json is None and got["none.clip"].error.startswith("unsupported_input")
    assert ffmpeg.run_probes(df.limit(0), tool).count() == 0


def test_commands(spark, tool, tmp_path, capsys):
    a, b = clip(tmp_path, "a", [10, 20, 30, 40]), clip(tmp_path, "b", [10, 25, 30])
    programs = ["--ffmpeg", tool.ffmpeg, "--ffprobe", tool.ffprobe]
    base = str(tmp_path / "r.db")

    def run(*argv):
        status = cli.main(list(argv))
        return status, capsys.readouterr().out

    status, out = run("video", a, b, "--metrics", "maxae,mae", "--gate", "mean_maxae<=0.01", "--sqlite", base, *programs)
    report = json.loads(out)
    assert status == 0 and report["compared_frames"] == 3 and [m["name"] for m in report["metrics"]] == ["mean_mae", "mean_maxae"]
    assert [round(f["score"] * 255) for f in report["frames"] if f["name"] == "maxae"] == [0, 5, 0]
    assert run("video", a, b, "--metrics", "maxae", "--gate", "mean_maxae<=0.001", *programs)[0] == 1
    status, out = run("video", a, b, "--metrics", "maxae", "--align", "time", "--every", "2", "--format", "csv", *programs)
    assert status == 0 and len(out.splitlines()) == 3 and "timestamp_delta_seconds" in out
    assert run("extract-frame", a, "--index", "1", "--time", "0.1", "--output", str(tmp_path / "f.png"), *programs)[0] == 0
    assert frames.load_images(spark, str(tmp_path / "f.png")).first().frame.planes[0].data[0] == 30
    assert run("extract-frame", a, "--index", "9", "--output", str(tmp_path / "g.png"), *programs)[0] == 2
    assert "toy" in run("probe", a, "--run", "--format", "text", "--sqlite", base, *programs)[1]
    png = str(tmp_path / "f.png")
    status, out = run("image", png, png, "--metrics", "mse", "--stats", "--bins", "4", "--sqlite", base, "--format", "text")
    assert status == 0 and "stats:" in out and "mse" in out
    assert run("stats", png, "--sqlite", base)[0] == 0 and run("formats", "--sqlite", base)[0] == 0 and run("formats", "--sqlite", base)[0] == 0
    assert json.loads(run("external", png, png, "--name", "tool", "--", "echo", "is 0.5 {reference}")[1])["score"] == 0.5
    assert run("external", png, png, "--name", "tool", "--timeout", "1", "--", "sleep", "30")[0] == 2
    packed = str(tmp_path / "x.bundle")
    assert run("pack", png, png, "--output", packed, "--tag", "2:last")[0] == 0
    assert json.loads(run("find-tag", packed, "last")[1])["index"] == 1 and run("decode", packed, "last", "--output", str(tmp_path / "h.png"))[0] == 0
    assert bundle.decode_record(open(packed, "rb").read(), 1)["planes"][0]["data"] == frames.load_images(spark, str(tmp_path / "h.png")).first().frame.planes[0].data
    db = sqlite3.connect(base)
    count = {t: db.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in sinks.SQLITE_TABLES}
    assert count == {"reports": 2, "metrics": 9, "probe_reports": 1, "formats": len(frames.IMAGE_FORMATS), "image_stats": 1}
    assert db.execute("SELECT codec_name, avg_frame_rate, nb_frames FROM probe_reports").fetchone() == ("toy", 10.0, 4)
    assert db.execute("SELECT kind, count(*) FROM metrics m JOIN reports r ON r.id = report_id GROUP BY kind ORDER BY kind").fetchall() == [("image", 1), ("video", 8)]


def test_text():
    assert sinks.to_text([{"a": 1, "b": None}, {"a": 22, "b": 0.5}]) == "a   b\n1   -\n22  0.5\n"
    assert sinks.to_text({"x": float("inf"), "y": {"z": [1, True]}, "w": []}) == "x: Infinity\ny:\n  z:\n    1\n    yes\nw: []\n"
