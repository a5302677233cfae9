"""Command line over the same functions: ``python -m fidelis <command>``."""

from __future__ import annotations

import argparse
import itertools
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.errors import QualityError
from .operators import gate, kernels, suite, timeline
from .plans import metrics, video
from .sources import bundle, external, ffmpeg, frames, probe, sinks


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("fidelis").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _image(spark: SparkSession, path: str) -> Any:
    row = frames.load_images(spark, path).first()
    if row is None or row.error:
        raise QualityError(f"{path}: {row.error if row else 'no such image'}")
    return row.frame.asDict(recursive=True)


def _emit(value: Any, form: str, output: str | None) -> None:
    value = sinks.plain(value)
    if form == "csv":
        import csv
        import io

        rows = value if isinstance(value, list) else [value]
        buffer = io.StringIO()
        writer = csv.DictWriter(buffer, list(rows[0]) if rows else [])
        writer.writeheader()
        writer.writerows({k: json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else v for k, v in r.items()} for r in rows)
        text = buffer.getvalue()
    else:
        text = {"json": lambda: json.dumps(value, indent=2) + "\n", "yaml": lambda: sinks.to_yaml(value), "text": lambda: sinks.to_text(value), "toml": lambda: sinks.to_toml(value if isinstance(value, dict) else {"rows": value})}[form]()
    if output:
        with open(output, "w") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _suite(args: argparse.Namespace) -> int:
    spark = _session()
    reference = spark.createDataFrame([(_image(spark, args.reference),)], f"frame {frames.FRAME_TYPE.simpleString()}")
    labels = bundle.pack_labels(args.candidates, args.label)
    named = spark.createDataFrame([(k, i, _image(spark, p)) for i, (k, p) in enumerate(zip(labels, args.candidates, strict=True))], f"label string, ord int, frame {frames.FRAME_TYPE.simpleString()}")
    suite.check_labels(named.select("label"), [])
    rows = metrics.compare_candidates(reference, named, args.metrics).cache()
    if args.fail_fast:
        metrics.first_error(rows)
    good = rows.where("error is null")
    weights = {k: float(v) for k, _, v in (w.partition("=") for w in args.weight)}
    suite.check_weights({r.name for r in good.select("name").distinct().collect()}, weights, args.primary)
    ranked = suite.metric_ranks(good, [])
    overall = {r.label: r for r in suite.overall_ranks(ranked, [], weights, args.primary).collect()}
    best = {r.label: r.pareto_optimal for r in suite.pareto_frontier(good, []).collect()}
    ranks: dict[str, dict[str, int]] = {}
    for r in ranked.collect():
        ranks.setdefault(r.label, {})[r.name] = r["rank"]
    deltas: dict[str, dict[str, float]] = {}
    if args.baseline:
        suite.require_baseline(good, args.baseline)
        for r in suite.baseline_deltas(good, [], args.baseline).collect():
            deltas.setdefault(r.label, {})[r.name] = r.delta
    checks: dict[str, list[dict[str, Any]]] = {}
    if args.gate:
        for c in _rows(gate.evaluate(good, ["label"], args.gate, args.baseline)):
            checks.setdefault(c.pop("label"), []).append(c)
    errors = {r.label: r.error for r in rows.where("error is not null").collect()}
    scores: dict[str, dict[str, float]] = {}
    for r in good.collect():
        scores.setdefault(r.label, {})[r.name] = r.score
    out = []
    for k in labels:
        passed = k not in errors and all(c["passed"] for c in checks.get(k, []))
        o = overall.get(k)
        out.append({"candidate": k, "passed": passed, "error": errors.get(k), "scores": scores.get(k, {}), "ranks": ranks.get(k, {}), "mean_rank": o and o.mean_rank, "overall_rank": o and o.overall_rank, "pareto_optimal": best.get(k, False), "baseline_deltas": deltas.get(k, {}), "checks": checks.get(k, [])})
    _emit(out, args.format, args.output)
    return 0 if all(c["passed"] for c in out) else 1


def _compare(args: argparse.Namespace) -> int:
    spark = _session()
    a, b = _image(spark, args.reference), _image(spark, args.distorted)
    kind = frames.FRAME_TYPE.simpleString()
    rows = metrics.compare_pairs(spark.createDataFrame([("distorted", a, b)], f"label string, reference {kind}, distorted {kind}"), args.metrics).cache()
    metrics.first_error(rows.withColumn("ord", F.lit(0)))
    checks = _rows(gate.evaluate(rows, ["label"], args.gate)) if args.gate else []
    report = {"reference": args.reference, "distorted": args.distorted, "width": a["width"], "height": a["height"], "metrics": [{k: v for k, v in r.items() if k not in ("label", "pos", "error")} for r in _rows(rows)], "alpha": kernels.alpha_diagnostics(a, b), "checks": checks}
    if getattr(args, "stats", False):
        report["stats"] = {k: _profile(f, args.bins) for k, f in (("reference", a), ("distorted", b))}
    if args.sqlite:
        sinks.append_sqlite(args.sqlite, {"kind": "image", **report}, report["metrics"])
    _emit(report["metrics"] if args.format == "csv" else report, args.format, args.output)
    return 0 if all(c["passed"] for c in checks) else 1


def _programs(args: argparse.Namespace) -> ffmpeg.Programs:
    return ffmpeg.Programs(args.ffmpeg, args.ffprobe, args.timeout)


def _video(args: argparse.Namespace) -> int:
    """Each video is decoded by one task; only the paired frames meet."""
    spark, tool = _session(), _programs(args)
    sides = [frames.decode_frames(spark.createDataFrame([(p,)], "path string"), tool, args.width, args.height).drop("path") for p in (args.reference, args.distorted)]
    if args.align == "order":
        rows = video.compare_in_order(*sides, args.metrics, every=args.every, max_frames=args.max_frames)
    else:
        probes = [ffmpeg.run_probes(spark.createDataFrame([(p,)], "path string"), tool, frames=True).cache() for p in (args.reference, args.distorted)]
        for p in probes:
            if bad := p.where("error is not null").first():
                raise QualityError(bad.error)
        times = [probe.frames(p).select(F.col("frame_index").alias("index"), "pts_seconds") for p in probes]
        rows = video.compare_by_time(*sides, *times, args.metrics, max_delta=args.max_delta, reuse=not args.no_reuse, estimate=args.align == "estimate", every=args.every, max_frames=args.max_frames)
    rows = rows.cache()
    if bad := rows.where("error is not null").first():
        raise QualityError(bad.error)
    means = timeline.metric_means(rows, []).orderBy("name").cache()
    checks = _rows(gate.evaluate(means.withColumn("label", F.lit("distorted")), ["label"], args.gate)) if args.gate else []
    each = [{k: v for k, v in r.items() if k in ("frame_index", "pts_seconds", "name", "score", "unit", "direction", "details")} for r in _rows(rows.orderBy("frame_index", "pos"))]
    report = {"reference": args.reference, "distorted": args.distorted, "compared_frames": rows.select("frame_index").distinct().count(), "metrics": _rows(means), "frames": each, "checks": checks}
    if args.sqlite:
        sinks.append_sqlite(args.sqlite, {"kind": "video", **{k: v for k, v in report.items() if k != "frames"}}, [*({"scope": "video", **m} for m in report["metrics"]), *({"scope": "frame", **m} for m in each)])
    _emit(each if args.format == "csv" else report, args.format, args.output)
    return 0 if all(c["passed"] for c in checks) else 1


def _extract_frame(args: argparse.Namespace) -> int:
    found = next(itertools.islice(_programs(args)(args.input, args.width, args.height, args.time), args.index, None), None)
    if found is None:
        raise QualityError(f"{args.input}: no frame {args.index}")
    with open(args.output, "wb") as f:
        f.write(frames.write_png(found))
    return 0


def _external(args: argparse.Namespace) -> int:
    pairs = _session().createDataFrame([(args.reference, args.distorted)], "reference string, distorted string")
    row = external.run_external(pairs, args.program, args.name, args.unit, args.direction, timeout=args.timeout).first()
    if row.error:
        raise QualityError(row.error)
    _emit({k: row[k] for k in ("name", "score", "unit", "direction")}, args.format, args.output)
    return 0


def _find_tag(args: argparse.Namespace) -> int:
    with open(args.input, "rb") as f:
        _emit({"tag": args.tag, "index": bundle.find_tag(f.read(), args.tag)}, args.format, args.output)
    return 0


def _unpack(args: argparse.Namespace) -> int:
    with open(args.input, "rb") as f:
        data = f.read()
    with open(args.output, "wb") as f:
        f.write(frames.write_png(bundle.decode_record(data, int(args.record) if args.record.isdigit() else bundle.find_tag(data, args.record))))
    return 0


def _profile(frame: Any, bins: int) -> dict[str, Any]:
    from .operators.profile import image_statistics

    return image_statistics(frame, bins)


def _stats(args: argparse.Namespace) -> int:
    spark = _session()
    out = [{"input": p, **_profile(_image(spark, p), args.bins)} for p in args.inputs]
    if args.sqlite:
        sinks.append_stats_sqlite(args.sqlite, out)
    _emit(out, args.format, args.output)
    return 0


def _diff(args: argparse.Namespace) -> int:
    spark = _session()
    out = kernels.diff_image(_image(spark, args.reference), _image(spark, args.distorted), args.mode, args.scale, args.include_alpha)
    with open(args.output, "wb") as f:
        f.write(frames.write_png(out))
    return 0


def _pack(args: argparse.Namespace) -> int:
    spark = _session()
    labels, tags = bundle.pack_labels(args.inputs, args.label), bundle.pack_tags(len(args.inputs), args.tag)
    with open(args.output, "wb") as f:
        f.write(bundle.encode([{**_image(spark, p), "label": k, "tags": t} for p, k, t in zip(args.inputs, labels, tags, strict=True)]))
    return 0


def _bundle_info(args: argparse.Namespace) -> int:
    rows = bundle.load_bundles(_session(), args.input).cache()
    bad = rows.where("error is not null").select("error").first()
    if bad:
        raise QualityError(bad.error)
    _emit(_rows(bundle.bundle_info(rows).orderBy("path", "index")), args.format, args.output)
    return 0


def _probe(args: argparse.Namespace) -> int:
    spark = _session()
    if args.videos:
        df = ffmpeg.run_probes(spark.createDataFrame([(p,) for p in args.inputs], "path string"), _programs(args), args.frames).cache()
        if bad := df.where("error is not null").first():
            raise QualityError(bad.error)
    else:
        docs = []
        for p in args.inputs:
            with open(p) as f:
                docs.append((p, f.read()))
        df = spark.createDataFrame(docs, "input string, json string")
    out = _rows(probe.frames(df) if args.frames else probe.streams(df))
    if args.sqlite and not args.frames:
        sinks.append_probes_sqlite(args.sqlite, out)
    _emit(out, args.format, args.output)
    return 0


def _formats(args: argparse.Namespace) -> int:
    out = [{"format": f} for f in frames.IMAGE_FORMATS]
    if args.sqlite:
        sinks.write_sqlite(args.sqlite, {"formats": out})
    _emit(out, args.format, args.output)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fidelis", description="Full-reference quality metrics.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run: Any, text: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=text)
        s.set_defaults(run=run)
        if name not in ("diff", "pack", "extract-frame", "decode"):
            s.add_argument("--format", choices=("json", "yaml", "toml", "csv", "text"), default="json")
            s.add_argument("--output")
        return s

    def with_programs(s: argparse.ArgumentParser) -> None:
        s.add_argument("--ffmpeg", default="ffmpeg")
        s.add_argument("--ffprobe", default="ffprobe")
        s.add_argument("--timeout", type=float, default=600.0, help="seconds")

    for name, run in (("compare", _compare), ("image", _compare), ("gate", _compare)):
        s = add(name, run, "compare two images; rules decide the exit status")
        s.add_argument("reference")
        s.add_argument("distorted")
        s.add_argument("--metrics")
        s.add_argument("--gate", action="append", default=[], metavar="RULE", required=name == "gate")
        s.add_argument("--sqlite", metavar="FILE")
        if name == "image":
            s.add_argument("--stats", action="store_true")
            s.add_argument("--bins", type=int, default=16)
    s = add("video", _video, "compare two videos frame by frame")
    s.add_argument("reference")
    s.add_argument("distorted")
    for flag, kw in {"--metrics": {}, "--align": {"choices": ("order", "time", "estimate"), "default": "order"}, "--max-delta": {"type": float, "default": timeline.DEFAULT_MAX_DELTA}, "--no-reuse": {"action": "store_true"}, "--every": {"type": int, "default": 1}, "--max-frames": {"type": int}, "--width": {"type": int}, "--height": {"type": int}, "--gate": {"action": "append", "default": [], "metavar": "RULE"}, "--sqlite": {"metavar": "FILE"}}.items():
        s.add_argument(flag, **kw)
    with_programs(s)
    s = add("extract-frame", _extract_frame, "write one frame of a video as PNG")
    s.add_argument("input")
    for flag, kw in {"--output": {"required": True}, "--index": {"type": int, "default": 0}, "--time": {"type": float, "help": "seconds; the index counts from there"}, "--width": {"type": int}, "--height": {"type": int}}.items():
        s.add_argument(flag, **kw)
    with_programs(s)
    s = add("external", _external, "a metric from an external program")
    s.add_argument("reference")
    s.add_argument("distorted")
    for flag, kw in {"--name": {"required": True}, "--unit": {"default": "unitless"}, "--direction": {"choices": ("higher", "lower"), "default": "higher"}, "--timeout": {"type": float, "default": 600.0}}.items():
        s.add_argument(flag, **kw)
    s.add_argument("program", nargs="+", help="after --; {reference} and {distorted} are replaced")
    s = add("find-tag", _find_tag, "index of the first record with a tag")
    s.add_argument("input")
    s.add_argument("tag")
    s = add("decode", _unpack, "write one record of a bundle as PNG")
    s.add_argument("input")
    s.add_argument("record", help="index or tag")
    s.add_argument("--output", required=True)
    s = add("suite", _suite, "rank candidates against a reference")
    s.add_argument("reference")
    s.add_argument("candidates", nargs="+")
    for flag, kw in {"--metrics": {}, "--primary": {}, "--baseline": {}, "--label": {"action": "append"}, "--weight": {"action": "append", "default": [], "metavar": "METRIC=W"}, "--gate": {"action": "append", "default": [], "metavar": "RULE"}, "--fail-fast": {"action": "store_true"}}.items():
        s.add_argument(flag, **kw)
    s = add("stats", _stats, "profile images")
    s.add_argument("inputs", nargs="+")
    s.add_argument("--bins", type=int, default=16)
    s.add_argument("--sqlite", metavar="FILE")
    s = add("diff", _diff, "write a difference image as PNG")
    s.add_argument("reference")
    s.add_argument("distorted")
    s.add_argument("--output", required=True)
    s.add_argument("--mode", choices=("heatmap", "absolute", "signed_luma"), default="heatmap")
    s.add_argument("--scale", type=float, default=4.0)
    s.add_argument("--include-alpha", action="store_true")
    s = add("pack", _pack, "pack images into a frame bundle")
    s.add_argument("inputs", nargs="+")
    s.add_argument("--output", required=True)
    s.add_argument("--label", action="append")
    s.add_argument("--tag", action="append", default=[], metavar="[N:|all:]TAG")
    s = add("bundle-info", _bundle_info, "list the records of a bundle")
    s.add_argument("input")
    s = add("probe", _probe, "read probe JSON")
    s.add_argument("inputs", nargs="+")
    s.add_argument("--frames", action="store_true")
    s.add_argument("--run", dest="videos", action="store_true", help="inputs are videos, not probe JSON")
    s.add_argument("--sqlite", metavar="FILE")
    with_programs(s)
    add("formats", _formats, "names of image formats").add_argument("--sqlite", metavar="FILE")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return int(args.run(args))
    except QualityError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
