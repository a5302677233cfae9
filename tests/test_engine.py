import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.functions import color, formats
from fidelis.functions.errors import BundleError, UnsupportedInput
from fidelis.operators import gate, kernels, suite, timeline
from fidelis.plans import metrics
from fidelis.sources import bundle, external, frames, locators, probe, sinks
from fidelis.streaming import compare as streaming

NAN, INF = float("nan"), float("inf")
ROWS = "label string, ord int, pos int, name string, score double, unit string, direction string, details map<string,double>"


def luma(data, w=2, h=2):
    return frames.packed(bytes(data), w, h, "luma8")


def candidates(spark, named):
    schema = "label string, ord int, frame " + formats.FRAME_TYPE.simpleString()
    return spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(named.items())], schema)


def reference(spark, frame):
    return spark.createDataFrame([(frame,)], "frame " + formats.FRAME_TYPE.simpleString())


def test_suite_ranks(spark):
    named = {"far": luma([20, 80, 150, 220]), "exact": luma([0, 64, 128, 255]), "near": luma([0, 65, 128, 254])}
    rows = metrics.compare_candidates(reference(spark, named["exact"]), candidates(spark, named), "psnr,mse,mae").cache()
    ranked = suite.metric_ranks(rows, [])
    overall = {r.label: r.overall_rank for r in suite.overall_ranks(ranked, [], primary="psnr").collect()}
    assert overall == {"far": 3, "exact": 1, "near": 2}
    assert suite.winners(suite.overall_ranks(ranked, []), []).first().winner == "exact"
    assert {r.label: r.pareto_optimal for r in suite.pareto_frontier(rows, []).collect()} == {"far": False, "exact": True, "near": False}
    deltas = {(r.label, r.name): r.delta for r in suite.baseline_deltas(rows, [], "near").collect()}
    assert deltas["near", "mse"] == 0 and deltas["exact", "psnr"] == INF
    with pytest.raises(UnsupportedInput):
        suite.require_baseline(rows, "none")
    with pytest.raises(UnsupportedInput):
        suite.check_weights({"psnr"}, {"psnr": 0.0})


def test_perfect_candidates_and_json(spark):
    named = {"a": luma([1, 2, 3, 4]), "b": luma([1, 2, 3, 4])}
    rows = metrics.compare_candidates(reference(spark, named["a"]), candidates(spark, named), "psnr")
    delta = suite.baseline_deltas(rows, [], "a").where("label = 'b'").first().delta
    assert math.isnan(delta)
    text = rows.select(sinks.details_json(F.create_map(F.lit("x"), F.col("score"))).alias("j")).first().j
    assert json.loads(text) == {"x": "Infinity"}


def test_failed_candidate_is_kept(spark):
    named = {"bad": luma([1, 2], 2, 1), "good": luma([0, 64, 128, 255])}
    rows = metrics.compare_candidates(reference(spark, named["good"]), candidates(spark, named), "mse").cache()
    errors = {r.label: r.error for r in rows.collect()}
    assert errors["bad"].startswith("incompatible_frames") and errors["good"] is None
    with pytest.raises(ValueError, match="bad"):
        metrics.first_error(rows)
    listed = rows.select("label", "error").distinct().withColumn("passed", F.lit(True))
    assert not gate.suite_passed(listed.withColumn("s", F.lit(1)), ["s"]).first().passed
    good = rows.where("error is null")
    out = {r.candidate: r.metric for r in sinks.suite_csv_rows(listed, good, []).collect()}
    assert out == {"bad": None, "good": "mse"}


def test_chained_ties_and_nan(spark):
    rows = spark.createDataFrame([(c, i, 0, "m", s, "u", "higher", {}) for i, (c, s) in enumerate({"a": 1.0, "b": 1.0 + 4e-10, "c": 1.0 + 1.3e-9, "d": NAN, "e": 0.5, "f": INF}.items())], ROWS)
    got = {r.label: r.rank for r in suite.metric_ranks(rows, []).collect()}
    assert got == {"f": 1, "c": 2, "b": 2, "a": 2, "e": 5, "d": 6}
    with pytest.raises(UnsupportedInput):
        suite.check_labels(spark.createDataFrame([("x",), ("x",)], "label string"), [])


def gate_rows(spark, scores, label="c"):
    return spark.createDataFrame([(label, 0, i, k, v, "u", "higher", d) for i, (k, v, d) in enumerate(scores)], ROWS)


def test_gates(spark):
    rows = gate_rows(spark, [("psnr", 41.0, {}), ("mae:color", 0.5, {"red_mae": 0.02}), ("inf", INF, {}), ("nan", NAN, {})])
    rules = ["psnr>=40", "ssim>=0.9", "mae:color.red_mae<=0.03", "mae:color.none<1", "inf>=1", "nan>=0", "nan<0"]
    checks = {r.rule_index: r for r in gate.evaluate(rows, ["label"], rules).collect()}
    assert [checks[i].passed for i in range(7)] == [True, False, True, False, True, False, False]
    assert checks[1].message == "metric `ssim` was not produced" and checks[3].message == "metric detail `mae:color.none` was not produced"
    both = rows.union(gate_rows(spark, [("psnr", 40.0, {}), ("inf", INF, {})], "base"))
    checks = gate.evaluate(both, ["label"], ["psnr>=baseline-0.5", "inf>=baseline", "mae:color<=baseline"], baseline="base").where("label = 'c'").orderBy("rule_index").collect()
    assert [c.passed for c in checks] == [True, True, False] and checks[0].threshold == 39.5
    assert checks[2].message == "baseline metric `mae:color` was not produced"
    for bad in (">=1", "psnr", "psnr>=x", "psnr>=inf", "psnr>=baseline/0", "psnr>=baseline%2"):
        with pytest.raises(UnsupportedInput):
            gate.parse_rule(bad)
    assert gate.parse_rule("mse<=baseline*1.1") == gate.Rule("mse", "<=", None, 1.1, 0.0)


def test_baseline_gate_of_candidates(spark):
    named = {"base": luma([10] * 4), "five": luma([5] * 4), "twenty": luma([20] * 4)}
    rows = metrics.compare_candidates(reference(spark, luma([0] * 4)), candidates(spark, named), "mse")
    checks = gate.evaluate(rows, ["label"], ["mse<=baseline*1.1"], baseline="base")
    assert {r.label: r.passed for r in checks.collect()} == {"base": True, "five": True, "twenty": False}


def series(spark, points, direction="higher"):
    return spark.createDataFrame([("m", i, p, s, "u", direction) for i, (p, s) in enumerate(points)], "name string, frame_index long, pts_seconds double, score double, unit string, direction string")


def test_series(spark):
    r = timeline.series_aggregate(series(spark, [(0.0, 10.0), (1.0, 20.0), (3.0, 30.0), (4.0, NAN)]), ["name"]).first()
    assert (r.samples, r.total_samples, r.nan_samples) == (3, 4, 1) and r.time_weighted_mean == pytest.approx(21.1111, abs=1e-4)
    assert timeline.series_aggregate(series(spark, [(0.0, 40.0), (1.0, 30.0)]), ["name"]).first().worst_frame_index == 1
    r = timeline.series_aggregate(series(spark, [(0.0, INF), (1.0, INF)]), ["name"]).first()
    assert (r.samples, r.positive_infinite_samples, r.mean, r.worst_frame_index) == (0, 2, INF, 0) and math.isnan(r.standard_deviation)
    r = timeline.series_aggregate(series(spark, [(0.0, INF), (1.0, -INF), (2.0, NAN)]), ["name"]).first()
    assert math.isnan(r.mean) and (r.min, r.max) == (-INF, INF)
    assert timeline.time_weighted_mean(series(spark, [(0.0, 0.0), (0.0, 100.0), (1.0, 0.0)]), ["name"]).first()[1] == 25.0


def clock(spark, points):
    return spark.createDataFrame([(i, float(p)) for i, p in points], "index long, pts_seconds double")


def test_timelines(spark):
    r, d = clock(spark, enumerate([0, 2, 4])), clock(spark, enumerate([1, 2, 3]))
    fit = timeline.estimate_transform(r, d, []).first()
    assert (fit.scale, fit.offset) == pytest.approx((2, -2))
    pairs = timeline.nearest_with_reuse(r, timeline.apply_transform(d, fit.scale, fit.offset), [])
    assert timeline.residuals(pairs, []).first().max_delta == pytest.approx(0, abs=1e-12) and pairs.count() == 3
    one = timeline.estimate_transform(clock(spark, [(0, 5)]), clock(spark, [(0, 3)]), []).first()
    assert (one.scale, one.offset) == (1, 2)
    r, d = clock(spark, enumerate([0, NAN, 2])), clock(spark, [(0, 0.001)])
    pairs = timeline.nearest_with_reuse(r, d, [], 0.01)
    assert pairs.count() == 1
    assert {x[0] for x in timeline.unmatched(r, pairs, [], "reference").collect()} == {1, 2}
    assert [x.distorted_index for x in timeline.nearest_with_reuse(clock(spark, [(0, 0.0)]), clock(spark, [(10, 0.01)]), []).collect()] == [10]
    with pytest.raises(UnsupportedInput):
        timeline.check_timeline(clock(spark, [(0, NAN)]))


def greedy(ref, dist, limit):
    out, c = [], 0
    for i, t in sorted(ref, key=lambda p: (p[1], p[0])):
        while c < len(dist) and dist[c][1] < t - limit:
            c += 1
        if c >= len(dist):
            continue
        best = c + 1 if c + 1 < len(dist) and abs(t - dist[c + 1][1]) < abs(t - dist[c][1]) else c
        if abs(t - dist[best][1]) <= limit:
            out.append((i, dist[best][0]))
            c = best + 1
    return out


def test_nearest_against_scans(spark):
    rng = np.random.default_rng(0)
    for limit in (0.5, 3.0):
        ref = [(i, float(t)) for i, t in enumerate(np.round(rng.random(60) * 40, 1))]
        dist = [(i, float(t)) for i, t in enumerate(np.round(rng.random(45) * 40, 1))]
        r, d = clock(spark, ref), clock(spark, dist)
        got = sorted((x.reference_index, x.distorted_index) for x in timeline.nearest_with_reuse(r, d, [], limit).collect())
        assert got == sorted(timeline.naive_pairs(iter(ref), iter(dist), limit))
        once = sorted((x.reference_index, x.distorted_index) for x in timeline.nearest_once(r, d, [], limit).collect())
        assert once == sorted(greedy(ref, sorted(dist, key=lambda p: (p[1], p[0])), limit))


def test_bundle(spark):
    a, b = frames.packed(bytes([0, 0, 0, 255]), 1, 1, "rgba8"), frames.packed(bytes([255, 0, 0, 255]), 1, 1, "rgba8")
    data = bundle.encode([{**a, "label": "ref", "tags": ["reference"]}, {**b, "label": None, "tags": ["candidate", "x"]}])
    assert bundle.find_tag(data, "candidate") == 1 and bundle.record_count(data) == 2
    assert bundle.decode_record(data, 1)["planes"][0]["data"] == bytes([255, 0, 0, 255]) and bundle.decode(data)[1]["label"] is None
    assert bundle.encode(bundle.decode(data)) == data
    for bad in (data + b"x", data[:-1], b"other", data[:8] + b"\xff\xff\xff\xff" + data[12:]):
        with pytest.raises(BundleError):
            bundle.decode(bad)
    for call in (lambda: bundle.find_tag(data, "none"), lambda: bundle.decode_record(data, 2), lambda: bundle.decode(data, limit=10)):
        with pytest.raises(BundleError):
            call()
    files = spark.createDataFrame([("good", bytearray(data)), ("bad", bytearray(b"junk"))], "path string, content binary")
    rows = bundle.read_bundles(files)
    assert {(r.path, r.record_index, r.error is None) for r in rows.collect()} == {("good", 0, True), ("good", 1, True), ("bad", None, False)}
    assert bundle.by_tag(rows, "candidate").first().record_index == 1 and bundle.by_index(rows, 0).count() == 1
    assert [r.bytes for r in bundle.bundle_info(rows.where("error is null")).collect()] == [4, 4]
    assert {r.error is None for r in bundle.read_bundles(files, limit=5).collect()} == {False}
    assert bundle.pack_tags(2, ["t", "all:u", "2:v"]) == [["t", "u"], ["t", "u", "v"]] and bundle.pack_labels(["a"]) == ["a"]


def test_locators(spark):
    p = locators.parse_frame_pairs
    assert p("0:1,30->31,(60,61)") == [(0, 1, None), (30, 31, None), (60, 61, None)] and p("(0,1,0), (2,3,2)") == [(0, 1, 0), (2, 3, 2)] and p("7") == [(7, 7, None)]
    for bad in ("", "0:", ":1", "(0,)", "(,1)", "0:-1", "abc", "0, "):
        with pytest.raises(UnsupportedInput):
            p(bad)
    x = locators.parse_locator("ssh://me@[::1]:22/a/b.mp4")
    assert (x.user, x.host, x.port, x.path, x.extension, x.uri) == ("me", "::1", 22, "/a/b.mp4", "mp4", "ssh://me@[::1]:22/a/b.mp4")
    for bad in ("ssh://host", "ssh:///x", "ssh://h:0/x", "ssh://-o/x", "ssh://::1/x"):
        with pytest.raises(UnsupportedInput):
            locators.parse_locator(bad)
    assert locators.parse_locator("-").kind == "stdin" and locators.quote_posix("a'b") == "'a'\\''b'"
    assert spark.createDataFrame([("x/y.MOV",), ("x.mov/y",)], "p string").select(locators.is_video(F.col("p"))).collect()[0][0]


def test_probe_and_pts(spark):
    doc = {"streams": [{"width": 4, "height": 2, "avg_frame_rate": "30000/1001", "r_frame_rate": "0/0", "codec_name": "x"}], "format": {"duration": "2.5"}, "frames": [{"pts_time": "N/A", "pkt_dts_time": "0.5"}, {"best_effort_timestamp_time": "1.0", "key_frame": 1}, {"pts_time": "nan"}]}
    df = spark.createDataFrame([("v", json.dumps(doc))], "input string, json string")
    s = probe.streams(df).first()
    assert s.avg_rate == pytest.approx(29.97, abs=0.01) and s.base_rate is None and s.duration_seconds == 2.5
    info = probe.frames(df)
    assert [r.pts_seconds for r in info.orderBy("frame_index").collect()] == [0.5, 1.0, None]
    pts = timeline.effective_pts(info.withColumn("start_seconds", F.lit(0.0)).withColumn("avg_rate", F.lit(10.0))).orderBy("frame_index").collect()
    assert [r.pts_effective for r in pts] == [0.5, 1.0, 0.2] and math.isnan(pts[2].pts_exact)


def test_sources_and_sinks(spark, tmp_path):
    red = frames.packed(bytes([255, 0, 0, 255]), 1, 1, "rgba8")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "red.png").write_bytes(frames.write_png(red))
    (tmp_path / "img" / "bad.png").write_bytes(b"not an image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in frames.load_images(spark, str(tmp_path / "img")).collect()}
    assert rows["red.png"].frame.planes[0].data == bytes([255, 0, 0, 255]) and rows["bad.png"].error
    files = spark.createDataFrame([("a", bytearray([1, 2, 3, 4])), ("b", bytearray([1]))], "path string, content binary")
    assert {r.path: r.error is None for r in frames.raw_frames(files, 2, 2, "luma8").collect()} == {"a": True, "b": False}
    assert formats.validate_frames(spark.createDataFrame([("x", "", [], 2, 2, tuple(formats.default_spec("luma8").values()), [(bytearray(4), 2)]), ("y", "", [], 2, 2, tuple(formats.default_spec("luma8").values()), [(bytearray(3), 2)])], formats.FRAMES_SCHEMA)).where("error is null").count() == 1
    assert external.first_float("score: 97.5") == 97.5
    with pytest.raises(UnsupportedInput):
        external.first_float("none")
    run = external.run_external(spark.createDataFrame([("r", "d", 1)], "reference string, distorted string, k int"), ["echo", "score: 12.5 {reference}"], "tool")
    assert run.first().score == 12.5
    assert sinks.append_sqlite(str(tmp_path / "r.db"), {"kind": "image", "x": INF}, [{"name": "psnr", "score": INF, "unit": "dB", "direction": "higher"}]) == 1
    assert sqlite3.connect(tmp_path / "r.db").execute("SELECT score FROM metrics").fetchone() == ("Infinity",)
    assert sinks.to_yaml({"a": 1.0, "b": [NAN], "c": {"d": []}}) == 'a: 1.0\nb:\n  - "NaN"\nc:\n  d: []\n'
    import tomllib

    assert tomllib.loads(sinks.to_toml({"a": 1, "b": {"c": INF}, "d": [{"e": 2}]})) == {"a": 1, "b": {"c": "Infinity"}, "d": [{"e": 2}]}
    rows = metrics.compare_candidates(reference(spark, red), candidates(spark, {"x": red}), "mse")
    sinks.write_csv(sinks.metric_csv_rows(rows), str(tmp_path / "csv"))
    sinks.append_report({"metrics": rows.drop("error"), "reports": rows.select("label")}, str(tmp_path / "tables"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(sinks.METRIC_COLUMNS)
    assert metrics.feature_distance(spark.createDataFrame([(red, red)], f"reference {formats.FRAME_TYPE.simpleString()}, distorted {formats.FRAME_TYPE.simpleString()}"), lambda t: [t, t * 2]).first().score == 0


def test_color(spark):
    v = spark.range(1).select(F.lit(0.5).alias("v"))
    for t in ("srgb", "bt1886", "pq", "linear"):
        assert v.select(color.encode_transfer(color.decode_transfer(F.col("v"), t), t)).first()[0] == pytest.approx(0.5, abs=1e-9)
    assert v.select(color.encode_transfer(color.decode_transfer(F.lit(0.8), "hlg", standard_hlg=True), "hlg")).first()[0] == pytest.approx(0.8)
    assert v.select(color.expand_luma_range(F.lit(16 / 255), "limited"), color.expand_luma_range(F.lit(235 / 255), "limited")).first() == (0, 1)
    rgb = np.random.default_rng(3).random((20, 3)).tolist()
    df = spark.createDataFrame([tuple(c) for c in rgb], "r double, g double, b double")
    h, s, val = color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    back = df.select(h.alias("h"), s.alias("s"), val.alias("x")).select(*color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("x"))).collect()
    assert np.allclose([tuple(r) for r in back], rgb)


def test_kernel_equals_relational(spark):
    from fidelis.operators import relational

    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 256, (12, 10, 3), dtype=np.uint8) for _ in range(2))
    samples = spark.createDataFrame([(y, x, c, float(a[y, x, c] / 255), float(b[y, x, c] / 255)) for y in range(12) for x in range(10) for c in range(3)], "y int, x int, channel int, ref double, dist double")
    k = {r["name"]: r for r in kernels.compare(frames.from_array(a), frames.from_array(b), kernels_specs())}
    r = relational.error_metrics(samples, []).first()
    assert (r.mse, r.rmse, r.psnr, r.mae, r.maxae) == pytest.approx([k[f"{n}:color"]["score"] for n in ("mse", "rmse", "psnr", "mae", "maxae")], rel=1e-12)
    p = relational.error_percentiles(samples, []).first()
    assert [p[f"abs_error_{q}"] for q in ("p50", "p90", "p95", "p99")] == [k["mse:color"]["details"][f"abs_error_{q}"] for q in ("p50", "p90", "p95", "p99")]
    place = relational.max_error_location(samples, []).first()
    d = k["mse:color"]["details"]
    assert (place.max_error_x, place.max_error_y, place.max_error_channel) == (d["max_error_x"], d["max_error_y"], d["max_error_channel"])
    gray = samples.where("channel = 0")
    x, y = (frames.from_array(v[..., 0]) for v in (a, b))
    from fidelis.operators.pixels import Pixels

    assert relational.global_ssim(gray, []).first().ssim == pytest.approx(kernels.global_ssim(Pixels(x), Pixels(y))["score"], rel=1e-9)
    w = relational.windowed_ssim(gray, [], 10, 12, (4, 5), (3, 2)).first()
    kw = kernels.windowed_ssim(Pixels(x), Pixels(y), kernels.Windows(4, 5, 3, 2))
    assert w.wssim == pytest.approx(kw["score"], rel=1e-9) and w.windows == kw["details"]["windows"] and w.p05_window_ssim == kw["details"]["p05_window_ssim"]


def kernels_specs():
    from fidelis.functions.spec import parse_specs

    return parse_specs([f"{n}:color" for n in ("mse", "rmse", "psnr", "mae", "maxae")])


def test_streaming_means(spark, tmp_path):
    rng = np.random.default_rng(1)
    frame = formats.FRAME_TYPE.simpleString()
    mk = lambda i: (i, luma(rng.integers(0, 256, 4).tolist()))
    for side in ("r", "d"):
        for part in range(2):
            spark.createDataFrame([mk(3 * part + k) for k in range(3)], f"frame_index long, frame {frame}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{side}")
    schema = spark.read.parquet(f"{tmp_path}/r").schema
    read = lambda side: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}")
    rows = streaming.compare_stream(streaming.join_frames(read("r"), read("d"), []), "mse,mae")
    seen = []
    q = streaming.start(rows, lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = metrics.compare_pairs(spark.read.parquet(f"{tmp_path}/r").withColumnRenamed("frame", "reference").join(spark.read.parquet(f"{tmp_path}/d").withColumnRenamed("frame", "distorted"), "frame_index"), "mse,mae")
    assert sorted((r.frame_index, r.name, r.score) for r in seen) == sorted((r.frame_index, r.name, r.score) for r in batch.collect())
    batch.where("name = 'mse'").repartition(3).write.parquet(f"{tmp_path}/rows")
    rows = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    q = streaming.running_means(rows, []).writeStream.outputMode("update").format("memory").queryName("means").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2"))
    q.start().awaitTermination(120)
    last = max(spark.table("means").collect(), key=lambda r: r.frames)
    want = [r.score for r in batch.collect() if r.name == "mse"]
    assert last.frames == 6 and last.score == pytest.approx(np.mean(want))



def test_several_references_need_a_key(spark):
    red = frames.packed(bytes([255, 0, 0, 255] * 4), 2, 2, "rgba8")
    one = reference(spark, red)
    with pytest.raises(Exception, match="several references"):
        metrics.compare_candidates(one.union(one), candidates(spark, {"x": red}), "mse").collect()
    assert metrics.compare_candidates(one.limit(0), candidates(spark, {"x": red}), "mse").count() == 0
