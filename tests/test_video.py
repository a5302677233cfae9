import pytest

from fidelis.functions import formats
from fidelis.functions.errors import UnsupportedInput
from fidelis.operators import gate
from fidelis.plans import metrics, video
from fidelis.sources import bundle, frames, locators, sinks
from fidelis.streaming import compare as streaming

KIND = formats.FRAME_TYPE.simpleString()


def gray(v):
    return frames.packed(bytes([v] * 4), 2, 2, "luma8")


def clips(spark):
    make = lambda vs: spark.createDataFrame([(i, gray(v)) for i, v in enumerate(vs)], f"frame_index long, frame {KIND}")
    return make([0, 10, 20, 30]), make([0, 15, 20])


def test_orders(spark):
    r, d = clips(spark)
    got = {x.frame_index: round(x.score * 255) for x in video.compare_in_order(r, d, "mae").collect()}
    assert got == {0: 0, 1: 5, 2: 0}
    assert [x.frame_index for x in video.compare_in_order(r, d, "mae", every=2, max_frames=1).collect()] == [0]
    rows = {x.pair_index: x for x in video.compare_listed(locators.frame_pair_table(spark, "3->1,(0,2,7),9"), r, d, "mae").collect()}
    assert round(rows[0].score * 255) == 15 and rows[1].label == 7 and rows[2].error


def test_by_time(spark):
    r, d = clips(spark)
    times = lambda ts: spark.createDataFrame(list(enumerate(map(float, ts))), "index long, pts_seconds double")
    rows = video.compare_by_time(r, d, times([0, 1, 2, 3]), times([0, 0.5, 1]), "mae", estimate=True, max_delta=0.2).collect()
    assert {(x.frame_index, int(x.details["distorted_frame_index"])) for x in rows} <= {(0, 0), (1, 1), (2, 1), (3, 2)} and len(rows) >= 2
    rows = video.compare_by_time(r, d, times([0, 1, 2, 3]), times([0, 0.5, 1]), "mae", transform=(2.0, 0.0), reuse=False, every=2).collect()
    assert [(x.frame_index, x.pair_index) for x in rows] == [(0, 0), (2, 2)] and rows[1].details["timestamp_delta_seconds"] == 0
    for bad in ((0.0, 0.0), (float("nan"), 0.0)):
        with pytest.raises(UnsupportedInput):
            video.compare_by_time(r, d, times([0]), times([0]), transform=bad)


def test_image_gate(spark):
    a, b = (frames.packed(bytes([v, 0, 0, al]), 1, 1, "rgba8") for v, al in ((0, 255), (10, 250)))
    pairs = spark.createDataFrame([("x", a, b)], f"label string, reference {KIND}, distorted {KIND}")
    rows, alpha = metrics.compare_pairs(pairs, "psnr,mae:color").cache(), metrics.alpha_rows(pairs)
    check = lambda **k: gate.image_gate(rows, ["label"], gate.ImageThresholds(**k), alpha).first()
    assert check().passed and check(fail_under=30).passed and not check(fail_under=90).passed
    assert check(metric="color").name == "mae:color" and not check(metric="color", max_selected_channel_delta=9.5).passed
    assert len(check(max_alpha_delta=4, max_alpha_mismatches=0, max_alpha_mismatches_beyond_one_lsb=1).failures) == 2
    with pytest.raises(UnsupportedInput):
        gate.ImageThresholds(fail_under=float("inf"))


def test_stats_rows_and_bundle_stream(spark, tmp_path):
    one = spark.createDataFrame([("i", gray(7))], f"input string, frame {KIND}")
    rows = {r.metric: r.value for r in sinks.stats_rows(metrics.image_profiles(one)).collect()}
    assert rows["color_balance.dominant_channel"] == "blue" and rows["pixel_format"] == "luma8"
    records = spark.createDataFrame([("b", i, None, ["t"], gray(i)) for i in range(3)], f"bundle string, record_index int, label string, tags array<string>, frame {KIND}").select("bundle", "record_index", "label", "tags", "frame.*")
    records.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(records.schema).parquet(f"{tmp_path}/in")
    streaming.start(stream, streaming.bundle_writer(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination(60)
    content = spark.read.parquet(f"{tmp_path}/out").first().content
    assert [r["planes"][0]["data"][0] for r in bundle.decode(bytes(content))] == [0, 1, 2]


def test_alignment_rows(spark):
    from pyspark.sql import functions as F

    from fidelis.operators import timeline

    times = lambda ts: spark.createDataFrame([("v", i, float(t)) for i, t in enumerate(ts)], "v string, index long, pts_seconds double")
    r, d = times([0, 1, 2]), times([0.1, 1.1])
    pairs = timeline.nearest_with_reuse(r, d, ["v"], 0.5)
    fit = spark.createDataFrame([("v", 1.0, 0.0)], "v string, scale double, offset double")
    rows = timeline.alignment_rows(pairs, ["v"], timeline.unmatched(r, pairs, ["v"], "reference"), timeline.unmatched(d, pairs, ["v"], "distorted"), fit)
    got = {x.name: x.score for x in rows.collect()}
    assert len(got) == 9 and (got["alignment_planned_pairs"], got["alignment_unmatched_reference_frames"], got["alignment_unmatched_distorted_frames"]) == (2, 1, 0)
    assert got["alignment_max_residual"] == pytest.approx(0.1) and got["alignment_mean_signed_residual"] == pytest.approx(-0.1)
    none = timeline.alignment_rows(pairs.where(F.lit(False)), ["v"], r.select("v", "index"), d.select("v", "index"), fit)
    assert none.count() == 5
