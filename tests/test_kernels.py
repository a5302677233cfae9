import math

import numpy as np
import pytest

from fidelis.functions.errors import IncompatibleFrames, InvalidFrame, QualityError, UnknownMetric, UnsupportedInput
from fidelis.functions.spec import Domain, MetricSpec, parse_specs
from fidelis.operators import kernels, profile
from fidelis.operators.kernels import Windows
from fidelis.operators.pixels import Pixels
from fidelis.sources import frames


def luma(data, w, h):
    return frames.packed(bytes(data), w, h, "luma8")


def rgba(data, w, h):
    return frames.packed(bytes(data), w, h, "rgba8")


def score(a, b, spec):
    return kernels.compare(a, b, parse_specs(spec))[0]


def details(a, b, spec):
    return score(a, b, spec)["details"]


@pytest.mark.parametrize(("a", "b", "mse", "mae", "psnr"), [([0, 128, 255, 64], [0, 128, 255, 64], 0, 0, math.inf), ([0, 0, 255, 255], [0, 255, 255, 0], 0.5, 0.5, 3.010299956639812)])
def test_known_vectors(a, b, mse, mae, psnr):
    rows = {r["name"]: r["score"] for r in kernels.compare(luma(a, 2, 2), luma(b, 2, 2), parse_specs("mse,mae,psnr"))}
    assert rows["mse"] == mse and rows["mae"] == mae and rows["psnr"] == pytest.approx(psnr, abs=1e-12)


def test_rgb_details():
    d = details(frames.packed(bytes(6), 2, 1, "rgb8"), frames.packed(bytes([0, 10, 20, 30, 40, 50]), 2, 1, "rgb8"), "mae:color")
    want = {"pixel_count": 2, "samples": 6, "changed_samples": 5, "changed_pixels": 2, "pixels_beyond_8_lsb": 2, "samples_beyond_1_lsb": 5, "samples_beyond_8_lsb": 5, "max_error_x": 1, "max_error_y": 0, "max_error_channel": 2}
    assert {k: d[k] for k in want} == want
    assert [d[f"{c}_mae_code"] for c in ("red", "green", "blue")] == pytest.approx([15, 25, 35])
    assert d["max_pixel_delta_code"] == pytest.approx(70.710678, abs=1e-6)
    assert d["abs_error_p50_code"] == pytest.approx(20, abs=0.04) and d["abs_error_p99_code"] == pytest.approx(50, abs=0.04)


def test_partials_add_up():
    a, b = luma(bytes(4), 2, 2), luma([0, 10, 20, 30], 2, 2)
    whole = kernels.error_stats(Pixels(a), Pixels(b), Domain())
    parts = [kernels.error_stats(Pixels(luma(bytes(2), 2, 1)), Pixels(luma(r, 2, 1)), Domain()) for r in ([0, 10], [20, 30])]
    merged = parts[0] + parts[1]
    assert merged.total.count == 4 and merged.changed == 3 and merged.channels[0].absolute == pytest.approx(whole.channels[0].absolute)
    assert kernels.histogram_percentile(merged.total.bins, 4, merged.total.largest, 0.95) == kernels.histogram_percentile(whole.total.bins, 4, whole.total.largest, 0.95)


def test_plane_and_nv12():
    d = details(luma([0, 10], 2, 1), luma([0, 20], 2, 1), "mae:plane0")
    assert d["channel_count"] == 1 and d["plane_mae_code"] == pytest.approx(5) and "max_error_x" not in d
    zero, other = (frames.planar(p, 2, 2, "nv12") for p in ([bytes(4), bytes(2)], [bytes([0, 10, 0, 10]), bytes([20, 30])]))
    d = details(zero, other, "mae:all")
    assert [d[f"channel_{i}_samples"] for i in range(3)] == [4, 1, 1] and [d[f"{c}_mae_code"] for c in "yuv"] == pytest.approx([5, 20, 30])
    assert "changed_pixels" not in d


def test_interior_and_masks():
    a = bytearray([0, 0, 0, 255] * 9)
    b = bytearray(a)
    a[16], b[16] = 10, 20
    d = details(rgba(a, 3, 3), rgba(b, 3, 3), "mae:rgb-interior1px")
    assert d["pixel_count"] == 1 and d["samples"] == 3
    b[3] = 0
    with pytest.raises(UnsupportedInput):
        score(rgba(a, 3, 3), rgba(b, 3, 3), "mae:rgb-visible-interior1px")
    with pytest.raises(UnsupportedInput):
        score(rgba([1, 2, 3, 255], 1, 1), rgba([1, 2, 3, 255], 1, 1), f"mae:rgb-interior{2**62}px")
    for radius in (1, 2):
        rng = np.random.default_rng(radius)
        x, y = (rgba(rng.choice([0, 255], 9 * 8 * 4).astype(np.uint8).tobytes(), 9, 8) for _ in range(2))
        domain = Domain("render", mask="nonblack", radius=radius)
        base = kernels.mask_of(Pixels(x), Pixels(y), "nonblack", True)
        naive = np.array([[radius <= j < 8 - radius and radius <= i < 9 - radius and base[j - radius : j + radius + 1, i - radius : i + radius + 1].all() for i in range(9)] for j in range(8)])
        assert (kernels.render_mask(Pixels(x), Pixels(y), domain) == naive).all()


def test_alpha_hue_binary():
    d = kernels.alpha_diagnostics(rgba([0, 0, 0, 0, 0, 0, 0, 128], 2, 1), rgba([0, 0, 0, 1, 0, 0, 0, 255], 2, 1))
    assert d["reference"] == {"transparent": 1, "partial": 1, "opaque": 0} and d["distorted"] == {"transparent": 0, "partial": 1, "opaque": 1}
    assert (d["mismatch_count"], d["max_delta"], d["mismatches_beyond_one_lsb"]) == (2, 127, 1)
    near, far = (frames.packed(bytes([h, 255, 255]), 1, 1, "hsv8") for h in (1, 254))
    assert score(near, far, "maxae:hsv")["score"] < 0.02
    one, two = (frames.packed(bytes([v]), 4, 1, "binary1lsb") for v in (0b1011, 0b1001))
    r = score(one, two, "maxae:binary")
    assert r["details"]["pixel_count"] == 4 and r["score"] == 1


def test_spec_grammar():
    s = MetricSpec.parse("psnr:rgb-visible-interior2px")
    assert s.domain == Domain("render", 0, "rgb", "visible", 2) and s.key == "psnr:rgb-visible-interior2px"
    keys = {"max_ae": "maxae", "max-error:y": "maxae", "msssim": "ms-ssim", "global_ssim:rgb": "ssim", "mse:rgb": "mse:color", "mse:rgb-all": "mse:rgb-all", "mae:gray": "mae:gray", "mae:grey-interior": "mae:gray-interior1px", "psnr:plane2": "psnr:plane2", "mse:rgba": "mse:rgba", "mse:": "mse", "mae:mask-non-black": "mae:binary-nonblack", "mae:hsv-nonblack-interior3px": "mae:hsv-nonblack-interior3px"}
    assert {k: MetricSpec.parse(k).key for k in keys} == keys
    for bad in ("mse:what", "mse:rgb-interior0px", "mse:plane", "mse:rgb-visible-what"):
        with pytest.raises(UnsupportedInput):
            MetricSpec.parse(bad)
    with pytest.raises(UnknownMetric):
        parse_specs("mse,vmaf")
    assert [s.key for s in parse_specs(None)] == ["psnr", "ssim", "mse", "mae", "maxae"]


def test_ssim_windows():
    f = luma([0, 32, 64, 96, 128, 160, 192, 255], 4, 2)
    r = kernels.windowed_ssim(Pixels(f), Pixels(f), Windows(2, 2, 2, 2))
    d = r["details"]
    assert r["score"] == pytest.approx(1) and (d["windows"], d["samples"], d["p01_window_ssim"], d["p50_window_ssim"], d["worst_window_x"], d["worst_window_y"]) == (2, 8, 1, 1, 0, 0)
    e = luma(range(6), 3, 2)
    d = kernels.windowed_ssim(Pixels(e), Pixels(luma(range(0, 12, 2), 3, 2)), Windows(2, 1, 2, 1))["details"]
    assert d["windows"] == 4 and d["samples"] == 6
    same = luma([v % 251 for v in range(1024)], 32, 32)
    assert kernels.ms_ssim(Pixels(same), Pixels(same))["score"] == pytest.approx(1)
    x, y = luma([96 if v % 2 else 192 for v in range(64)], 8, 8), luma([96] * 64, 8, 8)
    assert kernels.ms_ssim(Pixels(x), Pixels(y))["score"] < 1 and kernels.windowed_ssim(Pixels(x), Pixels(y))["score"] < 1
    assert [kernels.window_starts(*a) for a in ((8, 8, 8), (9, 8, 8), (20, 8, 8), (10, 4, 3), (3, 2, 2), (5, 9, 4))] == [[0], [0, 1], [0, 8, 12], [0, 3, 6], [0, 1], [0]]
    with pytest.raises(UnsupportedInput):
        Windows(0, 1, 1, 1)


def test_windows_against_loop():
    rng = np.random.default_rng(0)
    x, y = rng.random((2, 13, 17))
    s = kernels.window_stats(x, y, Windows(5, 4, 3, 2))
    got = []
    for y0 in kernels.window_starts(13, 4, 2):
        for x0 in kernels.window_starts(17, 5, 3):
            p, q = x[y0 : y0 + 4, x0 : x0 + 5], y[y0 : y0 + 4, x0 : x0 + 5]
            c = np.cov(p.ravel(), q.ravel())
            cs = (2 * c[0, 1] + 9e-4) / (c[0, 0] + c[1, 1] + 9e-4)
            got.append((2 * p.mean() * q.mean() + 1e-4) / (p.mean() ** 2 + q.mean() ** 2 + 1e-4) * cs)
    assert s["mean"] == pytest.approx(np.mean(got)) and s["min"] == pytest.approx(min(got)) and s["windows"] == len(got)


def test_code_stats_and_diff():
    a, b = rgba([0, 10, 20, 30, 255, 250, 240, 230], 2, 1), rgba([1, 8, 23, 26, 250, 255, 230, 240], 2, 1)
    s = kernels.rgba8_code_stats(a, b)
    assert s["channel_mse"] == [13, 14.5, 54.5, 58] and (s["mse"], s["mae"], s["samples"]) == (35, 5, 8)
    assert s["channel_mae"] == [3, 3.5, 6.5, 7] and s["channel_max"] == [5, 5, 10, 10] and kernels.rgba8_code_stats(a, b, "color")["samples"] == 6
    black, red = rgba([0, 0, 0, 255], 1, 1), rgba([255, 0, 0, 255], 1, 1)
    assert kernels.diff_image(black, red, "absolute", 1.0)["planes"][0]["data"] == bytes([255, 0, 0, 255])
    assert kernels.diff_image(black, red, "signed_luma", 1.0)["planes"][0]["data"] == bytes([54, 0, 0, 255])
    assert kernels.diff_image(black, black)["planes"][0]["data"] == bytes([0, 0, 255, 255])
    assert frames.write_png(red).startswith(b"\x89PNG")


def test_profile_of_red():
    p = profile.image_statistics(rgba([255, 0, 0, 255] * 16, 4, 4))
    assert p["color_balance"]["dominant_channel"] == "red" and p["tendencies"]["temperature"] == "warm" and p["tendencies"]["color_cast"]
    assert p["histograms"]["red"][-1] == 16 and p["hsv"]["mean_hue_degrees"] == 0
    gray = profile.image_statistics(luma([128] * 16, 4, 4))
    assert gray["color_balance"]["dominant_channel"] == "blue" and gray["channels"]["alpha"] is None


def test_formats():
    assert np.array_equal(Pixels(frames.tight({**rgba(bytes(4), 1, 1), "height": 2, "planes": [{"data": bytes([1, 2, 3, 4, 99, 99, 5, 6, 7, 8]), "stride": 6}]})).planes[0].ravel(), range(1, 9))
    rng = np.random.default_rng(1)
    for name, w, h in (("yuv444p8", 5, 3), ("yuv422p8", 5, 3), ("yuv420p8", 5, 3), ("nv12", 5, 3)):
        from fidelis.functions.formats import pixel_format

        f = pixel_format(name)
        planes = [rng.integers(0, 256, math.prod(f.plane_shape(w, h, i)), dtype=np.uint8).tobytes() for i in range(f.planes)]
        p = Pixels(frames.planar(planes, w, h, name))
        assert p.rgb().shape == (h, w, 3) and 0 <= p.rgb().min() and p.rgb().max() <= 1 and p.luma().shape == (h, w)
    sixteen = frames.packed(np.array([0, 65535], "<u2").tobytes(), 2, 1, "luma16le")
    assert Pixels(sixteen).luma().tolist() == [[0.0, 1.0]]
    floats = frames.packed(np.array([0.5, 2.0, -1.0], "=f4").tobytes(), 1, 1, "rgbf32")
    assert Pixels(floats).rgb().ravel().tolist() == [0.5, 2.0, -1.0]
    with pytest.raises(InvalidFrame):
        frames.packed(bytes(3), 2, 2, "luma8")
    with pytest.raises(IncompatibleFrames):
        score(luma(bytes(4), 2, 2), luma(bytes(2), 2, 1), "mse")
    with pytest.raises(QualityError):
        score(rgba(bytes(4), 1, 1), luma(bytes(1), 1, 1), "mse:all")


def test_bit_packed():
    get = lambda *a, **k: list(frames.bit_packed_gray(*a, **k)["planes"][0]["data"])
    assert get(bytes([0b1011]), 4, 1, 1) == [255, 255, 0, 255]
    assert get(bytes([0b111001]), 3, 1, 2) == [85, 170, 255]
    assert get(bytes([0x21, 99, 0x43, 99]), 2, 2, 4, stride=2) == [17, 34, 51, 68]
    assert get(bytes([0b10110000]), 4, 1, 1, lsb_first=False) == [255, 0, 255, 255]
    with pytest.raises(InvalidFrame):
        frames.bit_packed_gray(b"", 4, 1, 1)


def test_hsv_round_trip():
    from fidelis.operators.pixels import hsv_to_rgb, rgb_to_hsv

    rgb = np.random.default_rng(2).random((50, 3))
    assert np.allclose(hsv_to_rgb(rgb_to_hsv(rgb)), rgb)


def test_bands_equal_whole(monkeypatch):
    rng = np.random.default_rng(9)
    a, b = (frames.from_array(rng.integers(0, 256, (37, 21, 4), dtype=np.uint8)) for _ in range(2))
    for spec in ("mse", "mae:color", "maxae:all"):
        monkeypatch.setattr(kernels, "BAND_PIXELS", 1 << 20)
        whole = details(a, b, spec)
        monkeypatch.setattr(kernels, "BAND_PIXELS", 100)
        assert details(a, b, spec) == pytest.approx(whole, rel=1e-12)
    assert kernels.histogram(np.array([0.0, 0.5, 1.0, 3.0, np.nan, np.inf])).nonzero()[0].tolist() == [0, 2048, 4096]
