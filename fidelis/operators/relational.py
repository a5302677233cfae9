"""Relational form of the metrics: samples as rows, statistics as Column aggregates.

A samples table has grouping columns (``by``), optional pixel coordinates x and y, a channel, and the two values
``ref`` and ``dist``. All aggregates are partial first, so groups of any size are combined before they are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import BINS, C1, C2, LSB, PERCENTILES, window_starts

def delta() -> Column:
    return F.col("ref") - F.col("dist")


def psnr(mse: Column, peak: float = 1.0) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.log10(F.lit(peak * peak) / F.nullif(mse, F.lit(0.0))) * 10.0)


def error_aggregates() -> list[Column]:
    """Everything that one scan of the samples can tell, to be shared by all error metrics of a domain."""
    a = F.abs(delta())
    return [
        F.count("*").alias("samples"),
        F.avg(delta() * delta()).alias("mse"),
        F.avg(a).alias("mae"),
        F.avg(delta()).alias("mean_error"),
        F.max(a).alias("maxae"),
        F.count_if(delta() != 0).alias("changed_samples"),
        *(F.count_if(a * 255.0 > k).alias(f"samples_beyond_{k}_lsb") for k in LSB),
    ]


def error_metrics(samples: DataFrame, by: list[str]) -> DataFrame:
    """samples, mse, rmse, psnr, mae, maxae, mean_error, change and LSB counts of each group, from one scan."""
    return samples.groupBy(*by).agg(*error_aggregates()).withColumn("rmse", F.sqrt("mse")).withColumn("psnr", psnr(F.col("mse")))


def error_bin() -> Column:
    a = F.abs(delta())
    return F.when(F.isnan(a) | (a >= 1.0), F.lit(BINS)).otherwise(F.round(a * float(BINS)).cast("int"))


def error_percentiles(samples: DataFrame, by: list[str]) -> DataFrame:
    """Percentiles of the absolute error from the fixed histogram: the first bin that holds the rank."""
    bins = samples.groupBy(*by, error_bin().alias("bin")).agg(F.count("*").alias("n"), F.max(F.abs(delta())).alias("top"))
    up = Window.partitionBy(*by).orderBy("bin")
    whole = Window.partitionBy(*by)
    ranked = bins.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(whole)).withColumn("largest", F.max("top").over(whole))
    value = F.when((F.col("bin") == BINS) & (F.col("largest") > 1.0), F.col("largest")).otherwise(F.col("bin") / float(BINS))
    picked = [F.min_by(value, F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * p)), F.col("bin"))).alias(f"abs_error_{label}") for label, p in PERCENTILES]
    return ranked.groupBy(*by).agg(*picked)


def max_error_location(samples: DataFrame, by: list[str]) -> DataFrame:
    """Where the largest error is: the first in row, then channel order; null where there is no error."""
    a = F.abs(delta())
    best = F.min(F.struct((-a).alias("k"), "y", "x", "channel")).alias("b")
    some = samples.groupBy(*by).agg(best)
    there = F.col("b.k") < 0
    return some.select(*by, (-F.col("b.k")).alias("max_channel_delta"), *(F.when(there, F.col(f"b.{c}")).alias(f"max_error_{c}") for c in ("x", "y", "channel")))


def pixel_statistics(samples: DataFrame, by: list[str]) -> DataFrame:
    """Changed pixels, pixels beyond 1, 2, 4, 8 codes, and the largest Euclidean pixel error."""
    pixels = samples.groupBy(*by, "y", "x").agg(F.max(F.abs(delta())).alias("top"), F.sqrt(F.sum(delta() * delta())).alias("norm"))
    counts = [F.count_if(F.col("top") * 255.0 > k).alias(f"pixels_beyond_{k}_lsb") for k in LSB]
    return pixels.groupBy(*by).agg(F.count("*").alias("pixel_count"), F.count_if(F.col("top") != 0).alias("changed_pixels"), *counts, F.max("norm").alias("max_pixel_delta"))


def global_ssim(samples: DataFrame, by: list[str], c1: float = C1, c2: float = C2) -> DataFrame:
    """SSIM of each group from its moments; the variance of one sample is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m = samples.groupBy(*by).agg(
        F.count("*").alias("samples"), F.avg("ref").alias("mean_reference"), F.avg("dist").alias("mean_distorted"),
        zero(F.var_samp("ref")).alias("variance_reference"), zero(F.var_samp("dist")).alias("variance_distorted"), zero(F.covar_samp("ref", "dist")).alias("covariance"),
    )
    return _with_ssim(m, c1, c2)


def _with_ssim(m: DataFrame, c1: float, c2: float) -> DataFrame:
    mx, my = F.col("mean_reference"), F.col("mean_distorted")
    cs = (F.col("covariance") * 2.0 + c2) / (F.col("variance_reference") + F.col("variance_distorted") + c2)
    return m.withColumn("contrast_structure", cs).withColumn("ssim", (mx * my * 2.0 + c1) / (mx * mx + my * my + c1) * F.col("contrast_structure"))


def window_scores(samples: DataFrame, by: list[str], width: int, height: int, window: tuple[int, int] = (8, 8), stride: tuple[int, int] = (8, 8), c1: float = C1, c2: float = C2) -> DataFrame:
    """SSIM of every local window (by, y0, x0): a sample is sent to the windows that cover it."""
    ww, wh = min(window[0], width), min(window[1], height)

    def covering(at: Column, starts: list[int], size: int) -> Column:
        return F.filter(F.array(*(F.lit(s) for s in starts)), lambda s: (s <= at) & (at < s + size))

    spread = samples.select(*by, "ref", "dist", "x", F.explode(covering(F.col("y"), window_starts(height, wh, stride[1]), wh)).alias("y0"))
    spread = spread.select(*by, "ref", "dist", "y0", F.explode(covering(F.col("x"), window_starts(width, ww, stride[0]), ww)).alias("x0"))
    n, d = float(ww * wh), float(max(ww * wh - 1, 1))
    sums = spread.groupBy(*by, "y0", "x0").agg(*(F.sum(e).alias(k) for k, e in {"sx": F.col("ref"), "sy": F.col("dist"), "sxx": F.col("ref") * F.col("ref"), "syy": F.col("dist") * F.col("dist"), "sxy": F.col("ref") * F.col("dist")}.items()))
    var = lambda s, q: F.greatest(F.col(q) - F.col(s) * F.col(s) / n, F.lit(0.0)) / d
    m = sums.select(
        *by, "y0", "x0", (F.col("sx") / n).alias("mean_reference"), (F.col("sy") / n).alias("mean_distorted"), var("sx", "sxx").alias("variance_reference"), var("sy", "syy").alias("variance_distorted"),
        ((F.col("sxy") - F.col("sx") * F.col("sy") / n) / d).alias("covariance"),
    )
    return _with_ssim(m, c1, c2).select(*by, "y0", "x0", "ssim", "contrast_structure")


def windowed_ssim(samples: DataFrame, by: list[str], width: int, height: int, window: tuple[int, int] = (8, 8), stride: tuple[int, int] = (8, 8)) -> DataFrame:
    """Mean, least and largest window score, the worst window, and percentiles from the fixed histogram."""
    scores = window_scores(samples, by, width, height, window, stride)
    scores = scores.withColumn("bin", F.round((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "ssim")) + 1.0) * 0.5 * BINS).cast("int"))
    up, whole = Window.partitionBy(*by).orderBy("bin").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    ranked = scores.withColumn("upto", F.count("*").over(up)).withColumn("total", F.count("*").over(whole))
    low = [(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * p)), F.col("bin"))) / float(BINS) * 2.0 - 1.0).alias(f"p{label}_window_ssim") for label, p in (("01", 0.01), ("05", 0.05), ("50", 0.5))]
    worst = F.min(F.struct("ssim", "y0", "x0")).alias("w")
    out = ranked.groupBy(*by).agg(F.count("*").alias("windows"), F.avg("ssim").alias("wssim"), F.avg("contrast_structure").alias("mean_contrast_structure"), F.max("ssim").alias("max_window_ssim"), *low, worst)
    return out.select(*by, "windows", "wssim", "mean_contrast_structure", F.col("w.ssim").alias("min_window_ssim"), "max_window_ssim", F.col("w.x0").alias("worst_window_x"), F.col("w.y0").alias("worst_window_y"), *(f"p{k}_window_ssim" for k in ("01", "05", "50")))


def halve(samples: DataFrame, by: list[str]) -> DataFrame:
    """Means of 2x2 boxes, of what there is at ragged edges."""
    half = lambda c: F.shiftright(F.col(c), 1).alias(c)
    return samples.groupBy(*by, half("y"), half("x")).agg(F.avg("ref").alias("ref"), F.avg("dist").alias("dist"))


def mask_column(mask: str, inner: bool = False, ref: str = "r", dist: str = "d") -> Column:
    """Inclusion of a pixel from columns <side>r, <side>g, <side>b, <side>a: all, visible, opaque, nonblack."""
    a, b = F.col(f"{ref}a"), F.col(f"{dist}a")
    if mask == "visible":
        return (a > 0) & (b > 0) if inner else (a > 0) | (b > 0)
    if mask == "opaque":
        return (a >= 1) & (b >= 1)
    if mask == "nonblack":
        return F.greatest(*(F.col(f"{s}{c}") for s in (ref, dist) for c in "rgb")) > 0
    return F.lit(True)


def interior(pixels: DataFrame, by: list[str], included: Column, radius: int) -> DataFrame:
    """Pixels whose whole (2 radius + 1) squared neighbourhood is included: erosion by rows, then by columns."""
    if radius <= 0:
        return pixels.where(included)
    k = 2 * radius + 1

    def erode(df: DataFrame, along: str, across: str) -> DataFrame:
        w = Window.partitionBy(*by, across).orderBy(along).rowsBetween(-radius, radius)
        return df.withColumn("__in", (F.count("*").over(w) == k) & F.min("__in").over(w))

    rows = pixels.withColumn("__in", F.coalesce(included, F.lit(False)))
    return erode(erode(rows, "x", "y"), "y", "x").where("__in").drop("__in")


def alpha_statistics(pixels: DataFrame, by: list[str], ref: str = "ra", dist: str = "da") -> DataFrame:
    """Alpha buckets of both sides and their mismatch, in 8-bit codes."""
    code = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 255.0)
    d = F.abs(code(ref) - code(dist))
    buckets = []
    for side, c in (("reference", code(ref)), ("distorted", code(dist))):
        buckets += [F.count_if(c == 0).alias(f"{side}_transparent"), F.count_if(c == 255).alias(f"{side}_opaque"), F.count_if((c > 0) & (c < 255)).alias(f"{side}_partial")]
    return pixels.groupBy(*by).agg(*buckets, F.count_if(d != 0).alias("mismatch_count"), F.max(d).cast("int").alias("max_delta"), F.count_if(d > 1).alias("mismatches_beyond_one_lsb"))


def wrap_hue(delta: Column) -> Column:
    return F.when(F.abs(delta) <= 0.5, delta).when(delta > 0, delta - 1.0).otherwise(delta + 1.0)


def channel_profile(values: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """min, max, mean, deviation, nearest-index percentiles, entropy and clipping of each group's values.

    Values are counted first, so that what is ranked is distinct values (256 of 8-bit channels), not pixels.
    """
    v = F.col(value)
    counts = values.groupBy(*by, v.alias("v")).agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy(*by).orderBy("v"), Window.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(whole))
    ranked = ranked.withColumn("bin", F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "v")) * 256), F.lit(255)))
    in_bin = Window.partitionBy(*by, "bin")
    ranked = ranked.withColumn("bn", F.sum("n").over(in_bin)).withColumn("head", F.row_number().over(in_bin.orderBy("v")) == 1)
    share = F.col("bn") / F.col("total")
    picks = [F.min(F.when(F.col("upto") > F.round((F.col("total") - 1) * p), F.col("v"))).alias(name) for name, p in (("median", 0.5), ("p01", 0.01), ("p05", 0.05), ("p95", 0.95), ("p99", 0.99))]
    total = F.max("total")
    mean = F.sum(F.col("v") * F.col("n")) / total
    agg = ranked.groupBy(*by).agg(
        total.alias("pixels"), F.min("v").alias("min"), F.max("v").alias("max"), mean.alias("mean"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("sq"), *picks,
        F.sum(F.when(F.col("head"), -share * F.log2(share))).alias("entropy_bits"),
        (F.sum(F.when(F.col("v") <= 1.0 / 255.0, F.col("n")).otherwise(0)) / total).alias("clipped_low_ratio"),
        (F.sum(F.when(F.col("v") >= 254.0 / 255.0, F.col("n")).otherwise(0)) / total).alias("clipped_high_ratio"),
    )
    return agg.withColumn("std_dev", F.sqrt(F.greatest(F.col("sq") / F.col("pixels") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("sq")


def value_histogram(values: DataFrame, by: list[str], bins: int = 16, value: str = "v") -> DataFrame:
    """(by, bin, count) with every bin present."""
    bins = min(max(bins, 1), 256)
    at = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))) * bins), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(*by).agg(*(F.count_if(at == b).alias(f"b{b}") for b in range(bins)))
    return counts.select(*by, F.posexplode(F.array(*(f"b{b}" for b in range(bins)))).alias("bin", "count"))


def hue_mean(hue_turns: Column) -> Column:
    """Aggregate: circular mean in degrees of hues given as shares of the circle."""
    t = hue_turns * 6.283185307179586
    d = F.degrees(F.atan2(F.sum(F.sin(t)), F.sum(F.cos(t))))
    return F.when(d < 0, d + 360.0).otherwise(d)


def color_balance(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """From channel means; of equal means the last of red, green, blue dominates."""
    total = F.greatest(r + g + b, F.lit(2.220446049250313e-16))
    gain = lambda c: total / 3.0 / F.greatest(c, F.lit(1.0 / 255.0))
    return {
        "normalized_red": r / total, "normalized_green": g / total, "normalized_blue": b / total, "red_minus_blue": r - b, "green_magenta": g - (r + b) * 0.5, "warm_cool_score": r - b + (g - b) * 0.25,
        "gain_red": gain(r), "gain_green": gain(g), "gain_blue": gain(b), "dominant_channel": F.when((b >= r) & (b >= g), "blue").when(g >= r, "green").otherwise("red"),
    }


def tendencies(c: dict[str, Column]) -> dict[str, Column]:
    """Labels and flags from luma_mean, luma_std, luma_p05, luma_p95, luma_low, luma_high, saturation_mean, alpha_min,
    alpha_mean (null without alpha) and the balance's columns."""
    three = lambda v, low, high, names: F.when(v < low, names[0]).when(v > high, names[2]).otherwise(names[1])
    off = [F.abs(c[f"normalized_{n}"] - 1.0 / 3.0) > 0.08 for n in ("red", "green", "blue")]
    return {
        "exposure": three(c["luma_mean"], 0.25, 0.75, ("dark", "balanced", "bright")),
        "contrast": three(c["luma_std"], 0.08, 0.24, ("low", "medium", "high")),
        "saturation": three(c["saturation_mean"], 0.10, 0.55, ("muted", "moderate", "vivid")),
        "temperature": three(c["red_minus_blue"], -0.05, 0.05, ("cool", "neutral", "warm")),
        "tint": three(c["green_magenta"], -0.04, 0.04, ("magenta", "neutral", "green")),
        "likely_grayscale": c["saturation_mean"] < 0.03,
        "shadow_clipping": c["luma_low"] > 0.01,
        "highlight_clipping": c["luma_high"] > 0.01,
        "color_cast": F.greatest(F.abs(c["red_minus_blue"]), F.abs(c["green_magenta"])) > 0.06,
        "has_transparency": F.coalesce(c["alpha_min"] < 1.0, F.lit(False)),
        "mostly_transparent": F.coalesce(c["alpha_mean"] < 0.5, F.lit(False)),
        "dominant_channel_bias": off[0] | off[1] | off[2],
        "low_dynamic_range": c["luma_p95"] - c["luma_p05"] < 0.20,
    }


def spatial_means(pixels: DataFrame, by: list[str], width: int, height: int, value: str = "luma") -> DataFrame:
    """Mean luma of the centre, the border and the four halves; an empty part has 0."""
    x, y = F.col("x"), F.col("y")
    center = (x >= width // 4) & (x < width * 3 // 4) & (y >= height // 4) & (y < height * 3 // 4)
    mean = lambda where, name: F.coalesce(F.avg(F.when(where, F.col(value))), F.lit(0.0)).alias(name)
    out = pixels.groupBy(*by).agg(
        mean(center, "center_luma_mean"), mean(~center, "border_luma_mean"), mean(y < height // 2, "top_luma_mean"), mean(y >= height // 2, "bottom_luma_mean"),
        mean(x < width // 2, "left_luma_mean"), mean(x >= width // 2, "right_luma_mean"),
    )
    return out.withColumn("center_border_delta", F.col("center_luma_mean") - F.col("border_luma_mean"))


def to_code(v: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255.0).cast("int")


def diff_columns(mode: str = "heatmap", scale: float = 4.0, include_alpha: bool = False) -> dict[str, Column]:
    """Codes r, g, b, a of a difference image from columns rr, rg, rb, ra and dr, dg, db, da."""
    d = {c: F.col(f"r{c}") - F.col(f"d{c}") for c in "rgba"}
    if mode == "absolute":
        return {c: to_code(F.abs(d[c]) * scale) for c in "rgb"} | {"a": to_code(F.abs(d["a"]) * scale) if include_alpha else F.lit(255)}
    if mode == "signed_luma":
        s = -(d["r"] * 0.2126 + d["g"] * 0.7152 + d["b"] * 0.0722) * scale
        return {"r": to_code(s), "g": F.lit(0), "b": to_code(-s), "a": F.lit(255)}
    t = F.least(F.lit(1.0), F.sqrt((d["r"] * d["r"] + d["g"] * d["g"] + d["b"] * d["b"]) / 3.0) * scale)
    ramp = lambda a, b, c, e: F.when(t < 0.25, a(t / 0.25)).when(t < 0.5, b((t - 0.25) / 0.25)).when(t < 0.75, c((t - 0.5) / 0.25)).otherwise(e((t - 0.75) / 0.25))
    zero, full, up, down = (lambda k: F.lit(0)), (lambda k: F.lit(255)), to_code, (lambda k: to_code(1.0 - k))
    return {"r": ramp(zero, zero, up, full), "g": ramp(up, full, full, down), "b": ramp(full, down, zero, zero), "a": F.lit(255)}
