"""Timelines: joining frames by index or nearest time, clock estimates, and aggregates of metric series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import UnsupportedInput
from .ranking import global_rank

#: Quantiles at which two clocks are compared, at most.
QUANTILES = 129
DEFAULT_MAX_DELTA = 1.0 / 60.0
#: Seconds of the shortest time slice.
_SLICE = 1.0


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def lockstep(reference: DataFrame, distorted: DataFrame, by: list[str], every: int = 1, max_frames: int | None = None) -> DataFrame:
    """Frames of equal index, up to the shorter side; every n-th of them, and at most ``max_frames``."""
    both = reference.join(distorted, [*by, "frame_index"])
    kept = both.where(F.col("frame_index") % max(every, 1) == 0)
    return kept if max_frames is None else kept.where(F.col("frame_index") < max_frames * max(every, 1))


def lockstep_summary(reference: DataFrame, distorted: DataFrame, by: list[str]) -> DataFrame:
    """Decoded frames of both sides, whether either ended first, and whether lengths differ."""
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    both = n(reference, "reference_frames").join(n(distorted, "distorted_frames"), by, "full_outer") if by else n(reference, "reference_frames").crossJoin(n(distorted, "distorted_frames"))
    both = both.fillna(0, ["reference_frames", "distorted_frames"])
    r, d = F.col("reference_frames"), F.col("distorted_frames")
    return both.withColumn("compared_frames", F.least(r, d)).withColumn("reference_ended", r <= d).withColumn("distorted_ended", d <= r).withColumn("length_mismatch", r != d)


def frame_pairs(pairs: DataFrame, reference: DataFrame, distorted: DataFrame, by: list[str]) -> DataFrame:
    """An explicit pair list (by, pair_index, reference_index, distorted_index, label) with both frames."""
    a = reference.select(*by, F.col("frame_index").alias("reference_index"), F.col("frame").alias("reference"))
    b = distorted.select(*by, F.col("frame_index").alias("distorted_index"), F.col("frame").alias("distorted"))
    return pairs.join(a, [*by, "reference_index"], "left").join(b, [*by, "distorted_index"], "left")


def effective_pts(info: DataFrame, start: str = "start_seconds", rate: str = "avg_rate") -> DataFrame:
    """Exact presentation time, or else start plus index over a positive rate; ``pts_exact`` is NaN where none is known."""
    fps = F.col(rate)
    estimate = F.when(finite(fps) & (fps > 0), F.coalesce(F.col(start), F.lit(0.0)) + F.col("frame_index") / fps)
    exact = F.when(finite(F.col("pts_seconds")), F.col("pts_seconds"))
    return info.withColumn("pts_effective", F.coalesce(exact, estimate)).withColumn("pts_exact", F.coalesce(exact, F.lit(float("nan"))))


def estimate_transform(reference: DataFrame, distorted: DataFrame, by: list[str]) -> DataFrame:
    """(by, scale, offset): least squares of distorted on reference quantiles; a useless scale becomes 1.

    One frame on a side gives an offset only; a side without any finite time gives no row.
    """

    def quantiles(df: DataFrame, name: str, n: DataFrame) -> DataFrame:
        values = df.where(finite(F.col("pts_seconds"))).join(n, by) if by else df.where(finite(F.col("pts_seconds"))).crossJoin(F.broadcast(n))
        # exact linear quantiles by rank: position q (n - 1) between its two neighbours
        rows = global_rank(values.select(*by, "k", F.col(f"n_{name}").alias("n"), "pts_seconds"), by, ["pts_seconds"], "i")
        at = F.explode(F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0)))).alias("q")
        wanted = n.select(*by, "k", F.col(f"n_{name}").alias("n"), at).withColumn("pos", F.col("q") / F.greatest(F.col("k") - 1, F.lit(1)) * (F.col("n") - 1))
        low, high = rows.select(*by, F.col("i").alias("lo"), F.col("pts_seconds").alias("a")), rows.select(*by, F.col("i").alias("hi"), F.col("pts_seconds").alias("b"))
        placed = wanted.withColumn("lo", F.floor("pos").cast("int")).withColumn("hi", F.ceil("pos").cast("int"))
        t = F.col("pos") - F.col("lo")
        return placed.join(low, [*by, "lo"]).join(high, [*by, "hi"]).select(*by, "q", "k", (F.when(F.col("lo") == F.col("hi"), F.col("a")).otherwise(F.col("a") * (1.0 - t) + F.col("b") * t)).alias(name))

    count = lambda df, name: df.where(finite(F.col("pts_seconds"))).groupBy(*by).agg(F.count("*").alias(name))
    n = count(reference, "n_r").join(count(distorted, "n_d"), by) if by else count(reference, "n_r").crossJoin(count(distorted, "n_d"))
    n = n.where("n_r > 0 and n_d > 0").withColumn("k", F.least("n_r", "n_d", F.lit(QUANTILES)).cast("int"))
    points = quantiles(distorted, "d", n).join(quantiles(reference, "r", n).drop("k"), [*by, "q"])
    fit = points.groupBy(*by).agg(F.avg("d").alias("mx"), F.avg("r").alias("my"), F.covar_pop("d", "r").alias("c"), F.var_pop("d").alias("v"), F.max("k").alias("k"))
    raw = F.when((F.col("k") > 1) & (F.col("v") * F.col("k") > float(np.finfo(float).eps)), F.col("c") / F.nullif(F.col("v"), F.lit(0.0)))
    scale = F.when(finite(raw) & (raw > 0), raw).otherwise(F.lit(1.0))
    return fit.withColumn("scale", scale).select(*by, "scale", (F.col("my") - F.col("scale") * F.col("mx")).alias("offset"))


def apply_transform(distorted: DataFrame, scale: float | Column = 1.0, offset: float | Column = 0.0) -> DataFrame:
    """``aligned`` = pts * scale + offset."""
    s, o = (c if isinstance(c, Column) else F.lit(float(c)) for c in (scale, offset))
    return distorted.withColumn("aligned", F.col("pts_seconds") * s + o)


def nearest_with_reuse(reference: DataFrame, distorted: DataFrame, by: list[str], max_delta: float = DEFAULT_MAX_DELTA) -> DataFrame:
    """Each reference frame with its nearest distorted frame within ``max_delta``; ties go to the smaller index.

    ``distorted`` may have ``aligned``. Time is cut into slices at least as long as the largest distance; a
    distorted frame is sent to its slice and both neighbours, so that long timelines spread over tasks. Within a
    slice the last frame before and the first at or after a reference frame are its candidates.
    """
    max_delta = max(0.0, max_delta) if math.isfinite(max_delta) else 0.0
    width = max(max_delta, _SLICE)
    time = F.col("aligned") if "aligned" in distorted.columns else F.col("pts_seconds")
    d = distorted.where(finite(F.col("pts_seconds")) & finite(time)).select(*by, F.col("index").alias("di"), F.col("pts_seconds").alias("dp"), time.alias("t"))
    r = reference.where(finite(F.col("pts_seconds"))).select(*by, F.col("index").alias("ri"), F.col("pts_seconds").alias("t"))
    slot = F.floor(F.col("t") / width)
    d = d.select("*", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"), F.lit(0).alias("side"))
    rows = r.select("*", slot.alias("slot"), F.lit(1).alias("side")).unionByName(d, allowMissingColumns=True)
    frame = F.when(F.col("side") == 0, F.struct("di", "dp", "t"))
    # before: among equal times the largest index is nearest in sorted order; at or after: the smallest
    back = Window.partitionBy(*by, "slot").orderBy("t", F.desc("side"), F.col("di")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by, "slot").orderBy("t", F.desc("side"), F.col("di")).rowsBetween(0, Window.unboundedFollowing)
    found = rows.withColumn("b", F.last(frame, True).over(back)).withColumn("a", F.first(frame, True).over(ahead)).where("side = 1")
    gap = lambda c: F.abs(F.col("t") - F.col(c)["t"])
    take_a = F.col("b").isNull() | (gap("a") < gap("b")) | ((gap("a") == gap("b")) & (F.col("a")["di"] < F.col("b")["di"]))
    best = F.when(F.col("a").isNotNull() & take_a, F.col("a")).otherwise(F.col("b"))
    out = found.withColumn("m", best).withColumn("delta_seconds", F.abs(F.col("t") - F.col("m.t"))).where(F.col("delta_seconds") <= max_delta)
    return out.select(*by, F.col("ri").alias("reference_index"), F.col("m.di").alias("distorted_index"), F.col("t").alias("reference_pts"), F.col("m.dp").alias("distorted_pts"), F.col("m.t").alias("aligned_pts"), "delta_seconds")


def nearest_once(reference: DataFrame, distorted: DataFrame, by: list[str], max_delta: float = DEFAULT_MAX_DELTA) -> DataFrame:
    """Monotone pairs, every distorted frame at most once: a cursor over the distorted frames, looking one ahead.

    The cursor can't matter across a silence longer than ``max_delta``, so each stretch between silences is a
    group of its own.
    """
    max_delta = max(0.0, max_delta) if math.isfinite(max_delta) else 0.0
    time = F.col("aligned") if "aligned" in distorted.columns else F.col("pts_seconds")
    d = distorted.where(finite(F.col("pts_seconds")) & finite(time)).select(*by, F.lit(1).alias("side"), F.col("index"), F.col("pts_seconds").alias("pts"), time.alias("t"))
    r = reference.where(finite(F.col("pts_seconds"))).select(*by, F.lit(0).alias("side"), F.col("index"), F.col("pts_seconds").alias("pts"), F.col("pts_seconds").alias("t"))
    rows = r.union(d)
    rows = rows if by else rows.withColumn("__one", F.lit(1))
    keys = by or ["__one"]
    w = Window.partitionBy(*keys).orderBy("t")
    islands = rows.withColumn("__gap", F.coalesce((F.col("t") - F.lag("t").over(w) > max_delta).cast("int"), F.lit(0))).withColumn("island", F.sum("__gap").over(w)).drop("__gap")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        ref = pdf[pdf["side"] == 0].sort_values(["t", "index"])
        dist = pdf[pdf["side"] == 1].sort_values(["t", "index"])
        t, cursor, out = dist["t"].to_numpy(), 0, []
        for i, now in zip(ref["index"].tolist(), ref["t"].tolist(), strict=True):
            cursor += int(np.searchsorted(t[cursor:], now - max_delta))
            if cursor >= len(t):
                break
            best = cursor + 1 if cursor + 1 < len(t) and abs(now - t[cursor + 1]) < abs(now - t[cursor]) else cursor
            if abs(now - t[best]) <= max_delta:
                out.append((i, int(dist["index"].iloc[best]), now, float(dist["pts"].iloc[best]), float(t[best]), abs(now - float(t[best]))))
                cursor = best + 1
        found = pd.DataFrame(out, columns=["reference_index", "distorted_index", "reference_pts", "distorted_pts", "aligned_pts", "delta_seconds"])
        for k in by:
            found[k] = pdf[k].iloc[0]
        return found

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in by), "reference_index long, distorted_index long, reference_pts double, distorted_pts double, aligned_pts double, delta_seconds double"])
    return islands.groupBy(*keys, "island").applyInPandas(lambda pdf: pair(pdf)[[*by, "reference_index", "distorted_index", "reference_pts", "distorted_pts", "aligned_pts", "delta_seconds"]], schema)


def unmatched(frames: DataFrame, pairs: DataFrame, by: list[str], side: str) -> DataFrame:
    """Frames (by, index) that no pair has; frames without a finite time among them."""
    return frames.select(*by, "index").join(pairs.select(*by, F.col(f"{side}_index").alias("index")), [*by, "index"], "left_anti")


def residuals(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean signed, mean absolute, root mean square and largest residual of the pairs."""
    d = F.col("reference_pts") - F.col("aligned_pts")
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(d).alias("mean_signed_delta"), F.avg(F.abs(d)).alias("mean_absolute_delta"), F.sqrt(F.avg(d * d)).alias("rms_delta"), F.max(F.abs(d)).alias("max_delta"))


def check_timeline(frames: DataFrame) -> None:
    if frames.where(finite(F.col("pts_seconds"))).limit(1).count() == 0:
        raise UnsupportedInput("a timeline has no finite timestamp")


def metric_means(rows: DataFrame, by: list[str], count_name: str = "frames") -> DataFrame:
    """mean_<name> of each metric: of finite scores; else infinity if any score is infinite; else NaN."""
    s = F.col("score")
    ok = finite(s)
    any_inf = F.bool_or(F.abs(s) == float("inf"))
    mean = F.coalesce(F.avg(F.when(ok, s)), F.when(any_inf, F.lit(float("inf"))), F.lit(float("nan")))
    out = rows.groupBy(*by, "name").agg(mean.alias("score"), F.first("unit").alias("unit"), F.first("direction").alias("direction"), F.count("*").cast("double").alias("n"))
    return out.select(*by, F.concat(F.lit("mean_"), "name").alias("name"), "score", "unit", "direction", F.create_map(F.lit(count_name), "n").alias("details"))


def time_weighted_mean(rows: DataFrame, by: list[str]) -> DataFrame:
    """Scores weighted by the time until the next; equal times are averaged, the last gets the median interval.

    Null with fewer than two distinct times.
    """
    usable = rows.where(finite(F.col("pts_seconds")) & finite(F.col("score")))
    points = usable.groupBy(*by, "pts_seconds").agg(F.avg("score").alias("s"))
    w = Window.partitionBy(*by).orderBy("pts_seconds")
    spans = points.withColumn("d", F.lead("pts_seconds").over(w) - F.col("pts_seconds"))
    middle = spans.groupBy(*by).agg(F.percentile("d", F.lit(0.5)).alias("median"))
    weighed = spans.join(middle, by).withColumn("d", F.coalesce("d", "median")) if by else spans.crossJoin(F.broadcast(middle)).withColumn("d", F.coalesce("d", "median"))
    total = F.sum("d")
    return weighed.groupBy(*by).agg(F.when(total > 0, F.sum(F.col("s") * F.col("d")) / F.nullif(total, F.lit(0.0))).alias("time_weighted_mean"))


def series_aggregate(rows: DataFrame, by: list[str], percentiles: tuple[float, ...] = (1.0, 5.0, 50.0, 95.0, 99.0)) -> DataFrame:
    """Counts, mean, range, median, deviation, percentiles, time-weighted mean and worst frame of each series.

    ``rows``: by (with the metric's name), frame_index, pts_seconds, score, direction. Only finite scores count;
    without any, infinities give the range and percentiles, the mean if they agree and nothing is NaN, else NaN.
    Of equally bad frames the one with the smallest position (``pos``, or else frame_index) is the worst.
    """
    s = F.col("score")
    ok, nan = finite(s), float("nan")
    value = F.when(ok, s)
    order = "pos" if "pos" in rows.columns else "frame_index"
    bad = F.when(F.col("direction") == "higher", s).when(F.col("direction") == "lower", -s).otherwise(-F.abs(s))
    worst = lambda keep: F.min(F.when(keep, F.struct(bad.alias("k"), F.col(order).alias("o"), "frame_index", "pts_seconds", "score")))
    some = F.when(~F.isnan(s), s)
    cuts = [max(0.0, min(100.0, p)) / 100.0 for p in (*percentiles, 50.0)]
    agg = rows.groupBy(*by).agg(
        F.count(value).alias("samples"), F.count("*").alias("total_samples"), F.count_if(F.isnan(s)).alias("nan_samples"), F.count_if(s == float("inf")).alias("positive_infinite_samples"), F.count_if(s == float("-inf")).alias("negative_infinite_samples"),
        F.avg(value).alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_pop(value).alias("sd"), F.percentile(value, F.array(*map(F.lit, cuts))).alias("q"),
        F.min(some).alias("lo_any"), F.max(some).alias("hi_any"), F.sort_array(F.collect_list(F.when(~ok & ~F.isnan(s), s))).alias("infinite"), worst(ok).alias("w"), worst(~F.isnan(s)).alias("w_any"),
    )
    none = F.col("samples") == 0
    p, n, x = (F.col(f"{k}_samples") for k in ("positive_infinite", "negative_infinite", "nan"))
    mean_any = F.when((p > 0) & (n == 0) & (x == 0), F.lit(float("inf"))).when((n > 0) & (p == 0) & (x == 0), F.lit(float("-inf"))).otherwise(F.lit(nan))

    def at_any(cut: float) -> Column:
        k = F.size("infinite")
        pos = (k - 1) * F.lit(cut)
        a, b = (F.try_element_at("infinite", (f(pos) + 1).cast("int")) for f in (F.floor, F.ceil))
        t = pos - F.floor(pos)
        return F.when(k == 0, F.lit(nan)).when(F.floor(pos) == F.ceil(pos), a).otherwise(a * (1.0 - t) + b * t)

    pick = lambda i: F.when(none, at_any(cuts[i])).otherwise(F.col("q")[i])
    w = F.when(none, F.col("w_any")).otherwise(F.col("w"))
    out = agg.select(
        *by, "samples", "total_samples", "nan_samples", "positive_infinite_samples", "negative_infinite_samples",
        F.when(none, mean_any).otherwise(F.col("m")).alias("mean"), F.when(none, F.coalesce("lo_any", F.lit(nan))).otherwise(F.col("lo")).alias("min"), F.when(none, F.coalesce("hi_any", F.lit(nan))).otherwise(F.col("hi")).alias("max"),
        pick(len(cuts) - 1).alias("median"), F.when(none, F.lit(nan)).otherwise(F.col("sd")).alias("standard_deviation"), *(pick(i).alias(f"p{c:g}".replace(".", "_")) for i, c in enumerate(percentiles)),
        w["frame_index"].alias("worst_frame_index"), w["pts_seconds"].alias("worst_pts_seconds"), w["score"].alias("worst_score"),
    )
    return out.join(time_weighted_mean(rows, by), by, "left") if by else out.crossJoin(time_weighted_mean(rows, by))


def alignment_rows(pairs: DataFrame, by: list[str], unmatched_reference: DataFrame, unmatched_distorted: DataFrame, transform: DataFrame) -> DataFrame:
    """Alignment diagnostics as metric rows (scope alignment); residual rows are left out where there are no pairs."""
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    wide = transform.join(residuals(pairs, by), by, "left").join(n(unmatched_reference, "ur"), by, "left").join(n(unmatched_distorted, "ud"), by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    # Names of the diagnostics.
    named = {
        "alignment_planned_pairs": zero("pairs"),
        "alignment_unmatched_reference_frames": zero("ur"),
        "alignment_unmatched_distorted_frames": zero("ud"),
        "alignment_timestamp_scale": F.col("scale"),
        "alignment_timestamp_offset": F.col("offset"),
        "alignment_mean_signed_residual": F.col("mean_signed_delta"),
        "alignment_mean_absolute_residual": F.col("mean_absolute_delta"),
        "alignment_rms_residual": F.col("rms_delta"),
        "alignment_max_residual": F.col("max_delta"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(k).alias("name"), v.alias("score")) for i, (k, v) in enumerate(named.items())))).alias("r")
    return wide.select(*by, rows).select(*by, F.lit("alignment").alias("scope"), "r.pos", "r.name", "r.score").where("score is not null")


def naive_pairs(reference: Iterator[tuple[int, float]], distorted: Iterator[tuple[int, float]], max_delta: float) -> list[tuple[int, int]]:
    """Nearest pairs with reuse by a full scan, for tests."""
    out, right = [], [(i, t) for i, t in distorted if math.isfinite(t)]
    for i, t in reference:
        if math.isfinite(t) and right:
            gap, j = min((abs(t - u), j) for j, u in right)
            if gap <= max_delta:
                out.append((i, j))
    return out
