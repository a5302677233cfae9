"""Comparison of frame sequences: in decode order, by explicit pairs, and by time.

Frames are tables (by, frame_index, frame); times come from probe tables. Only the paired frames meet.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import UnsupportedInput
from ..operators import timeline
from .metrics import compare_pairs


def _both(pairs: DataFrame, reference: DataFrame, distorted: DataFrame, by: list[str]) -> DataFrame:
    a = reference.select(*by, F.col("frame_index").alias("reference_index"), F.col("frame").alias("reference"))
    b = distorted.select(*by, F.col("frame_index").alias("distorted_index"), F.col("frame").alias("distorted"))
    return pairs.join(a, [*by, "reference_index"], "left").join(b, [*by, "distorted_index"], "left")


def compare_in_order(reference: DataFrame, distorted: DataFrame, metrics: Any = None, by: list[str] | None = None, every: int = 1, max_frames: int | None = None) -> DataFrame:
    """Metric rows of frames of equal index, every n-th, at most ``max_frames``."""
    by = by or []
    r, d = reference.withColumnRenamed("frame", "reference"), distorted.withColumnRenamed("frame", "distorted")
    return compare_pairs(timeline.lockstep(r, d, by, every, max_frames), metrics, [*by, "frame_index"])


def compare_listed(pairs: DataFrame, reference: DataFrame, distorted: DataFrame, metrics: Any = None, by: list[str] | None = None) -> DataFrame:
    """Metric rows of an explicit pair list (pair_index, reference_index, distorted_index, label), in its order."""
    keep = [*(by or []), "pair_index", "reference_index", "distorted_index", "label"]
    return compare_pairs(_both(pairs, reference, distorted, by or []), metrics, keep)


def compare_by_time(
    reference: DataFrame, distorted: DataFrame, reference_times: DataFrame, distorted_times: DataFrame, metrics: Any = None, by: list[str] | None = None, max_delta: float = timeline.DEFAULT_MAX_DELTA,
    reuse: bool = True, transform: tuple[float, float] | None = None, estimate: bool = False, every: int = 1, max_frames: int | None = None,
) -> DataFrame:
    """Metric rows of the frames nearest in time; times are tables (by, index, pts_seconds).

    The distorted clock is mapped by ``transform`` (scale, offset), or by an estimate, or not at all. Every n-th pair
    in time order is compared. Details also hold both frame indices, the distorted time and the distance.
    """
    by = by or []
    for side in (reference_times, distorted_times):
        timeline.check_timeline(side)
    if transform is not None:
        if not transform[0] > 0 or any(abs(v) == float("inf") or v != v for v in transform):
            raise UnsupportedInput("a clock's scale must be positive, and both its numbers finite")
        moved = timeline.apply_transform(distorted_times, *transform)
    elif estimate:
        fit = timeline.estimate_transform(reference_times, distorted_times, by)
        joined = distorted_times.join(fit, by, "left") if by else distorted_times.crossJoin(F.broadcast(fit))  # without keys the fit is one row
        moved = timeline.apply_transform(joined, F.coalesce("scale", F.lit(1.0)), F.coalesce("offset", F.lit(0.0))).drop("scale", "offset")
    else:
        moved = distorted_times
    pairs = (timeline.nearest_with_reuse if reuse else timeline.nearest_once)(reference_times, moved, by, max_delta)
    w = Window.partitionBy(*by).orderBy("reference_pts", "reference_index")
    pairs = pairs.withColumn("pair_index", F.row_number().over(w) - 1).where(F.col("pair_index") % max(every, 1) == 0)
    if max_frames is not None:
        pairs = pairs.where(F.col("pair_index") < max_frames * max(every, 1))
    rows = compare_pairs(_both(pairs, reference, distorted, by), metrics, [*by, "pair_index", "reference_index", "distorted_index", "reference_pts", "distorted_pts", "delta_seconds"])
    # Names of the added details.
    more = {"reference_frame_index": "reference_index", "distorted_frame_index": "distorted_index", "distorted_pts_seconds": "distorted_pts", "timestamp_delta_seconds": "delta_seconds"}
    added = F.map_from_arrays(F.array(*map(F.lit, more)), F.array(*(F.col(c).cast("double") for c in more.values())))
    details = F.when(F.col("details").isNotNull(), F.map_concat("details", added))
    return rows.withColumn("details", details).withColumn("frame_index", F.col("reference_index")).withColumn("pts_seconds", F.col("reference_pts"))
