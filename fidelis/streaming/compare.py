"""Streaming comparison of two frame streams, with running means of the metrics."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.timeline import finite
from ..plans.metrics import compare_pairs


def join_frames(reference: DataFrame, distorted: DataFrame, by: list[str], time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Stream-stream join of frames (by, frame_index, frame) of equal index.

    With an event-time column on both sides, watermarks bound the state: a frame waits ``late`` for its partner.
    """
    r = reference.withColumnRenamed("frame", "reference")
    d = distorted.withColumnRenamed("frame", "distorted")
    if time is None:
        return r.join(d, [*by, "frame_index"])
    r = r.withWatermark(time, late).withColumnRenamed(time, "reference_time")
    d = d.withColumnRenamed(time, "distorted_time").withWatermark("distorted_time", late)
    span = F.expr(f"distorted_time BETWEEN reference_time - INTERVAL {late} AND reference_time + INTERVAL {late}")
    keys = [F.col(f"r.{k}") == F.col(f"d.{k}") for k in (*by, "frame_index")]
    on = span
    for k in keys:
        on = on & k
    return r.alias("r").join(d.alias("d"), on).select(*(F.col(f"r.{k}").alias(k) for k in (*by, "frame_index")), "reference_time", "reference", "distorted")


def compare_stream(pairs: DataFrame, metrics: Any = None) -> DataFrame:
    """Metric rows of a stream of pairs; frames are compared one by one, so memory stays bounded."""
    return compare_pairs(pairs, metrics)


def running_means(rows: DataFrame, by: list[str]) -> DataFrame:
    """Running mean of finite scores per metric, as a streaming aggregate (update or complete mode).

    Update mode allows no stream-stream join upstream: let the joined rows be written first and stream from there.
    """
    s = F.col("score")
    ok = finite(s)
    mean = F.coalesce(F.avg(F.when(ok, s)), F.when(F.max(F.when(F.abs(s) == float("inf"), 1)) == 1, F.lit(float("inf"))), F.lit(float("nan")))
    return rows.where("error is null").groupBy(*by, "name").agg(mean.alias("score"), F.count("*").alias("frames")).withColumn("name", F.concat(F.lit("mean_"), "name"))


def start(rows: DataFrame, on_batch: Callable[[DataFrame, int], bool | None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feed each micro-batch of metric rows to ``on_batch``; it may return False to stop the query.

    Sinks called from it are repeated after a failure, so they should be idempotent by the batch id.
    """
    holder: dict[str, StreamingQuery] = {}

    def handle(df: DataFrame, batch: int) -> None:
        if on_batch(df, batch) is False and "q" in holder:
            holder["q"].stop()

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    holder["q"] = (writer.trigger(availableNow=True) if once else writer).start()
    return holder["q"]


def bundle_writer(path: str, key: str = "bundle") -> Callable[[DataFrame, int], None]:
    """For ``start`` on a stream of frames: packs each micro-batch into bundles, stored by batch id, so that a repeat
    overwrites what it wrote before."""
    from ..sources.bundle import encode_bundles

    def write(df: DataFrame, batch: int) -> None:
        encode_bundles(df, key).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
