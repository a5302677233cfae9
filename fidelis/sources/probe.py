"""Probe metadata from JSON: streams and frames of videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STREAM = "index int, codec_name string, width int, height int, avg_frame_rate string, r_frame_rate string, time_base string, nb_frames string, duration string, start_time string, pix_fmt string, color_space string, color_transfer string, color_primaries string, color_range string"
_FRAME = "best_effort_timestamp_time string, pts_time string, pkt_dts_time string, pkt_duration_time string, duration_time string, key_frame int, pict_type string"


def number(text: Column) -> Column:
    """A finite number, or null."""
    v = text.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def ratio(text: Column) -> Column:
    """``n/d`` or a number; null for a zero denominator."""
    n, d = number(F.split_part(text, F.lit("/"), F.lit(1))), number(F.split_part(text, F.lit("/"), F.lit(2)))
    return F.when(F.contains(text, F.lit("/")), n / F.nullif(d, F.lit(0.0))).otherwise(number(text))


def streams(probes: DataFrame, stream: int = 0) -> DataFrame:
    """One row per probe (input, json) of its stream; what a stream lacks comes from its container."""
    fields = ", ".join(f.replace(" ", ": ", 1) for f in _STREAM.split(", "))
    root = F.from_json("json", f"streams array<struct<{fields}>>, format struct<duration: string, start_time: string>")
    rows = probes.withColumn("p", root).withColumn("s", F.try_element_at("p.streams", F.lit(stream + 1)))
    rate, base = ratio(F.col("s.avg_frame_rate")), ratio(F.col("s.r_frame_rate"))
    return rows.select(
        "input", "s.width", "s.height", "s.codec_name", F.when(rate > 0, rate).alias("avg_rate"), F.when(base > 0, base).alias("base_rate"), ratio(F.col("s.time_base")).alias("time_base"),
        F.col("s.nb_frames").try_cast("long").alias("nb_frames"), F.coalesce(number(F.col("s.duration")), number(F.col("p.format.duration"))).alias("duration_seconds"),
        F.coalesce(number(F.col("s.start_time")), number(F.col("p.format.start_time"))).alias("start_seconds"), F.col("s.pix_fmt").alias("pixel_format"), "s.color_space", "s.color_transfer", "s.color_primaries", "s.color_range",
    )


def frames(probes: DataFrame) -> DataFrame:
    """One row per frame of each probe: the best known time and duration; what is not finite is null."""
    root = F.from_json("json", "frames array<struct<" + ", ".join(f.replace(" ", ": ", 1) for f in _FRAME.split(", ")) + ">>")
    rows = probes.select("input", F.posexplode(root["frames"]).alias("frame_index", "f"))
    return rows.select(
        "input", F.col("frame_index").cast("long").alias("frame_index"), F.coalesce(*(number(F.col(f"f.{c}")) for c in ("best_effort_timestamp_time", "pts_time", "pkt_dts_time"))).alias("pts_seconds"),
        F.coalesce(number(F.col("f.pkt_duration_time")), number(F.col("f.duration_time"))).alias("duration_seconds"), (F.col("f.key_frame") != 0).alias("key_frame"), F.col("f.pict_type").alias("picture_type"),
    )
