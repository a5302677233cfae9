"""Planner of the kernel form: pairs of frames in, metric rows out, in one narrow stage."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import QualityError
from ..functions.spec import parse_specs
from ..operators import kernels, profile

ROW_FIELDS = [
    T.StructField("pos", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("error", T.StringType()),
]


def _map(df: DataFrame, keep: list[str], inputs: list[str], fields: list[T.StructField], work: Any) -> DataFrame:
    """Run ``work`` on the input structs of each row; what it yields becomes rows after the kept columns.

    Arrow batches of frames are cut to few rows, since frames are large.
    """
    schema = T.StructType([*(df.schema[k] for k in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 8):
                part = batch.slice(lo, 8)
                held = {k: part.column(k).to_pylist() for k in (*keep, *inputs)}
                rows = []
                for i in range(part.num_rows):
                    kept = {k: held[k][i] for k in keep}
                    rows.extend(kept | r for r in work(*(held[k][i] for k in inputs)))
                if out_schema is None:
                    from pyspark.sql.pandas.types import to_arrow_schema

                    out_schema = to_arrow_schema(schema)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out_schema)

    return df.select(*keep, *inputs).mapInArrow(run, schema)


def compare_pairs(pairs: DataFrame, metrics: Any = None, keep: list[str] | None = None, custom: dict[str, kernels.CustomMetric] | None = None) -> DataFrame:
    """Metric rows of each pair (keep columns, reference frame, distorted frame).

    Specifications are parsed here, so unknown metrics fail before anything runs; a pair that can't be compared
    gives one row with ``error`` and null scores. A null frame is an error too.
    """
    specs = parse_specs(metrics)
    keep = [c for c in pairs.columns if c not in ("reference", "distorted")] if keep is None else keep

    def work(reference: Any, distorted: Any) -> Iterator[dict[str, Any]]:
        try:
            if reference is None or distorted is None:
                raise QualityError("a frame of the pair is missing")
            rows = kernels.compare(reference, distorted, specs, custom)
        except QualityError as e:
            yield {"pos": 0, "name": None, "score": None, "unit": None, "direction": None, "details": None, "error": f"{e.kind}: {e}"}
            return
        for i, r in enumerate(rows):
            yield {**r, "pos": i, "details": list(r["details"].items()), "error": None}

    return _map(pairs, keep, ["reference", "distorted"], ROW_FIELDS, work)


def compare_candidates(reference: DataFrame, candidates: DataFrame, metrics: Any = None, on: list[str] | None = None) -> DataFrame:
    """Every candidate (on, label, ord, frame) against the reference frame of its suite (on, frame).

    References are joined by key; without keys there must be a single reference row.
    """
    r = reference.select(*(on or []), F.col("frame").alias("reference"))
    c = candidates.withColumnRenamed("frame", "distorted")
    if on:
        return compare_pairs(c.join(r, on), metrics)
    # more than one reference is an error, not a choice between them
    one = r.limit(2).agg(F.count("*").alias("n"), F.first("reference").alias("reference"))
    one = one.select(F.when(F.col("n") > 1, F.raise_error(F.lit("several references without a key to join them by"))).otherwise(F.col("reference")).alias("reference"), "n").where("n > 0").drop("n")
    return compare_pairs(c.crossJoin(F.broadcast(one)), metrics)


def first_error(rows: DataFrame) -> None:
    """The fail-fast policy: raise the first error in input order."""
    found = rows.where("error is not null").orderBy("ord").select("label", "error").limit(1).collect()
    if found:
        raise QualityError(f"candidate {found[0][0]!r}: {found[0][1]}")


def alpha_rows(pairs: DataFrame) -> DataFrame:
    """Alpha diagnostics of each pair."""
    bucket = T.StructType([T.StructField(k, T.LongType()) for k in ("transparent", "partial", "opaque")])
    fields = [T.StructField("reference_alpha", bucket), T.StructField("distorted_alpha", bucket), *(T.StructField(k, T.LongType()) for k in ("mismatch_count", "max_delta", "mismatches_beyond_one_lsb")), T.StructField("error", T.StringType())]

    def work(a: Any, b: Any) -> Iterator[dict[str, Any]]:
        try:
            d = kernels.alpha_diagnostics(a, b)
            yield {"reference_alpha": d.pop("reference"), "distorted_alpha": d.pop("distorted"), **d, "error": None}
        except QualityError as e:
            yield {"error": f"{e.kind}: {e}"}

    return _map(pairs, [c for c in pairs.columns if c not in ("reference", "distorted")], ["reference", "distorted"], fields, work)


def diff_frames(pairs: DataFrame, mode: str = "heatmap", scale: float = 4.0, include_alpha: bool = False) -> DataFrame:
    """A difference image (column frame) of each pair."""
    from ..functions.formats import FRAME_TYPE

    def work(a: Any, b: Any) -> Iterator[dict[str, Any]]:
        try:
            yield {"frame": kernels.diff_image(a, b, mode, scale, include_alpha), "error": None}
        except QualityError as e:
            yield {"frame": None, "error": f"{e.kind}: {e}"}

    return _map(pairs, [c for c in pairs.columns if c not in ("reference", "distorted")], ["reference", "distorted"], [T.StructField("frame", FRAME_TYPE), T.StructField("error", T.StringType())], work)


def image_profiles(frames: DataFrame, bins: int = 16) -> DataFrame:
    """The profile of each frame (column frame) as JSON, and flat columns of what is asked for most."""
    import json

    fields = [T.StructField("profile", T.StringType()), T.StructField("luma_mean", T.DoubleType()), T.StructField("dominant_channel", T.StringType()), T.StructField("error", T.StringType())]

    def work(frame: Any) -> Iterator[dict[str, Any]]:
        try:
            p = profile.image_statistics(frame, bins)
            yield {"profile": json.dumps(p, sort_keys=True), "luma_mean": p["luma"]["mean"], "dominant_channel": p["color_balance"]["dominant_channel"], "error": None}
        except QualityError as e:
            yield {"error": f"{e.kind}: {e}"}

    return _map(frames, [c for c in frames.columns if c != "frame"], ["frame"], fields, work)


def feature_distance(pairs: DataFrame, extractor: Any, normalisation: str = "identity", name: str = "feature_distance") -> DataFrame:
    """Sum over layers of mean squared differences of features that ``extractor`` finds in a (1, 3, H, W) tensor."""
    import numpy as np

    from ..operators.pixels import Pixels

    # Channel means and deviations of the usual image normalisation.
    mean, deviation = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)

    def tensor(p: Pixels) -> np.ndarray:
        rgb = p.rgb().astype(np.float32)
        rgb = (rgb - mean) / deviation if normalisation == "imagenet" else rgb
        return np.moveaxis(rgb, -1, 0)[None]

    def metric(a: Pixels, b: Pixels) -> kernels.Row:
        layers = [float(((np.asarray(x, float) - np.asarray(y, float)) ** 2).mean()) for x, y in zip(extractor(tensor(a)), extractor(tensor(b)), strict=True)]
        return kernels.row(name, sum(layers), "unitless", "lower", {f"layer_{i}": v for i, v in enumerate(layers)})

    rows = compare_pairs(pairs, "mse", custom={name: metric})
    return rows.where((F.col("name") == name) | F.col("error").isNotNull())
