"""Ranking of candidates from metric rows: tolerant competition ranks, mean ranks, baseline deltas, Pareto frontier.

Rows are (suite columns, label, ord, name, score, direction); ``ord`` is the candidate's place in the input.
Failed candidates have no rows here and are joined back by reports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import UnsupportedInput


@dataclass(frozen=True)
class Tolerance:
    absolute: float = 1e-12
    relative: float = 1e-9

    def equivalent(self, a: Column, b: Column) -> Column:
        """Equal, both NaN, or finite and within tolerance."""
        finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
        near = F.abs(a - b) <= F.lit(self.absolute) + F.greatest(F.abs(a), F.abs(b)) * self.relative
        return (F.isnan(a) & F.isnan(b)) | F.coalesce((a == b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False)) | (finite(a) & finite(b) & near)


def oriented(score: Column, direction: Column) -> Column:
    """Scores so that more is better; NaN stays NaN."""
    return F.when(direction == "lower", -score).otherwise(score)


def tolerant_rank(rows: DataFrame, by: list[str], key: Column, label: str, tolerance: Tolerance, name: str = "rank", nan_last: bool = True) -> DataFrame:
    """Competition ranks (1, 1, 3) by ascending ``key``, ties by label: a row that is equivalent to the one before
    it shares its rank, which chains."""
    w = Window.partitionBy(*by).orderBy(F.isnan("__k") if nan_last else F.lit(False), "__k", label)
    placed = rows.withColumn("__k", key).withColumn("__n", F.row_number().over(w)).withColumn("__p", F.lag("__k").over(w))
    fresh = F.col("__p").isNull() | ~tolerance.equivalent(F.col("__p"), F.col("__k"))
    first = F.max(F.when(fresh, F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, first).drop("__k", "__n", "__p")


def metric_ranks(rows: DataFrame, suite: list[str], tolerance: Tolerance | None = None) -> DataFrame:
    """``rows`` of directional metrics with their rank within the metric; NaN is last in either direction."""
    key = -oriented(F.col("score"), F.col("direction"))
    return tolerant_rank(rows.where("direction <> 'neutral'"), [*suite, "name"], key, "label", tolerance or Tolerance())


def check_weights(names: set[str], weights: dict[str, float], primary: str | None = None) -> None:
    """What must hold of the requested weights and primary metric, given the directional metrics produced."""
    for metric, weight in weights.items():
        if not 0 <= weight < float("inf"):
            raise UnsupportedInput(f"weight of {metric!r} must be finite and not negative")
        if metric not in names:
            raise UnsupportedInput(f"weighted metric {metric!r} was not produced as a directional metric")
    if names and all(weights.get(n) == 0 for n in names):
        raise UnsupportedInput("a directional metric must have a positive weight")
    if primary is not None and primary not in names:
        raise UnsupportedInput(f"primary metric {primary!r} was not produced as a directional metric")


def overall_ranks(ranked: DataFrame, suite: list[str], weights: dict[str, float] | None = None, primary: str | None = None, tolerance: Tolerance | None = None) -> DataFrame:
    """mean_rank (weighted; default weight 1) and overall_rank, by the primary metric's rank or else the mean rank."""
    weight = F.lit(1.0)
    for metric, value in (weights or {}).items():
        weight = F.when(F.col("name") == metric, F.lit(float(value))).otherwise(weight)
    total = F.sum(weight)
    mean = F.when(total > 0, F.sum(F.col("rank") * weight) / F.nullif(total, F.lit(0.0)))
    first = F.min(F.when(F.col("name") == primary, F.col("rank"))) if primary else F.lit(None).cast("int")
    per = ranked.groupBy(*suite, "label").agg(F.min("ord").alias("ord"), mean.alias("mean_rank"), F.coalesce(first.cast("double"), mean).alias("value"))
    rated = tolerant_rank(per.where("value is not null"), suite, F.col("value"), "label", tolerance or Tolerance(), "overall_rank")
    return rated.select(*suite, "label", "ord", "mean_rank", "overall_rank").union(per.where("value is null").select(*suite, "label", "ord", "mean_rank", F.lit(None).cast("int")))


def winners(overall: DataFrame, suite: list[str]) -> DataFrame:
    """The first candidate in input order with rank 1."""
    return overall.where("overall_rank = 1").groupBy(*suite).agg(F.min_by("label", "ord").alias("winner")) if suite else overall.where("overall_rank = 1").agg(F.min_by("label", "ord").alias("winner"))


def baseline_deltas(rows: DataFrame, suite: list[str], baseline: str | Column) -> DataFrame:
    """Score minus the baseline candidate's, for metrics that both have."""
    base = rows.where(F.col("label") == baseline).select(*suite, "name", F.col("score").alias("baseline_score"))
    return rows.join(base, [*suite, "name"]).withColumn("delta", F.col("score") - F.col("baseline_score"))


def require_baseline(rows: DataFrame, baseline: str) -> None:
    if rows.where(F.col("label") == baseline).limit(1).count() == 0:
        raise UnsupportedInput(f"baseline candidate {baseline!r} does not exist or failed")


def pareto_frontier(rows: DataFrame, suite: list[str], tolerance: Tolerance | None = None) -> DataFrame:
    """(suite, label, pareto_optimal): not dominated by a candidate as good on every directional metric and better on one.

    A metric missing on either side blocks dominance. Candidates are wide rows, compared by an anti-join whose
    condition looks at whole rows, so that pairs are tested and never stored.
    """
    t = tolerance or Tolerance()
    directed = rows.where("direction <> 'neutral'")
    names = directed.select(*suite, "name").distinct().groupBy(*suite).agg(F.sort_array(F.collect_set("name")).alias("names")) if suite else directed.agg(F.sort_array(F.collect_set("name")).alias("names"))
    held = directed.groupBy(*suite, "label").agg(F.map_from_entries(F.collect_list(F.struct("name", oriented(F.col("score"), F.col("direction")).alias("v")))).alias("m"))
    wide = (held.join(names, suite) if suite else held.crossJoin(F.broadcast(names))).select(*suite, "label", F.transform("names", lambda n: F.try_element_at("m", n)).alias("v"))
    wide = wide if suite else wide.withColumn("__one", F.lit(1))
    keys = suite or ["__one"]
    other = wide.select(*keys, F.col("label").alias("other"), F.col("v").alias("o"))
    pairs = F.zip_with("o", "v", lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def better(p: Column) -> Column:
        return ~t.equivalent(p["a"], p["b"]) & ~F.isnan(p["a"]) & (F.isnan(p["b"]) | (p["a"] > p["b"]))

    fine = F.forall(pairs, lambda p: F.coalesce(t.equivalent(p["a"], p["b"]) | better(p), F.lit(False)))
    strict = F.exists(pairs, lambda p: F.coalesce(better(p), F.lit(False)))
    on = [F.col(f"w.{k}") == F.col(f"o_.{k}") for k in keys]
    condition = (F.col("label") != F.col("other")) & fine & strict
    for c in on:
        condition = c & condition
    best = wide.alias("w").join(other.alias("o_"), condition, "left_anti").select(*suite, "label", F.lit(True).alias("pareto_optimal"))
    return wide.select(*suite, "label").join(best, [*suite, "label"], "left").withColumn("pareto_optimal", F.coalesce("pareto_optimal", F.lit(False)))


def check_labels(candidates: DataFrame, suite: list[str]) -> None:
    """Labels must be there, not blank, and unique within their suite."""
    if candidates.where(F.col("label").isNull() | (F.trim("label") == "")).limit(1).count():
        raise UnsupportedInput("candidate labels must not be blank")
    again = candidates.groupBy(*suite, "label").count().where("count > 1").select("label").limit(1).collect()
    if again:
        raise UnsupportedInput(f"candidate label {again[0][0]!r} is not unique")
