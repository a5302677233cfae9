"""Quality gates: absolute and baseline-relative threshold rules on metric rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import UnsupportedInput

# Operators in the order in which they are looked for.
OPERATORS = (">=", "<=", ">", "<")


@dataclass(frozen=True)
class Rule:
    """``metric op threshold``; relative to a baseline: threshold = baseline * scale + offset."""

    metric: str
    operator: str
    threshold: float | None = None
    scale: float | None = None
    offset: float | None = None

    @property
    def relative(self) -> bool:
        return self.threshold is None


def _number(text: str, rule: str) -> float:
    try:
        value = float(text.strip().replace("_", "x"))
    except ValueError:
        raise UnsupportedInput(f"invalid number in rule {rule!r}") from None
    if not math.isfinite(value):
        raise UnsupportedInput(f"numbers must be finite in rule {rule!r}")
    return value


def parse_rule(text: str) -> Rule:
    """``metric>=40``, ``metric.detail<=0.03``, ``metric>=baseline-0.5``, ``metric<=baseline*1.1``, ``metric<baseline/2``."""
    operator = next((o for o in OPERATORS if o in text), None)
    if operator is None:
        raise UnsupportedInput(f"invalid rule {text!r}")
    metric, right = (p.strip() for p in text.split(operator, 1))
    if not metric:
        raise UnsupportedInput(f"no metric in rule {text!r}")
    if not right.startswith("baseline"):
        return Rule(metric, operator, _number(right, text))
    rest = right.removeprefix("baseline").strip()
    if not rest:
        return Rule(metric, operator, None, 1.0, 0.0)
    if rest[0] in "+-":
        return Rule(metric, operator, None, 1.0, _number(rest, text))
    if rest[0] == "*":
        return Rule(metric, operator, None, _number(rest[1:], text), 0.0)
    if rest[0] == "/":
        divisor = _number(rest[1:], text)
        if divisor == 0 or not math.isfinite(1.0 / divisor):
            raise UnsupportedInput(f"invalid divisor in rule {text!r}")
        return Rule(metric, operator, None, 1.0 / divisor, 0.0)
    raise UnsupportedInput(f"invalid baseline expression in rule {text!r}")


def holds(operator: Column, value: Column, threshold: Column) -> Column:
    """A comparison with NaN is false, as IEEE has it and SQL has not."""
    ok = (
        F.when(operator == ">=", value >= threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == ">", value > threshold)
        .otherwise(value < threshold)
    )
    return F.coalesce(ok & ~F.isnan(value) & ~F.isnan(threshold), F.lit(False))


def _lookup(scores: Column, details: Column, metric: Column) -> tuple[Column, Column]:
    """(value, what is missing): a metric by its whole name, else the detail after the last dot."""
    dot = F.length(metric) - F.locate(".", F.reverse(metric)) + 1
    dotted = F.locate(".", metric) > 0
    base, leaf = F.substring(metric, F.lit(1), dot - 1), F.substring(metric, dot + 1, F.length(metric))
    whole = F.map_contains_key(scores, metric)
    outer = dotted & F.map_contains_key(scores, F.when(dotted, base).otherwise(metric))
    inner = F.coalesce(F.map_contains_key(F.try_element_at(details, base), leaf), F.lit(False))
    value = F.when(whole, F.try_element_at(scores, metric)).when(outer & inner, F.try_element_at(F.try_element_at(details, base), leaf))
    return value, F.when(whole | (outer & inner), F.lit(None).cast("string")).when(outer, F.lit("metric detail")).otherwise(F.lit("metric"))


def by_candidate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate with maps of its scores and details; the first of equal names counts."""
    one = rows.groupBy(*keys, "name").agg(F.min_by(F.struct("score", "details"), "pos").alias("m")) if "pos" in rows.columns else rows.groupBy(*keys, "name").agg(F.first(F.struct("score", "details")).alias("m"))
    entries = lambda f: F.map_from_entries(F.collect_list(F.struct("name", F.col(f"m.{f}").alias("v"))))
    return one.groupBy(*keys).agg(entries("score").alias("scores"), entries("details").alias("all_details"))


def evaluate(rows: DataFrame, keys: list[str], rules: list[Rule | str], baseline: str | None = None, label: str = "label") -> DataFrame:
    """One row per candidate and rule: rule_index, metric, operator, score, baseline_score, threshold, passed, message.

    ``rows``: keys (with ``label`` among them), name, score, details. Missing metrics and details fail their rules.
    Baseline rules need the label of the baseline, whose values are those of the same keys without the label.
    """
    parsed = [parse_rule(r) if isinstance(r, str) else r for r in rules]
    if any(r.relative for r in parsed) and baseline is None:
        raise UnsupportedInput("baseline-relative rules need a baseline candidate")
    held = by_candidate(rows, keys)
    others = [k for k in keys if k != label]
    if baseline is not None:
        base = held.where(F.col(label) == baseline).select(*others, F.col("scores").alias("base_scores"), F.col("all_details").alias("base_details"))
        held = held.join(base, others, "left") if others else held.crossJoin(F.broadcast(base))  # without suite keys the baseline is one row
    else:
        held = held.withColumn("base_scores", F.col("scores")).withColumn("base_details", F.col("all_details"))
    literal = F.array(*(F.struct(F.lit(r.metric).alias("metric"), F.lit(r.operator).alias("operator"), F.lit(r.threshold).cast("double").alias("fixed"), F.lit(r.scale).cast("double").alias("scale"), F.lit(r.offset).cast("double").alias("offset")) for r in parsed))
    each = held.select(*keys, "scores", "all_details", "base_scores", "base_details", F.posexplode(literal).alias("rule_index", "rule"))
    metric, operator = F.col("rule.metric"), F.col("rule.operator")
    score, missing = _lookup(F.col("scores"), F.col("all_details"), metric)
    relative = F.col("rule.fixed").isNull()
    base_score, base_missing = _lookup(F.col("base_scores"), F.col("base_details"), metric)
    each = each.withColumn("score", score).withColumn("baseline_score", F.when(relative, base_score))
    gone = F.when(missing.isNotNull(), F.concat(F.when(relative, F.lit("candidate ")).otherwise(F.lit("")), missing)).when(relative & base_missing.isNotNull(), F.concat(F.lit("baseline "), base_missing))
    each = each.withColumn("gone", gone).withColumn("threshold", F.when(F.col("gone").isNull(), F.coalesce(F.col("rule.fixed"), F.col("baseline_score") * F.col("rule.scale") + F.col("rule.offset"))))
    each = each.withColumn("passed", F.col("gone").isNull() & holds(operator, F.col("score"), F.col("threshold")))
    verb = F.when(F.col("passed"), F.lit(" satisfies ")).otherwise(F.lit(" violates "))
    tail = F.when(relative, F.concat(F.lit(" (baseline="), F.col("baseline_score").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    text = F.when(F.col("gone").isNotNull(), F.concat(F.col("gone"), F.lit(" `"), metric, F.lit("` was not produced"))).otherwise(F.concat(metric, F.lit("="), F.col("score").cast("string"), verb, operator, F.col("threshold").cast("string"), tail))
    return each.select(*keys, "rule_index", metric.alias("metric"), operator.alias("operator"), "score", "baseline_score", "threshold", "passed", text.alias("message"))


def verdicts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, passed, failed checks): a candidate passes if all its checks do."""
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failures"))


def suite_passed(candidates: DataFrame, suite: list[str]) -> DataFrame:
    """A candidate passes if it has no error and its gate passed; a suite if all its candidates pass."""
    ok = F.col("error").isNull() & F.coalesce("passed", F.lit(True))
    return candidates.groupBy(*suite).agg(F.bool_and(ok).alias("passed"))


@dataclass(frozen=True)
class ImageThresholds:
    """Thresholds of single comparisons; None: not asked for. Deltas are in 8-bit codes."""

    metric: str | None = None
    fail_under: float | None = None
    max_selected_channel_delta: float | None = None
    max_alpha_delta: int | None = None
    max_alpha_mismatches: int | None = None
    max_alpha_mismatches_beyond_one_lsb: int | None = None

    def __post_init__(self) -> None:
        for v in (self.fail_under, self.max_selected_channel_delta):
            if v is not None and not math.isfinite(v):
                raise UnsupportedInput("thresholds must be finite")


def image_gate(rows: DataFrame, keys: list[str], thresholds: ImageThresholds, alpha: DataFrame | None = None) -> DataFrame:
    """(keys, name, score, passed, failures) of the chosen metric, the first by default.

    It is chosen by its name or by its domain alone. A NaN score passes ``fail_under``. Alpha thresholds look at
    ``alpha`` (keys, max_delta, mismatch_count, mismatches_beyond_one_lsb) where that is given.
    """
    t, m = thresholds, (thresholds.metric or "").strip()
    chosen = rows.where((F.col("name") == m) | (F.regexp_extract("name", "^[^:]*:(.*)$", 1) == m)) if m else rows
    out = chosen.groupBy(*keys).agg(F.min_by(F.struct("name", "score", "details"), "pos").alias("m"))
    if alpha is not None:
        out = out.join(alpha.select(*keys, "max_delta", "mismatch_count", "mismatches_beyond_one_lsb"), keys, "left")
    get = lambda k: F.try_element_at(F.col("m.details"), F.lit(k))
    delta = F.coalesce(get("max_channel_delta_code"), get("max_channel_delta") * 255.0, F.lit(0.0))
    tests: list[tuple[Column, str]] = []
    if t.fail_under is not None:
        tests.append(((F.col("m.score") < t.fail_under) & ~F.isnan("m.score"), f"score is below {t.fail_under:g}"))
    if t.max_selected_channel_delta is not None:
        tests.append(((delta > t.max_selected_channel_delta) & ~F.isnan(delta), f"channel delta exceeds {t.max_selected_channel_delta:g}"))
    if alpha is not None:
        for column, limit, text in (("max_delta", t.max_alpha_delta, "alpha delta"), ("mismatch_count", t.max_alpha_mismatches, "alpha mismatches"), ("mismatches_beyond_one_lsb", t.max_alpha_mismatches_beyond_one_lsb, "alpha mismatches beyond one code")):
            if limit is not None:
                tests.append((F.col(column) > limit, f"{text} exceeds {limit}"))
    failures = F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in tests))) if tests else F.array().cast("array<string>")
    return out.select(*keys, F.col("m.name").alias("name"), F.col("m.score").alias("score"), failures.alias("failures")).withColumn("passed", F.size("failures") == 0)


def report(rows: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """One gate report per candidate: passed, its metrics and its checks in order."""
    m = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "score", "unit", "direction"))).alias("metrics"))
    c = checks.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.array_sort(F.collect_list(F.struct("rule_index", "metric", "operator", "score", "threshold", "passed", "message"))).alias("checks"))
    return m.join(c, keys, "left").withColumn("passed", F.coalesce("passed", F.lit(True)))
