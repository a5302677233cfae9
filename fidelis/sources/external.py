"""Metrics from external programs, opt-in: a command per pair on the executors, its first finite number is the score."""

from __future__ import annotations

import math
import re
import subprocess
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import UnsupportedInput


def first_float(text: str) -> float:
    """The first token of digits, signs, points and exponents that is a finite number."""
    for token in re.findall(r"[0-9+\-.eE]+", text):
        try:
            value = float(token)
        except ValueError:
            continue
        if math.isfinite(value):
            return value
    raise UnsupportedInput("no finite number in the output")


def first_float_column(text: Column) -> Column:
    """The same as a column; null where there is none."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9+\-.eE]+)"), F.lit(1)), lambda t: t.try_cast("double"))
    return F.try_element_at(F.filter(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(1))


def run_external(pairs: DataFrame, command: list[str], name: str, unit: str = "unitless", direction: str = "higher", parse: bool = True, timeout: float = 600.0) -> DataFrame:
    """Run ``command`` for each pair (reference, distorted paths); {reference} and {distorted} are replaced in it."""
    keep = [c for c in pairs.columns if c not in ("reference", "distorted")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[dict[str, Any]] = []
            for r in pdf.to_dict("records"):
                args = [a.replace("{reference}", r["reference"]).replace("{distorted}", r["distorted"]) for a in command]
                score, error = None, None
                try:
                    done = subprocess.run(args, capture_output=True, text=True, timeout=timeout, check=False)
                except (subprocess.TimeoutExpired, OSError) as e:
                    done, error = None, str(e)
                if done is None:
                    pass
                elif done.returncode:
                    error = f"status {done.returncode}: {done.stderr[:1000]}"
                elif parse:
                    try:
                        score = first_float(done.stdout)
                    except UnsupportedInput as e:
                        error = str(e)
                rows.append({**{k: r[k] for k in keep}, "name": name, "score": score, "unit": unit, "direction": direction, "stdout": done and done.stdout, "error": error})
            yield pd.DataFrame(rows, columns=[*keep, "name", "score", "unit", "direction", "stdout", "error"])

    types = dict(pairs.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keep), "name string, score double, unit string, direction string, stdout string, error string"])
    return pairs.mapInPandas(run, schema)
