"""Reports: metric rows as CSV or JSON, suite rows, Parquet report tables, small YAML, TOML, text and SQLite reports."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of metric rows and suite rows in reports.
METRIC_COLUMNS = ("report_kind", "reference", "distorted", "width", "height", "scope", "frame_index", "pts_seconds", "pair_index", "reference_frame_index", "distorted_frame_index", "metric", "score", "unit", "direction", "details_json")
SUITE_COLUMNS = ("reference", "candidate", "candidate_passed", "overall_rank", "mean_rank", "pareto_optimal", "error", "gate_json", "baseline_gate_json", "metric", "score", "unit", "direction", "metric_rank", "baseline_delta", "details_json")
REPORT_TABLES = ("reports", "metrics", "probe_reports", "formats", "image_stats")


def number_text(c: Column) -> Column:
    """A double as text: Infinity, -Infinity and NaN by name."""
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(c.cast("string"))


def details_json(details: Column) -> Column:
    """The map with sorted keys as JSON; what is not finite becomes a string."""
    entries = F.transform(F.array_sort(F.map_entries(details)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    odd = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    part = lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), F.when(odd(e["v"]), F.concat(F.lit('"'), number_text(e["v"]), F.lit('"'))).otherwise(number_text(e["v"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, part), ","), F.lit("}"))


def metric_csv_rows(rows: DataFrame, kind: str = "image", scope: str = "image") -> DataFrame:
    """Metric rows in the columns of the reports; what a row lacks is null."""
    have = set(rows.columns)
    made = {"report_kind": F.lit(kind), "scope": F.col("scope") if "scope" in have else F.lit(scope), "metric": F.col("name"), "details_json": details_json(F.col("details"))}
    return rows.select(*((made[c] if c in made else F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in METRIC_COLUMNS))


def suite_csv_rows(candidates: DataFrame, metrics: DataFrame, suite: list[str]) -> DataFrame:
    """A row per candidate and metric; a failed candidate keeps one row without a metric."""
    m = metrics.select(*suite, F.col("label"), F.col("name").alias("metric"), "score", "unit", "direction", F.col("rank").alias("metric_rank") if "rank" in metrics.columns else F.lit(None).cast("int").alias("metric_rank"), F.col("delta").alias("baseline_delta") if "delta" in metrics.columns else F.lit(None).cast("double").alias("baseline_delta"), details_json(F.col("details")).alias("details_json"))
    joined = candidates.join(m, [*suite, "label"], "left").withColumn("candidate", F.col("label"))
    have = set(joined.columns)
    return joined.select(*((F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in SUITE_COLUMNS))


def write_csv(rows: DataFrame, path: str) -> None:
    text = [number_text(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in rows.dtypes]
    rows.select(*text).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def append_report(tables: dict[str, DataFrame], path: str) -> None:
    """Append to the report tables as Parquet; the reports table goes last, so that it names complete reports only."""
    for name in sorted(tables, key=lambda n: n == "reports"):
        if name not in REPORT_TABLES:
            raise ValueError(f"unknown report table {name!r}")
        tables[name].write.mode("append").parquet(f"{path}/{name}")


def plain(value: Any) -> Any:
    """Values for small text reports: numbers that are not finite become their names."""
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def to_yaml(value: Any, indent: int = 0) -> str:
    """A small report as YAML."""
    pad, value = "  " * indent, plain(value)
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{k}:" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v).strip()}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v).strip()}\n") for v in value)
    return f"{pad}{json.dumps(value)}\n"


def to_toml(value: dict[str, Any], prefix: str = "") -> str:
    """A small report as TOML: scalars first, then tables and arrays of tables; nulls are left out."""
    value = plain(value)
    lines = [f"{json.dumps(k)} = {json.dumps(v)}\n" for k, v in value.items() if not isinstance(v, dict) and v is not None and not (isinstance(v, list) and v and isinstance(v[0], dict))]
    for k, v in value.items():
        name = f"{prefix}{json.dumps(k)}"
        if isinstance(v, dict):
            lines.append(f"\n[{name}]\n{to_toml(v, name + '.')}")
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            lines += [f"\n[[{name}]]\n{to_toml(x, name + '.')}" for x in v]
    return "".join(lines)


# The tables of a local report file.
SQLITE_TABLES = {
    "reports": "id INTEGER PRIMARY KEY AUTOINCREMENT, kind TEXT NOT NULL, reference TEXT, distorted TEXT, width INTEGER, height INTEGER, compared_frames INTEGER, payload_json TEXT NOT NULL, created_at TEXT NOT NULL DEFAULT CURRENT_TIMESTAMP",
    "metrics": "id INTEGER PRIMARY KEY AUTOINCREMENT, report_id INTEGER NOT NULL REFERENCES reports(id) ON DELETE CASCADE, scope TEXT NOT NULL, frame_index INTEGER, pts_seconds REAL, name TEXT NOT NULL, score REAL NOT NULL, unit TEXT NOT NULL, direction TEXT NOT NULL, details_json TEXT NOT NULL",
    "probe_reports": "id INTEGER PRIMARY KEY AUTOINCREMENT, input TEXT NOT NULL, width INTEGER NOT NULL, height INTEGER NOT NULL, avg_frame_rate REAL, nb_frames INTEGER, codec_name TEXT, duration_seconds REAL, payload_json TEXT NOT NULL, created_at TEXT NOT NULL DEFAULT CURRENT_TIMESTAMP",
    "formats": "format TEXT PRIMARY KEY",
    "image_stats": "id INTEGER PRIMARY KEY AUTOINCREMENT, input TEXT NOT NULL, width INTEGER NOT NULL, height INTEGER NOT NULL, pixels INTEGER NOT NULL, exposure TEXT NOT NULL, contrast TEXT NOT NULL, saturation TEXT NOT NULL, temperature TEXT NOT NULL, tint TEXT NOT NULL, dominant_channel TEXT NOT NULL, payload_json TEXT NOT NULL, created_at TEXT NOT NULL DEFAULT CURRENT_TIMESTAMP",
}


def write_sqlite(path: str, tables: dict[str, list[dict[str, Any]]]) -> int:
    """Append small rows to the tables of a local SQLite file in one transaction; returns the id of the last report.

    Metrics without a report_id belong to the report written with them. Numbers that are not finite are stored by name.
    """
    import sqlite3
    from contextlib import closing

    def value(v: Any) -> Any:
        return json.dumps(plain(v)) if isinstance(v, (dict, list)) else plain(v)

    report = 0
    with closing(sqlite3.connect(path)) as db, db:
        db.execute("PRAGMA foreign_keys = ON")
        for name, columns in SQLITE_TABLES.items():
            db.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
        for name in SQLITE_TABLES:
            for row in tables.get(name, []):
                row = {"report_id": report, **row} if name == "metrics" else row
                found = db.execute(f"INSERT {'OR IGNORE ' if name == 'formats' else ''}INTO {name} ({', '.join(row)}) VALUES ({', '.join('?' * len(row))})", [value(v) for v in row.values()])
                report = int(found.lastrowid or 0) if name == "reports" else report
    return report


def append_sqlite(path: str, report: dict[str, Any], metrics: list[dict[str, Any]]) -> int:
    """One small report and its metric rows in one transaction of a local SQLite file; returns the report's id."""
    columns = ("kind", "reference", "distorted", "width", "height", "compared_frames")
    rows = [{"scope": m.get("scope", "image"), "frame_index": m.get("frame_index"), "pts_seconds": m.get("pts_seconds"), **{c: m[c] for c in ("name", "score", "unit", "direction")}, "details_json": m.get("details") or {}} for m in metrics]
    return write_sqlite(path, {"reports": [{**{c: report.get(c) for c in columns}, "payload_json": report}], "metrics": rows})


def append_probes_sqlite(path: str, probes: list[dict[str, Any]]) -> None:
    """Rows of :func:`fidelis.sources.probe.streams`."""
    columns = {"input": "input", "width": "width", "height": "height", "avg_frame_rate": "avg_rate", "nb_frames": "nb_frames", "codec_name": "codec_name", "duration_seconds": "duration_seconds"}
    write_sqlite(path, {"probe_reports": [{**{k: p.get(v) for k, v in columns.items()}, "payload_json": p} for p in probes]})


def append_stats_sqlite(path: str, profiles: list[dict[str, Any]]) -> None:
    """Image profiles, each with its input."""
    kinds = ("exposure", "contrast", "saturation", "temperature", "tint")
    write_sqlite(path, {"image_stats": [{**{k: p[k] for k in ("input", "width", "height", "pixels")}, **{k: p["tendencies"][k] for k in kinds}, "dominant_channel": p["color_balance"]["dominant_channel"], "payload_json": p} for p in profiles]})


def to_text(value: Any) -> str:
    """A small report for readers: rows as a table, other values as lines of name and value, nested ones indented."""
    value = plain(value)
    show = lambda v: "-" if v is None else f"{v:.6g}" if isinstance(v, float) else ("yes" if v else "no") if isinstance(v, bool) else json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else str(v)
    if isinstance(value, list) and value and all(isinstance(r, dict) for r in value):
        names = list(dict.fromkeys(k for r in value for k in r))
        rows = [names, *([show(r.get(k)) for k in names] for r in value)]
        widths = [max(len(r[i]) for r in rows) for i in range(len(names))]
        return "".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in rows)
    if isinstance(value, dict):
        out = ""
        for k, v in value.items():
            if isinstance(v, (dict, list)) and v:
                out += f"{k}:\n" + "".join(f"  {line}\n" for line in to_text(v).splitlines())
            else:
                out += f"{k}: {show(v)}\n"
        return out
    return "".join(f"{show(v)}\n" for v in value) if isinstance(value, list) else f"{show(value)}\n"


def stats_rows(profiles: DataFrame) -> DataFrame:
    """(input, width, height, pixels, metric, value): the leaves of image profiles (input, profile JSON) as rows."""
    from collections.abc import Iterator

    import pandas as pd

    def leaves(value: Any, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif value is not None:
            yield path, value if isinstance(value, str) else json.dumps(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["input"], pdf["profile"], strict=True):
                p = json.loads(text)
                head = (name, p.pop("width"), p.pop("height"), p.pop("pixels"))
                rows += [(*head, k, v) for k, v in leaves(p, "")]
            yield pd.DataFrame(rows, columns=["input", "width", "height", "pixels", "metric", "value"])

    return profiles.where("profile is not null").select("input", "profile").mapInPandas(run, "input string, width int, height int, pixels long, metric string, value string")
