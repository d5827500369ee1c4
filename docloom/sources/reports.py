"""Results of runs as CSV and as a report for people."""

from __future__ import annotations

import csv
import os
import statistics
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.metrics import extremes


def flattened(results: DataFrame, stages: list[str], resources: list[str]) -> DataFrame:
    """One flat row a result: maps ``stages`` and structs of resource statistics as columns, to three decimals."""
    parts = [F.bround(F.try_element_at("stages", F.lit(s)), 3).alias(f"stage_{s}_s") for s in stages]
    parts += [F.bround(F.col(r)[q], 3).alias(f"{r}_{short}") for r in resources for q, short in (("min", "min"), ("median", "med"), ("p95", "p95"), ("max", "max"))]
    gone = {"stages", *resources}
    return results.select(*[c for c in results.columns if c not in gone], *parts)


def write_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


class SweepLog:
    """The CSV file of a sweep that is still running, on the driver: written anew after each run, whole or not at
    all, so that what is done outlives a crash.  A sweep has as many rows as its grid has values."""

    def __init__(self, path: str) -> None:
        self.path, self.rows = path, []

    def add(self, row: dict[str, Any]) -> None:
        """Adds a flat row; the first one's keys are the columns, and another key is an error."""
        if self.rows and (unknown := sorted(set(row) - set(self.rows[0]))):
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        self.rows.append(dict(row))
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        part = f"{self.path}.{uuid.uuid4().hex}"
        with open(part, "w", newline="", encoding="utf-8") as f:
            out = csv.DictWriter(f, fieldnames=list(self.rows[0]), restval="")
            out.writeheader()
            out.writerows(self.rows)
        os.replace(part, self.path)


def shown(value: Column) -> Column:
    """Two decimals, half to even; a zero as '--'."""
    text = F.format_string("%.2f", F.bround(value, 2))
    return F.when(text == "0.00", "--").otherwise(text)


def scaled(df: DataFrame, columns: list[str], scale: float) -> DataFrame:
    """The columns times ``scale``; missing ones are an error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.col(c) * scale for c in columns})


def markdown(results: DataFrame, *, key: str = "benchmark", value: str = "wall_s", name: str = "value", most: int = 1000) -> str:
    """A table of each sweep's fastest and slowest run and the failures; at most ``most`` sweeps of each, which the
    driver prints, the first by key, and how many are left out."""
    numbered = results.where("status = 'ok'")
    found = extremes(numbered, key=key, value=value, order="ord")
    chosen = found.orderBy(key).limit(most)
    rows = chosen.collect()
    names = {r["ord"]: r[name] for r in numbered.select("ord", name).join(F.broadcast(chosen.select(F.explode(F.array("fastest", "slowest")).alias("ord")).distinct()), "ord").collect()}
    lines = ["| sweep | fastest | s | slowest | s | spread |", "|---|---|---|---|---|---|"]
    lines += [f"| {r[key]} | {names[r['fastest']]} | {r['fastest_value']:.2f} | {names[r['slowest']]} | {r['slowest_value']:.2f} | {r['spread']:.2f} |" for r in rows]
    if len(rows) == most and (left := found.count() - most):
        lines += ["", f"Left out: {left} more sweeps"]
    failures = results.where("status IS NULL OR status <> 'ok'").groupBy(key).count()
    failed = failures.orderBy(key).limit(most).collect()
    if failed:
        left = failures.count() - most if len(failed) == most else 0
        lines += ["", "Failed: " + ", ".join(f"{r[key]} ({r['count']})" for r in failed) + (f" and {left} more" if left else "")]
    return "\n".join(lines)


def _grid(head: Sequence[str], rows: Sequence[Sequence[str]]) -> list[str]:
    lines = ["| " + " | ".join(r) + " |" for r in (head, *rows)]
    return [lines[0], "|" + "---|" * len(head), *lines[1:], ""]


def sweep_page(
    rows: Sequence[dict[str, Any]],
    *,
    name: str,
    knob: str,
    pdf: str,
    description: str = "",
    stages: Sequence[str] = ("render", "layout", "blocks", "table", "formula", "reference", "bundle"),
    resources: dict[str, str] | None = None,
    quality: Sequence[str] = ("blocks_total", "text_chars", "miss"),
) -> str:
    """A sweep's page, from flat rows (dicts as :func:`flattened` names them) in the order of the sweep.

    Times, resources and quality by value, failures with the first 200 characters of what they say, and from two
    good runs on the spread, from three on a note on wall times.  Missing stages and zeros are '--'; the quality
    table needs a good run that has any of its columns.
    """
    resources = {"cpu_pct": "CPU%", "rss_mb": "RSS MiB", "vram_mb": "VRAM MiB"} if resources is None else resources
    good = [r for r in rows if r["status"] == "ok"]
    walls = [r["wall_s"] for r in good]
    out = [f"# {name}", "", description, "", f"- **Knob:** `{knob}`", f"- **PDF:** `{pdf}`", f"- **Runs:** {len(rows)} ({len(good)} ok, {len(rows) - len(good)} failed)"]
    if len(good) > 1:
        ends = [(text, choose(good, key=lambda r: r["wall_s"])) for text, choose in (("Fastest", min), ("Slowest", max))]
        told = [f"**{text}:** `{r['value']}` @ {r['wall_s']:.2f}s" for text, r in ends]
        out.append(f"- {' -- '.join(told)} (**{max(walls) / max(min(walls), 1e-9):.2f}x** spread)")

    def number(x: float | None) -> str:
        return f"{x:.2f}" if x else "--"

    def resource(row: dict[str, Any], of: str) -> str:
        found = [row.get(f"{of}_{q}") for q in ("min", "med", "p95", "max")]
        return "--" if None in found or "" in found else " / ".join(f"{x:.0f}" for x in found)

    out += ["", "## Speed", "", *_grid(["value", "status", "wall (s)", *(f"{s} (s)" for s in stages)], [[str(r["value"]), r["status"], f"{r['wall_s']:.2f}", *(number(r.get(f"stage_{s}_s")) for s in stages)] for r in rows])]
    out += ["## Resources (min / median / p95 / max)", "", *_grid(["value", *(f"{x} (min/med/p95/max)" for x in resources.values())], [[str(r["value"]), *(resource(r, x) for x in resources)] for r in rows])]
    if any(r.get(f"quality_{q}") is not None for r in good for q in quality):
        cells = [[str(r["value"]), *("" if r.get(f"quality_{q}") is None else str(r[f"quality_{q}"]) for q in quality)] for r in rows]
        out += ["## Quality", "", *_grid(["value", *quality], cells)]
    if bad := [f"- `{r['value']}` -- **{r['status']}** -- `{(r.get('error') or '')[:200]}`" for r in rows if r["status"] != "ok"]:
        out += ["## Failures", "", *bad, ""]
    if len(good) > 2:
        out += ["## Notes", "", f"- Wall time across {len(good)} successful runs: min={min(walls):.2f}s, median={statistics.median(walls):.2f}s, max={max(walls):.2f}s.", ""]
    return "\n".join(out)
