"""Statistics as text: aligned tables, CSV, JSON; trees; CI annotations."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row

#: Fixed: what each statistic's CSV holds, as (heading, column, format of the value); the public contract.
CSV: dict[str, tuple[tuple[str, str, str], ...]] = {
    "contributors": (("name", "name", ""), ("email", "email", ""), ("commits", "commits", ""), ("additions", "additions", ""), ("deletions", "deletions", "")),
    "hotspots": (("path", "path", ""), ("commits", "commits", ""), ("churn", "churn", ""), ("unique_devs", "unique_devs", "")),
    "directories": (("directory", "dir", ""), ("file_touches", "file_touches", ""), ("churn", "churn", ""), ("files", "files", ""), ("devs", "unique_devs", ""), ("bus_factor", "bus_factor", "")),
    "extensions": (("ext", "ext", ""), ("files", "files", ""), ("churn", "churn", ""), ("recent_churn", "recent_churn", ".1f"), ("unique_devs", "unique_devs", ""), ("first_seen", "first_seen", ""), ("last_seen", "last_seen", "")),
    "activity": (("period", "period", ""), ("commits", "commits", ""), ("additions", "additions", ""), ("deletions", "deletions", "")),
    "busfactor": (("path", "path", ""), ("bus_factor", "bus_factor", ""), ("top_devs", "top_devs", ";")),
    "coupling": (("file_a", "file_a", ""), ("file_b", "file_b", ""), ("co_changes", "co_changes", ""), ("coupling_pct", "coupling_pct", ".0f"), ("changes_a", "changes_a", ""), ("changes_b", "changes_b", "")),
    "churn-risk": (
        ("path", "path", ""), ("label", "label", ""), ("recent_churn", "recent_churn", ".1f"), ("bus_factor", "bus_factor", ""), ("age_days", "age_days", ""), ("age_percentile", "age_percentile", ""),
        ("trend", "trend", ".2f"), ("trend_percentile", "trend_percentile", ""), ("total_changes", "total_changes", ""), ("first_change", "first_change", ""), ("last_change", "last_change", ""),
    ),
    "working-patterns": (("day", "day", ""), ("hour", "hour", ""), ("commits", "commits", "")),
    "dev-network": (("dev_a", "dev_a", ""), ("dev_b", "dev_b", ""), ("shared_files", "shared_files", ""), ("shared_lines", "shared_lines", ""), ("weight_pct", "weight", ".1f")),
    "top-commits": (
        ("sha", "sha", "12"), ("author", "author", ""), ("email", "email", ""), ("date", "date", ""), ("additions", "additions", ""), ("deletions", "deletions", ""), ("lines_changed", "lines_changed", ""),
        ("files_changed", "files_changed", ""), ("message", "message", ""),
    ),
    "profile": (
        ("name", "name", ""), ("email", "email", ""), ("commits", "commits", ""), ("lines_changed", "lines_changed", ""), ("files_touched", "files_touched", ""), ("active_days", "active_days", ""),
        ("weekend_pct", "weekend_pct", ".1f"), ("first_date", "first_date", ""), ("last_date", "last_date", ""),
    ),
    "structure": (("path", "path", ""), ("type", "is_dir", "dir"), ("depth", "depth", ""), ("commits", "commits", ""), ("churn", "churn", ""), ("files", "files", ""), ("truncated", "truncated", "")),
}
#: Fixed: JSON keys that are not the column's words put together.
JSON_KEYS = {"sha": "SHA", "first_commit": "FirstCommitDate", "last_commit": "LastCommitDate", "first_change": "FirstChangeDate", "last_change": "LastChangeDate", "author": "AuthorName"}
JSON_BY_STAT = {("top-commits", "email"): "AuthorEmail", ("profile", "partner"): "Email", ("profile", "lines"): "Churn"}
#: Rows of an unlimited result that a text form takes to the driver; beyond it, write with Spark.
TEXT_ROWS = 1_000_000


def humanize(n: int) -> str:
    """1234 -> 1.2k, and so on for M and B."""
    for size, unit in ((10**9, "B"), (10**6, "M"), (10**3, "k")):
        if abs(n) >= size:
            return f"{n / size:.1f}".removesuffix(".0") + unit
    return str(n)


def thousands(n: int) -> str:
    return f"{n:,}"


def joined_devs(devs: list[str]) -> str:
    return ", ".join(devs[:3]) + (f" +{len(devs) - 3}" if len(devs) > 3 else "")


def shell_quoted(text: str) -> str:
    return "'" + text.replace("'", "'\\''") + "'"


def percentile_label(row: Row) -> str:
    """The label, with percentiles where there are enough files for them."""
    if row["age_percentile"] is None or row["trend_percentile"] is None:
        return row["label"]
    return f"{row['label']} (age P{row['age_percentile']}, trend P{row['trend_percentile']})"


def cell(value: Any, form: str = "") -> str:
    if form == "dir":
        return "dir" if value else "file"
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if form == ";":
        return ";".join(value)
    if form == "12":
        return value[:12]
    return format(value, form) if form else str(value)


def collected(df: DataFrame) -> list[Row]:
    rows = df.limit(TEXT_ROWS + 1).collect()
    if len(rows) > TEXT_ROWS:
        raise ValueError(f"more than {TEXT_ROWS} rows; write them with Spark, or ask for fewer")
    return rows


def to_csv(headings: list[str], rows: list[list[str]]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(headings)
    writer.writerows(rows)
    return out.getvalue()


def to_table(headings: list[str], rows: list[list[str]]) -> str:
    lines = [[h.upper().replace("_", " ") for h in headings]]
    lines += [["-" * len(h) for h in headings], *rows]
    widths = [max(len(line[i]) for line in lines) for i in range(len(headings))]
    return "".join("  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() + "\n" for line in lines)


def json_key(stat: str, column: str) -> str:
    return JSON_BY_STAT.get((stat, column)) or JSON_KEYS.get(column) or "".join(w.capitalize() for w in column.split("_"))


def to_json(stat: str, value: Any) -> Any:
    """Rows as objects; null percentiles are left out."""
    if isinstance(value, Row):
        return {json_key(stat, k): to_json(stat, v) for k, v in value.asDict().items() if not (v is None and k.endswith("percentile"))}
    return [to_json(stat, v) for v in value] if isinstance(value, list) else value


def summary_lines(row: Row) -> list[list[str]]:
    return [[k, f"{v:.1f}" if isinstance(v, float) else str(v)] for k, v in row.asDict().items()]


def pareto_lines(rows: list[Row]) -> str:
    what = {
        "files_churn": "Files:  {} of {} files concentrate 80% of churn — {}", "devs_commits": "Devs (commits): {} of {} devs produce 80% of commits — {}",
        "devs_churn": "Devs (churn):   {} of {} devs produce 80% of line churn — {}", "dirs_churn": "Dirs:   {} of {} dirs concentrate 80% of churn — {}",
    }
    return "".join(what[r["lens"]].format(r["top"], r["total"], r["label"]) + "\n" for r in rows)


def preorder(rows: list[Row]) -> list[Row]:
    """Tree rows, each directory before what it holds."""
    below: dict[str | None, list[Row]] = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        below.setdefault(r["parent"], []).append(r)
    out, stack = [], list(reversed(below.get(None, [])))
    while stack:
        row = stack.pop()
        out.append(row)
        if row["is_dir"]:
            stack.extend(reversed(below.get(row["path"], [])))
    return out


def tree_text(rows: list[Row]) -> str:
    """Box drawing; directories with files and churn, files with commits and churn."""
    below: dict[str | None, list[Row]] = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        below.setdefault(r["parent"], []).append(r)
    lines: list[str] = []

    def walk(path: str, prefix: str) -> None:
        held = below.get(path, [])
        for i, r in enumerate(held):
            last = i == len(held) - 1
            what = f"{r['name']}/  ({r['files']} files" if r["is_dir"] else f"{r['name']}  ({r['commits']} commits"
            lines.append(f"{prefix}{'└── ' if last else '├── '}{what}, {humanize(r['churn'])} churn)")
            inner = prefix + ("    " if last else "│   ")
            if r["truncated"]:
                lines.append(f"{inner}... (subtree hidden, use --tree-depth to expand)")
            elif r["is_dir"]:
                walk(r["path"], inner)

    for root in below.get(None, []):
        lines.append(root["name"])
        walk(root["path"], "")
    return "".join(f"{line}\n" for line in lines)


def tree_json(rows: list[Row]) -> dict[str, Any] | None:
    nodes: dict[tuple[str, bool], dict[str, Any]] = {}
    root = None
    for r in preorder(rows):
        node = {"Name": r["name"], "Path": r["path"], "IsDir": r["is_dir"], "Commits": r["commits"], "Churn": r["churn"], "Files": r["files"], "Children": [], "Depth": r["depth"], "Truncated": r["truncated"], "HiddenChildren": r["hidden_children"]}
        nodes[(r["path"], r["is_dir"])] = node
        if r["parent"] is None:
            root = node
        else:
            nodes[(r["parent"], True)]["Children"].append(node)
    return root


def statistic(stat: str, df: DataFrame, form: str) -> str:
    """A statistic as text in the form table, csv or json."""
    rows = collected(df)
    if form == "json":
        if stat == "summary":
            return json.dumps(to_json(stat, rows[0]), indent=2, ensure_ascii=False) + "\n"
        value = tree_json(rows) if stat == "structure" else to_json(stat, rows)
        return json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    if stat == "summary":
        lines = summary_lines(rows[0])
        return to_csv(["metric", "value"], lines) if form == "csv" else to_table(["metric", "value"], lines)
    if stat == "pareto":
        return pareto_lines(rows)
    if stat == "structure":
        if form == "table":
            return tree_text(rows)
        rows = [Row(**{**r.asDict(), "path": r["path"] or r["name"]}) for r in preorder(rows)]
    columns = CSV[stat]
    cells = [[cell(r[c], f) for _, c, f in columns] for r in rows]
    if form == "table" and stat == "busfactor":
        cells = [[r["path"], str(r["bus_factor"]), joined_devs(r["top_devs"])] for r in rows]
    headings = [h for h, _, _ in columns]
    return to_csv(headings, cells) if form == "csv" else to_table(headings, cells)


def annotations(violations: list[Row], form: str) -> str:
    """CI output: text, github-actions, gitlab or json."""
    if form == "github-actions":
        return "".join(f"::{v['level']} file={v['file']}::{v['message']}\n" for v in violations)
    if form == "gitlab":
        issues = [{"description": f"[{v['rule']}] {v['message']}", "severity": "minor", "location": {"path": v["file"]}} for v in violations]
        return json.dumps(issues, indent=2, ensure_ascii=False) + "\n"
    if form == "json":
        found = [{k: v[k] for k in ("file", "rule", "message", "level")} for v in violations] or None
        return json.dumps(found, indent=2, ensure_ascii=False) + "\n"
    return "".join(f"[{v['level']}] {v['file']}: {v['message']}\n" for v in violations)


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A result of any size, by the executors: parquet, csv or json files in a folder."""
    writer: Callable = df.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
