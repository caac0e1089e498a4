"""HTML pages: a team report, a developer's page, an index over repositories."""

from __future__ import annotations

import datetime as dt
from html import escape
from typing import Any

from pyspark.sql import Row

from chronolith.operators import ownership, pairs, profiles, ranking, risk, structure
from chronolith.plans.history import History
from chronolith.schema import TREE_CHILDREN, TREE_DEPTH, Limits
from chronolith.sinks.render import collected, humanize, percentile_label, thousands, tree_text

STYLE = """body{font:14px system-ui,sans-serif;margin:2em auto;max-width:72em;color:#1f2328}h2{border-bottom:1px solid #d8dee4;padding-bottom:.2em}
table{border-collapse:collapse;width:100%}td,th{padding:.25em .6em;text-align:left;border-bottom:1px solid #eaeef2}td.n{text-align:right;font-variant-numeric:tabular-nums}
.heat td{width:2em;height:1.4em;text-align:center;font-size:11px}.chip{display:inline-block;border:1px solid #d0d7de;border-radius:1em;padding:.1em .7em;margin-right:.5em}pre{font-size:12px}"""


def page(title: str, sections: list[tuple[str, str]]) -> str:
    body = "".join(f"<section><h2>{escape(h)}</h2>{b}</section>" for h, b in sections)
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def _cell(value: Any) -> str:
    if isinstance(value, bool) or value is None:
        return f"<td>{'' if value is None else str(value).lower()}</td>"
    if isinstance(value, int):
        return f'<td class="n">{thousands(value)}</td>'
    if isinstance(value, float):
        return f'<td class="n">{value:,.2f}</td>'
    return f"<td>{escape(', '.join(map(str, value)) if isinstance(value, list) else str(value))}</td>"


def table(rows: list[Row], columns: list[str], total: int | None = None) -> str:
    if not rows:
        return "<p>No data.</p>"
    note = f"<p>{thousands(len(rows))} of {thousands(total)}</p>" if total and total > len(rows) else ""
    head = "".join(f"<th>{escape(c.replace('_', ' '))}</th>" for c in columns)
    return note + f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(_cell(r[c]) for c in columns) + "</tr>" for r in rows) + "</table>"


def heat(cells: dict[tuple[Any, Any], int], rows: list[Any], columns: list[Any], names: list[str]) -> str:
    """A grid whose cells are darker the nearer they are to the largest."""
    most = max(cells.values(), default=0) or 1
    out = "<tr><th></th>" + "".join(f"<th>{escape(str(c))}</th>" for c in columns) + "</tr>"
    for r, name in zip(rows, names, strict=True):
        out += f"<tr><th>{escape(name)}</th>" + "".join(f'<td style="background:rgba(9,105,218,{cells.get((r, c), 0) / most:.2f})">{cells.get((r, c)) or ""}</td>' for c in columns) + "</tr>"
    return f'<table class="heat">{out}</table>'


def team_report(h: History, title: str, n: int = 20, limits: Limits = Limits()) -> str:
    """All statistics of a history on one page; lists hold n rows."""
    total = ranking.summary(h).first()
    days = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    months = [f"{m:02d}" for m in range(1, 13)]
    activity = {(r["period"][:4], r["period"][5:7]): r["commits"] for r in collected(ranking.activity(h, "month"))}
    years = sorted({y for y, _ in activity})
    hours = {(r["day"], r["hour"]): r["commits"] for r in collected(ranking.working_patterns(h))}
    risky = collected(risk.churn_risk(h, n))
    chips = "".join(f'<span class="chip">{escape(r["label"])}: {thousands(r["files"])}</span>' for r in risk.label_counts(h).collect())
    risky = [Row(**{**r.asDict(), "label": percentile_label(r)}) for r in risky]
    people = collected(profiles.profiles(h, n=n))
    return page(title, [
        ("Summary", table([total], list(total.asDict()))),
        ("Concentration", table(ownership.pareto(h).collect(), ["lens", "top", "total", "pct", "label"])),
        ("Activity", heat(activity, years, months, years)),
        ("Top Contributors", table(collected(ranking.contributors(h, n)), ["name", "email", "commits", "additions", "deletions", "files_touched", "active_days"], total["total_devs"])),
        ("File Hotspots", table(collected(ranking.hotspots(h, n)), ["path", "commits", "churn", "unique_devs"], total["total_files"])),
        ("Directories", table(collected(ranking.directories(h, n)), ["dir", "file_touches", "churn", "files", "unique_devs", "bus_factor"])),
        ("Extensions", table(collected(ranking.extensions(h, n)), ["ext", "files", "churn", "recent_churn", "unique_devs", "first_seen", "last_seen"])),
        ("Churn Risk", chips + table(risky, ["path", "label", "recent_churn", "bus_factor", "age_days", "trend"], total["total_files"])),
        ("Bus Factor Risk", table(collected(ownership.bus_factor(h, n)), ["path", "bus_factor", "top_devs"])),
        ("File Coupling", table(collected(pairs.coupling(h, n, limits)), ["file_a", "file_b", "co_changes", "coupling_pct", "changes_a", "changes_b"])),
        ("Working Patterns", heat(hours, days, list(range(24)), days)),
        ("Top Commits", table(collected(ranking.top_commits(h, n)), ["sha", "author", "date", "lines_changed", "files_changed", "message"], total["total_commits"])),
        ("Developer Network", table(collected(pairs.dev_network(h, n, limits)), ["dev_a", "dev_b", "shared_files", "shared_lines", "weight"])),
        ("Developer Profiles", "".join(_profile(p) for p in people)),
        ("Structure", f"<pre>{escape(tree_text(collected(structure.structure(h, TREE_DEPTH, TREE_CHILDREN))))}</pre>"),
    ])


def _profile(p: Row) -> str:
    facts = f"{thousands(p['commits'])} commits, {humanize(p['lines_changed'])} lines, {p['active_days']} active days, {p['pace']} commits a day, {p['specialist']}, {p['contrib_type']}, weekend {p['weekend_pct']} %"
    lists = []
    for name, key, size in (("Scope", "dir", "files"), ("Extensions", "ext", "files"), ("Collaborators", "partner", "shared_lines")):
        held = p[name.lower()] or []
        more = p[f"{name.lower()}_hidden"]
        lists.append(f"{name}: " + ", ".join(f"{x[key]} ({x[size]})" for x in held) + (f" +{more} more" if more else ""))
    return f"<h3>{escape(p['name'])} &lt;{escape(p['email'])}&gt;</h3><p>{escape(facts)}</p>" + "".join(f"<p>{escape(x)}</p>" for x in lists)


def profile_report(h: History, email: str, title: str) -> str:
    """A developer's page; an unknown email is an error."""
    people = profiles.profiles(h, email).collect()
    if not people:
        raise LookupError(f"no developer with email {email}")
    p = people[0]
    grid = {(x["day"], x["hour"]): x["commits"] for x in p["work_grid"] or []}
    months = {(x["period"][:4], x["period"][5:7]): x["commits"] for x in p["monthly_activity"] or []}
    years = sorted({y for y, _ in months})
    return page(title, [
        (p["name"], _profile(p)),
        ("Per-Repository Breakdown", table(collected(ranking.repo_breakdown(h, email)), ["repo", "commits", "churn", "files", "active_days", "commits_pct", "churn_pct", "first_date", "last_date"])),
        ("Top Files", table(p["top_files"] or [], ["path", "commits", "lines"])),
        ("Top Commits", table(p["top_commits"] or [], ["sha", "date", "lines", "files_changed", "message"])),
        ("Activity", heat(months, years, [f"{m:02d}" for m in range(1, 13)], years)),
        ("Working Hours", heat(grid, list(range(7)), list(range(24)), ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])),
    ])


def ago(day: str, now: dt.date) -> tuple[str, str]:
    """('3d', 'fresh') and so on: how long ago, and fresh (30 days), stable (a year) or stale; empty for no or future days."""
    try:
        days = (now - dt.date.fromisoformat(day)).days
    except ValueError:
        return "", ""
    if days < 0:
        return "", ""
    label = "today" if days == 0 else f"{days}d ago" if days < 30 else f"{min(11, days // 30)}mo ago" if days < 365 else f"{days // 365}y ago"
    return label, "fresh" if days <= 30 else "stable" if days <= 365 else "stale"


def scan_index(entries: list[dict[str, Any]], now: dt.date, total: dict[str, Any] | None = None) -> str:
    """An index of repositories: failed ones first, then those that wait, then by commits. `total` counts over all that are
    ok: commits, devs (each once, whatever the number of repositories), files, churn."""
    entries = [{**e, "status": "pending" if e["status"] == "skipped" else e["status"]} for e in entries]
    order = {"failed": 0, "pending": 1, "ok": 2}
    ranked = sorted(entries, key=lambda e: (order.get(e["status"], 3), -e.get("commits", 0), e["slug"]))
    most = max((e.get("commits", 0) for e in entries), default=0) or 1
    rows = []
    for e in ranked:
        label, bucket = ago(e.get("last_commit", ""), now)
        dates = f"{e.get('first_commit', '')} to {e['last_commit']}" if e.get("last_commit") else ""
        link = f'<a href="{escape(e["slug"])}.html">{escape(e["slug"])}</a>' if e["status"] == "ok" else escape(e["slug"])
        bar = f'<progress max="{most}" value="{e.get("commits", 0)}"></progress>'
        state = f"<td>{escape(e['status'])} {escape(e.get('error', ''))}</td>"
        rows.append(f'<tr title="{escape(e.get("path", ""))}"><td>{link}</td>{state}{_cell(e.get("commits", 0))}<td>{bar}</td>{_cell(e.get("devs", 0))}{_cell(e.get("files", 0))}{_cell(e.get("churn", 0))}<td>{escape(dates)}</td><td>{escape(label)} {escape(bucket)}</td></tr>')
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in ("repository", "status", "commits", "", "devs", "files", "churn", "dates", "last commit")) + "</tr>"
    counts = {s: sum(e["status"] == s for e in entries) for s in ("ok", "failed", "pending")}
    total = total or {}
    cards = "".join(f'<span class="chip">{name}: {thousands(total.get(key, 0))}</span>' for name, key in (("Total commits", "commits"), ("Unique devs", "devs"), ("Files", "files"), ("Churn", "churn")))
    return page("Repositories", [("Overview", f"<p>{len(entries)} repositories: {counts['ok']} ok, {counts['failed']} failed, {counts['pending']} pending</p><p>{cards}</p><table>{head}{''.join(rows)}</table>")])
