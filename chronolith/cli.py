"""Command line: extract, stats, diff, ci, report, scan."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import re
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import compose, fleet, ownership, pairs, profiles, ranking, risk, structure
from chronolith.plans.checkpoints import released
from chronolith.plans.history import History
from chronolith.plans.together import together
from chronolith.schema import Limits, Options
from chronolith.sinks import html, render
from chronolith.sources import discovery, extract, jsonl

#: Statistics in the order in which they are shown; the last two only when asked for by name.
STATS = ("summary", "contributors", "hotspots", "directories", "extensions", "activity", "busfactor", "coupling", "churn-risk", "working-patterns", "dev-network", "pareto", "top-commits", "profile", "structure")
ON_REQUEST = ("profile", "structure")
SHOWN_SUSPECTS = 6


class UsageError(ValueError):
    """Flags that do not go together."""


def file_link(path: str) -> str:
    """A local path as a link that terminals open."""
    return Path(path).absolute().as_uri()


def scan_label(roots: list[str]) -> str:
    """What a page over several scanned folders is about: their names, or how many there are beyond three."""
    names = [Path(r).absolute().name for r in roots]
    if len(names) > 3:
        return f"{len(names)} roots"
    return " + ".join(names) or "scan"


def session() -> SparkSession:
    return SparkSession.builder.appName("chronolith").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()


def since_date(text: str, today: dt.date | None = None) -> str:
    """`7d`, `4w`, `3m` or `1y` before today, as a date. Days that a month lacks run over into the next."""
    found = re.fullmatch(r"([0-9]+)([dwmy])", text)
    if not found or int(found[1]) == 0:
        raise UsageError(f"invalid --since {text!r}; use e.g. 7d, 4w, 3m, 1y")
    today, n = today or dt.date.today(), int(found[1])
    if found[2] in "dw":
        return (today - dt.timedelta(days=n * (7 if found[2] == "w" else 1))).isoformat()
    months = today.year * 12 + today.month - 1 - n * (12 if found[2] == "y" else 1)
    return (dt.date(months // 12, months % 12 + 1, 1) + dt.timedelta(days=today.day - 1)).isoformat()


def checked_date(text: str, flag: str) -> str:
    if text:
        try:
            if len(text) != 10:
                raise ValueError
            dt.date.fromisoformat(text)
        except ValueError:
            raise UsageError(f"invalid {flag} {text!r}; expected YYYY-MM-DD") from None
    return text


def window(args: argparse.Namespace) -> tuple[str | None, str | None]:
    if args.since and (args.start or args.end):
        raise UsageError("--since cannot be combined with --from/--to; pick one window")
    start, end = checked_date(args.start, "--from"), checked_date(args.end, "--to")
    if start and end and start > end:
        raise UsageError(f"--from ({start}) must be on or before --to ({end})")
    return (since_date(args.since) if args.since else start or None), end or None


def computed(h: History, stat: str, args: argparse.Namespace) -> DataFrame:
    n, limits = args.top, Limits(args.coupling_min_changes, args.network_min_files)
    made: dict[str, Callable[[], DataFrame]] = {
        "summary": lambda: ranking.summary(h), "contributors": lambda: ranking.contributors(h, n), "hotspots": lambda: ranking.hotspots(h, n), "directories": lambda: ranking.directories(h, n),
        "extensions": lambda: ranking.extensions(h, n), "activity": lambda: ranking.activity(h, args.granularity), "busfactor": lambda: ownership.bus_factor(h, n), "coupling": lambda: pairs.coupling(h, n, limits),
        "churn-risk": lambda: risk.churn_risk(h, n), "working-patterns": lambda: ranking.working_patterns(h), "dev-network": lambda: pairs.dev_network(h, n, limits), "pareto": lambda: ownership.pareto(h),
        "top-commits": lambda: ranking.top_commits(h, n), "profile": lambda: profiles.profiles(h, args.email or None), "structure": lambda: structure.structure(h, args.tree_depth),
    }
    return made[stat]()


def show(h: History, args: argparse.Namespace) -> None:
    wanted = [args.stat] if args.stat else [s for s in STATS if s not in ON_REQUEST]
    if args.format == "json":
        made = together(h.commits.sparkSession, {s: lambda s=s: json.loads(render.statistic(s, computed(h, s, args), "json")) if s != "pareto" else render.to_json(s, ownership.pareto(h).collect()) for s in wanted})
        print(json.dumps({s.replace("-", "_").replace("profile", "profiles"): x for s, x in made.items()}, indent=2, ensure_ascii=False))
        return
    # text of every statistic is made side by side, then shown in order
    made = together(h.commits.sparkSession, {s: lambda s=s: render.statistic(s, computed(h, s, args), args.format) for s in wanted}, timeout=getattr(args, "timeout", None))
    for stat in wanted:
        if not (stat == "structure" and args.format == "csv"):
            print(f"\n=== {stat} ===", file=sys.stderr)
        print(made[stat], end="")


def warn_of_suspects(h: History) -> None:
    buckets = structure.suspect_counts(h).collect()  # one row for each pattern
    if buckets and buckets[0]["worth_warning"]:
        print("Paths that look vendored or generated hold much of the churn:", file=sys.stderr)
        for b in buckets[:SHOWN_SUSPECTS]:
            print(f"  {b['glob']:<22} {b['files']:>4} files, {b['churn']:>8} churn   ({b['reason']})", file=sys.stderr)
        flags = " ".join(f"--ignore {render.shell_quoted(r['suggestion'])}" for r in structure.all_suggestions(h).collect())
        print(f"  extract again with: {flags}", file=sys.stderr)


def run_stats(args: argparse.Namespace) -> int:
    start, end = window(args)
    h = jsonl.load(session(), args.input, Options(start, end, args.churn_half_life, args.coupling_max_files), staged=True).cache()
    if args.format == "table":
        warn_of_suspects(h)
    show(h, args)
    return 0


def run_diff(args: argparse.Namespace) -> int:
    if not (args.start and args.end):
        raise UsageError("--from and --to are required")
    spark = session()
    a = jsonl.load(spark, args.input[0], Options(checked_date(args.start, "--from"), checked_date(args.end, "--to")))
    if not (args.vs_from and args.vs_to):
        args.stat, args.granularity, args.email, args.tree_depth, args.coupling_min_changes, args.network_min_files = "", "month", "", 3, 5, 5
        show(a, args)
        return 0
    b = jsonl.load(spark, args.input[0], Options(checked_date(args.vs_from, "--vs-from"), checked_date(args.vs_to, "--vs-to")))
    names = {"period_a": (a, f"{args.start} to {args.end}"), "period_b": (b, f"{args.vs_from} to {args.vs_to}")}
    if args.format == "json":
        stat = lambda s, df: json.loads(render.statistic(s, df, "json"))
        print(json.dumps({k: {"label": label, "summary": stat("summary", ranking.summary(h)), "contributors": stat("contributors", ranking.contributors(h, args.top)), "hotspots": stat("hotspots", ranking.hotspots(h, args.top))} for k, (h, label) in names.items()}, indent=2, ensure_ascii=False))
        return 0
    for r in compose.diff(a, b).collect():
        print(f"{r['metric']:<25} {r['period_a']:>8}  ->  {r['period_b']:>8}  ({r['delta']:+d})")
    for stat, made in (("contributors", ranking.contributors), ("hotspots", ranking.hotspots)):
        for h, label in names.values():
            print(f"\n=== {stat}: {label} ===", file=sys.stderr)
            print(render.statistic(stat, made(h, args.top), args.format), end="")
    return 0


def run_ci(args: argparse.Namespace) -> int:
    h = jsonl.load(session(), args.input[0], Options(half_life_days=args.churn_half_life))
    found = render.collected(compose.gates(h, args.fail_on_busfactor, args.fail_on_churn_risk))
    print(render.annotations(found, args.format), end="")
    print(f"{len(found)} violation(s) found" if found else "No violations found", file=sys.stderr)
    return int(bool(found))


def run_report(args: argparse.Namespace) -> int:
    h = jsonl.load(session(), args.input, Options(*window(args), args.churn_half_life, args.coupling_max_files), staged=True).cache()
    text = html.profile_report(h, args.email, args.email) if args.email else html.team_report(h, args.title, args.top, Limits(args.coupling_min_changes, args.network_min_files))
    with open(args.output, "w", encoding="utf-8") as file:
        file.write(text)
    print(f"{f'Profile of {args.email}' if args.email else 'Report'} written to {file_link(args.output)}", file=sys.stderr)
    return 0


def run_extract(args: argparse.Namespace) -> int:
    from chronolith.sources.vcs import default_branch

    done = extract.extract(args.repo, args.output, args.state, ref=args.branch or default_branch(args.repo), ignore=args.ignore, first_parent=args.first_parent, messages=args.messages, mailmap=args.mailmap, sizes=args.sizes, batch=args.batch_size, offset=args.start_offset, sha=args.start_sha)
    print(f"{done} commits", file=sys.stderr)
    return 0


def run_scan(args: argparse.Namespace) -> int:
    matcher = discovery.Matcher.load(args.ignore_file) if args.ignore_file else discovery.Matcher()
    options = Options(*window(args), args.churn_half_life, args.coupling_max_files)
    limits = Limits(args.coupling_min_changes, args.network_min_files)
    manifest = discovery.scan(
        args.root, args.output, matcher, args.max_depth, args.parallel, timeout=args.timeout,
        ignore=args.ignore, batch=args.batch_size, mailmap=args.mailmap, first_parent=args.first_parent, messages=args.messages,
    )
    good = [e for e in manifest.repositories if e.status == "ok"]
    if good and (args.report_dir or args.report or args.email):
        spark = session()
        rows = jsonl.staged_rows(spark, [e.output for e in good], by_input=True)  # every input is parsed once, for index and pages
        wrong = jsonl.faults(rows)
    if good and (args.email or args.report):
        if wrong:
            raise jsonl.MalformedInput(next(iter(wrong.values())))
        h = jsonl.history_of(rows, options, multi=len(good) > 1).cache()
        pages = [(args.report, lambda: html.team_report(h, "All repositories", args.top, limits))] if args.report else []
        pages += [(os.path.join(args.output, "profile.html"), lambda: html.profile_report(h, args.email, f"{args.email}: {scan_label(args.root)}"))] if args.email else []
        for path, page in pages:
            with open(path, "w", encoding="utf-8") as file:
                file.write(page())
            print(f"Page written to {file_link(path)}", file=sys.stderr)
        h.uncache()
    if args.report_dir:
        os.makedirs(args.report_dir, exist_ok=True)
        failed = {good[i].slug: text for i, text in wrong.items()} if good else {}
        if good:
            for i, e in enumerate(good):
                if i not in wrong and (text := repository_page(rows.where(F.col("input") == i), options, e.slug, args, limits)):
                    failed[e.slug] = text
        sound = [i for i, e in enumerate(good) if e.slug not in failed]
        held, total = index_figures(jsonl.history_of(rows.where(F.col("input").isin(sound)), options, multi=True)) if sound else ({}, {})
        entries = [index_entry(e, failed.get(e.slug), held.get(os.path.basename(e.output).removesuffix(".jsonl"), {})) for e in manifest.repositories]
        with open(os.path.join(args.report_dir, "index.html"), "w", encoding="utf-8") as file:
            file.write(html.scan_index(entries, dt.datetime.now(dt.UTC).date(), total))
        print(f"{len(entries)} repositories, index written to {file_link(os.path.join(args.report_dir, 'index.html'))}", file=sys.stderr)
    return 0


def repository_page(rows: DataFrame, options: Options, slug: str, args: argparse.Namespace, limits: Limits) -> str:
    """Writes the report of one repository; what goes wrong with it is its own failure, returned as text, and leaves no page."""
    path = os.path.join(args.report_dir, f"{slug}.html")
    h = jsonl.history_of(rows, options).cache()
    try:
        text = html.team_report(h, slug, args.top, limits)
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
    except Exception as error:  # noqa: BLE001  the other repositories' pages and the index are still wanted
        if os.path.exists(path):
            os.remove(path)
        return f"page: {error}"
    finally:
        h.uncache()
    return ""


def index_figures(h: History) -> tuple[dict[str, dict], dict]:
    """Figures by repository, and of all: one query, whatever their number."""
    found = [r.asDict() for r in fleet.repositories(h).collect()]  # a row for each repository
    return {r["repo"]: r for r in found if not r["total"]}, next((r for r in found if r["total"]), {})


def index_entry(entry: discovery.Entry, fault: str | None, figures: dict) -> dict:
    """A repository's row of the index; one whose page or input was faulty counts as failed."""
    out = {"slug": entry.slug, "path": entry.path, "status": "failed" if fault else entry.status, "error": fault or entry.error}
    return out | {c: figures.get(c, "" if c.endswith("commit") else 0) for c in ("commits", "devs", "files", "churn", "first_commit", "last_commit")} if out["status"] == "ok" else out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronolith", description="Questions about software history, answered by Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable[[argparse.Namespace], int], n: int = 10) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if name in ("stats", "diff", "ci", "report"):
            p.add_argument("--input", action="append", default=None)
        if name in ("stats", "diff", "report", "scan"):
            p.add_argument("--top", type=int, default=n)
        return p

    def windows(p: argparse.ArgumentParser) -> None:
        p.add_argument("--since", default="")
        p.add_argument("--from", dest="start", default="")
        p.add_argument("--to", dest="end", default="")
        p.add_argument("--churn-half-life", type=int, default=90)
        p.add_argument("--coupling-max-files", type=int, default=50)
        p.add_argument("--coupling-min-changes", type=int, default=5)
        p.add_argument("--network-min-files", type=int, default=5)
        p.add_argument("--email", default="")

    p = command("stats", run_stats)
    p.add_argument("--timeout", type=float, help="seconds after which running statistics are cancelled")
    windows(p)
    p.add_argument("--format", choices=("table", "csv", "json"), default="table")
    p.add_argument("--stat", choices=STATS, default="")
    p.add_argument("--granularity", choices=("day", "week", "month", "year"), default="month")
    p.add_argument("--tree-depth", type=int, default=3)
    p = command("diff", run_diff)
    for flag, name in (("--from", "start"), ("--to", "end"), ("--vs-from", "vs_from"), ("--vs-to", "vs_to")):
        p.add_argument(flag, dest=name, default="")
    p.add_argument("--format", choices=("table", "csv", "json"), default="table")
    p = command("ci", run_ci)
    p.add_argument("--format", choices=("text", "github-actions", "gitlab", "json"), default="text")
    p.add_argument("--fail-on-busfactor", type=int, default=0)
    p.add_argument("--fail-on-churn-risk", type=float, default=0.0)
    p.add_argument("--churn-half-life", type=int, default=90)
    p = command("report", run_report, 20)
    windows(p)
    p.add_argument("--output", default="report.html")
    p.add_argument("--title", default="Report")
    p = command("extract", run_extract)
    p.add_argument("--repo", default=".")
    p.add_argument("--output", default="history.jsonl")
    p.add_argument("--state", default=None)
    p.add_argument("--branch", default="")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--batch-size", type=int, default=1000)
    p.add_argument("--start-offset", type=int, default=-1)
    p.add_argument("--start-sha", default="")
    for flag in ("--first-parent", "--messages", "--mailmap", "--sizes"):
        p.add_argument(flag, action="store_true")
    p = command("scan", run_scan, 20)
    p.add_argument("--root", action="append", required=True)
    p.add_argument("--output", default="scan")
    p.add_argument("--report-dir", default="")
    p.add_argument("--ignore-file", default="")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--max-depth", type=int, default=0)
    p.add_argument("--parallel", type=int, default=0)
    p.add_argument("--timeout", type=float, default=0.0)
    p.add_argument("--report", default="")
    p.add_argument("--batch-size", type=int, default=1000)
    p.add_argument("--mailmap", action="store_true")
    p.add_argument("--first-parent", action="store_true")
    p.add_argument("--include-commit-messages", dest="messages", action="store_true")
    windows(p)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if getattr(args, "input", "") is None:
        args.input = ["history.jsonl"]
    try:
        with released():  # parsed copies of the inputs go when the command ends
            return args.run(args)
    except (UsageError, LookupError, TimeoutError, extract.StateError, jsonl.MalformedInput) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
