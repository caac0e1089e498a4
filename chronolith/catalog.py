"""Every statistic as a named query over the test bed, and its DuckDB SQL, written independently of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith import testbed
from chronolith.operators import compose, fleet, merged, ownership, pairs, profiles, ranking, risk, structure
from chronolith.plans.history import History
from chronolith.schema import Limits, Options
from chronolith.sources.jsonl import developers

Query = Callable[[SparkSession, str], DataFrame]
FIRST = Options(since="1995-01-01", until="1997-12-31")
SECOND = Options(since="1998-01-01", until="2001-12-31")


def _on(kind: str, stat: Callable[[History], DataFrame], **how: object) -> Query:
    return lambda spark, sf_dir: stat(testbed.history(spark, sf_dir, kind, **how))


def _lists(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as text, so that engines can be compared."""
    return df.withColumns({c: F.array_join(c, ";") for c in columns})


def _profile_lists(h: History) -> DataFrame:
    """Profiles with their lists as text."""
    rows = profiles.profiles(h)
    text = {
        "top_files": "concat_ws(':', x.path, x.commits, x.lines)", "top_commits": "concat_ws(':', x.sha, x.lines)", "monthly_activity": "concat_ws(':', x.period, x.commits)", "work_grid": "concat_ws(':', x.day, x.hour, x.commits)",
        "scope": "concat_ws(':', x.dir, x.files)", "extensions": "concat_ws(':', x.ext, x.files, x.churn)", "collaborators": "concat_ws(':', x.partner, x.shared_files, x.shared_lines)",
    }
    return rows.withColumns({c: F.expr(f"array_join(transform(coalesce({c}, array()), x -> {e}), ';')") for c, e in text.items()}).withColumn("specialization", F.round("specialization", 6))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "summary": _on("fine", ranking.summary),
        "summary_window": _on("fine", ranking.summary, options=FIRST),
        "contributors": _on("fine", lambda h: ranking.contributors(h, 0)),
        "contributors_top10": _on("coarse", lambda h: ranking.contributors(h, 10)),
        "dev_emails": _on("fine", ranking.dev_emails),
        "dev_registry": _on("fine", lambda h: developers(h.commits)),
        "hotspots": _on("fine", lambda h: ranking.hotspots(h, 0)),
        "hotspots_top10": _on("coarse", lambda h: ranking.hotspots(h, 10)),
        "hotspots_window": _on("fine", lambda h: ranking.hotspots(h, 0), options=FIRST),
        "hotspots_renamed": _on("fine", lambda h: ranking.hotspots(h, 0), renames=True),
        "directories": _on("coarse", lambda h: ranking.directories(h, 0)),
        "extensions": _on("fine", lambda h: ranking.extensions(h, 0)),
        "working_patterns": _on("fine", ranking.working_patterns),
        "top_commits": _on("fine", lambda h: ranking.top_commits(h, 0)),
        "activity_grid": _on("fine", lambda h: ranking.activity_grid(h).select("year", *(F.coalesce(F.col(f"`{m:02d}`.commits"), F.lit(0)).alias(f"m{m:02d}") for m in range(1, 13)))),
        "busfactor": _on("fine", lambda h: _lists(ownership.bus_factor(h, 0), "top_devs")),
        "coupling": _on("coarse", lambda h: pairs.coupling(h, 0)),
        "dev_network": _on("coarse", lambda h: pairs.dev_network(h, 0)),
        "dev_network_loose": _on("fine", lambda h: pairs.dev_network(h, 0, Limits(network_min_files=1))),
        "churn_risk": _on("fine", lambda h: risk.churn_risk(h, 0)),
        "churn_risk_top20": _on("fine", lambda h: risk.churn_risk(h, 20)),
        "churn_risk_labels": _on("fine", risk.label_counts),
        "profile": _on("fine", _profile_lists),
        "directory_focus": _on("fine", lambda h: profiles.directory_focus(h).withColumn("specialization", F.round("specialization", 6))),
        "pareto": _on("fine", ownership.pareto),
        "pareto_coarse": _on("coarse", ownership.pareto),
        "structure": _on("coarse", structure.structure),
        "structure_depth1": _on("fine", lambda h: structure.structure(h, max_depth=1)),
        "repo_breakdown": _on("fine", ranking.repo_breakdown, multi=True),
        "repo_breakdown_dev": _on("fine", lambda h: ranking.repo_breakdown(h, " DEV1@example.com "), multi=True),
        "repositories": _on("fine", fleet.repositories, multi=True),
        "repositories_window": _on("fine", fleet.repositories, multi=True, options=FIRST),
        "suspects": _on("coarse", lambda h: _lists(structure.suspects(h), "paths", "suggestions")),
        "diff": lambda spark, d: compose.diff(testbed.history(spark, d, options=FIRST), testbed.history(spark, d, options=SECOND)),
        "ci": _on("fine", lambda h: compose.gates(h, max_bus_factor=1, max_risk=20.0)),
    }
    through: dict[str, tuple[str, Callable[[History], DataFrame], dict]] = {
        "summary": ("fine", ranking.summary, {}), "summary_window": ("fine", ranking.summary, {"options": FIRST}), "hotspots_window": ("fine", lambda h: ranking.hotspots(h, 0), {"options": FIRST}),
        "working_patterns": ("fine", ranking.working_patterns, {}), "extensions": ("fine", lambda h: ranking.extensions(h, 0), {}), "churn_risk": ("fine", lambda h: risk.churn_risk(h, 0), {}), "coupling": ("coarse", lambda h: pairs.coupling(h, 0), {}),
        "dev_registry": ("fine", lambda h: developers(h.commits), {}),
    }
    for name, (kind, stat, how) in through.items():  # the same results, through JSON lines and the loader
        found[f"lines_{name}"] = lambda spark, d, kind=kind, stat=stat, how=how: stat(testbed.read_lines(spark, testbed.history(spark, d, kind), **how))
    found["lines_hotspots_renamed"] = lambda spark, d: ranking.hotspots(testbed.read_lines(spark, testbed.history(spark, d, renames=True)), 0)
    found["lines_two_inputs"] = lambda spark, d: ranking.repo_breakdown(testbed.read_lines(spark, testbed.history(spark, d, options=FIRST), testbed.history(spark, d, options=SECOND)))
    found["lines_repositories"] = lambda spark, d: fleet.repositories(testbed.read_staged(spark, testbed.history(spark, d, options=FIRST), testbed.history(spark, d, options=SECOND)))
    found["coupling_split_runs"] = _on("coarse", lambda h: pairs.coupling(h, 0), halves=True)
    found["lines_coupling_split_runs"] = lambda spark, d: pairs.coupling(testbed.read_lines(spark, testbed.history(spark, d, "coarse", halves=True)), 0)
    stored = {"summary_window": ("fine", ranking.summary, FIRST), "hotspots_window": ("fine", lambda h: ranking.hotspots(h, 0), FIRST), "churn_risk": ("fine", lambda h: risk.churn_risk(h, 0), Options()), "coupling": ("coarse", lambda h: pairs.coupling(h, 0), Options())}
    for name, (kind, stat, options) in stored.items():  # through JSON lines and the month-clustered store
        found[f"store_{name}"] = lambda spark, d, kind=kind, stat=stat, options=options: stat(testbed.read_store(spark, testbed.history(spark, d, kind), options))
    months = {"since": FIRST.since[:7], "until": FIRST.until[:7]}
    sets = {"contributors": ("fine", merged.contributors), "extensions": ("fine", merged.extensions), "directories": ("coarse", merged.directories)}
    for name, (kind, stat) in sets.items():  # from partial states of months, of all and of some of them
        found[f"merged_{name}"] = lambda spark, d, kind=kind, stat=stat: stat(testbed.read_merged(spark, testbed.history(spark, d, kind)), 0)
        found[f"merged_{name}_window"] = lambda spark, d, kind=kind, stat=stat: stat(testbed.read_merged(spark, testbed.history(spark, d, kind), **months), 0)
    found["merged_contributors_two_parts"] = lambda spark, d: merged.contributors(testbed.read_merged(spark, testbed.history(spark, d, options=FIRST), testbed.history(spark, d, options=SECOND)), 0)
    found["odd_coupling"] = lambda spark, d: pairs.coupling(testbed.odd_history(spark, d), 0)
    found["odd_suspects"] = lambda spark, d: structure.suspects(testbed.odd_history(spark, d)).select("glob", "reason", "churn", F.size("paths").cast("bigint").alias("files"), F.array_join("suggestions", ";").alias("suggestions"), "worth_warning")
    for g in ("day", "week", "month", "year"):
        found[f"activity_{g}"] = _on("fine", lambda h, g=g: ranking.activity(h, g))
    return found
