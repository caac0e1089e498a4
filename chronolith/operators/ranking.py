"""Rankings: summary, contributors, files, directories, extensions, activity, working hours, big commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.scalars import cut_message, dirname, period, round_k, weekday_name
from chronolith.operators.ownership import bus_factors
from chronolith.plans.history import History
from chronolith.schema import MESSAGE_BYTES, MESSAGE_CUT


def top(df: DataFrame, n: int, *order: object) -> DataFrame:
    """Ordered rows; the first n if n is above 0, else all."""
    ranked = df.orderBy(*order)
    return ranked.limit(n) if n > 0 else ranked


def day(ts: str) -> F.Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))


def summary(h: History) -> DataFrame:
    """One row of totals over raw commit rows."""
    totals = h.commits.agg(
        F.count(F.lit(1)).alias("total_commits"), F.count_distinct("email").alias("total_devs"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("total_additions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("total_deletions"),
        F.coalesce(F.sum("files_changed"), F.lit(0)).alias("files_changed"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    files = h.touches.agg(F.count_distinct("file").alias("total_files"))
    merges = h.parents.groupBy("sha").count().where("count > 1").agg(F.count(F.lit(1)).alias("merge_commits"))
    mean = lambda c: F.when(F.col("total_commits") > 0, F.col(c) / F.col("total_commits")).otherwise(0.0)
    return totals.crossJoin(files).crossJoin(merges).select(  # one row each
        "total_commits", "total_devs", "total_files", "total_additions", "total_deletions", "merge_commits",
        mean("total_additions").alias("avg_additions"), mean("total_deletions").alias("avg_deletions"), mean("files_changed").alias("avg_files_changed"),
        day("first").alias("first_commit"), day("last").alias("last_commit"),
    )


def contributors(h: History, n: int = 10) -> DataFrame:
    """By author email: commits, lines, active days, files touched, dates; the name first seen."""
    people = h.commits.groupBy("email").agg(
        F.min_by("name", "ord").alias("name"), F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.count_distinct(F.to_date("ts")).alias("active_days"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    files = h.file_dev.groupBy("email").agg(F.count(F.lit(1)).alias("files_touched"))
    rows = people.join(files, "email", "left").select(
        "name", "email", "commits", "additions", "deletions", F.coalesce("files_touched", F.lit(0)).alias("files_touched"), "active_days", day("first").alias("first_date"), day("last").alias("last_date")
    )
    return top(rows, n, F.desc("commits"), "email")


def dev_emails(h: History) -> DataFrame:
    return h.commits.select("email").distinct()


def hotspots(h: History, n: int = 10) -> DataFrame:
    """By canonical file: change records, lines, developers who changed a line."""
    devs = h.authored.groupBy("file").agg(F.count(F.lit(1)).alias("unique_devs"))
    rows = h.file_facts.join(devs, "file", "left").select(F.col("file").alias("path"), "commits", "additions", "deletions", "churn", F.coalesce("unique_devs", F.lit(0)).alias("unique_devs"))
    return top(rows, n, F.desc("commits"), "path")


def directories(h: History, n: int = 10) -> DataFrame:
    """By directory: touches, lines, files, developers, bus factor over the summed lines of each developer."""
    facts = h.file_facts.groupBy(dirname(F.col("file")).alias("dir")).agg(F.sum("commits").alias("file_touches"), F.sum("churn").alias("churn"), F.count(F.lit(1)).alias("files"))
    lines = h.authored.groupBy(dirname(F.col("file")).alias("dir"), "email").agg(F.sum("lines").alias("lines"))
    owners = bus_factors(lines, "dir").select("dir", F.col("devs").alias("unique_devs"), "bus_factor")
    rows = facts.join(owners, "dir", "left").select("dir", "file_touches", "churn", "files", F.coalesce("unique_devs", F.lit(0)).alias("unique_devs"), F.coalesce("bus_factor", F.lit(0)).alias("bus_factor"))
    return top(rows, n, F.desc("file_touches"), "dir")


def extensions(h: History, n: int = 10) -> DataFrame:
    """By extension at the time of change; developers are those of the files that ever had it."""
    by_ext = h.file_ext.groupBy("ext").agg(
        F.count(F.lit(1)).alias("files"), F.sum("churn").alias("churn"), round_k(F.sum("micro") / 1e6, 1).alias("recent_churn"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    devs = h.file_ext.select("file", "ext").join(h.authored.select("file", "email"), "file").groupBy("ext").agg(F.count_distinct("email").alias("unique_devs"))
    rows = by_ext.join(devs, "ext", "left").select("ext", "files", "churn", "recent_churn", F.coalesce("unique_devs", F.lit(0)).alias("unique_devs"), day("first").alias("first_seen"), day("last").alias("last_seen"))
    return top(rows, n, F.desc("recent_churn"), F.desc("files"), "ext")


def activity(h: History, granularity: str = "month") -> DataFrame:
    """Commits and lines by UTC day, ISO week, month or year; each sha once, undated commits left out."""
    rows = h.distinct_commits.where("ts IS NOT NULL").groupBy(period(F.col("ts"), granularity).alias("period"))
    return rows.agg(F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")).orderBy("period")


def activity_grid(h: History) -> DataFrame:
    """A row for each year, a struct of commits, lines and del/add ratio for each month."""
    months = activity(h, "month")
    cell = F.struct(F.sum("commits").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.sum(F.when(F.col("additions") > 0, F.col("deletions") / F.col("additions")).otherwise(0.0)).alias("ratio"))
    years = months.select(F.substring("period", 1, 4).alias("year"), F.substring("period", 6, 2).alias("month"), "commits", "additions", "deletions")
    return years.groupBy("year").pivot("month", [f"{m:02d}" for m in range(1, 13)]).agg(F.first(F.struct("commits", "additions", "deletions", F.when(F.col("additions") > 0, F.col("deletions") / F.col("additions")).otherwise(0.0).alias("ratio")))).orderBy("year")


def working_patterns(h: History) -> DataFrame:
    """Commits by the author's weekday and hour; Monday first."""
    dated = h.commits.where("ts_local IS NOT NULL")
    grid = dated.groupBy(F.weekday("ts_local").alias("weekday"), F.hour("ts_local").alias("hour")).agg(F.count(F.lit(1)).alias("commits"), F.min(weekday_name(F.col("ts_local"))).alias("day"))
    return grid.orderBy("weekday", "hour").select("day", "hour", "commits")


def top_commits(h: History, n: int = 10) -> DataFrame:
    """The largest commits by changed lines; the author under the name first seen."""
    rows = h.distinct_commits.select("sha", "email", "ts", "message", "additions", "deletions", (F.col("additions") + F.col("deletions")).alias("lines_changed"), "files_changed")
    first = rows.orderBy(F.desc("lines_changed"), "sha")
    first = (first.limit(n) if n > 0 else first).join(h.names, "email", "left")
    return first.select(
        "sha", F.coalesce("name", "email").alias("author"), "email", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("0001-01-01")).alias("date"),
        "additions", "deletions", "lines_changed", "files_changed", cut_message(F.col("message"), MESSAGE_BYTES, MESSAGE_CUT).alias("message"),
    ).orderBy(F.desc("lines_changed"), "sha")


def repo_breakdown(h: History, email: str | None = None) -> DataFrame:
    """By repository: commits, lines, files, days, developers, dates and shares; of one author, if given."""
    commits, wanted = h.commits, email.strip().lower() if email else None
    same = F.lower(F.trim("email")) == wanted
    if wanted:
        commits = commits.where(same)
    by_repo = commits.groupBy("repo").agg(
        F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"),
        F.count_distinct(F.to_date("ts")).alias("active_days"), F.count_distinct(F.lower(F.trim("email"))).alias("unique_devs"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    paths = (h.file_dev.where(same) if wanted else h.file_facts).select("file").distinct()
    repo = F.when(F.instr("file", ":") > 0, F.substring_index("file", ":", 1)).otherwise("(repo)")
    files = paths.groupBy(repo.alias("repo")).agg(F.count(F.lit(1)).alias("files"))
    whole = Window.partitionBy()
    share = lambda c: F.when(F.sum(c).over(whole) > 0, round_k(F.col(c) * 100.0 / F.sum(c).over(whole), 1)).otherwise(0.0)
    rows = by_repo.join(files, "repo", "left").select(  # one row for each repository
        "repo", "commits", "additions", "deletions", "churn", F.coalesce("files", F.lit(0)).alias("files"), "active_days", "unique_devs", day("first").alias("first_date"), day("last").alias("last_date"),
        share("commits").alias("commits_pct"), share("churn").alias("churn_pct"),
    )
    return rows.orderBy(F.desc("commits"), "repo")
