"""Developer profiles: one row for each developer, with ranked lists as arrays of structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.scalars import cut_message, dirname, extension, round_k, strip_repo
from chronolith.operators.ownership import herfindahl
from chronolith.operators.partners import collaborators
from chronolith.operators.ranking import contributors
from chronolith.plans.history import History
from chronolith.schema import BALANCED_RATIO, MESSAGE_BYTES, MESSAGE_CUT, NARROW_SPECIALIST, REFACTOR_RATIO, SPECIALIST_BANDS

TOP_FILES, TOP_COMMITS, TOP_DIRS, TOP_EXTENSIONS, TOP_PARTNERS = 10, 10, 5, 5, 5


def specialist_label(x: Column) -> Column:
    out = F.lit(NARROW_SPECIALIST)
    for bound, name in reversed(SPECIALIST_BANDS):
        out = F.when(x < bound, name).otherwise(out)
    return out


def contribution_type(ratio: Column) -> Column:
    return F.when(ratio >= REFACTOR_RATIO, "refactor").when(ratio >= BALANCED_RATIO, "balanced").otherwise("growth")


def _best(rows: DataFrame, k: int, fields: list[str], name: str, *order: object) -> DataFrame:
    """(email, name, name_hidden): the first k rows of each developer, and how many are left out."""
    window = Window.partitionBy("email").orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(window))
    item = F.when(F.col("rank") <= k, F.struct("rank", *fields))
    kept = ranked.groupBy("email").agg(F.array_sort(F.collect_list(item)).alias("x"), F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias(f"{name}_hidden"))
    return kept.select("email", F.transform("x", lambda s: s.dropFields("rank")).alias(name), f"{name}_hidden")


def profiles(h: History, email: str | None = None, n: int = 0) -> DataFrame:
    """Profiles of one developer (exact email), of the n with most commits, or of all (n = 0)."""
    people = contributors(h, 0 if email is not None else n)
    if email is not None:
        people = people.where(F.col("email") == email)
    targets = people.select("email")
    mine = h.authored.join(targets, "email", "left_semi")
    commits = h.distinct_commits.join(targets, "email", "left_semi").where("ts IS NOT NULL")
    pct = lambda a, b: F.when(b > 0, round_k(a / b * 100, 1)).otherwise(0.0)

    files = _best(mine.select("email", F.col("file").alias("path"), "lines", F.col("touches").alias("commits")), TOP_FILES, ["path", "commits", "lines"], "top_files", F.desc("lines"), "path")
    big = commits.select(
        "email", "sha", F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("additions") + F.col("deletions")).alias("lines"), "additions", "deletions", "files_changed",
        cut_message(F.col("message"), MESSAGE_BYTES, MESSAGE_CUT).alias("message"),
    )
    big = _best(big, TOP_COMMITS, ["sha", "date", "message", "additions", "deletions", "lines", "files_changed"], "top_commits", F.desc("lines"), "sha")
    monthly = commits.groupBy("email", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    monthly = monthly.groupBy("email").agg(F.array_sort(F.collect_list(F.struct("period", "commits", "additions", "deletions"))).alias("monthly_activity"))
    local = commits.where("ts_local IS NOT NULL").groupBy("email", F.weekday("ts_local").alias("day"), F.hour("ts_local").alias("hour")).agg(F.count(F.lit(1)).alias("commits"))
    grid = local.groupBy("email").agg(
        F.array_sort(F.collect_list(F.struct("day", "hour", "commits"))).alias("work_grid"),  # 7 x 24 cells at most
        pct(F.sum(F.when(F.col("day") >= 5, F.col("commits")).otherwise(0)), F.sum("commits")).alias("weekend_pct"),
    )
    path = strip_repo(F.col("file")) if h.multi else F.col("file")
    dirs = mine.groupBy("email", dirname(path).alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    of_all = Window.partitionBy("email")
    dirs = dirs.withColumn("of_all", F.sum("files").over(of_all)).withColumn("pct", pct(F.col("files"), F.col("of_all")))
    squares, whole = F.sum(F.col("files") * F.col("files")).cast("double"), F.sum("files").cast("double")
    special = dirs.groupBy("email").agg((squares / (whole * whole)).alias("specialization"))  # whole numbers, one division
    scope = _best(dirs, TOP_DIRS, ["dir", "files", "pct"], "scope", F.desc("files"), "dir")
    exts = mine.groupBy("email", extension(F.col("file")).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("churn"))
    exts = exts.withColumn("pct", pct(F.col("files"), F.sum("files").over(of_all)))
    exts = _best(exts, TOP_EXTENSIONS, ["ext", "files", "churn", "pct"], "extensions", F.desc("files"), F.desc("churn"), "ext")
    partners = collaborators(h, mine, TOP_PARTNERS)

    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (people, files, big, monthly, grid, special, scope, exts, partners))
    rows = parts.groupBy("email").agg(*(F.first(c, ignorenulls=True).alias(c) for c in parts.columns if c != "email"))  # one shuffle; each part has one row for a developer
    ratio = F.when(F.col("additions") > 0, round_k(F.col("deletions") / F.col("additions"), 2)).otherwise(0.0)
    hidden = [f"{x}_hidden" for x in ("top_files", "top_commits", "scope", "extensions", "collaborators")]
    return rows.select(
        "name", "email", "commits", "additions", "deletions", (F.col("additions") + F.col("deletions")).alias("lines_changed"), "files_touched", "active_days", "first_date", "last_date",
        F.coalesce("specialization", F.lit(0.0)).alias("specialization"), specialist_label(F.coalesce("specialization", F.lit(0.0))).alias("specialist"),
        ratio.alias("contrib_ratio"), contribution_type(ratio).alias("contrib_type"),
        F.when(F.col("active_days") > 0, round_k(F.col("commits") / F.col("active_days"), 1)).otherwise(0.0).alias("pace"), F.coalesce("weekend_pct", F.lit(0.0)).alias("weekend_pct"),
        "top_files", "top_commits", "monthly_activity", "work_grid", "scope", "extensions", "collaborators", *(F.coalesce(x, F.lit(0)).alias(x) for x in hidden),
    ).orderBy(F.desc("commits"), "email")


def directory_focus(h: History) -> DataFrame:
    """(email, specialization): Herfindahl index of each developer's files by directory, from an array."""
    dirs = h.authored.groupBy("email", dirname(F.col("file")).alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    return dirs.groupBy("email").agg(herfindahl(F.array_sort(F.collect_list("files"))).alias("specialization"))
