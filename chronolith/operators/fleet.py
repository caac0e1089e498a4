"""Many repositories in one plan: figures of each and of all, where a developer of several counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.ranking import day
from chronolith.plans.history import History


def _facts(h: History) -> DataFrame:
    """What adds up over repositories: a row for each author of a repository, one for its files and one for its merges."""
    people = h.commits.groupBy("repo", "email").agg(
        F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    files = h.touches.select("repo", "file").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    merges = h.parents.groupBy("repo", "sha").count().where("count > 1").groupBy("repo").agg(F.count(F.lit(1)).alias("merges"))
    return people.unionByName(files, allowMissingColumns=True).unionByName(merges, allowMissingColumns=True)


def repositories(h: History) -> DataFrame:
    """A row for each repository, and one for all (`total` true, no name).

    Rows of the input are reduced to authors of repositories first; repositories and their total are grouping sets over
    these. Commits, files, lines and merges of the total are sums, its developers the union: an email that commits to
    several repositories counts once. A repository with file rows alone has 0 commits and empty dates; a history
    without rows gives none.
    """
    held = _facts(h).rollup("repo").agg(
        F.grouping("repo").alias("total"), F.count_distinct("email").alias("devs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("commits", "files", "additions", "deletions", "merges")),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    return held.select(
        "repo", (F.col("total") == 1).alias("total"), "commits", "devs", "files", "additions", "deletions", (F.col("additions") + F.col("deletions")).alias("churn"), "merges", day("first").alias("first_commit"), day("last").alias("last_commit")
    ).orderBy(F.desc("total"), F.desc("commits"), "repo")
