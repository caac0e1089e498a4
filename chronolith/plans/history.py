"""A loaded history: three typed frames, and the fact frames that the statistics share."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.scalars import epoch, extension, minus_months, months
from chronolith.plans.checkpoints import written
from chronolith.plans.lineage import canonical_paths
from chronolith.schema import TREND_MONTHS, Options


def with_authors(files: DataFrame, commits: DataFrame) -> DataFrame:
    """File rows with email and ts of their commit (the last of the input, if it stands there more than once), and whether there is one."""
    who = commits.groupBy("repo", "sha").agg(F.max_by(F.struct("email", "ts"), "ord").alias("c"))
    rows = files.select("repo", "sha", "path", "status", "old_path", "new_path", "additions", "deletions", "ord")
    return rows.join(who, ["repo", "sha"], "left").select(
        "repo", "sha", "path", "status", "old_path", "new_path", "additions", "deletions", F.col("c.email").alias("email"), F.col("c.ts").alias("ts"), F.col("c").isNotNull().alias("known"), "ord"
    )


def _with_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lines", F.col("additions") + F.col("deletions"))


@dataclass
class History:
    """
    commits: repo, sha, name, email, ts, ts_local (TIMESTAMP_NTZ), additions, deletions, files_changed, message, ord
    files: repo, sha, path, status, old_path, new_path, additions, deletions, ord
    parents: repo, sha
    A source that knows the commit of every file row may give files its email and ts as well, which spares the join; `owned`
    are file rows with these two and `known` (false where there is no such commit), of a source that keeps them so; one whose
    commits cost a join may give `headers`, the same rows without additions, deletions and files_changed.
    A null email marks no author; an empty one is a contributor. `ord` is the order of the input.
    """

    commits: DataFrame
    files: DataFrame
    parents: DataFrame
    options: Options = field(default_factory=Options)
    multi: bool = False
    renames: bool = True  # False: known to hold no rename, which spares the search for them
    kept: dict[str, DataFrame] = field(default_factory=dict)  # results that several statistics share
    headers: DataFrame | None = None
    owned: DataFrame | None = None

    @property
    def heads(self) -> DataFrame:
        """Commits, for what reads no sums of theirs."""
        return self.commits if self.headers is None else self.headers

    @cached_property
    def distinct_commits(self) -> DataFrame:
        """One row for each sha: the last of the input."""
        cols = [c for c in self.commits.columns if c not in ("sha", "ord")]
        last = self.commits.groupBy("sha").agg(F.max_by(F.struct(*cols), "ord").alias("x"))
        return last.select("sha", *(F.col(f"x.{c}").alias(c) for c in cols))

    @cached_property
    def names(self) -> DataFrame:
        """(email, name): the name that an author was first seen with."""
        return self.heads.groupBy("email").agg(F.min_by("name", "ord").alias("name"))

    @cached_property
    def latest(self) -> DataFrame:
        """One row: the date of the newest commit and of the oldest."""
        return self.heads.agg(F.max("ts").alias("latest"), F.min("ts").alias("earliest"))

    @cached_property
    def _authored(self) -> DataFrame:
        """File rows with author and date of their commit, raw paths."""
        if self.owned is not None:
            return self.owned
        cols = ["email", "ts"]
        if set(cols) <= set(self.files.columns):
            return self.files.select("repo", "sha", "path", "status", "old_path", "new_path", "additions", "deletions", *cols, F.lit(True).alias("known"), "ord")
        return with_authors(self.files, self.heads)

    @cached_property
    def canonical(self) -> DataFrame | None:
        """(path, canonical) of the paths that a rename leads elsewhere; None if there is none."""
        dated = self.owned is not None or {"email", "ts"} <= set(self.files.columns)
        if not self.renames or not dated and not self.files.where("status LIKE 'R%'").limit(1).count():  # reads one column, before any join
            return None
        facts = self.__dict__.get("_raw_facts")
        return canonical_paths(self._authored, used=None if facts is None else facts.select("path", F.col("last").alias("ts")))

    @cached_property
    def touches(self) -> DataFrame:
        """File rows under their canonical path, with lines changed."""
        return self._under_canonical(self._authored)

    @cached_property
    def changes(self) -> DataFrame:
        """Touches without what their commits hold: no join with these."""
        return self._under_canonical(self.files)

    def _under_canonical(self, rows: DataFrame) -> DataFrame:
        return _with_lines(self._filed(rows))

    def _filed(self, rows: DataFrame) -> DataFrame:
        """Rows of raw paths with `file`, their canonical path."""
        if self.canonical is None:
            return rows.withColumn("file", F.col("path"))
        return rows.join(self.canonical, "path", "left").withColumn("file", F.coalesce("canonical", "path")).drop("canonical")

    @cached_property
    def decayed_touches(self) -> DataFrame:
        """Touches with `micro`: lines decayed to the anchor, in millionths.

        Whole numbers add up the same in any order, so results do not depend on partitioning.
        """
        return self._decayed(self.touches)

    def _decayed(self, touches: DataFrame) -> DataFrame:
        if self.options.anchor == "stream":
            seen = self._seen().groupBy("repo", "sha").agg(F.max_by("seen", "ord").alias("anchor"))
            rows = touches.join(seen, ["repo", "sha"], "left")
        else:
            rows = touches.crossJoin(F.broadcast(self.latest.select(F.col("latest").alias("anchor"))))  # one row
        days = (epoch(F.col("anchor")) - epoch(F.col("ts"))) / 86400.0
        rate = math.log(2) / self.options.half_life
        micro = F.round(F.col("lines") * F.exp(-rate * days) * 1e6).cast("bigint")
        return rows.withColumn("micro", F.when(F.col("ts").isNotNull(), micro))

    def _seen(self) -> DataFrame:
        """(repo, sha, ord, seen): the newest date so far in the order of the input. Splits of the input are put in order by
        their newest dates, then each split's lines in a task of its own."""
        known = dict(self.commits.dtypes)["ord"].startswith("struct")  # else a plain number, from one source
        split = [F.col("ord.file").alias("file"), F.struct(*(f"ord.{c}" for c in self.commits.schema["ord"].dataType.names if c in ("batch", "part", "block"))).alias("block")] if known else [F.lit(0).alias("file"), F.lit(0).alias("block")]
        lines = self.commits.select("repo", "sha", "ord", "ts", *split)
        before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
        splits = lines.groupBy("file", "block").agg(F.max("ts").alias("newest")).select("file", "block", F.max("newest").over(before).alias("earlier"))  # one row for each split
        inside = Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return lines.withColumn("inside", F.max("ts").over(inside)).join(splits, ["file", "block"]).select("repo", "sha", "ord", F.greatest("inside", "earlier").alias("seen"))

    @cached_property
    def _raw_facts(self) -> DataFrame:
        """author_facts before renames are followed: a raw path has one canonical file, so this pass needs no chains."""
        rows = self._decayed(_with_lines(self._authored)).drop("anchor").crossJoin(F.broadcast(self.bounds.select("cutoff")))  # one row
        month, dated = months("ts"), F.col("ts").isNotNull()
        facts = rows.groupBy("path", "email", "known").agg(
            F.count(F.lit(1)).alias("touches"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.sum("micro").alias("micro"), F.min("ts").alias("first"), F.max("ts").alias("last"),
            F.sum(F.when(dated & (month < F.col("cutoff")), F.col("lines"))).alias("earlier"), F.sum(F.when(dated & (month >= F.col("cutoff")), F.col("lines"))).alias("later"),
        )
        return written(facts)

    @cached_property
    def author_facts(self) -> DataFrame:
        """One row for each canonical file, path that it had and author: one pass over all touches, written once, for every
        statistic of files and of their owners; the search for chains reads it too."""
        return _with_lines(self._filed(self._raw_facts))

    @cached_property
    def file_dev(self) -> DataFrame:
        """(file, email, lines, touches): who changed a canonical file; lines may be 0."""
        known = self.author_facts.where("known")
        if self.canonical is None:  # a row each already
            return known.select("file", "email", "lines", "touches")
        return known.groupBy("file", "email").agg(F.sum("lines").alias("lines"), F.sum("touches").alias("touches"))

    @cached_property
    def authored(self) -> DataFrame:
        """file_dev without the rows that changed no line."""
        return self.file_dev.where("lines > 0")

    @cached_property
    def bounds(self) -> DataFrame:
        """One row: latest and earliest date, and as numbers of months the first month of the trend and the oldest one."""
        return self.latest.select("latest", "earliest", months(minus_months(F.to_date("latest"), TREND_MONTHS)).alias("cutoff"), months("earliest").alias("oldest"))

    @cached_property
    def path_facts(self) -> DataFrame:
        """One row for each canonical file and path that it had."""
        sums = {"touches": "commits", "additions": "additions", "deletions": "deletions", "lines": "churn", "micro": "micro", "earlier": "earlier", "later": "later"}
        return self.author_facts.groupBy("file", "path").agg(*(F.sum(c).alias(name) for c, name in sums.items()), F.min("first").alias("first"), F.max("last").alias("last"))

    @cached_property
    def file_facts(self) -> DataFrame:
        """One row for each canonical file; earlier and later are its lines before and in the months of the trend."""
        sums = ("commits", "additions", "deletions", "churn")
        some = ("micro", "earlier", "later")
        return self.path_facts.groupBy("file").agg(
            *(F.sum(c).alias(c) for c in sums), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in some), F.min("first").alias("first"), F.max("last").alias("last")
        )

    @cached_property
    def file_ext(self) -> DataFrame:
        """(file, ext, churn, micro, first, last): a file's history under each extension it had."""
        return self.path_facts.groupBy("file", extension(F.col("path")).alias("ext")).agg(  # the extension is taken once for each path
            F.sum("churn").alias("churn"), F.coalesce(F.sum("micro"), F.lit(0)).alias("micro"), F.min("first").alias("first"), F.max("last").alias("last")
        )

    def cache(self) -> History:
        """Keeps the frames that most statistics read. For sessions that ask for several."""
        for df in self._kept():
            df.cache()
        return self

    def uncache(self) -> None:
        for df in self._kept():
            df.unpersist()

    def _kept(self) -> list[DataFrame]:
        return [self.commits, self.parents, self.touches, self.distinct_commits, self.file_dev, self.path_facts]
