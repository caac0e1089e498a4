"""A history as a store to ask repeatedly: typed Parquet, clustered by the month of the commits.

Dates are parsed when the store is written. Every file row and parent link carries its commit's date, so a window is a
filter on the scan of each table: folders of other months are not opened, and row groups of other days are skipped by their
bounds. No join with the commits is needed to find which rows are inside. File rows carry the author too; only those of commits
with several dates, with an unreadable one or of no commit (few) are joined with commits when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.plans.checkpoints import PARQUET, released
from chronolith.plans.history import History, with_authors
from chronolith.schema import Options
from chronolith.sources import jsonl

#: Months of rows that have none: of commits without a readable date; of no commit of the input; of commits that
#: stand in the input more than once, with several dates.
UNDATED, ORPHAN, MIXED = "undated", "orphan", "mixed"
_ORD = "struct<file: int, part: string, block: bigint, line: bigint>"
TABLES = {
    "commits": f"repo string, sha string, name string, email string, ts timestamp_ntz, ts_local timestamp_ntz, additions bigint, deletions bigint, files_changed bigint, message string, ord {_ORD}, month string",
    "files": f"repo string, sha string, ord {_ORD}, status string, previous string, current string, additions bigint, deletions bigint, ts timestamp_ntz, email string, month string",
    "parents": f"repo string, sha string, ord {_ORD}, ts timestamp_ntz, month string",
}

#: `authored`: file rows carry their author's email (null in stores that were written before they did).
INPUTS = "input int, repo string, authored boolean"

#: Where a row stands, as columns, and the columns of file rows in the order in which shuffled rows hold them: those of one length first,
#: the path last, so that rows differ in few places and pack well.
PLACE = ("file", "part", "block", "line")
CHILDREN = {"commit_file": ("files", ("file", "block", "line", "additions", "deletions", "same", "part", "sha", "status", "previous", "current")), "commit_parent": ("parents", ("file", "block", "line", "part", "sha"))}


@released()  # the typed records that it stages
def write(spark: SparkSession, paths: list[str] | str, folder: str) -> None:
    """Writes the inputs, in the order given, as a store. Malformed lines are an error; nothing is written then."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = jsonl.staged_rows(spark, paths)
    jsonl.check(rows)
    names = jsonl.repo_names(paths)
    repo = F.element_at(F.array(*map(F.lit, names)), F.col("ord.file") + 1).alias("repo")  # known by the input, so no shuffle carries it
    commits = rows.where("type = 'commit'").withColumn("month", F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit(UNDATED)))
    by_sha = commits.groupBy(F.col("ord.file").alias("input"), F.col("sha").alias("of")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.bool_or(F.col("ts").isNull()).alias("undated"), F.max_by("email", "ord").alias("email"))
    clustered = lambda df, *ord_: df.repartitionByRange("month", "ts", *ord_).sortWithinPartitions("month", "ts", *ord_)
    save = lambda df, table: df.withColumn("repo", repo).write.partitionBy("month").parquet(f"{folder}/{table}", compression=PARQUET)
    save(clustered(commits.select(*(c for c in jsonl.COMMIT if c != "repo"), "month"), "ord"), "commits")
    which = F.when(F.col("of").isNull(), ORPHAN).when(F.col("undated"), UNDATED).when(F.col("first") != F.col("last"), MIXED).otherwise(F.date_format("first", "yyyy-MM"))
    same = F.col("previous").eqNullSafe(F.col("current"))  # most files keep their path: the two shuffles carry it once
    for kind, (table, columns) in CHILDREN.items():
        children = rows.where(F.col("type") == kind).select("*", *(F.col(f"ord.{c}") for c in PLACE)).withColumns({"same": same, "previous": F.when(~same, F.col("previous"))}).select(*columns)
        dated = children.join(by_sha, (children["file"] == by_sha["input"]) & (children["sha"] == by_sha["of"]), "left")
        author = ["email"] if table == "files" else []
        placed = clustered(dated.select(F.when(~which.isin(UNDATED, ORPHAN, MIXED), F.col("first")).alias("ts"), *columns[:-1], *author, which.alias("month"), columns[-1]), *PLACE)
        if "same" in columns:
            placed = placed.withColumn("previous", F.when(F.col("same"), F.col("current")).otherwise(F.col("previous"))).drop("same")
        save(placed.withColumn("ord", F.struct(*PLACE)).drop(*PLACE), table)
    spark.createDataFrame([(i, name, True) for i, name in enumerate(names)], INPUTS).coalesce(1).write.parquet(f"{folder}/inputs")


def _months(options: Options) -> Column:
    """The months of a window, as a condition on the folders."""
    out = ~F.col("month").isin(UNDATED, ORPHAN, MIXED)
    if options.since:
        out = out & (F.col("month") >= options.since[:7])
    if options.until:
        out = out & (F.col("month") <= options.until[:7])
    return out


def read(spark: SparkSession, folder: str, options: Options = Options()) -> History:
    """The history of a store, as jsonl.load() has it of the same inputs: in a window, those of its commits and of commits without a date."""
    found = {t: spark.read.schema(schema).parquet(f"{folder}/{t}") for t, schema in TABLES.items()}
    inputs = spark.read.schema(INPUTS).parquet(f"{folder}/inputs").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("repos"), F.bool_and(F.coalesce("authored", F.lit(False))).alias("authored")).first()
    multi = inputs["n"] > 1
    if options.since or options.until:
        commits = found["commits"]
        kept = commits.where(_months(options) & jsonl.inside(options, F.col("ts"))).unionAll(commits.where(F.col("month") == UNDATED))
        keys = kept.select(F.col("ord.file").alias("input"), F.col("sha").alias("of")).distinct()

        def window(df: DataFrame) -> DataFrame:
            mixed = df.where(F.col("month") == MIXED)  # few: only these need their commits
            mixed = mixed.join(keys, (mixed["ord.file"] == keys["input"]) & (mixed["sha"] == keys["of"]), "left_semi")
            return df.where(_months(options) & jsonl.inside(options, F.col("ts"))).unionAll(df.where(F.col("month") == UNDATED)).unionAll(mixed)

        found = {"commits": kept} | {t: window(found[t]) for t in ("files", "parents")}
    h = jsonl.history(found["commits"].select(*jsonl.COMMIT), jsonl.file_rows(found["files"], multi, ("ts", "email", "month")), found["parents"].select("repo", "sha", "ord"), options, multi)
    if inputs["authored"] and inputs["repos"] == inputs["n"]:  # inputs of one name share their commits
        h.owned = _owned(h)
    h.files = h.files.drop("ts", "email", "month")
    return h


def _owned(h: History) -> DataFrame:
    """File rows with email, ts and known. Those without a month of their own get them from the commits that were read."""
    own = ~F.col("month").isin(UNDATED, ORPHAN, MIXED)
    rows = h.files.where(own).select("repo", "sha", "path", "status", "old_path", "new_path", "additions", "deletions", "email", "ts", F.lit(True).alias("known"), "ord")
    others = h.files.where(~own)
    return rows.unionAll(with_authors(others, h.commits)) if others.limit(1).count() else rows
