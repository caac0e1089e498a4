"""Statistics from the stored partial states of months: the same rows as a pass over the records gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.ownership import bus_factors
from chronolith.operators.ranking import day, top
from chronolith.plans.partials import NUMBERS, Merged, numbers


def contributors(m: Merged, n: int = 10) -> DataFrame:
    """As ranking.contributors(): days and files of a developer are sizes of unions of months."""
    months = m.state("people").groupBy("email", "month").agg(  # parts may share a month, and days in it
        F.min_by("name", F.struct("part", "place")).alias("name"), F.min(F.struct("part", "place")).alias("place"), *(F.sum(c).alias(c) for c in ("commits", "additions", "deletions")),
        F.bit_count(F.bit_or("days")).alias("days"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    people = months.groupBy("email").agg(
        F.min_by("name", "place").alias("name"), *(F.sum(c).alias(c) for c in ("commits", "additions", "deletions")), F.sum("days").cast("bigint").alias("active_days"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    files = m.sizes("dev_files", "files_touched").join(numbers(m.spark, m.folder, "devs").withColumnRenamed("id", "dev"), "dev")
    rows = people.join(files.select(NUMBERS["devs"], "files_touched"), "email", "left").select(
        "name", "email", "commits", "additions", "deletions", F.coalesce("files_touched", F.lit(0)).alias("files_touched"), "active_days", day("first").alias("first_date"), day("last").alias("last_date")
    )
    return top(rows, n, F.desc("commits"), "email")


def extensions(m: Merged, n: int = 10) -> DataFrame:
    """As ranking.extensions(), most churn first; without recent churn, whose decay hangs on the newest commit asked for."""
    sums = m.state("exts").groupBy("ext").agg(F.sum("churn").alias("churn"), F.min("first").alias("first"), F.max("last").alias("last"))
    rows = sums.join(m.sizes("ext_files", "files"), "ext").join(m.sizes("ext_devs", "unique_devs"), "ext", "left").select(
        "ext", "files", "churn", F.coalesce("unique_devs", F.lit(0)).alias("unique_devs"), day("first").alias("first_seen"), day("last").alias("last_seen")
    )
    return top(rows, n, F.desc("churn"), F.desc("files"), "ext")


def directories(m: Merged, n: int = 10) -> DataFrame:
    """As ranking.directories(): files are sizes of unions of months, lines of developers add up."""
    sums = m.state("dirs").groupBy("dir").agg(F.sum("file_touches").alias("file_touches"), F.sum("churn").alias("churn"))
    owners = bus_factors(m.state("dir_lines").groupBy("dir", F.col("dev").alias("email")).agg(F.sum("lines").alias("lines")), "dir").select("dir", F.col("devs").alias("unique_devs"), "bus_factor")
    rows = sums.join(m.sizes("dir_files", "files"), "dir").join(owners, "dir", "left").select(
        "dir", "file_touches", "churn", "files", F.coalesce("unique_devs", F.lit(0)).alias("unique_devs"), F.coalesce("bus_factor", F.lit(0)).alias("bus_factor")
    )
    return top(rows, n, F.desc("file_touches"), "dir")
