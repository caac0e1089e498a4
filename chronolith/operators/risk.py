"""Churn risk: recent change, age, trend and ownership put together in one label for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.scalars import epoch, round_k
from chronolith.operators.ownership import bus_factors
from chronolith.plans.checkpoints import checkpointed
from chronolith.plans.history import History
from chronolith.plans.ordered import running
from chronolith.schema import ACTIVE_BUS_FACTOR, COLD_RATIO, DECLINING_FLOOR, DECLINING_TREND, MIN_SAMPLE, OLD_AGE_DAYS, RISK_LABELS


def _ranks(files: DataFrame) -> DataFrame:
    """(measure, v, n, below, total) of the distinct ages, trends and positive recent changes: how many files have a smaller value, and how many have one."""
    positive = F.when(F.col("recent") > 0, F.col("recent"))
    stacked = F.stack(F.lit(3), F.lit("age"), F.col("age").cast("double"), F.lit("trend"), F.col("trend"), F.lit("recent"), positive).alias("measure", "v")
    counts = files.select(stacked).where("v IS NOT NULL").groupBy("measure", "v").agg(F.count(F.lit(1)).alias("n"))
    return running(counts, "v", ["n"], ["measure"]).select("measure", "v", "n", F.col("n_before").alias("below"), F.col("n_all").alias("total"))


def _nth(measure: str, rank: Column) -> Column:
    """An aggregate over _ranks(): the value of the file with this rank (from 1) among all; null without files."""
    return F.max(F.when((F.col("measure") == measure) & (F.col("below") < rank) & (F.col("below") + F.col("n") >= rank), F.col("v")))


def _measured(h: History) -> DataFrame:
    """One row for each file: recent, first, last, changes, age, trend, bus factor (1 at least)."""
    files = h.file_facts.crossJoin(F.broadcast(h.bounds.drop("earliest")))  # one row
    trend = (
        F.when((F.col("oldest") >= F.col("cutoff")) | F.col("first").isNull(), 1.0)
        .when(F.col("earlier") == 0, F.when(F.col("later") == 0, 1.0).otherwise(2.0))
        .when(F.col("later") == 0, 0.0).otherwise(F.col("later") / F.col("earlier"))
    )
    age = F.coalesce(F.floor((epoch(F.col("latest")) - epoch(F.col("first"))) / 86400), F.lit(0)).cast("bigint")
    owners = bus_factors(h.authored, "file").select("file", "bus_factor")
    return files.join(owners, "file", "left").select(
        "file", (F.col("micro") / 1e6).alias("recent"), F.col("commits").alias("total_changes"), "first", "last", age.alias("age"), trend.alias("trend"),
        F.greatest(F.coalesce("bus_factor", F.lit(1)), F.lit(1)).alias("bus_factor"),
    )


def labelled(h: History) -> DataFrame:
    """Every file with its measures, label and percentile ranks (null with fewer than MIN_SAMPLE files).

    Thresholds are medians and percentiles by rank. They are taken over distinct values with their counts, in ranges
    (see running()), so no task puts all values in order. Kept with the history: lists, counts and gates share it.
    """
    if "labelled" not in h.kept:
        h.kept["labelled"] = checkpointed(_labelled(checkpointed(_measured(h))))  # the measures are read some ten times
    return h.kept["labelled"]


def _labelled(files: DataFrame) -> DataFrame:
    ranks = checkpointed(_ranks(files))
    rank = lambda p: F.greatest(F.lit(1), F.floor((F.col("total") * p + 99) / 100))
    thresholds = ranks.agg(
        _nth("recent", F.floor(F.col("total") / 2) + 1).alias("median"),  # the upper one
        _nth("age", rank(75)).alias("p75"), _nth("trend", rank(25)).alias("p25"), F.coalesce(F.max(F.when(F.col("measure") == "age", F.col("total"))), F.lit(0)).alias("sample"),
    )
    bands = thresholds.select(
        (F.coalesce("median", F.lit(0.0)) * COLD_RATIO).alias("low"),
        F.when(F.col("sample") < MIN_SAMPLE, OLD_AGE_DAYS).otherwise(F.col("p75")).alias("old"),
        F.when(F.col("sample") < MIN_SAMPLE, DECLINING_TREND).otherwise(F.greatest("p25", F.lit(DECLINING_FLOOR))).alias("declining"),
        "sample",
    )
    of = lambda m: ranks.where(F.col("measure") == m).select(F.col("v").alias(f"{m}_value"), F.col("below").alias(f"{m}_below"))
    ranked = files.join(of("age"), F.col("age").cast("double") == F.col("age_value")).join(of("trend"), F.col("trend") == F.col("trend_value")).crossJoin(F.broadcast(bands))  # one row
    label = (
        F.when(F.col("recent") <= F.col("low"), "cold").when(F.col("bus_factor") >= ACTIVE_BUS_FACTOR, "active").when(F.col("age") < F.col("old"), "active-core")
        .when(F.col("trend") < F.col("declining"), "fading-silo").otherwise("silo")
    )
    percentile = lambda c: F.when(F.col("sample") >= MIN_SAMPLE, F.floor(F.col(c) * 100 / F.col("sample")).cast("int"))
    return ranked.withColumns({"label": label, "age_percentile": percentile("age_below"), "trend_percentile": percentile("trend_below")})


def churn_risk(h: History, n: int = 10) -> DataFrame:
    """Files by label (most urgent first), recent change, bus factor and path."""
    priority = F.array_position(F.array(*(F.lit(x) for x in RISK_LABELS)), F.col("label"))
    rows = labelled(h).select(
        F.col("file").alias("path"), "label", round_k(F.col("recent"), 1).alias("recent_churn"), round_k(F.col("recent") / F.col("bus_factor"), 1).alias("risk_score"), round_k(F.col("trend"), 2).alias("trend"),
        "bus_factor", "total_changes", F.col("age").alias("age_days"), F.coalesce(F.date_format("first", "yyyy-MM-dd"), F.lit("")).alias("first_change"), F.coalesce(F.date_format("last", "yyyy-MM-dd"), F.lit("")).alias("last_change"),
        "age_percentile", "trend_percentile",
    )
    ranked = rows.orderBy(priority, F.desc("recent_churn"), "bus_factor", "path")
    return ranked.limit(n) if n > 0 else ranked


def label_counts(h: History) -> DataFrame:
    """How many files bear each label, in the labels' order; absent labels are left out."""
    priority = F.array_position(F.array(*(F.lit(x) for x in RISK_LABELS)), F.col("label"))
    return labelled(h).groupBy("label").agg(F.count(F.lit(1)).alias("files")).orderBy(priority)
