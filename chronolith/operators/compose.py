"""Commands put together from statistics: period comparison and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.ownership import bus_factor
from chronolith.operators.ranking import summary
from chronolith.operators.risk import churn_risk
from chronolith.plans.history import History

METRICS = ("total_commits", "total_devs", "total_files", "total_additions", "total_deletions")


def diff(a: History, b: History) -> DataFrame:
    """(metric, period_a, period_b, delta) of the summaries of two periods."""
    pair = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(m).alias("metric"), F.col(m).alias("value")) for i, m in enumerate(METRICS)))).alias("x")
    left, right = (summary(h).select(pair).select("x.*") for h in (a, b))
    rows = left.withColumnRenamed("value", "period_a").join(right.withColumnRenamed("value", "period_b"), ["at", "metric"])
    return rows.orderBy("at").select("metric", "period_a", "period_b", (F.col("period_b") - F.col("period_a")).alias("delta"))


def joined_devs(devs: F.Column) -> F.Column:
    """The first three, and how many more."""
    more = F.when(F.size(devs) > 3, F.format_string(" +%d", F.size(devs) - 3)).otherwise("")
    return F.concat(F.array_join(F.slice(devs, 1, 3), ", "), more)


def gates(h: History, max_bus_factor: int = 0, max_risk: float = 0.0) -> DataFrame:
    """(file, rule, message, level): files with a bus factor up to, or a rounded risk from, the thresholds; 0 turns a gate off."""
    empty = h.commits.sparkSession.createDataFrame([], "file string, rule string, message string, level string, gate int, at bigint")
    rows = empty
    if max_bus_factor > 0:
        low = bus_factor(h, 0).where(F.col("bus_factor") <= max_bus_factor)
        rows = rows.unionByName(low.select(F.col("path").alias("file"), F.lit("busfactor").alias("rule"), F.format_string("Bus factor %d (only %s)", "bus_factor", joined_devs(F.col("top_devs"))).alias("message"), F.lit("warning").alias("level"), F.lit(0).alias("gate"), F.col("bus_factor").cast("bigint").alias("at")))
    if max_risk > 0:
        high = churn_risk(h, 0).where(F.col("risk_score") >= max_risk)
        rows = rows.unionByName(high.select(F.col("path").alias("file"), F.lit("churn-risk").alias("rule"), F.format_string(f"Churn risk %.1f exceeds threshold {max_risk:.0f}", "risk_score").alias("message"), F.lit("warning").alias("level"), F.lit(1).alias("gate"), F.lit(0).cast("bigint").alias("at")))
    return rows.orderBy("gate", "at", "file").select("file", "rule", "message", "level")
