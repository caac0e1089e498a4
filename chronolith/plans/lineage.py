"""Renamed files under one canonical path.

Rename rows give edges old -> new, dated by their commit. An edge of an old path that was used again is dropped:
if the path has several edges and is no rename's target, or if it was changed after the last edge that touches
it. Of the rest the newest edge of each path counts. The canonical path is the end of the chain; on a cycle each
node is its own end, and a chain that enters a cycle ends at its entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.plans.checkpoints import checkpointed

#: Chains over up to so many edges are followed on the driver; beyond it by doubling in joins.
DRIVER_EDGES = 100_000


def surviving_edges(touches: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(path, next): at most one edge for each path. `used`: dates (path, ts) that hold each path's last, if there are fewer rows of them than touches."""
    edges = touches.where("status LIKE 'R%' AND old_path <> '' AND new_path <> '' AND old_path <> new_path").select("old_path", "new_path", "ts", "ord")
    edges = checkpointed(edges)  # few beside the touches, and read four times
    if not edges.limit(1).count():
        return edges.select(F.col("old_path").alias("path"), F.col("new_path").alias("next"))
    used = (touches if used is None else used).groupBy("path").agg(F.max("ts").alias("changed"))
    targets = edges.select(F.col("new_path").alias("old_path"), F.lit(True).alias("target")).distinct()
    sides = edges.select(F.col("old_path").alias("p"), "ts").unionAll(edges.select(F.col("new_path").alias("p"), "ts"))
    last_edge = sides.groupBy(F.col("p").alias("old_path")).agg(F.max("ts").alias("last_edge"))
    newest = Window.partitionBy("old_path").orderBy(F.col("ts").desc_nulls_last(), "ord")
    ranked = edges.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("old_path"))).withColumn("rank", F.row_number().over(newest)).where("rank = 1")
    joined = ranked.join(targets, "old_path", "left").join(last_edge, "old_path", "left").join(used.withColumnRenamed("path", "old_path"), "old_path", "left")
    reused = ((F.col("many") > 1) & F.col("target").isNull()) | F.coalesce(F.col("changed") > F.col("last_edge"), F.lit(False))
    return joined.where(~reused).select(F.col("old_path").alias("path"), F.col("new_path").alias("next"))


def follow(step: dict[str, str]) -> dict[str, str]:
    """The end of every chain; a chain that meets itself ends at the first node it meets twice."""
    ends = {}
    for start in step:
        seen, node = set(), start
        while node in step and node not in seen:
            seen.add(node)
            node = step[node]
        ends[start] = node
    return ends


def _doubled(step: DataFrame) -> DataFrame:
    """(path, next) moved at least as many steps as there are edges, or to an end."""
    at = checkpointed(step)
    for _ in range(max(1, at.count()).bit_length()):
        ahead = at.select(F.col("path").alias("next"), F.col("next").alias("far"))
        at = checkpointed(at.join(ahead, "next", "left").select("path", F.coalesce("far", "next").alias("next")))
    return at


def follow_distributed(step: DataFrame) -> DataFrame:
    """follow() in joins, whatever the number of edges. Moved far enough, what still has a next is on a cycle."""
    step = checkpointed(step)
    far = _doubled(step)
    ring = far.join(step.select(F.col("path").alias("next")), "next", "left_semi").select(F.col("next").alias("path")).distinct()
    ring = checkpointed(ring)
    return _doubled(step.join(ring, "path", "left_anti"))


def canonical_paths(touches: DataFrame, driver_edges: int = DRIVER_EDGES, used: DataFrame | None = None) -> DataFrame | None:
    """(path, canonical) of the paths that move; None if none does. `used` as in surviving_edges()."""
    step = surviving_edges(touches, used)
    head = step.limit(driver_edges + 1).collect()  # bounded by the parameter
    if not head:
        return None
    if len(head) > driver_edges:
        ends = follow_distributed(step)
        return ends.select("path", F.col("next").alias("canonical"))
    moved = [(p, c) for p, c in follow({r["path"]: r["next"] for r in head}).items() if p != c]
    if not moved:
        return None
    return F.broadcast(touches.sparkSession.createDataFrame(moved, "path string, canonical string"))
