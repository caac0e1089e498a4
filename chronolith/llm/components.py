"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import discard, saved

#: With so many edges at most, a round sends the least neighbours of all nodes to the edges, which then stay where they are.
FEW = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps: the number of edges never grows, and the number of rounds is
    about the logarithm of a component's length. Each round is written to the shared folder, so lineage stays
    short and a lost executor costs one round at most. Stars are joined, never gathered: a hub is many rows.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = saved(edges)
    state = _state(edges)
    for _ in range(max_rounds if state[0] else 0):
        sent = F.broadcast if state[0] <= FEW else lambda x: x
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(sent(low), "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y")
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        following = saved(large.join(sent(small), "x").select(F.explode(F.array(F.struct(F.col("x").alias("b"), F.col("m").alias("a")), F.struct(F.col("y").alias("b"), F.col("m").alias("a")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        discard(edges)
        edges, before = following, state
        state = _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
