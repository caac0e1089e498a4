"""Running sums over all rows in one order, without a task that sees them all.

Keys are dealt into ranges at cut points; sums of whole ranges are put in order first (a row for each range), then
the rows inside each range, every range in a task of its own. The cut points are a bounded sample of the keys, taken
by hash: they change how even the ranges are, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most; the session's shuffle partitions, if these are fewer.
RANGES = 512


def cut_points(rows: DataFrame, key: str) -> list:
    """Some keys in order, as many as there are ranges at most."""
    many = min(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = rows.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(many - 1).collect() if many > 1 else []
    return sorted({r[0] for r in sample})


def range_of(key: Column, cuts: list) -> Column:
    """How many cut points lie below the key, by a balanced tree of comparisons."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key > F.lit(cuts[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(cuts))


def running(rows: DataFrame, key: str, sums: list[str], by: list[str] | None = None, descending: bool = False, broadcast: bool = True) -> DataFrame:
    """`rows`, whose keys differ, with <name>_before (the sum of all rows before) and <name>_all for each of `sums`.

    With `by`, every group of these columns is an order of its own; the groups share their cut points. `broadcast` is for
    groups whose number is bounded; without it the sums of ranges meet their rows in a join by group and range.
    """
    by = by or []
    part = range_of(F.col(key), cut_points(rows, key))
    ranged = rows.withColumn("part", -part if descending else part)
    held = ranged.groupBy(*by, "part").agg(*(F.sum(s).alias(s) for s in sums))  # RANGES rows for each group at most, whatever the input
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*by, "part", *(F.coalesce(F.sum(s).over(upto), F.lit(0)).alias(f"{s}_offset") for s in sums), *(F.sum(s).over(whole).alias(f"{s}_all") for s in sums))
    inside = Window.partitionBy(*by, "part").orderBy(F.desc(key) if descending else F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({f"{s}_inside": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).join(F.broadcast(offsets) if broadcast else offsets, [*by, "part"])
    return placed.select(*rows.columns, *((F.col(f"{s}_offset") + F.col(f"{s}_inside")).alias(f"{s}_before") for s in sums), *(f"{s}_all" for s in sums))
