"""Runs of neighbouring rows over a whole input, without a task that sees it all.

The rows of an input are cut into chunks of neighbours, and shuffled once, by chunk. Inside a chunk each row is compared with
the one before it, and the rows of a run become one row. Only a chunk's first and last run can go on in another chunk: a row
for each chunk, with its first and last key, tells which ones do. So only chunks' ends are put in one order, never the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.plans.checkpoints import written

#: A chunk holds 2^CHUNK_BITS lines of a split of the input, or places of a plain number `ord`.
CHUNK_BITS = 16
#: Numbers of splits are broadcast, if there are no more splits than this.
SPLITS = 100_000
CHUNK = ("input", "split", "chunk")


def _placed(rows: DataFrame) -> DataFrame:
    """`rows` with input, split and chunk, numbers in the order of the input, and their place `at` in the chunk, in `ord`'s stead.

    The splits' names, which are long, are numbered first, so that no shuffle or sort of rows carries them.
    """
    kind, others = rows.schema["ord"].dataType, [c for c in rows.columns if c != "ord"]
    inside = lambda line: (F.shiftright(line, CHUNK_BITS).alias("chunk"), line.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).alias("at"))
    if not isinstance(kind, T.StructType):
        return rows.select(F.lit(0).alias("input"), F.lit(0).alias("split"), *inside(F.col("ord").cast("bigint")), *others)
    names = [c for c in ("batch", "part", "block") if c in kind.names]
    split = F.struct(*(f"ord.{c}" for c in names))
    number = F.row_number().over(Window.partitionBy("of").orderBy("name"))  # a row for each split
    splits = written(rows.select(F.col("ord.file").alias("of"), split.alias("name")).distinct().withColumn("split", number))
    numbers = F.broadcast(splits) if splits.count() <= SPLITS else splits
    placed = rows.withColumns({"input": F.col("ord.file"), "named": split})
    placed = placed.join(numbers, (placed["input"] == numbers["of"]) & (placed["named"] == numbers["name"]), "left")
    return placed.select("input", "split", *inside(F.col("ord.line")), *others)


def pieces(rows: DataFrame, key: str, by: list[str], value: str) -> DataFrame:
    """One row for each run of equal keys inside a chunk, by `ord` inside each input: input, split, chunk; place, the run's number
    in its chunk, and last, that of the chunk's last run; the key; members, the distinct `by` with the sum of `value` of each;
    n and total, their number and sum.

    A plain number `ord` is one input; rows of equal `ord` stand in the order of their keys. Keys are not null. Written once.
    """
    inside = Window.partitionBy(*CHUNK).orderBy("at", key)
    first = (F.coalesce(F.lag(key).over(inside) != F.col(key), F.lit(True))).cast("bigint")
    upto, whole = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    placed = _placed(rows).withColumn("first", first).withColumns({"place": F.sum("first").over(upto), "last": F.sum("first").over(whole)})
    run = [*CHUNK, "place", "last", key]
    members = placed.groupBy(*run, *by).agg(F.sum(value).alias(value))
    return written(members.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.collect_list(F.struct(*by, value)).alias("members")))  # rows of one chunk at most


def complete(found: DataFrame) -> DataFrame:
    """The pieces that are whole runs: those between their chunk's first and last one."""
    return found.where("place > 1 AND place < last")


def ends(found: DataFrame, key: str) -> DataFrame:
    """(input, run, members) of all other pieces; those of one run have its number."""
    outer = found.where("place = 1 OR place = last")
    chunks = outer.groupBy(*CHUNK).agg(F.min_by(key, "place").alias("starts"), F.max_by(key, "place").alias("stops"), F.max("last").alias("runs"))
    order = Window.partitionBy("input").orderBy("split", "chunk")  # a row for each chunk
    goes_on = F.coalesce(F.lag("stops").over(order) == F.col("starts"), F.lit(False)).cast("bigint")
    before = F.sum(F.col("runs") - F.col("goes_on")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = chunks.withColumn("goes_on", goes_on).select(*CHUNK, (F.coalesce(before, F.lit(0)) - F.col("goes_on")).alias("offset"))
    return outer.join(offsets, list(CHUNK)).select("input", (F.col("offset") + F.col("place")).alias("run"), "members")
