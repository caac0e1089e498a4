"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_training(doc_id: Column) -> Column:
    """True for the rows that a learner may see: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)) != 2


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir where the cluster names one.

    Where the setting is absent, local mode (tests) gets a folder of its own; on a cluster that is an error, since
    executors would not see a folder of the driver's machine.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: With it Spark removes a query's shuffle files when the query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of saved() that are still there, by open scope.
_scopes: list[list[DataFrame]] = [[]]


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    _scopes[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of saved() that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        for scope in _scopes:
            scope[:] = [x for x in scope if x is not table]


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are saved inside go when the block ends: what the block returns must be saved outside of it, or by result()."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes[-1])
        _scopes.pop()


def result(df: DataFrame) -> DataFrame:
    """saved(), for what a scratch() block hands on: it stays when the block ends."""
    table = saved(df)
    _scopes[-2 if len(_scopes) > 1 else -1].append(_scopes[-1].pop())
    return table


def clear() -> None:
    """Removes the tables that are left once a query's rows have been read or written; queries over them are void then."""
    discard(*_scopes[0])


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's shuffle partitions, without a key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: A side of a join is broadcast if it has been measured to hold no more bytes.
BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, row_bytes: Column | int = 64) -> DataFrame:
    """`df`, which is saved, marked for broadcast if its rows hold BROADCAST_BYTES at most; else both sides are shuffled."""
    held = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def pieces(batches: Iterator[pd.Series], rows: int = 512) -> Iterator[pd.Series]:
    """Slices of the batches, so that a Python worker holds the results of few rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]
