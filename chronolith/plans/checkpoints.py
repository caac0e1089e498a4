"""Cutting lineage with reliable checkpoints, and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders that the innermost released() block has handed out; each thread has its own.
_lent: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("lent", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, local mode (tests) gets one of its own; on a cluster it is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The path of a folder in the shared one that nobody has used."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if _lent.get() is not None:
        _lent.get().append((spark, folder))
    return folder


@contextmanager
def released() -> Iterator[None]:
    """Folders that new_folder() names inside are removed when the block ends, with an error too. What the block returns
    must not read them. Outside of such a block they stay."""
    before = _lent.set([])
    try:
        yield
    finally:
        lent = _lent.get()
        _lent.reset(before)
        for spark, folder in lent:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: How Parquet that this package writes is compressed: a third smaller than by the default.
PARQUET = "zstd"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once, as Parquet in the shared folder, and read from there."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder, compression=PARQUET)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
