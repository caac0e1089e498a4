"""Histories that grow: JSON lines read as a stream into a typed Parquet store, and activity over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chronolith.functions.scalars import utc_time
from chronolith.plans.history import History
from chronolith.schema import CORRUPT, RECORD, Options
from chronolith.sources import jsonl


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Adds the records of files that are new in `source` to `store`; what was read is kept in `checkpoint`.

    Each batch is a folder of its own, by type of record, and is written over if it is run again: a run that was cut
    short or replayed adds nothing twice. Lines that are no record stay there as well (quarantine()). `ord` goes on over
    batches: first the batch, then the place in it.
    """
    schema = T.StructType(RECORD.fields + [T.StructField(CORRUPT, T.StringType())])
    raw = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(source)
    lines = raw.select("*", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"))

    def add(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, store, jsonl.repo_names([source])[0])

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, number: int, store: str, repo: str) -> None:
    """One batch of raw lines (with part and block, where they stood) as a folder of the store, in place of what the folder held."""
    place = F.struct(F.lit(0).alias("file"), F.lit(number).cast("bigint").alias("batch"), "part", "block", F.monotonically_increasing_id().alias("line"))
    rows = jsonl.typed(batch.select("*", F.lit(repo).alias("repo"), place.alias("ord")))
    rows.write.mode("overwrite").partitionBy("type").parquet(f"{store}/batch={number}")


STORED = (
    "type string, repo string, ord struct<file: int, batch: bigint, part: string, block: bigint, line: bigint>, sha string, name string, email string, ts timestamp_ntz, ts_local timestamp_ntz, additions bigint, deletions bigint, "
    "files_changed bigint, message string, status string, previous string, current string, wrong string, batch bigint"
)


def _stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(store).drop("batch")


def read(spark: SparkSession, store: str, options: Options = Options()) -> History:
    """The history of all batches so far: that of the same lines read at once, in the order of their batches."""
    return jsonl.history_of(_stored(spark, store), options)


def quarantine(spark: SparkSession, store: str) -> DataFrame:
    """(batch, file, wrong): the lines that are no JSON object or have a field of another type; no statistic reads them."""
    return _stored(spark, store).where("type = 'bad'").select(F.col("ord.batch").alias("batch"), F.col("ord.part").alias("file"), "wrong")


def activity(records: DataFrame, every: str = "1 day", late: str = "7 days") -> DataFrame:
    """Commits and lines by event time of a stream of records; commits later than `late` are dropped."""
    commits = records.where("type = 'commit'").select(utc_time(F.col("author_date")).cast("timestamp").alias("ts"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))
    commits = commits.where("ts IS NOT NULL").withWatermark("ts", late)
    return commits.groupBy(F.window("ts", every).alias("window")).agg(F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
