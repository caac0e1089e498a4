"""Sharding by jump consistent hashing, in DataFrame functions only.

The shard of a document depends on its ``doc_id`` and on the number of shards, on nothing else, so one
more shard takes about 1/(n+1) of the keys and no key moves between the shards that were there before.

Jump hashing draws from a 64-bit linear congruential generator that is seeded with the key. Its products
need 127 bits; they are taken in DECIMAL(38), reduced modulo 2^64, so ANSI arithmetic never overflows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import saved, spread, table

#: Fixed values of the published algorithm.
MULTIPLIER = Decimal(2862933555777941757)
TWO_31 = 2147483648
TWO_33 = Decimal(8589934592)
TWO_64 = Decimal(18446744073709551616)

SHARDS = 24
#: A run of equal rows is dealt out in pieces of so many.
PIECE = 65_536
#: Each shard's documents are numbered in this many independent ranges, so no task numbers a whole shard.
SLOT_RANGES = 2048


def jump_hash(key: Column, shards: int) -> Column:
    """Jump consistent hash of a BIGINT key (negative keys as unsigned; null as 0) into 0 .. shards-1."""
    unsigned = F.coalesce(key.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    unsigned = F.when(unsigned < 0, unsigned + F.lit(TWO_64).cast("decimal(38,0)")).otherwise(unsigned).cast("decimal(20,0)")
    start = F.named_struct(F.lit("b"), F.lit(-1).cast("bigint"), F.lit("j"), F.lit(0).cast("bigint"), F.lit("k"), unsigned)

    def step(state: Column, _: Column) -> Column:
        # decimal(20) x decimal(19) is exact in decimal(38): keys stay below 2^64, the multiplier below 2^62
        drawn = (
            (state["k"].cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"))
            .cast("decimal(38,0)") % F.lit(TWO_64).cast("decimal(20,0)")
        ).cast("decimal(20,0)")
        high = F.floor(drawn.cast("decimal(20,0)") / F.lit(TWO_33).cast("decimal(10,0)")).cast("bigint")
        ratio = F.lit(float(TWO_31)) / (high + 1).cast("double")
        jumped = F.floor((state["j"] + 1).cast("double") * ratio).cast("bigint")
        moved = F.named_struct(F.lit("b"), state["j"], F.lit("j"), jumped, F.lit("k"), drawn)
        return F.when(state["j"] < shards, moved).otherwise(state)

    # every draw moves j forward by one at least, so `shards` draws always suffice
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda state: state["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slot_ranges: int = SLOT_RANGES) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text (null: 0) plus 8; ``text_crc32`` the unsigned CRC-32 of its bytes
    (null: of no bytes, 0). ``slot`` numbers a shard's rows from 0 without gaps. ``grown_shard`` is the shard
    under one more shard: the same, or the new one.

    Rows that agree in id, size and checksum are interchangeable: they are counted before the shuffle and
    share one run of slots, so a key that holds a third of all rows is one row from there on; longer runs are cut
    into pieces of PIECE slots, which are dealt over all tasks before their rows are written out. Null ids count
    as key 0 and keep their null id; an empty table gives no rows; other columns are not read, so clashing
    names do no harm. Empty texts have size 8.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    distinct = (
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("shard", jump_hash(F.col("doc_id"), shards))
        .withColumn("range", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slot_ranges)).cast("int"))
    )
    distinct = saved(distinct)  # the input is read once; what follows reads four short columns
    held = distinct.groupBy("shard", "range").agg(F.sum("n").alias("held"))  # shards x ranges rows at most
    before = held.select("shard", "range", (F.sum("held").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"))
    order = Window.partitionBy("shard", "range").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    first = (F.col("before") + F.sum("n").over(order) - F.col("n")).alias("first")
    placed = distinct.join(before, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", "n", first)
    many = F.col("n") > PIECE
    pieces = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(PIECE).cast("bigint"))
    at = placed.where(many).withColumn("from", F.explode(pieces)).select(
        "doc_id", "size", "text_crc32", "shard", F.least(F.lit(PIECE), F.col("n") - F.col("from")).alias("n"), (F.col("first") + F.col("from")).alias("first")
    )
    return placed.where(~many).unionByName(spread(at)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 23 by jump consistent hashing of doc_id."""
    return shard_documents(table(spark, sf_dir, "documents"))
