"""Partial states of a history by month, which merge: sets as words of bits, sums and dates beside them.

Developers and files get numbers. A set of them is held as rows (word, bits), 64 numbers a row, so that a union is a
`bit_or` of longs, which every aggregation does before its shuffle, and its size a sum of `bit_count`. A set of few members
costs a row a member, a dense one 64 times less; files are numbered in the order of their paths, so members that lie in one
directory share words. Days of a month are the bits of one long. Any run of months is then answered from its months'
folders, without the records.

A state is made of parts: what add() is given. Parts hold disjoint records and may share developers, files and months; each
numbers only those that no part before it knows. The last part may be written again and takes the place of what it was; a
part that was cut off is not read.

What is counted is as a history has it, with these rules: file rows carry the date of the last row of their commit (a commit
that stands in the input with several dates counts in the month of its last); rows of commits without a date belong to every
run of months, those of no commit to the whole alone; paths, and the extensions that a file ever had, are those of the whole
part, so only a first part may hold renames; lines are not negative. Null emails are no developers; an empty history adds none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.scalars import dirname, extension
from chronolith.plans.history import History
from chronolith.plans.together import together

#: Months of rows that have none, as in the store.
UNDATED, ORPHAN = "undated", "orphan"
_BITS = "word bigint, bits bigint"
_RANGE = "first timestamp_ntz, last timestamp_ntz"
#: A place in the input, of whatever source: the fields that its `ord` may have, in the order that they count.
_PLACE = "struct<file: int, batch: bigint, part: string, block: bigint, line: bigint>"
STATES = {
    "people": f"email string, name string, place {_PLACE}, commits bigint, additions bigint, deletions bigint, days bigint, {_RANGE}",
    "dev_files": f"dev bigint, {_BITS}",
    "exts": f"ext string, churn bigint, {_RANGE}",
    "ext_files": f"ext string, {_BITS}",
    "ext_devs": f"ext string, {_BITS}",
    "dirs": "dir string, file_touches bigint, churn bigint",
    "dir_files": f"dir string, {_BITS}",
    "dir_lines": "dir string, dev bigint, lines bigint",
}
NUMBERS = {"devs": "email", "files": "file"}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{schema}, part int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def parts(spark: SparkSession, folder: str) -> int:
    """How many parts a state has: those written to their end."""
    ended = _read(spark, f"{folder}/ended", "months bigint")
    last = ended.agg(F.max("part")).first()[0] if ended is not None else None
    return 0 if last is None else last + 1


def add(h: History, folder: str, part: int | None = None) -> int:
    """Adds a history, which the return value numbers. part: the number that is expected; that of the last part writes it again."""
    spark = h.commits.sparkSession
    held = parts(spark, folder)
    part = held if part is None else part
    if part not in (held, held - 1) or part < 0:
        raise ValueError(f"part {part} of a state of {held}: only the last can be written again, or the next")
    if part and h.canonical is not None:
        raise ValueError("a part with renames must be the first: it would change the names of files that earlier parts counted")
    facts = h.touches.groupBy(_month(F.col("ts"), F.col("known")), "file", "path", "email", "known").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("touches"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    facts = facts.persist()  # read for the numbers, then for every state
    try:
        for table, column in NUMBERS.items():
            people = h.commits.select("email").unionAll(facts.select("email")) if column == "email" else facts.select("file")
            _number(people.where(F.col(column).isNotNull()).distinct(), folder, table, column, part)
        dev, file = (numbers(spark, folder, t, part + 1) for t in NUMBERS)
        rows = facts.join(file.withColumnRenamed("id", "file_id"), "file").join(dev.withColumnRenamed("id", "dev"), "email", "left").persist()
        try:
            together(spark, {name: lambda name=name, state=state: _write(state, name, f"{folder}/{name}/part={part}") for name, state in _states(h, rows).items()})
        finally:
            rows.unpersist()
    finally:
        facts.unpersist()
    spark.read.schema(f"{STATES['people']}, month string").parquet(f"{folder}/people/part={part}").agg(F.count_distinct("month").alias("months")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ended/part={part}")
    return part


def _write(state: DataFrame, name: str, folder: str) -> None:
    state = state.select(*T.DataType.fromDDL(STATES[name]).names, "month")
    state.repartitionByRange("month", state.columns[0]).write.mode("overwrite").partitionBy("month").parquet(folder)


def _month(ts: Column, known: Column | bool = True) -> Column:
    return F.when(F.lit(known), F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(UNDATED))).otherwise(ORPHAN).alias("month")


def _number(keys: DataFrame, folder: str, table: str, column: str, part: int) -> None:
    """Numbers the keys that no earlier part has, in their order. Each task counts its own range up from a start of its own,
    so no task sees all keys; numbers have gaps between ranges only."""
    start = 0
    if part:
        earlier = numbers(keys.sparkSession, folder, table, part)
        newest = earlier.agg(F.max("id")).first()[0]
        start = 0 if newest is None else (newest // 64 + 1) * 64
        keys = keys.join(earlier, column, "left_anti")
    keys.repartitionByRange(column).sortWithinPartitions(column).withColumn("id", F.monotonically_increasing_id() + F.lit(start)).write.mode("overwrite").parquet(f"{folder}/{table}/part={part}")


def numbers(spark: SparkSession, folder: str, table: str, held: int | None = None) -> DataFrame:
    """(email or file, id) of the first `held` parts; of all that are read, by default."""
    held = parts(spark, folder) if held is None else held
    return _read(spark, f"{folder}/{table}", f"{NUMBERS[table]} string, id bigint").where(F.col("part") < held).drop("part")


def _set(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The members of each key and month, as words of bits."""
    bit = F.expr(f"shiftleft(1L, cast({member} & 63 AS int))")
    return rows.where(F.col(member).isNotNull()).groupBy("month", key, F.shiftright(member, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _states(h: History, rows: DataFrame) -> dict[str, DataFrame]:
    ord_type = h.commits.schema["ord"].dataType
    held = {name: F.col(f"ord.{name}") for name in ord_type.names} if isinstance(ord_type, T.StructType) else {"line": F.col("ord")}
    place = F.struct(*(held.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.DataType.fromDDL(_PLACE).fields))
    first = F.min_by(F.struct("name", place.alias("place")), "ord")
    people = h.commits.groupBy("email", _month(F.col("ts"))).agg(
        first.alias("x"), F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.coalesce(F.bit_or(F.expr("shiftleft(1L, dayofmonth(ts))")), F.lit(0)).alias("days"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    return {"people": people.select("*", "x.name", "x.place")} | _file_states(h, rows)


def _file_states(h: History, rows: DataFrame) -> dict[str, DataFrame]:
    known, changed = rows.where("known"), rows.where("known AND lines > 0 AND dev IS NOT NULL")
    by_ext, by_dir = rows.withColumn("ext", extension(F.col("path"))), rows.withColumn("dir", dirname(F.col("file")))
    owned = changed.withColumn("dir", dirname(F.col("file")))
    if h.canonical is None:
        makers = changed.withColumn("ext", extension(F.col("path")))
    else:  # developers of a file count for all extensions that it had
        makers = changed.select("month", "file_id", "dev").join(by_ext.select("file_id", "ext").distinct(), "file_id")
    return {
        "dev_files": _set(known.where("dev IS NOT NULL"), "dev", "file_id"),
        "exts": by_ext.groupBy("month", "ext").agg(F.sum("lines").alias("churn"), F.min("first").alias("first"), F.max("last").alias("last")),
        "ext_files": _set(by_ext, "ext", "file_id"),
        "ext_devs": _set(makers, "ext", "dev"),
        "dirs": by_dir.groupBy("month", "dir").agg(F.sum("touches").alias("file_touches"), F.sum("lines").alias("churn")),
        "dir_files": _set(by_dir, "dir", "file_id"),
        "dir_lines": owned.groupBy("month", "dir", "dev").agg(F.sum("lines").alias("lines")),
    }


@dataclass(frozen=True)
class Merged:
    """The state in a folder, of all months or of those from `since` to `until` (yyyy-MM, both included)."""

    spark: SparkSession
    folder: str
    since: str = ""
    until: str = ""

    def state(self, name: str) -> DataFrame:
        """The rows of a state: of the months asked for, whose folders alone are opened."""
        rows = _read(self.spark, f"{self.folder}/{name}", f"{STATES[name]}, month string")
        if rows is None:
            raise FileNotFoundError(f"no state in {self.folder}")
        rows = rows.where(F.col("part") < parts(self.spark, self.folder))
        if self.since or self.until:
            dated = ~F.col("month").isin(UNDATED, ORPHAN)
            if self.since:
                dated = dated & (F.col("month") >= self.since)
            if self.until:
                dated = dated & (F.col("month") <= self.until)
            rows = rows.where(dated | (F.col("month") == UNDATED))
        return rows

    def sizes(self, name: str, size: str) -> DataFrame:
        """(key, size): members of the union over months and parts, for each key of a set."""
        rows, key = self.state(name), STATES[name].split(" ")[0]
        return rows.groupBy(key, "word").agg(F.bit_or("bits").alias("bits")).groupBy(key).agg(F.sum(F.bit_count("bits")).cast("bigint").alias(size))
