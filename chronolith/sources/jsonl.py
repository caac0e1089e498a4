"""Reading histories from JSON lines: one scan, three typed frames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.scalars import local_time, utc_time
from chronolith.plans.checkpoints import PARQUET, new_folder
from chronolith.plans.history import History
from chronolith.schema import CORRUPT, RECORD, Options


class MalformedInput(ValueError):
    """A line of the input is no JSON object, or a field is of another type."""


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of the files, or folders of files, with repo (see repo_names()) and ord (place in the input).

    Each input is read by itself, so inputs may share a base name; the same path given twice is read twice.
    """
    schema = T.StructType(RECORD.fields + [T.StructField(CORRUPT, T.StringType())])
    records = None
    for i, (path, repo) in enumerate(zip(paths, repo_names(paths), strict=True)):
        raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)
        place = F.struct(F.lit(i).alias("file"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        one = raw.select("*", F.lit(repo).alias("repo"), place.alias("ord"))
        records = one if records is None else records.unionAll(one)
    return records


def repo_names(paths: list[str]) -> list[str]:
    """The base name of each input without its last extension."""
    return [re.sub(r"(?s)\.[^.]*$", "", p.rstrip("/").rsplit("/", 1)[-1]) for p in paths]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


#: Types that statistics read. Among typed records `bad` are lines that are no JSON object or have a field of another type, `other` all else.
TYPES = ("commit", "commit_file", "commit_parent")
#: Types of typed records, bad and other ones included; beyond that many values a task sorts its rows.
WRITERS, OPEN_FILES = 5, "spark.sql.maxConcurrentOutputFileWriters"


def typed(records: DataFrame, strict: bool = True) -> DataFrame:
    """Records with their fields in one form for all types, dates parsed; `wrong` is the text of a bad line.

    Missing keys are empty strings and zeros. strict: every field is parsed, so that none of another type goes unseen;
    otherwise a scan parses only what is asked for, and a bad line is a record of what could be read.
    """
    if strict:
        parsed = F.xxhash64(*RECORD.names).bitwiseAND(F.lit(1)) >= 0  # always, but keeps the scan from leaving fields out
        wrong = F.when(parsed & F.col(CORRUPT).isNotNull() & (F.trim(CORRUPT) != ""), F.col(CORRUPT))
        bad = F.when(wrong.isNotNull(), "bad")
    else:
        wrong, bad = F.lit(None).cast("string"), F.lit(None).cast("string")
    kind = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("other")
    is_commit = F.col("type") == "commit"
    return records.select(
        F.coalesce(bad, kind).alias("type"), "repo", "ord", F.when(F.col("type") == "commit_file", _text("commit")).otherwise(_text("sha")).alias("sha"),
        _text("author_name").alias("name"), _text("author_email").alias("email"), F.when(is_commit, utc_time(F.col("author_date"))).alias("ts"), F.when(is_commit, local_time(F.col("author_date"))).alias("ts_local"),
        _number("additions").alias("additions"), _number("deletions").alias("deletions"), _number("files_changed").alias("files_changed"), _text("message").alias("message"),
        _text("status").alias("status"), _text("path_previous").alias("previous"), _text("path_current").alias("current"), wrong.alias("wrong"),
    )


def check(rows: DataFrame) -> None:
    """Raises MalformedInput with the first bad line of typed rows and its place: record and line of the file."""
    bad = rows.where("type = 'bad'").select("wrong", "repo", "ord").orderBy("ord").take(1)
    if bad:
        raise MalformedInput(_fault(rows, bad[0]))


def _place(rows: DataFrame, place: Row) -> str:
    """Where a line stands: its number among the records of its split of the file, and its number in the file, blank lines included."""
    o, same = F.col("ord"), F.lit(True)
    for c in ("file", "part", "block"):
        if c in place.asDict():
            same = same & (o[c] == F.lit(place[c]))
    before = rows.select("ord", "type").where(same & (o["line"] <= F.lit(place["line"]))).count()  # blank lines are no records
    if "part" not in place.asDict():
        return f"record {before}, line {place['line'] + 1}"
    lines = rows.sparkSession.read.text(unquote(place["part"])).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    own = lines.where(F.col("block") == F.lit(place["block"]))
    full = own.where(~F.col("value").rlike(r"\A[ \t\r\n]*\z")).select("id").orderBy("id").limit(before).agg(F.max("id")).first()[0]
    number = lines.where((F.col("block") < F.lit(place["block"])) | ((F.col("block") == F.lit(place["block"])) & (F.col("id") <= F.lit(full)))).count()
    return f"record {before}" + (f" from byte {place['block']}" if place["block"] else "") + f", line {number}"


COMMIT = ("repo", "sha", "name", "email", "ts", "ts_local", "additions", "deletions", "files_changed", "message", "ord")


def file_rows(rows: DataFrame, multi: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """File rows of a history from typed ones, with the columns `more`, without those of no path. With several inputs every path is prefixed by `<repo>:`."""
    prefix = F.concat("repo", F.lit(":")) if multi else F.lit("")
    path = F.when(F.col("current") != "", F.col("current")).otherwise(F.col("previous"))
    files = rows.select("repo", "sha", path.alias("path"), "status", F.col("previous").alias("old_path"), F.col("current").alias("new_path"), "additions", "deletions", "ord", *more).where("path <> ''")
    return files.withColumns({c: F.when(F.col(c) != "", F.concat(prefix, F.col(c))).otherwise("") for c in ("path", "old_path", "new_path")})


def inside(options: Options, ts: Column) -> Column:
    """Within the window, both days included."""
    out = F.lit(True)
    if options.since:
        out = out & (ts >= F.lit(f"{options.since} 00:00:00").cast("timestamp_ntz"))
    if options.until:
        out = out & (ts <= F.lit(f"{options.until} 23:59:59").cast("timestamp_ntz"))
    return out


def history_of(rows: DataFrame, options: Options = Options(), multi: bool = False) -> History:
    """A history of typed rows. Unknown record types are skipped.

    A date window keeps commits inside it (both days included) and those without a readable date; the rows of
    other commits go too, each input by itself, whatever the inputs' names.
    """
    commits, files, parents = rows.where("type = 'commit'").select(*COMMIT), file_rows(rows.where("type = 'commit_file'"), multi), rows.where("type = 'commit_parent'").select("repo", "sha", "ord")
    if options.since or options.until:
        commits = commits.where(F.col("ts").isNull() | inside(options, F.col("ts")))
        kept = commits.select(F.col("ord.file").alias("input"), F.col("sha").alias("kept")).distinct()
        of = lambda df: df.join(kept, (df["ord.file"] == kept["input"]) & (df["sha"] == kept["kept"]), "left_semi")
        files, parents = of(files), of(parents)
    return history(commits, files, parents, options, multi)


def history(commits: DataFrame, files: DataFrame, parents: DataFrame, options: Options, multi: bool) -> History:
    parents = parents.drop("ord")
    if not multi:
        commits, files, parents = (df.withColumn("repo", F.lit("(repo)")) for df in (commits, files, parents))
    return History(commits, files, parents, options, multi)


def staged_rows(spark: SparkSession, paths: list[str], by_input: bool = False) -> DataFrame:
    """The typed records of the inputs, parsed once into Parquet in the shared folder, by type: bad lines too, in the same job.

    by_input: by the number of their input as well (column `input`), so that one input's records can be read alone.
    """
    rows, folder = typed(read_records(spark, paths)), new_folder(spark)
    if by_input:
        rows = rows.withColumn("input", F.col("ord.file"))
    with open_writers(spark):
        rows.write.partitionBy("type", *(["input"] if by_input else [])).parquet(folder, compression=PARQUET)
    return spark.read.schema(rows.schema).parquet(folder)


@contextmanager
def open_writers(spark: SparkSession) -> Iterator[None]:
    """A task keeps a file open for each of up to WRITERS partition values, and so does not sort its rows by these first."""
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, str(max(WRITERS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(OPEN_FILES, before)


def faults(rows: DataFrame) -> dict[int, str]:
    """By input, its first bad line and where that stands; of rows staged by input. One job for all, and two for each faulty input."""
    first = rows.where("type = 'bad'").groupBy("input").agg(F.min_by(F.struct("wrong", "repo", "ord"), "ord").alias("x")).collect()  # a row for each input
    return {r["input"]: _fault(rows.where(F.col("input") == r["input"]), r["x"]) for r in first}


def _fault(rows: DataFrame, bad: Row) -> str:
    return f"{bad['repo']}, {_place(rows, bad['ord'])}: {bad['wrong'][:200]}"


def load(spark: SparkSession, paths: list[str] | str, options: Options = Options(), strict: bool = True, staged: bool = False) -> History:
    """A history from one or more JSONL files, in the order given. strict: malformed lines are an error.

    staged: the lines are parsed once, into typed Parquet in the shared folder, where every later step reads its own
    type of record and its own columns; for runs of several statistics.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = staged_rows(spark, paths) if staged else typed(read_records(spark, paths), strict)
    if strict:
        check(rows)
        if not staged:
            rows = typed(read_records(spark, paths), strict=False)  # all lines are sound: each statistic parses its own fields
    return history_of(rows, options, len(paths) > 1)


def load_lines(spark: SparkSession, lines: list[str], options: Options = Options()) -> History:
    """A history from JSON lines in memory (tests, small inputs); blank lines are skipped, a malformed one is an error."""
    numbered = [(i, line) for i, line in enumerate(lines) if line.strip()]
    schema = T.StructType(RECORD.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = spark.createDataFrame(numbered, "n int, line string").select("n", F.from_json("line", schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    rows = typed(parsed.select("r.*", F.lit("(repo)").alias("repo"), F.struct(F.lit(0).alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("n").cast("bigint").alias("line")).alias("ord")))
    check(rows)
    return history_of(rows, options)


def developers(commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(dev_id, name, email): each author email, case and outer blanks aside, under its first name; without those of `known`."""
    key = F.lower(F.trim("email"))
    found = commits.where(key != "").groupBy(F.sha2(key, 256).alias("dev_id")).agg(F.min_by(F.struct("name", "email"), "ord").alias("x")).select("dev_id", "x.name", "x.email")
    return found if known is None else found.join(known.select("dev_id"), "dev_id", "left_anti")
