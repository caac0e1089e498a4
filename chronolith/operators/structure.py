"""The tree of directories and files, and paths that look vendored or generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.scalars import basename, strip_repo
from chronolith.plans.checkpoints import checkpointed
from chronolith.plans.history import History
from chronolith.plans.ordered import running
from chronolith.schema import SUSPECT_FLOOR

#: Fixed values: (glob, reason, kind of match, text), in the order in which they are tried.
SUSPECTS = (
    ("vendor/*", "vendored third-party code", "segment", "vendor"),
    ("node_modules/*", "npm dependencies", "segment", "node_modules"),
    ("dist/*", "build artifacts", "segment", "dist"),
    ("build/*", "build output", "segment", "build"),
    ("third_party/*", "third-party code", "segment", "third_party"),
    ("*.min.js", "minified JS", "suffix", ".min.js"),
    ("*.min.css", "minified CSS", "suffix", ".min.css"),
    ("*.lock", "generic lock file", "suffix", ".lock"),
    ("package-lock.json", "npm lockfile", "name", "package-lock.json"),
    ("yarn.lock", "yarn lockfile", "name", "yarn.lock"),
    ("pnpm-lock.yaml", "pnpm lockfile", "name", "pnpm-lock.yaml"),
    ("go.sum", "go module hashes", "name", "go.sum"),
    ("Cargo.lock", "cargo lockfile", "name", "Cargo.lock"),
    ("poetry.lock", "poetry lockfile", "name", "poetry.lock"),
    ("*.pb.go", "protobuf generated (Go)", "suffix", ".pb.go"),
    ("*_pb2.py", "protobuf generated (Python)", "suffix", "_pb2.py"),
    ("*.generated.*", "generated code", "inside", ".generated."),
)


def _matches(path: Column, kind: str, text: str) -> Column:
    if kind == "segment":
        return F.startswith(path, F.lit(f"{text}/")) | F.contains(path, F.lit(f"/{text}/"))
    if kind == "suffix":
        return F.endswith(path, F.lit(text))
    return basename(path) == text if kind == "name" else F.contains(basename(path), F.lit(text))


def _suggestion(path: Column, glob: str, kind: str, text: str) -> Column:
    if kind != "segment":
        return F.lit(glob)
    at = F.instr(path, f"/{text}/")
    return F.when(F.startswith(path, F.lit(f"{text}/")) | (at == 0), glob).otherwise(F.concat(F.substring(path, F.lit(1), at - 1), F.lit(f"/{glob}")))


def _marked(h: History) -> DataFrame:
    """(path, churn, glob, reason, suggestion): every file, with the first pattern that it fits, if any."""
    files = h.file_facts.select(F.col("file").alias("path"), "churn", strip_repo(F.col("file")).alias("bare"))
    which, how, why = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for glob, reason, kind, text in reversed(SUSPECTS):
        found = _matches(F.col("bare"), kind, text)
        which, why = F.when(found, glob).otherwise(which), F.when(found, reason).otherwise(why)
        how = F.when(found, _suggestion(F.col("bare"), glob, kind, text)).otherwise(how)
    return files.select("path", "churn", which.alias("glob"), why.alias("reason"), how.alias("suggestion"))


def suspect_files(h: History) -> DataFrame:
    """(path, churn, glob, reason, suggestion): a row for each suspect file; for any number of them."""
    return _marked(h).where("glob IS NOT NULL")


def suspect_counts(h: History) -> DataFrame:
    """(glob, reason, churn, files, worth_warning): a row for each pattern, largest churn first, and whether all suspects hold 10 % of the churn."""
    by_pattern = _marked(h).groupBy("glob", "reason").agg(F.sum("churn").alias("churn"), F.count(F.lit(1)).alias("files"))  # one row for each pattern and one for the rest
    all_of, suspect = F.sum("churn").over(Window.partitionBy()), F.sum(F.when(F.col("glob").isNotNull(), F.col("churn"))).over(Window.partitionBy())
    rows = by_pattern.withColumns({"whole": all_of, "suspect": suspect}).where("glob IS NOT NULL AND whole > 0")
    return rows.select("glob", "reason", "churn", "files", (F.col("suspect") / F.col("whole") >= SUSPECT_FLOOR).alias("worth_warning")).orderBy(F.desc("churn"), "glob")


def suspects(h: History) -> DataFrame:
    """suspect_counts() without the count, with sorted paths and ignore globs in arrays: for reports. suspect_files() has them as rows."""
    lists = suspect_files(h).groupBy("glob").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.sort_array(F.collect_set("suggestion")).alias("suggestions"))
    return suspect_counts(h).join(lists, "glob").select("glob", "reason", "churn", "paths", "suggestions", "worth_warning").orderBy(F.desc("churn"), "glob")


def all_suggestions(h: History) -> DataFrame:
    """Ignore globs of all buckets, each once, in the buckets' order."""
    found = suspect_files(h).groupBy("glob", F.col("suggestion").alias("s")).agg(F.lit(1)).select("glob", "s")
    rows = found.join(suspect_counts(h).select("glob", "churn"), "glob").select("churn", "glob", "s", strip_repo(F.col("s")).alias("suggestion"))
    order = Window.partitionBy("suggestion").orderBy(F.desc("churn"), "glob", "s")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").orderBy(F.desc("churn"), "glob", "s").select("suggestion")


#: A directory with more children has them ranked in ranges, over several tasks.
HOT_CHILDREN = 65_536


def _parent(path: str) -> Column:
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1))


def _ancestors(folders: DataFrame) -> DataFrame:
    """(path, depth, churn, files, own): each folder's sums under itself and every folder above it.

    Folders are put in ranges of their paths first, so that those of one subtree stand together and a task adds up their
    common ancestors before the shuffle: that moves about a row for each folder, and one for each task and level.
    """
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    ranged = folders.repartitionByRange("path").withColumn("parts", parts)
    above = ranged.select("parts", "churn", "files", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    own = F.when(F.col("depth") == F.size("parts"), F.col("files")).otherwise(0)
    return above.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"), "depth", "churn", "files", own.alias("own"))


def _directories(files: DataFrame) -> DataFrame:
    """(path, depth, churn, files, own): every directory, the root '' included; `own` counts the files right in it."""
    folders = files.groupBy(_parent("path").alias("path")).agg(F.sum("churn").alias("churn"), F.count(F.lit(1)).alias("files"))
    return _ancestors(folders).groupBy("path", "depth").agg(*(F.sum(c).alias(c) for c in ("churn", "files", "own")))


def _ranked(nodes: DataFrame, dirs: DataFrame, hot_children: int) -> DataFrame:
    """`nodes` with their rank among siblings: directories first, then by churn and name. Children of hot directories are
    ranked in ranges of that order (see ordered.running()), all others by a window."""
    order = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.desc("churn"), "name")
    light = nodes.withColumn("rank", F.row_number().over(order))
    below = dirs.where("depth > 0").groupBy(_parent("path").alias("path")).agg(F.count(F.lit(1)).alias("folders"))
    hot = dirs.join(below, "path", "left").where(F.col("own") + F.coalesce("folders", F.lit(0)) > hot_children).select(F.col("path").alias("parent"))
    if hot.isEmpty():
        return light
    rest = nodes.join(hot, "parent", "left_anti").withColumn("rank", F.row_number().over(order))  # keeps the root, whose parent is null
    place = F.concat(F.when(F.col("is_dir"), "0").otherwise("1"), F.lpad((F.lit(1 << 62) - F.col("churn")).cast("string"), 19, "0"), "name")
    many = nodes.join(hot, "parent", "left_semi").withColumns({"place": place, "one": F.lit(1).cast("bigint")})
    ranked = running(many, "place", ["one"], ["parent"], broadcast=False).withColumn("rank", (F.col("one_before") + 1).cast("int"))
    return rest.unionByName(ranked.select(*rest.columns))


def structure(h: History, max_depth: int = 0, max_children: int = 0, hot_children: int = HOT_CHILDREN) -> DataFrame:
    """A row for every directory and file: path, parent, name, is_dir, depth, commits, churn, files, truncated, hidden_children, rank.

    Directories sum what lies below them and have 0 commits. With max_depth, deeper nodes are left out and their
    directory is marked truncated; with max_children, a directory keeps so many, directories and churn first.
    `rank` orders siblings. The root is the path ''. Directories are summed from the folders that hold files, not from
    the files, and written once (`checkpoint()`); `hot_children` changes how siblings are ranked, never a rank.
    """
    files = h.file_facts.select(F.col("file").alias("path"), "commits", "churn")
    whole = checkpointed(_directories(files))
    depth = F.size(F.split("path", "/"))
    leaves = files.select("path", F.lit(False).alias("is_dir"), depth.alias("depth"), "commits", "churn", F.lit(1).cast("bigint").alias("files"))
    dirs = whole.select("path", F.lit(True).alias("is_dir"), "depth", F.lit(0).cast("bigint").alias("commits"), "churn", "files")
    nodes = dirs.unionByName(leaves)
    if max_depth > 0:
        nodes = nodes.where(F.col("depth") <= max_depth)
    top = F.col("depth") == 0
    nodes = nodes.select("path", F.when(~top, _parent("path")).alias("parent"), F.when(top, ".").otherwise(basename(F.col("path"))).alias("name"), "is_dir", "depth", "commits", "churn", "files")
    cut = F.col("is_dir") & (F.col("depth") == max_depth) if max_depth > 0 else F.lit(False)
    nodes = _ranked(nodes.withColumn("truncated", cut), whole, hot_children)
    if max_children > 0:
        hidden = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.greatest(F.count(F.lit(1)) - max_children, F.lit(0)).alias("hidden_children"))
        gone = nodes.where((F.col("rank") > max_children) & F.col("is_dir") & F.col("parent").isNotNull()).select(F.col("path").alias("gone"))
        kept = nodes.where((F.col("rank") <= max_children) | F.col("parent").isNull())
        above = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
        lost = kept.where("depth > 1").select("path", "is_dir", F.explode(above).alias("gone")).join(gone, "gone", "left_semi").select("path", "is_dir").distinct()
        kept = kept.join(lost, ["path", "is_dir"], "left_anti")
        nodes = kept.join(hidden.withColumnRenamed("parent", "p"), F.col("is_dir") & (F.col("path") == F.col("p")), "left").drop("p").withColumn("hidden_children", F.coalesce("hidden_children", F.lit(0)))
    else:
        nodes = nodes.withColumn("hidden_children", F.lit(0).cast("bigint"))
    return nodes.select("path", "parent", "name", "is_dir", "depth", "commits", "churn", "files", "truncated", "hidden_children", "rank")
