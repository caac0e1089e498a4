"""Pairs: files that change together, developers who share files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.scalars import round_k
from chronolith.plans import runs
from chronolith.plans.history import History
from chronolith.schema import MECHANICAL_FILES, MECHANICAL_LINES, Limits


def _pieces(h: History) -> DataFrame:
    """Runs inside chunks of the input, with the paths of each (runs.pieces()); kept, as pairs and counts read them."""
    if "runs" not in h.kept:
        paths = ["path"] if h.canonical is None else ["path", "file"]
        h.kept["runs"] = runs.pieces(h.changes.select("lines", "sha", *paths, "ord"), "sha", paths, "lines")
    return h.kept["runs"]


def _end_paths(h: History) -> DataFrame:
    """(input, run, path, file, lines) of the runs that a chunk ends in, which others can go on with: every path once for each run."""
    rows = runs.ends(_pieces(h), "sha").select("input", "run", F.explode("members").alias("m")).select("input", "run", "m.path", F.col("m.path" if h.canonical is None else "m.file").alias("file"), "m.lines")
    return rows.groupBy("input", "run", "path", "file").agg(F.sum("lines").alias("lines"))


def file_changes(h: History) -> DataFrame:
    """(file, changes): runs that touch a path, by its raw path, then summed under the canonical one.

    Rows of one commit that stand apart in the input are runs of their own.
    """
    whole = runs.complete(_pieces(h)).select(F.explode("members.path" if h.canonical is None else "members.file").alias("file"))
    return whole.unionAll(_end_paths(h).select("file")).groupBy("file").agg(F.count(F.lit(1)).alias("changes"))


def pair_counts(h: History) -> DataFrame:
    """(file_a, file_b, co_changes) over runs of 2 to coupling_max_files paths that are no mechanical rewrite.

    Pairs are made of raw paths inside a run, after the size filter, so a run gives
    max * (max - 1) / 2 of them at most; then they are put under canonical paths.
    """
    fits = (F.col("n") >= 2) & (F.col("n") <= h.options.coupling_max_files) & ~((F.col("n") >= MECHANICAL_FILES) & (F.col("total") / F.col("n") < MECHANICAL_LINES))
    named = F.transform("members", lambda m: F.struct(m["path"].alias("path"), (m["path"] if h.canonical is None else m["file"]).alias("file")))
    whole = runs.complete(_pieces(h)).where(fits).select(F.array_sort(named).alias("p"))
    rows = _end_paths(h)
    fit = rows.groupBy("input", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("total")).where(fits)
    joined = rows.join(fit.select("input", "run"), ["input", "run"]).groupBy("input", "run").agg(F.array_sort(F.collect_list(F.struct("path", "file"))).alias("p"))  # coupling_max_files at most
    first = whole.unionAll(joined.select("p")).select("p", F.posexplode("p").alias("at", "a"))
    pairs = first.select("a.file", F.explode(F.slice("p", F.col("at") + 2, F.size("p"))).alias("b")).where("file <> b.file")
    return pairs.groupBy(F.least("file", "b.file").alias("file_a"), F.greatest("file", "b.file").alias("file_b")).agg(F.count(F.lit(1)).alias("co_changes"))


def coupling(h: History, n: int = 10, limits: Limits = Limits()) -> DataFrame:
    """Pairs with enough common changes, as a share of the file with fewer changes."""
    pairs = pair_counts(h).where(F.col("co_changes") >= limits.coupling_min_changes)
    changes = file_changes(h)
    a = changes.select(F.col("file").alias("file_a"), F.col("changes").alias("changes_a"))
    b = changes.select(F.col("file").alias("file_b"), F.col("changes").alias("changes_b"))
    least = F.least("changes_a", "changes_b")
    rows = pairs.join(a, "file_a").join(b, "file_b").select("file_a", "file_b", "co_changes", F.when(least > 0, F.col("co_changes") / least * 100).otherwise(0.0).alias("coupling_pct"), "changes_a", "changes_b")
    ranked = rows.orderBy(F.desc("co_changes"), F.desc("coupling_pct"), "file_a", "file_b")
    return ranked.limit(n) if n > 0 else ranked


#: Developers of a file in one block: a task pairs two blocks at a time.
BLOCK = 512


def met(held: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(file, a, la, b, lb): developers of `held` (file, email, lines) beside others of the same file.

    Without `others` every two developers meet once, a < b; with `others` (of the same form) each of `held` meets all of
    these but itself. A file with more than BLOCK developers is cut into blocks, and each pair of blocks is a key of its
    own: a triangle of tiles, or a rectangle with `others`. No key has more than about BLOCK * BLOCK pairs, and a row is
    copied once for each block of its file.
    """
    whole = held if others is None else others
    blocks = whole.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")

    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.select("file", "email", "lines").join(blocks, "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return rows.withColumn("block", F.pmod(F.xxhash64("email"), F.col("blocks")).cast("int"))

    def side(rows: DataFrame, email: str, lines: str, own: str, other: str, tiles: Column) -> DataFrame:
        return rows.select("file", F.col("email").alias(email), F.col("lines").alias(lines), F.col("block").alias(own), F.explode(tiles).alias(other))

    last = F.col("blocks") - 1
    if others is not None:
        a, b = side(cut(held), "a", "la", "i", "j", F.sequence(F.lit(0), last)), side(cut(others), "b", "lb", "j", "i", F.sequence(F.lit(0), last))
        return a.join(b, ["file", "i", "j"]).where("a <> b").select("file", "a", "la", "b", "lb")
    rows = cut(held)
    a, b = side(rows, "a", "la", "i", "j", F.sequence(F.col("block"), last)), side(rows, "b", "lb", "j", "i", F.sequence(F.lit(0), F.col("block")))
    pairs = a.join(b, ["file", "i", "j"]).where("i < j OR a < b").select("file", F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("la")).otherwise(F.col("lb")).alias("la"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("lb")).otherwise(F.col("la")).alias("lb"))
    return pairs


def dev_network(h: History, n: int = 10, limits: Limits = Limits()) -> DataFrame:
    """Pairs of developers by lines they share: over common files, the smaller of both sums.

    Developers with fewer files than a pair must share are left out before the join, which loses no pair. Files with
    many developers are paired in tiles (met()), and pairs are summed before they are shuffled.
    """
    held = h.authored.select("file", "email", "lines")
    files = held.groupBy("email").agg(F.count(F.lit(1)).alias("n"))
    if limits.network_min_files > 1:
        held = held.join(files.where(F.col("n") >= limits.network_min_files).select("email"), "email", "left_semi")
    pairs = met(held).groupBy(F.col("a").alias("dev_a"), F.col("b").alias("dev_b")).agg(F.count(F.lit(1)).alias("shared_files"), F.sum(F.least("la", "lb")).alias("shared_lines"))
    rows = pairs.where(F.col("shared_files") >= limits.network_min_files)
    rows = rows.join(files.select(F.col("email").alias("dev_a"), F.col("n").alias("na")), "dev_a").join(files.select(F.col("email").alias("dev_b"), F.col("n").alias("nb")), "dev_b")
    rows = rows.select("dev_a", "dev_b", "shared_files", "shared_lines", round_k(F.col("shared_files") / F.greatest("na", "nb") * 100, 1).alias("weight"))
    ranked = rows.orderBy(F.desc("shared_lines"), F.desc("shared_files"), "dev_a", "dev_b")
    return ranked.limit(n) if n > 0 else ranked
