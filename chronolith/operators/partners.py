"""Collaborators: for each developer the few with most shared lines, without pairing all developers of a file.

What two developers share is at most what the lesser of both has changed in all. A few developers of each crowded file,
taken at every size of contribution, are paired with all first; the k-th of these partial sums bounds a developer's
result from below, and only pairs whose bound reaches it are made. How many collaborators there are in all is counted from bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators import pairs
from chronolith.plans.checkpoints import checkpointed
from chronolith.plans.history import History


#: Classes of contributions for every doubling of lines.
STEPS = 32


def _first(rows: DataFrame, k: int) -> DataFrame:
    """(email, partner, shared_files, shared_lines) with the rank of each row, of the k first of each developer."""
    order = Window.partitionBy("email").orderBy(F.desc("shared_lines"), F.desc("shared_files"), "partner")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def crowded(authored: DataFrame) -> DataFrame:
    """(file) of the files with more than pairs.BLOCK developers."""
    return authored.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > pairs.BLOCK).select("file")


def _floors(mine: DataFrame, authored: DataFrame, k: int) -> DataFrame:
    """(email, least_lines, least_files, last): the k-th best of partial sums, which no result's k-th can fall below.

    Contributions to crowded files are put in classes, STEPS for every doubling. Seeds of a class are the k + 1 first
    names of it and all larger ones: at most STEPS * 63 * (k + 1) rows for each file. Each developer is paired with the
    seeds of its own class and of the next, who have changed as many lines or more.
    """
    size = F.floor(F.log2("lines") * STEPS).cast("int").alias("size")
    held = authored.join(crowded(authored), "file", "left_semi").select("file", "email", "lines", size)
    names = Window.partitionBy("file", "size").orderBy("email")
    first = held.withColumn("n", F.row_number().over(names)).where(F.col("n") <= k + 1).drop("n")
    larger = Window.partitionBy("file", "at").orderBy("email")
    seeds = first.join(first.select("file", F.col("size").alias("at")).distinct(), "file").where("size >= at").withColumn("n", F.row_number().over(larger)).where(F.col("n") <= k + 1)
    seeds = seeds.select("file", "at", F.col("email").alias("partner"), F.col("lines").alias("theirs"))
    following = first.groupBy("file", "size").agg(F.lit(1)).select("file", "size", F.coalesce(F.lead("size").over(Window.partitionBy("file").orderBy("size")), "size").alias("next"))  # a row for each class
    own = mine.select("file", "email", "lines", size).join(following, ["file", "size"]).select("file", "email", "lines", F.explode(F.array_distinct(F.array("size", "next"))).alias("at"))
    met = own.join(seeds, ["file", "at"]).where("partner <> email").select("file", "email", "lines", "partner", "theirs").distinct()
    sums = met.groupBy("email", "partner").agg(F.count(F.lit(1)).alias("shared_files"), F.sum(F.least("lines", "theirs")).alias("shared_lines"))
    return _first(sums, k).where(F.col("rank") == k).select("email", F.col("shared_lines").alias("least_lines"), F.col("shared_files").alias("least_files"), F.col("partner").alias("last"))


def candidates(mine: DataFrame, authored: DataFrame, k: int) -> DataFrame:
    """(file, a, la, b, lb): the pairs of one file, a of `mine`, whose bounds let b be among the k best of a. la and lb hold `lines`."""
    whole = authored.groupBy("email").agg(F.sum("lines").alias("total"), F.count(F.lit(1)).alias("many"))
    left = mine.join(whole, "email").join(_floors(mine, authored, k), "email", "left").select("file", "email", F.struct("lines", "total", "many", "least_lines", "least_files", "last").alias("lines"))
    right = authored.join(whole, "email").select("file", "email", F.struct("lines", "total", "many").alias("lines"))
    most, many = F.least("la.total", "lb.total"), F.least("la.many", "lb.many")
    reach = F.col("la.last").isNull() | (most > F.col("la.least_lines")) | ((most == F.col("la.least_lines")) & ((many > F.col("la.least_files")) | ((many == F.col("la.least_files")) & (F.col("b") <= F.col("la.last")))))
    return pairs.met(left, right).where(reach)


def _counts(mine: DataFrame, authored: DataFrame) -> DataFrame:
    """(email, partners): how many others have changed a developer's files. Developers are bits of bitmaps; a crowded file has its own."""
    numbers = checkpointed(authored.select("email").distinct().withColumn("number", F.monotonically_increasing_id()))
    number = F.col("number") + 1
    theirs = authored.join(numbers, "email").select("file", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    of, full = mine.select("file", "email"), crowded(authored)
    few = of.join(theirs.join(full, "file", "left_anti"), "file").groupBy("email", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    maps = theirs.join(full, "file", "left_semi").groupBy("file", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    many = of.join(maps, "file").groupBy("email", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = few.unionAll(many).groupBy("email", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return bits.groupBy("email").agg((F.sum(F.bitmap_count("bits")) - 1).alias("partners"))  # each has its own bit too


def collaborators(h: History, mine: DataFrame, k: int) -> DataFrame:
    """(email, collaborators, collaborators_hidden): of each developer of `mine` (rows of h.authored) the k with most shared
    lines (over common files the smaller of both sums), then files, then by name, and how many more there are.

    Where no file has more than pairs.BLOCK developers, all pairs are made and counted at once.
    """
    bounded = bool(crowded(h.authored).limit(1).count())
    if bounded:
        met = candidates(mine, h.authored.select("file", "email", "lines"), k).select("a", "b", F.col("la.lines").alias("la"), F.col("lb.lines").alias("lb"))
    else:
        others = h.authored.select("file", F.col("email").alias("b"), F.col("lines").alias("lb"))
        met = mine.select("file", F.col("email").alias("a"), F.col("lines").alias("la")).join(others, "file").where("a <> b")
    sums = met.groupBy(F.col("a").alias("email"), F.col("b").alias("partner")).agg(F.count(F.lit(1)).alias("shared_files"), F.sum(F.least("la", "lb")).alias("shared_lines"))
    if not bounded:
        sums = sums.withColumn("partners", F.count(F.lit(1)).over(Window.partitionBy("email")))
    item = F.array_sort(F.collect_list(F.struct("rank", "partner", "shared_files", "shared_lines")))
    lists = _first(sums, k).groupBy("email").agg(item.alias("x"), *([] if bounded else [F.first("partners").alias("partners")]))
    if bounded:
        lists = lists.join(_counts(mine, h.authored), "email")
    return lists.select("email", F.transform("x", lambda s: s.dropFields("rank")).alias("collaborators"), F.greatest(F.col("partners") - k, F.lit(0)).alias("collaborators_hidden"))
