"""The tree of directories: sums from folders upwards, ranks in hot directories, rows that are shuffled."""

import random

from history_records import change, commit
from pyspark.sql import functions as F

from chronolith.operators import structure


def paths(n, seed=3):
    pick = random.Random(seed)
    return sorted({"/".join([*(pick.choice("abcde") * (i % 2 + 1) for i in range(pick.randint(0, 5))), f"f{pick.randint(0, 60)}"]) for _ in range(n)} | {"top.c", "a/b", "a", "é/ü.c", "a b/c d"})


def brute(files):
    """(path, is_dir) -> (churn, files, rank), by plain Python."""
    nodes = {}
    for path, churn in files.items():
        parts = path.split("/")
        nodes[path, False] = [churn, 1]
        for i in range(len(parts)):
            held = nodes.setdefault(("/".join(parts[:i]), True), [0, 0])
            held[0] += churn
            held[1] += 1
    out = {}
    siblings = {}
    for path, is_dir in nodes:
        siblings.setdefault(None if (path, is_dir) == ("", True) else path.rpartition("/")[0], []).append((path, is_dir))
    for group in siblings.values():
        group.sort(key=lambda k: (not k[1], -nodes[k][0], k[0].rpartition("/")[2].encode()))
        out |= {k: (*nodes[k], i + 1) for i, k in enumerate(group)}
    return out


def rows(df):
    return {(r.path, r.is_dir): (r.churn, r.files, r["rank"]) for r in df.collect()}


def test_tree_equals_plain_python_with_and_without_hot_directories(history):
    files = {p: len(p) * 7 % 5 for p in paths(220)}
    h = history(commit("1"), *(change("1", p, n) for p, n in files.items()))
    want = brute(files)
    for hot in (structure.HOT_CHILDREN, 6, 0):  # none, some, all directories are hot
        df = structure.structure(h, hot_children=hot)
        assert rows(df) == want and dict(df.dtypes)["rank"] == "int"
    cut = structure.structure(h, max_depth=2, max_children=3, hot_children=2)
    assert rows(cut) == rows(structure.structure(h, max_depth=2, max_children=3)) and cut.agg(F.max("depth")).first()[0] == 2


def test_an_empty_history_has_no_tree(history):
    h = history(commit("1"))
    assert structure.structure(h).count() == 0 and structure.structure(h, hot_children=0).count() == 0


def test_rows_before_the_shuffle_stay_near_the_number_of_nodes(spark):
    folders = spark.range(20_000).select(F.concat_ws("/", *(F.expr(f"'{c}' || (id div {d}) % 10") for c, d in (("a", 2000), ("b", 200), ("c", 20), ("d", 1)))).alias("path"), F.lit(1).alias("churn"), F.lit(1).alias("files"))
    above = structure._ancestors(folders.groupBy("path").agg(F.sum("churn").alias("churn"), F.sum("files").alias("files")))
    nodes = above.select("path").distinct().count()
    sent = above.groupBy("path", F.spark_partition_id().alias("task")).count()
    assert sent.count() <= nodes + 5 * above.rdd.getNumPartitions()
