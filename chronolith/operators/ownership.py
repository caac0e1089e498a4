"""Who holds the knowledge: bus factor, Herfindahl, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.scalars import round_k
from chronolith.plans.checkpoints import checkpointed
from chronolith.plans.history import History
from chronolith.plans.ordered import running
from chronolith.schema import EXTREME_PCT, MODERATE_PCT, OWNERSHIP


def bus_factors(lines: DataFrame, key: str, names: bool = False) -> DataFrame:
    """(key, devs, bus_factor[, top_devs]): the fewest developers with 80 % of the lines. lines: key, email, lines above 0."""
    order = Window.partitionBy(key).orderBy(F.desc("lines"), "email")
    run = lines.withColumn("before", F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("lines"))
    run = run.withColumn("total", F.sum("lines").over(Window.partitionBy(key))).withColumn("rank", F.row_number().over(order))
    counted = F.col("before") < OWNERSHIP * F.col("total")
    aggregates = [F.count(F.lit(1)).alias("devs"), F.count_if(counted).alias("bus_factor")]
    if names:  # as many names as the factor, not as developers
        aggregates.append(F.transform(F.array_sort(F.collect_list(F.when(counted, F.struct("rank", "email")))), lambda x: x["email"]).alias("top_devs"))
    return run.groupBy(key).agg(*aggregates)


def bus_factor(h: History, n: int = 10) -> DataFrame:
    """Files by the number of developers who hold 80 % of their lines, fewest first."""
    rows = bus_factors(h.authored, "file", names=True).select(F.col("file").alias("path"), "bus_factor", "top_devs").orderBy("bus_factor", "path")
    return rows.limit(n) if n > 0 else rows


def herfindahl(values: Column) -> Column:
    """Sum of squared shares of an array; negatives count as 0, an empty array gives 0."""
    held = F.transform(values, lambda v: F.greatest(v, F.lit(0)).cast("double"))
    total = F.aggregate(held, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.aggregate(held, F.lit(0.0), lambda a, v: a + v * v) / (total * total)).otherwise(0.0)  # one division: the order of the values plays no part


def concentration_label(pct: Column, count: Column) -> Column:
    return F.when(count == 0, "no data").when(pct <= EXTREME_PCT, "extremely concentrated").when(pct <= MODERATE_PCT, "moderately concentrated").otherwise("well distributed")


def prefixes_for_most(lenses: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(lens, top, total, pct): how many rows, by `key` downwards and then by `name`, it takes to hold 80 % of `value`. lenses: rows, value, key, name.

    Rows are summed by key first, and running sums go over the distinct keys of all lenses, in ranges. In the one key
    in which the 80 % fall, rows of equal value are counted off; where values differ, running sums go over its names.
    """
    groups = None
    for lens, (rows, value, key, _) in lenses.items():
        held = rows.groupBy(F.lit(lens).alias("lens"), F.col(key).cast("bigint").alias("key")).agg(F.sum(value).alias("held"), F.count(F.lit(1)).alias("rows"))
        groups = held if groups is None else groups.unionByName(held)
    groups = checkpointed(groups)
    run = running(groups, "key", ["held", "rows"], ["lens"], descending=True)
    goal = OWNERSHIP * F.col("held_all")
    edges = run.where((F.col("held_before") < goal) & (F.col("held_before") + F.col("held") >= goal))  # one row for a lens, or none
    edges = checkpointed(edges.select("lens", F.col("key").alias("edge"), F.col("held_before").alias("before"), goal.alias("goal"), "rows", "rows_before"))
    counted = edges.where(F.col("lens").isin([lens for lens, (_, value, key, _) in lenses.items() if value == key]))
    tops = counted.select("lens", (F.col("rows_before") + F.least(F.col("rows"), F.ceil((F.col("goal") - F.col("before")) / F.col("edge")))).alias("top"))
    for lens, (rows, value, key, name) in lenses.items():
        if value != key:
            inside = rows.join(F.broadcast(edges.where(F.col("lens") == lens)), F.col(key) == F.col("edge")).select(name, value, "before", "goal", "rows_before")
            within = F.count_if(F.col("before") + F.col(f"{value}_before") < F.col("goal"))
            tops = tops.unionByName(running(inside, name, [value]).agg(F.max("rows_before").alias("offset"), within.alias("n")).select(F.lit(lens).alias("lens"), (F.coalesce("offset", F.lit(0)) + F.col("n")).alias("top")))
    names = lenses[next(iter(lenses))][0].sparkSession.createDataFrame([(i, lens) for i, lens in enumerate(lenses)], "at int, lens string")
    totals = groups.groupBy("lens").agg(F.sum("rows").alias("total"))
    found = names.join(totals, "lens", "left").join(tops, "lens", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("top", "total")})
    return found.orderBy("at").select("lens", "top", "total", F.when(F.col("total") > 0, round_k(F.col("top") / F.col("total") * 100, 1)).otherwise(0.0).alias("pct"))


def pareto(h: History) -> DataFrame:
    """One row a lens: how many files, developers or directories hold 80 % of the activity.

    Directories are taken in the order of their touches, as the ranking of directories is.
    """
    from chronolith.operators.ranking import contributors, directories

    files = h.file_facts.select(F.col("file").alias("path"), "churn")
    people = checkpointed(contributors(h, 0).select("email", "commits", (F.col("additions") + F.col("deletions")).alias("churn")))
    folders = checkpointed(directories(h, 0).select("dir", "file_touches", "churn"))
    found = prefixes_for_most({
        "files_churn": (files, "churn", "churn", "path"), "devs_commits": (people, "commits", "commits", "email"),
        "devs_churn": (people, "churn", "churn", "email"), "dirs_churn": (folders, "churn", "file_touches", "dir"),
    })
    key_person = (F.col("lens") == "devs_commits") & (F.col("top") > 0) & (F.col("pct") <= EXTREME_PCT)
    label = F.concat(concentration_label(F.col("pct"), F.col("top")), F.when(key_person, ", key-person dependence").otherwise(""))
    return found.select("lens", "top", "total", "pct", label.alias("label"))
