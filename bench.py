"""Times all statistics over the test bed, from JSON lines to rows, and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and threads.

The value is the wall time of a run of all statistics, reading included; statistics run side by side, as the
command line runs them, so the time of a part overlaps those of others. BENCH_ALONE=1 runs them one by one.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from chronolith import testbed  # noqa: E402
from chronolith.operators import ownership, pairs, profiles, ranking, risk, structure  # noqa: E402
from chronolith.plans.together import AT_ONCE, together  # noqa: E402
from chronolith.sources import jsonl  # noqa: E402

#: What a run of all statistics asks for, each with its usual limit.
STATS = {
    "summary": ranking.summary, "contributors": ranking.contributors, "hotspots": ranking.hotspots, "directories": ranking.directories, "extensions": ranking.extensions, "activity": ranking.activity, "busfactor": ownership.bus_factor,
    "coupling": pairs.coupling, "churn_risk": risk.churn_risk, "working_patterns": ranking.working_patterns, "dev_network": pairs.dev_network, "pareto": ownership.pareto, "top_commits": ranking.top_commits,
    "profile": lambda h: profiles.profiles(h, n=10), "structure": lambda h: structure.structure(h, 3), "suspects": structure.suspects,
}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start
    taken = {}

    def timed(name, run):
        began = time.perf_counter()
        out = run()
        taken[name] = round(time.perf_counter() - began, 3)
        return out

    lines = f"{tempfile.mkdtemp(prefix='bench-')}/history.jsonl"
    testbed.write_lines(spark, testbed.history(spark, folder, "fine"), lines)  # the input; not timed
    began = time.perf_counter()
    h = timed("parse", lambda: jsonl.load(spark, lines, staged=True).cache())
    timed("load", lambda: together(spark, {name: df.count for name, df in (("commits", h.commits), ("parents", h.parents), ("touches", h.touches))}))
    parts = {name: lambda name=name, stat=stat: timed(name, lambda: stat(h).collect()) for name, stat in STATS.items()}
    together(spark, parts, 1 if os.environ.get("BENCH_ALONE") else AT_ONCE)
    value = time.perf_counter() - began
    records = h.commits.count() + h.parents.count() + h.touches.count()
    print(json.dumps({"metric": "all statistics over the test bed, from JSON lines", "value": round(value, 3), "unit": "sec", "queries": taken, "sf": folder.rsplit("/", 1)[-1].removeprefix("sf"), "records": records, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
