"""Parts that run side by side, and how they end."""

import threading
import time

import pytest

from chronolith.plans.together import together


def endless(spark):
    return lambda: spark.range(1 << 44).selectExpr("sum(hash(id))").collect()


def test_results_by_name(spark):
    assert together(spark, {str(k): lambda k=k: spark.range(k).count() for k in range(5)}, at_once=2) == {str(k): k for k in range(5)}


def test_a_part_that_fails_ends_the_others(spark):
    failed = []

    def failing():
        while not spark.sparkContext.statusTracker().getActiveJobsIds():
            time.sleep(0.05)
        failed.append(time.monotonic())
        raise KeyError("broken")

    with pytest.raises(KeyError, match="broken"):
        together(spark, {"long": endless(spark), "broken": failing, "late": lambda: 1}, at_once=2)
    assert time.monotonic() - failed[0] < 3 and not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_a_timeout_cancels_jobs_and_leaves_other_jobs_alone(spark):
    other = threading.Thread(target=lambda: found.append(spark.range(1 << 31).selectExpr("sum(hash(id))").collect()))
    found: list = []
    other.start()
    with pytest.raises(TimeoutError, match="long"):
        together(spark, {"long": endless(spark), "short": lambda: 1}, timeout=1)
    other.join(60)
    assert len(found) == 1
