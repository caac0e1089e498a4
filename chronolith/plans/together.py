"""Several statistics of one history at the same time."""

from __future__ import annotations

import contextvars
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, Future, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import SparkContext, inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
#: Statistics whose jobs are in flight at once: enough to fill stages of few tasks.
AT_ONCE = 8
#: Seconds between two rounds of cancelling: a part may start another job before it learns that its last one has gone.
ROUND = 0.2


def together(spark: SparkSession, parts: dict[str, Callable[[], T]], at_once: int = AT_ONCE, timeout: float | None = None) -> dict[str, T]:
    """What each part returns. Parts run in threads of the driver, so that Spark's scheduler can fill idle executors
    with another part's stages.

    A part that fails stops the call with its error, an interrupt or `timeout` seconds with theirs (TimeoutError): jobs
    of all other parts, which carry a tag of this call, are cancelled, and parts that still wait are dropped.
    """
    context, tag = spark.sparkContext, f"together-{uuid.uuid4().hex}"

    def tagged(part: Callable[[], T]) -> Callable[[], T]:
        def run() -> T:
            context.addJobTag(tag)
            try:
                return part()
            finally:
                context.removeJobTag(tag)

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(contextvars.copy_context().run, tagged(part)) for name, part in parts.items()}  # folders of a part go with the caller's released() block
        try:
            done, left = wait(running.values(), timeout, FIRST_EXCEPTION)
            for future in done:
                future.result()
            if left:
                raise TimeoutError(f"after {timeout} seconds unfinished: {', '.join(n for n, f in running.items() if f in left)}")
        finally:
            _end(context, tag, list(running.values()))
        return {name: future.result() for name, future in running.items()}


def _end(context: SparkContext, tag: str, futures: list[Future]) -> None:
    for future in futures:
        future.cancel()
    while wait(futures, 0).not_done:
        context.cancelJobsWithTag(tag)
        wait(futures, ROUND)
