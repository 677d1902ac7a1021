"""Work that runs beside other work: a bounded number at once, each kind in its pool, and cancelled on request."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

POOL = "spark.scheduler.pool"
# Fixed value: exports that run at once.
EXPORTS_AT_ONCE = 2


def bounded(spark: SparkSession, works: Mapping[str, Callable[[], Any]], pool: str, at_most: int = EXPORTS_AT_ONCE) -> dict[str, Any]:
    """The results of some works by name, of which at most `at_most` run at once; the first error ends those that wait.

    Each runs on a driver thread of its own, with the caller's local properties, in the named pool: under the FAIR
    scheduler (spark.scheduler.mode) kinds of work share the executors evenly, under FIFO the pool means nothing.
    """
    if at_most < 1:
        raise ValueError("at least one at once")

    def run(work: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty(POOL, pool)
        return work()

    with ThreadPoolExecutor(at_most) as threads:
        begun = {name: threads.submit(inheritable_thread_target(spark)(run), work) for name, work in works.items()}
        try:
            return {name: future.result() for name, future in begun.items()}
        except BaseException:
            for future in begun.values():
                future.cancel()
            raise


class Outcome(NamedTuple):
    """COMPLETED with a result, FAILED with an error, or CANCELLED."""

    status: str
    result: Any = None
    error: BaseException | None = None


def cancellable(
    spark: SparkSession, work: Callable[[], Any], requested: Callable[[], bool], undo: Callable[[], None] = lambda: None, poll: float = 0.1
) -> Outcome:
    """Run work, whose Spark jobs are interrupted as soon as a cancellation is requested.

    `requested` is asked every `poll` seconds. Jobs that the work starts after the request are
    interrupted as well. `undo` removes what the work has left; it is called after work that is
    cancelled or fails, once nothing of it runs any more.
    """
    tag, done, held = f"work-{uuid.uuid4().hex}", threading.Event(), {}

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            held["result"] = work()
        except BaseException as e:
            held["error"] = e
        finally:
            spark.sparkContext.removeJobTag(tag)
            done.set()

    thread = threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True)
    thread.start()
    asked = False
    while not done.wait(poll):
        asked = asked or requested()
        if asked:
            spark.sparkContext.cancelJobsWithTag(tag)
    thread.join()
    if "error" not in held:
        return Outcome("COMPLETED", held["result"])
    undo()
    return Outcome("CANCELLED") if asked else Outcome("FAILED", error=held["error"])
