"""Spark jobs of one piece of work: told apart by a tag, watched task by task, and stopped while they run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from plumbline.errors import Cancelled

#: Seconds between looks.
EVERY = 0.2


def tasks(spark: SparkSession, tag: str) -> tuple[int, int]:
    """(done, total): tasks that have ended, and all of them, in the stages of the tag's running jobs."""
    tracker, done, total = spark.sparkContext._jsc.sc().statusTracker(), 0, 0
    for job in list(tracker.getJobIdsForTag(tag)):
        info = tracker.getJobInfo(job)
        if info.isEmpty() or info.get().status().toString() != "RUNNING":
            continue
        for stage in list(info.get().stageIds()):
            seen = tracker.getStageInfo(stage)
            if seen.isDefined():
                done, total = done + seen.get().numCompletedTasks(), total + seen.get().numTasks()
    return done, total


@contextmanager
def watched(spark: SparkSession, cancelled: Callable[[], bool] | None = None, tell: Callable[[int, int], None] | None = None) -> Iterator[str]:
    """Tags the jobs that this thread starts within; gives the tag.

    ``cancelled`` is asked several times a second; once it says so, running jobs and those that follow are stopped, and
    what they were run for ends with ``Cancelled``. ``tell`` gets the tasks that are done, and all, of what runs.
    """
    tag, over, stopped = f"plumbline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        last = None
        while not over.wait(EVERY):
            if cancelled and cancelled():
                stopped.set()
                spark.sparkContext.cancelJobsWithTag(tag)
            elif tell and (now := tasks(spark, tag)) != last and now[1]:
                tell(*now)
                last = now

    spark.sparkContext.addJobTag(tag)
    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield tag
    except Exception as e:
        if stopped.is_set() and not isinstance(e, Cancelled):
            raise Cancelled("cancelled while it ran") from e
        raise
    finally:
        over.set()
        thread.join()
        spark.sparkContext.removeJobTag(tag)
